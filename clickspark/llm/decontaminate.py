"""Benchmark passages in training texts by spaced-seed hashing.

A seed hashes the words of a window at the positions that a fixed mask marks and ignores the rest, so
a substituted word under a gap does not break it. Seeds that benchmark and training texts share give
candidate alignments; each is verified word by word around the hit.
"""

from __future__ import annotations

import functools
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickspark.llm.rowkeys import leave_rows
from clickspark.llm.storage import broadcast_if_small, materialise

#: Of the words that may be missing, two break every run of five in 12 or 13 words only if they stand so that
#: one of the gapped windows is whole; tests enumerate all placements.
MASKS = ("11111", "110111")
#: Items below so many words must be found whole, word for word.
EXACT_BELOW = 7
WORD = r"[\p{L}\p{N}]+"


def words(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(WORD), F.lit(0))


def _seeds(hashes: str, pairs: str, mask: str) -> Column:
    """Seed of every window of the mask's length, in order; none if the text is shorter. Neighbouring
    marked words go in as one hash of both."""
    parts, i = [], 0
    while i < len(mask):
        two = mask[i:i + 2] == "11"
        if mask[i] == "1":
            parts.append((pairs if two else hashes, i))
        i += 2 if two else 1
    last = F.size(hashes) - len(mask)
    seed = lambda at: F.xxhash64(F.lit(int(mask, 2)), *[F.col(c)[at + i] for c, i in parts])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), seed)).otherwise(F.array().cast("array<bigint>"))


def leaves_seed(n: int, missing: int, masks: tuple[str, ...]) -> bool:
    """Whether a mask survives every placement of ``missing`` substitutions in ``n`` words."""
    windows = [{at + i for i, c in enumerate(m) if c == "1"} for m in masks for at in range(n - len(m) + 1)]
    return all(any(w.isdisjoint(gone) for w in windows) for gone in combinations(range(n), missing))


def part_masks(n: int, missing: int) -> tuple[str, ...]:
    """``n`` words in ``missing`` + 3 parts: whatever words are missing, three parts are whole. One mask for
    every choice of three; masks that differ in their place only are one, since windows slide."""
    count = min(n, missing + 3)
    cuts = [n * i // count for i in range(count + 1)]
    masks = {"".join("01"[i not in gone] * (cuts[i + 1] - cuts[i]) for i in range(count)).strip("0") for gone in combinations(range(count), missing)}
    return tuple(sorted(masks))


@functools.cache
def masks_for(n: int, least: tuple[int, int] = (4, 5)) -> tuple[str, ...]:
    """Masks of which one survives every placement of the substitutions that ``least`` allows in ``n`` words."""
    missing = n - -(-n * least[0] // least[1])
    # so many words stand together however the substitutions are placed
    run = -(-(n - missing) // (missing + 1))
    if run >= 5 or not missing:
        return ("1" * min(run, 6),)
    if n <= 20 and leaves_seed(n, missing, MASKS):
        return MASKS
    # of so many equal pieces one misses two words at most
    pieces = missing // 3 + 1
    return part_masks(n // pieces, missing // pieces)


def seeds(hashed: DataFrame, hashes: str, masks: tuple[str, ...]) -> DataFrame:
    """One row per window and mask: ``seed`` and ``at``, the window's first word. Other columns stay."""
    kept = [c for c in hashed.columns if c != hashes]
    paired = hashed.withColumn("_pairs", F.transform(hashes, lambda w, i: F.xxhash64(w, F.get(hashes, i + 1))))
    every = F.concat(*[_seeds(hashes, "_pairs", m) for m in masks])
    rows = paired.select(*kept, F.size(hashes).alias("_n"), F.posexplode(every).alias("_i", "seed"))
    # the windows of the masks follow each other in the exploded array
    at, before = F.col("_i"), F.lit(0)
    for mask in masks[:-1]:
        before = before + F.greatest(F.col("_n") - len(mask) + 1, F.lit(0))
        at = F.when(F.col("_i") >= before, F.col("_i") - before).otherwise(at)
    return rows.select(*kept, "seed", at.alias("at"))


def word_hashes(text: str) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] | None = None, window: int = 13,
                  least: tuple[int, int] = (4, 5), exact_below: int = EXACT_BELOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, matched_words, item_words) for every document that holds a passage
    of a benchmark item.

    A passage is an alignment in which ``window`` neighbouring words of the item (the whole item, if it
    is shorter) agree with the document's words in at least ``least`` (4/5) of the places;
    ``matched_words`` counts all places of the best alignment. Substitutions are tolerated, words
    left out or put in start a new alignment. Every passage leaves a seed, wherever its substitutions
    stand (:func:`masks_for`), unless other ``masks`` are given. Items of fewer than ``exact_below`` words are
    little evidence: they match where they stand whole, word for word. Null and empty texts hold no
    words, and items without words match nothing. Repeated documents give one row; of several
    items with one id the best counts; rows without an item id are left
    out, documents without an id keep their null. Empty tables give no rows. Only the named columns
    are read.
    """
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash")).alias("key")
    texts = docs.select(key, F.col(text_col).alias("text"))
    items = benchmark.filter(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item_id"), F.xxhash64(item_text).alias("item_hash"), word_hashes(item_text).alias("item"))
    items = materialise(items.filter(F.size("item") > 0).dropDuplicates(["item_id", "item_hash"]), "benchmark")
    # items by the masks that their length needs; there are at most max(window, exact_below) lengths
    span = lambda size: F.when(size < exact_below, size).otherwise(F.least(F.lit(window), size))
    wide = span(F.size("item"))
    lengths: dict[tuple[str, ...], list[int]] = {}
    for n in sorted(r[0] for r in items.select(wide.alias("wide")).distinct().collect()):
        lengths.setdefault(masks or masks_for(n, (1, 1) if n < exact_below else least), []).append(n)
    lengths = lengths or {MASKS: []}
    probes = [seeds(items.filter(wide.isin(ns)), "item", ms) for ms, ns in lengths.items()]
    probes = materialise(functools.reduce(DataFrame.unionByName, probes).withColumnRenamed("at", "item_at"), "benchmark-seeds")
    masks = tuple(sorted({m for ms in lengths for m in ms}))
    hits = seeds(texts.select("key", word_hashes("text").alias("h")), "h", masks).join(broadcast_if_small(probes, 96), "seed")
    hits = materialise(hits.select("key", "item_id", "item_hash", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")

    # word hashes are made again, for the texts that were hit only
    hit_keys = materialise(hits.select("key").distinct(), "hit-texts")
    hit_texts = texts.join(broadcast_if_small(hit_keys, 128), "key", "left_semi").select("key", word_hashes("text").alias("h"))
    aligned = hit_texts.join(broadcast_if_small(hits, 192), "key").join(items, ["item_id", "item_hash"])
    first, end = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item"), F.size("h") - F.col("shift"))
    agree = F.transform(F.sequence(first, end - 1), lambda j: (F.col("h")[j + F.col("shift")] == F.col("item")[j]).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    checked = aligned.select("key", "item_id", F.size("item").alias("item_words"), agree.alias("agree"))
    checked = checked.withColumn("wide", span(F.col("item_words"))).filter(F.size("agree") >= F.col("wide"))
    needed = F.when(F.col("item_words") < exact_below, F.col("wide") * least[1]).otherwise(F.col("wide") * least[0])
    passage = F.exists(F.sequence(F.lit(1), F.size("agree") - F.col("wide") + 1),
                       lambda i: total(F.slice("agree", i, F.col("wide"))) * least[1] >= needed)
    found = checked.filter(passage).select("key", "item_id", total(F.col("agree")).alias("matched_words"), "item_words")
    return found.groupBy("key", "item_id").agg(F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words")).select(
        "key.doc_id", "key.text_hash", "item_id", "matched_words", "item_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows in which :func:`find_overlaps` finds a passage; all columns stay."""
    return leave_rows(docs, find_overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **options), id_col, text_col)
