"""SimHash near-duplicates through a hierarchical index over fingerprints in Gray order.

Fingerprints that differ in at most d bits agree in some b - d of b blocks of bits, so the fingerprints
are dealt out by (choice of blocks, their bits); more fingerprints take more blocks. In each task the fingerprints of a value are sorted by their rank in
the reflected Gray code; runs of neighbours share many bits. An inner node keeps the bits on which
all fingerprints below it agree and that no node above it has fixed yet. A search adds up the
differences on those bits from the root down and leaves a whole group as soon as they exceed d.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.llm.components import connected_components
from clickspark.llm.rowkeys import take_rows
from clickspark.llm.storage import broadcast_if_small, materialise

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FANOUT = 8
_FRONTIER = 4 << 20
_LARGE = 20_000  # members of a component whose rows are not moved to one place


# -- fingerprints ----------------------------------------------------------------------------------

def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64 bits: bit i is set if more than half of the shingle hashes have it; 0 for no words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at [\x20\x09-\x0D]
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = (ends - [len(w) + 1 for w in found]).tolist()
    stops = (ends - 1).tolist()[min(words, len(found)) - 1:]
    counts, n = np.zeros(64, dtype=np.int64), len(stops)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:], stops[at:at + (1 << 16)])], dtype="<u8")  # noqa: B905
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash`` (of the exact text) and ``fp`` (the fingerprint as a signed long) per row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.pop("text")], dtype=np.uint64)
            yield batch.assign(fp=fps.view(np.int64))

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id string, text_hash long, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


# -- the index -------------------------------------------------------------------------------------

def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected binary Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over groups of fingerprints; level 0 is the fingerprints themselves."""

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        order = np.lexsort((gray_rank(fps), group))
        self.fps, group = fps[order], group[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        slot = np.arange(len(group)) - np.repeat(starts, sizes)
        self.root = np.repeat(np.arange(len(starts)), sizes)
        shared, pattern, last = np.full(len(fps), ~np.uint64(0)), self.fps, np.arange(len(fps))
        levels = [(shared, pattern, last, None)]
        any_bits = self.fps
        while len(levels) == 1 or len(pattern) > len(starts):
            first = np.flatnonzero(slot % _FANOUT == 0)
            count = np.diff(np.r_[first, len(slot)])
            pattern = np.bitwise_and.reduceat(pattern, first)
            any_bits = np.bitwise_or.reduceat(any_bits, first)
            last = last[first + count - 1]
            slot = slot[first] // _FANOUT
            levels.append((~(pattern ^ any_bits), pattern, last, (first, count)))
        # residual: the bits a node fixes that its parent doesn't
        self.levels = []
        for k, (shared, pattern, last, children) in enumerate(levels):
            residual = shared
            if k + 1 < len(levels):
                above, (_, count) = levels[k + 1][0], levels[k + 1][3]
                residual = shared & ~np.repeat(above, count)
            self.levels.append((residual, pattern, last, children))

    def labels_by_node(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per level: the label that all fingerprints below a node carry, or -1."""
        low = high = labels
        found = [labels]
        for *_, (first, _) in self.levels[1:]:
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            found.append(np.where(low == high, low, -1))
        return found

    def search(self, rows: np.ndarray, distance: int, labels: np.ndarray, by_node: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, later row) of the same group within ``distance``, leaving out groups of nodes that
        already carry the row's own label."""
        q, node = rows, self.root[rows]
        residual, pattern, _, _ = self.levels[-1]
        difference = np.bitwise_count((self.fps[q] ^ pattern[node]) & residual[node])
        for k in range(len(self.levels) - 1, 0, -1):
            first, count = self.levels[k][3]
            width = count[node]
            child = np.repeat(first[node] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
            q, difference = np.repeat(q, width), np.repeat(difference, width)
            residual, pattern, last, _ = self.levels[k - 1]
            difference = difference + np.bitwise_count((self.fps[q] ^ pattern[child]) & residual[child])
            keep = (difference <= distance) & (last[child] > q) & (by_node[k - 1][child] != labels[q])
            q, node, difference = q[keep], child[keep], difference[keep]
        return q, node


def _unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after uniting a[i] and b[i]; each label is the smallest member of its set."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels != labels[labels]).any():
            labels = labels[labels]


def local_links(group: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly the fingerprints which chains of near fingerprints within a group join.

    At most one link per fingerprint comes out, however dense a group is: all members of a set are
    linked to one of them.
    """
    sizes = np.unique(group, return_inverse=True, return_counts=True)
    several = sizes[2][sizes[1]] > 1
    group, fps = sizes[1][several], fps[several]
    if not len(fps):
        return fps, fps
    index = GrayIndex(group, fps)
    values, ids = np.unique(index.fps, return_inverse=True)
    labels = np.arange(len(values))
    by_node = index.labels_by_node(labels[ids])
    step = max(64, min(4096, _FRONTIER // int(sizes[2].max())))
    for at in range(0, len(ids), step):
        rows = np.arange(at, min(at + step, len(ids)))
        a, b = index.search(rows, distance, labels[ids], by_node)
        if len(a):
            labels = _unite(labels, ids[a], ids[b])
            by_node = index.labels_by_node(labels[ids])
    moved = labels != np.arange(len(values))
    return values[moved], values[labels[moved]]


# -- the operator ----------------------------------------------------------------------------------

def block_count(n: int, distance: int, most: int) -> int:
    """The number of blocks that deals ``n`` evenly spread fingerprints out in the fewest copies.

    One copy goes out per choice of ``blocks - distance`` blocks, times the parts of a cell that holds
    more than ``most``. Any number finds the same links.
    """
    def copies(blocks: int) -> int:
        kept = blocks - distance
        return math.comb(blocks, kept) * max(1, math.ceil(n / 2 ** (64 * kept // blocks) / most))

    return min(range(distance + 1, min(2 * distance + 2, 64) + 1), key=copies)


def block_masks(blocks: int, distance: int) -> list[int]:
    """The bits of every choice of ``blocks - distance`` blocks, as signed longs."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in map(sum, combinations(parts, blocks - distance))]


def link_fingerprints(fps: DataFrame, distance: int = 4, most: int = 16384, blocks: int | None = None) -> DataFrame:
    """Links (u, v) between the distinct values of column ``fp`` whose connected components are those
    of all pairs within ``distance`` bits.

    ``blocks`` follows from the number of fingerprints if not given (:func:`block_count`). A cell
    (block choice, value) with more than ``most`` fingerprints is cut into parts by hash, and every
    pair of parts becomes a group of its own, so no pair is lost and no task holds more than two parts.
    """
    blocks = blocks or block_count(fps.count(), distance, most)
    keys = F.array(*[F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("value"))
                     for k, mask in enumerate(block_masks(blocks, distance))])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.block", "k.value")
    crowded = materialise(dealt.groupBy("block", "value").count().filter(F.col("count") > most).select(
        "block", "value", F.ceil(F.col("count") / most).cast("int").alias("parts")), "crowded")
    dealt = dealt.join(broadcast_if_small(crowded, 96), ["block", "value"], "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    dealt = dealt.select("fp", "block", "value", own.alias("own"), other.alias("other")).select(
        "fp", "block", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            _, group = np.unique(rows["cell"].to_numpy(), return_inverse=True)
            u, v = local_links(group, rows["fp"].to_numpy().view(np.uint64), distance)
            for at in range(0, len(u), 100_000):
                yield pd.DataFrame({"u": u[at:at + 100_000].view(np.int64), "v": v[at:at + 100_000].view(np.int64)})

    cell = F.xxhash64("block", "value", "low", "high")  # two cells of one hash only share an index
    return dealt.repartition("block", "value", "low", "high").select("fp", cell.alias("cell")).mapInPandas(link, "u long, v long").distinct()


def simhash_components(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp``, ``component_id`` and ``root`` for every row of ``docs``.

    Whole texts are used: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``words`` words
    joined by a space (the whole sequence if there are fewer), XXH64 with seed 42. Fingerprints link
    at ``distance`` or fewer differing bits; ``component_id`` is the smallest doc_id reachable,
    ``root`` the component's smallest fingerprint. A null or wordless text has fingerprint 0 and is
    linked like any other. Rows without a doc_id take part and get the component's id, null if no
    row of the component has one. Repeated rows each come back; an empty table gives no rows. Only
    the two named columns are read.
    """
    keys = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    fps = materialise(keys.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fps")
    found = connected_components(link_fingerprints(fps, distance))
    rooted = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    firsts = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "components")
    # rows of a large component stay where they are: it is found by broadcast, and they join on their own fingerprint
    large = broadcast_if_small(firsts.filter(F.col("members") > _LARGE).select("root", F.col("component_id").alias("large_id"), F.lit(True).alias("large")), 96)
    spread = rooted.join(large, "root", "left").withColumn("at", F.when(F.col("large"), F.col("fp")).otherwise(F.col("root")))
    placed = spread.join(firsts.select(F.col("root").alias("at"), "component_id"), "at", "left")
    by_fp = materialise(placed.select("fp", "root", F.when(F.col("large"), F.col("large_id")).otherwise(F.col("component_id")).alias("component_id")), "fp-components")
    return keys.join(by_fp, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def drop_near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per component: that of the smallest id, of the smallest text hash among
    equal ids, of the smallest columns among repeated rows. Rows without an id come last. All
    columns are kept.
    """
    rows = materialise(simhash_components(docs, words, distance, id_col, text_col), "components")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("best"))
    same = rows.groupBy(F.struct("doc_id", "text_hash").alias("key")).agg(F.count("*").alias("rows"))
    best = best.select(F.struct("best.doc_id", "best.text_hash").alias("key")).join(same, "key")
    return take_rows(docs, best.select("key.doc_id", "key.text_hash", F.lit(1).alias("copies"), "rows"), id_col, text_col)
