"""Token counts by byte-pair merging: a heap of adjacent pairs over a linked list of symbols.

A tokenizer file gives normal form, split into words and ranked merges. A word starts as one symbol per
byte; the pair of lowest rank (leftmost first) is popped and merged until no ranked pair is left. Every
merge takes one symbol away, so a word's count is its bytes minus its merges, and no token id is looked up.
"""

from __future__ import annotations

import heapq
import json
import sys
import types
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.llm.storage import text_batches

# fixed value: the split of byte-level tokenizers that use their own pattern
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

WORDS_KEPT = 300_000  # counts in each of the two memories of a worker process
_LONGEST_KEPT = 64  # characters; longer words are counted anew each time



class Merges:
    """Ranked merges over whole-number symbols: ``rank`` by pair (left << 32 | right), ``made`` by rank."""

    def __init__(self, pairs: list[tuple[str, str]], symbols: dict[str, int]):
        self.rank = {symbols[a] << 32 | symbols[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [symbols[a + b] for a, b in pairs]


def merged_count(symbols: list[int], merges: Merges) -> int:
    """Symbols left when ``symbols`` are merged pair by pair, lowest rank first, leftmost among equals.

    ``after`` and ``before`` link the symbols still there; the heap holds rank << 32 | place. A popped entry
    counts only if its place still starts the pair that it was pushed for: a pair is told by its rank.
    """
    n = len(symbols)
    rank_of, made = merges.rank.get, merges.made
    heap = [r << 32 | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(a << 32 | b)) is not None]
    if not heap:
        return n
    parts, left = [*symbols, -1], n  # the end of the list pairs with nothing
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        rank, i = entry >> 32, entry & 0xFFFFFFFF
        j = after[i]
        if (a := parts[i]) < 0 or (b := parts[j]) < 0 or rank_of(a << 32 | b) != rank:
            continue
        parts[i] = a = made[rank]
        parts[j] = -1
        left -= 1
        after[i] = k = after[j]
        before[k] = i
        if (b := parts[k]) >= 0 and (r := rank_of(a << 32 | b)) is not None:
            push(heap, r << 32 | i)
        if (h := before[i]) >= 0 and (r := rank_of(parts[h] << 32 | a)) is not None:
            push(heap, r << 32 | h)
    return left


def byte_letters() -> list[str]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 characters stand for
    themselves, the other bytes in turn for the characters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Counts(dict):
    """Tokens by word; a word that is missing is merged once.

    A full memory becomes the older one and the one before it is forgotten; words met again move
    back, so frequent words stay while memory is bounded.
    """

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count, self.older = count, {}

    def __missing__(self, word: str) -> int:
        if (n := self.older.get(word)) is None:
            n = self.count(word)
        if len(word) <= _LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n


class TokenCounter:
    """Counts of whole texts as a byte-level BPE file of the tokenizers library gives them, without
    added begin, end or special tokens, truncation or padding. Special tokens that stand in a text count
    as one, as is the library's default.

    Raises ValueError for what the merging here does not cover (other models, dropout, symbols outside the
    vocabulary, special tokens that strip or match normalised text) instead of counting wrongly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
        steps = splitter.get("pretokenizers", [splitter])
        letters = byte_letters()
        self.suffix = model.get("end_of_word_suffix") or ""
        if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: not a plain BPE model")
        if steps[-1].get("type") != "ByteLevel" or any(s.get("add_prefix_space") for s in steps):
            raise ValueError(f"{path}: not split into bytes")
        if any(x not in model["vocab"] for b in letters for x in {b, b + self.suffix}):
            raise ValueError(f"{path}: bytes are missing in the vocabulary")
        added = spec.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path}: added tokens with rules of their own")
        self.symbols = model["vocab"]
        self.merges = Merges([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], self.symbols)
        self.whole = self.symbols if model.get("ignore_merges") else {}
        byte_symbols = [self.symbols[b] for b in letters]
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else None
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.own_split = regex.compile(BYTE_LEVEL_SPLIT) if splitter.get("type") == "ByteLevel" and splitter.get("use_regex") else None
        self.alike: set[str] = set()
        self.unlike: set[str] = set()
        if self.suffix or self.whole:
            self.own_split = None
        self.raw = _Counts(lambda word: merged_count([byte_symbols[b] for b in word.encode()], self.merges))
        self.spelt = _Counts(self._merged)

    def _merged(self, spelt: str) -> int:
        if spelt in self.whole:
            return 1
        return merged_count([self.symbols[x] for x in (*spelt[:-1], spelt[-1] + self.suffix)], self.merges)

    def _own_split_holds(self, text: str) -> bool:
        """Whether our pattern splits every character of ``text`` where the library does. The two know
        different editions of Unicode, so a character is compared when it is first seen."""
        chars = set(text)
        for c in chars - self.alike - self.unlike:
            probe = f"a{c}1{c}!{c}{c} {c}a  {c}"
            same = [m.span() for m in self.own_split.finditer(probe)] == [at for _, at in self.split(probe)]
            (self.alike if same else self.unlike).add(c)
        return chars.isdisjoint(self.unlike)

    def _plain(self, text: str) -> int:
        if self.normalise:
            text = self.normalise(text)
        if self.own_split and self._own_split_holds(text):
            return sum(map(self.raw.__getitem__, self.own_split.findall(text)))
        return sum([self.spelt[word] for word, _ in self.split(text)])

    def count(self, text: str) -> int:
        if self.special is None:
            return self._plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum([self._plain(p) for p in pieces if p])


def _counter(path: str) -> TokenCounter:
    """The counter of ``path``, kept for all tasks of a worker process. Functions arrive by value, new ones
    with every task, so it hangs on a module of its own."""
    kept = sys.modules.setdefault("_token_counters", types.ModuleType("_token_counters")).__dict__
    if path not in kept:
        kept[path] = TokenCounter(path)
    return kept[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` for every row of ``docs``.

    ``tokenizer`` is a path that every executor can open. A null text is an empty one: no bytes, no
    tokens. Texts are counted whole, however long; a word's merges take n log n time and a few lists of its
    length. Repeated rows and null ids are rows like others, an empty table gives no rows, other columns are
    not read. ``over_limit`` is null without a ``limit``. Nothing is shuffled and no row waits for another.
    """
    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(tokenizer)
        for batch in batches:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))
    over = F.lit(None).cast("boolean") if limit is None else F.col("n_tokens") > F.lit(limit)
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", over.alias("over_limit"))
