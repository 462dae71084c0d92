"""Token ids in seekable Zstandard files: one independent frame per document, a seek table at the end.

File layout (all integers little-endian):

* one Zstandard frame per document, its content the ids as unsigned 32-bit integers;
* a skippable frame with the file's place in the corpus and the document ids (Zstandard inside);
* the seek table of the public seekable format: a skippable frame with compressed size,
  decompressed size and checksum (low 32 bits of the content's XXH64) of every frame before it.

A reader decodes the tail of a file and then only the frames of the documents it wants.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickspark.llm.storage import materialise, new_path, read_blobs, write_blobs

# fixed values of the seekable format
SEEKABLE_MAGIC = b"\xb1\xea\x92\x8f"
SEEK_TABLE_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A51
CHECKSUM_FLAG = 0x80

BLOB_BYTES = 24 << 20
_WORDS_KEPT = 300_000

# fixed values: the rules of a tokenizer file whose words _SPLIT finds
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
# A text of these characters only is already in normal form C, and lower-casing and the classes of
# the tokenizer's split mean the same here as in the tokenizer.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ž]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d"
                    "|[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ž]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
                    "|[^\\sA-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ž0-9\xb2\xb3\xb9\xbc-\xbe]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters
    for themselves, the other bytes in turn for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Words(dict):
    """Packed ids by word; a missing word is split by the merges once."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        spelt = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(spelt)]
        self[word] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


def splits_alike(tokenizer) -> bool:
    """Whether the tokenizer's own rules are those that ``_SPLIT`` stands for."""
    own = json.loads(tokenizer.to_str())
    added = own["added_tokens"]
    return all(own[k] == rule for k, rule in _RULES.items()) and own["model"]["type"] == "BPE" and not own["model"].get("dropout") and all(
        t["special"] and not (t["normalized"] or t["single_word"]) for t in added)


def _loaded(path: str):
    """(tokenizer, its words or None if it has other rules, its added tokens), kept for all tasks of a worker process.

    Functions of this module arrive in a worker by value, new ones with every task, so what is kept
    hangs on a module of its own."""
    kept = sys.modules.setdefault("_token_words", types.ModuleType("_token_words")).__dict__
    if path not in kept:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        kept[path] = tokenizer, _Words(tokenizer.model) if splits_alike(tokenizer) else None, [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return kept[path]


class WordEncoder:
    """Ids of whole texts, as the tokenizers library gives them for any of its files.

    Words repeat far more often than texts. Where the file's rules are those of :data:`_RULES`, the
    library's ids of a word are kept as packed bytes, and the ids of a text of plain characters without
    added tokens are the joined bytes of its words. All other texts, and all texts of other files, are
    encoded whole by the library.
    """

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.words, self.special = _loaded(path)
        self.end = struct.pack("<I", end_id)

    def _by_words(self, text: str) -> bool:
        return self.words is not None and _PLAIN.fullmatch(text) is not None and not any(t in text for t in self.special)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def pack(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, the end id included. One text at a time: the library's results take far more memory than the ids."""
        return [(b"".join(map(self.words.__getitem__, _SPLIT.findall(t.lower()))) if self._by_words(t) else self._whole(t)) + self.end for t in texts]


def build_file(part: int, number: int, ids: list[int | None], packed: list[bytes]) -> bytes:
    """A complete file, without the magic number it ends in."""
    compressor = zstandard.ZstdCompressor(level=1, write_checksum=True)
    frames, entries = [], []
    for content in packed:
        frame = compressor.compress(content)
        frames.append(frame)
        entries.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
    known = np.array([i is not None for i in ids], dtype="u1").tobytes()
    values = np.array([0 if i is None else i for i in ids], dtype="<i8").tobytes()
    index = compressor.compress(struct.pack("<III", part, number, len(ids)) + known + values)
    frames.append(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
    entries.append(struct.pack("<III", len(index) + 8, 0, 0))
    table = b"".join(entries)
    frames.append(struct.pack("<II", SEEK_TABLE_MAGIC, len(table) + 9) + table + struct.pack("<IB", len(entries), CHECKSUM_FLAG))
    return b"".join(frames)


def read_tail(content: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """(part, number, document ids, seek table, frame offsets); raises ValueError on a broken file."""
    if len(content) < 17 or content[-4:] != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    count, flags = struct.unpack("<IB", content[-9:-4])
    length = count * 12 + 9
    start = len(content) - length - 8
    if start < 0 or flags != CHECKSUM_FLAG or count < 1 or content[start:start + 8] != struct.pack("<II", SEEK_TABLE_MAGIC, length):
        raise ValueError("broken seek table")
    table = np.frombuffer(content, dtype="<u4", count=count * 3, offset=start + 8).reshape(count, 3)
    offsets = np.concatenate([[0], np.cumsum(table[:, 0].astype("i8"))])
    if offsets[-1] != start:
        raise ValueError("the frames do not fill the file")
    at = int(offsets[-2])
    if content[at:at + 4] != struct.pack("<I", INDEX_MAGIC):
        raise ValueError("no index frame")
    index = zstandard.ZstdDecompressor().decompress(content[at + 8:start])
    part, number, docs = struct.unpack("<III", index[:12])
    if docs != count - 1 or len(index) != 12 + 9 * docs:
        raise ValueError("broken index frame")
    known = np.frombuffer(index, "u1", docs, 12)
    values = np.frombuffer(index, "<i8", docs, 12 + docs)
    return part, number, [int(v) if k else None for k, v in zip(known, values, strict=True)], table, offsets


def read_frame(content: bytes, table: np.ndarray, offsets: np.ndarray, i: int) -> bytes:
    """The packed ids of the i-th document, checked against the seek table."""
    size, checksum = int(table[i, 1]), int(table[i, 2])
    packed = zstandard.ZstdDecompressor().decompress(content[int(offsets[i]):int(offsets[i + 1])], max_output_size=size)
    if len(packed) != size or xxhash.xxh64_intdigest(packed) & 0xFFFFFFFF != checksum:
        raise ValueError(f"frame {i} does not match its checksum")
    return packed


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1,
                      id_col: str = "doc_id", text_col: str = "text", blob_bytes: int = BLOB_BYTES) -> None:
    """Encode every whole text and write the ids under ``path`` in ascending id order.

    ``tokenizer`` is any file of the tokenizers library; the ids are the library's, without special
    tokens added and without its truncation and padding.
    A null text is an empty one and holds the end id alone. Null ids come first; repeated ids are
    ordered by their text. An empty table writes a folder without documents. Only the two named
    columns are read. A file takes documents until ``blob_bytes`` of packed ids are reached.
    """
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, 0
        encoder, ids, packed = WordEncoder(tokenizer, end_id), [], []
        for batch in batches:
            for at in range(0, len(batch), 256):
                piece = batch.iloc[at:at + 256]
                for i, p in zip(piece["id"].astype(object), encoder.pack(piece["text"].tolist()), strict=True):
                    ids.append(None if pd.isna(i) else int(i))
                    packed.append(p)
                    held += len(p)
                    if held >= blob_bytes:
                        yield pd.DataFrame({"blob": [build_file(part, number, ids, packed)]})
                        number, held, ids, packed = number + 1, 0, [], []
        if ids:
            yield pd.DataFrame({"blob": [build_file(part, number, ids, packed)]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), text.alias("text"),
                       F.col(id_col).cast("long").alias("by_id"), F.xxhash64(text).alias("by_text"))
    ordered = rows.repartitionByRange("by_id", "by_text").sortWithinPartitions("by_id", "by_text", "text")
    write_blobs(ordered.select("id", "text").mapInPandas(encode, "blob binary"), "blob", path, SEEKABLE_MAGIC)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of the files under ``path``; with ``doc_ids`` only those frames are decompressed.

    Columns: part, number (the file's place), doc_id, tokens_ahead (in the file), n_tokens,
    ids_crc32 and, with ``with_ids``, the ids. A frame that fails its checksum ends the job.
    """
    wanted = None if doc_ids is None else frozenset(doc_ids)
    schema = "part int, number int, doc_id long, tokens_ahead long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                part, number, ids, table, offsets = read_tail(content)
                ahead = np.concatenate([[0], np.cumsum(table[:-1, 1].astype("i8") // 4)])
                picked = [i for i, d in enumerate(ids) if wanted is None or d in wanted]
                for at in range(0, len(picked), 1000):
                    some = picked[at:at + 1000]
                    packed = [read_frame(content, table, offsets, i) for i in some]
                    out = {"part": part, "number": number, "doc_id": pd.array([ids[i] for i in some], dtype="Int64"),
                           "tokens_ahead": ahead[some], "n_tokens": [len(p) // 4 for p in packed],
                           "ids_crc32": [zlib.crc32(p) for p in packed]}
                    if with_ids:
                        out["ids"] = [np.frombuffer(p, "<u4").astype("i8") for p in packed]
                    yield pd.DataFrame(out)

    return read_blobs(spark, path).select("content").mapInPandas(decode, schema)


def corpus_positions(read: DataFrame) -> DataFrame:
    """``start`` of every document in the whole corpus: its place in its file plus all files before."""
    files = read.groupBy("part", "number").agg(F.max(F.col("tokens_ahead") + F.col("n_tokens")).alias("tokens"))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", "number", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("file_start"))
    return read.join(files, ["part", "number"]).withColumn("start", F.col("file_start") + F.col("tokens_ahead"))


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files, read them back and return doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    read = materialise(read_token_files(spark, path, with_ids=False), "token-rows")
    return corpus_positions(read).select("doc_id", "start", "n_tokens", "ids_crc32")
