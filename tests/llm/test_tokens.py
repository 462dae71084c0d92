import json
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from clickspark.llm import tokens
from clickspark.llm.queries import op7_token_files, tokenizer_path
from clickspark.llm.storage import new_path, read_blobs
from tests.conftest import SF_SMALL

ODD = ["", "Hello's WORLD, it'll be 12½ ²x", "İstanbul ΣΑΣ ς", "été café", "a<|endoftext|>b <|startoftext|>",
       "tab\tnew\nline\r\x0b\x0c\x85\xa0 x", "''s 't 're''ll!!'d", "漢字 かな 한글 🙂🙂", "ªº µ ß ÀÖØöøÿ ǅ ɏ", "a\x00b\x1cc\xadd", "x" * 50_000]


def expected(rows):
    tok = Tokenizer.from_file(tokenizer_path())
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_word_encoder_equals_the_tokenizer():
    tok = Tokenizer.from_file(tokenizer_path())
    encoder = tokens.WordEncoder(tokenizer_path(), 1)
    every = [chr(c) + "a" + chr(c) for c in range(1, 0x2000)]
    for text, packed in zip(ODD + every, encoder.pack(ODD + every), strict=True):
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == [*tok.encode(text, add_special_tokens=False).ids, 1], repr(text)


OTHERS = {
    "padded": {"padding": {"strategy": {"Fixed": 9}, "direction": "Right", "pad_to_multiple_of": None, "pad_id": 0, "pad_type_id": 0, "pad_token": "!"},
               "truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}},
    "cased": {"normalizer": {"type": "NFC"}},
    "spaces": {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"\s+"}, "behavior": "Removed", "invert": False},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}},
    "added": {"added_tokens": [{"id": 49406, "content": "hello", "single_word": True, "lstrip": False, "rstrip": False, "normalized": True, "special": False}]},
}


@pytest.mark.parametrize("name", ["byte_bpe_50k", *OTHERS])
def test_ids_of_any_tokenizer_file_are_the_librarys(name, tmp_path):
    path = tokenizer_path(f"{name}.json") if name not in OTHERS else str(tmp_path / f"{name}.json")
    if name in OTHERS:
        with open(tokenizer_path()) as given, open(path, "w") as changed:
            json.dump(json.load(given) | OTHERS[name], changed)
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    texts = [*ODD, "Hello World, it's 2024", "hello othello HELLO"]
    encoder = tokens.WordEncoder(path, 1)
    assert (encoder.words is not None) == (name == "padded")
    for text, packed in zip(texts, encoder.pack(texts), strict=True):
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == [*tok.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_files_of_another_tokenizer(spark):
    path = new_path(spark, "tokens")
    docs = spark.createDataFrame([(0, "Hello World, it's 2024"), (1, None)], "doc_id long, text string")
    tokens.write_token_files(docs, path, tokenizer_path("byte_bpe_50k.json"))
    assert {r.doc_id: r.ids for r in tokens.read_token_files(spark, path).collect()} == {0: [15496, 2159, 11, 340, 338, 48609, 1], 1: [1]}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in op7_token_files(spark, SF_SMALL).collect())
    assert got == expected([(r.doc_id, r.text) for r in docs])


def test_nulls_repeats_empty_and_many_files(spark):
    rows = [(None, "z"), (1, None), (2, ODD[1]), (3, "a"), (3, "b")] + [(10 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(3)
    path = new_path(spark, "tokens")
    tokens.write_token_files(docs, path, tokenizer_path(), blob_bytes=64)
    read = tokens.corpus_positions(tokens.read_token_files(spark, path))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in read.collect())
    ahead = expected(rows)
    assert [g[2:] for g in got] == [e[1:] for e in ahead]
    one = tokens.read_token_files(spark, path, doc_ids=[2]).collect()
    assert len(one) == 1 and one[0].ids == [*Tokenizer.from_file(tokenizer_path()).encode(ODD[1], add_special_tokens=False).ids, 1]
    assert tokens.token_table(docs.limit(0), tokenizer_path()).collect() == []


def test_files_are_plain_zstandard_and_checked(spark):
    import zstandard

    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string").coalesce(1)
    path = new_path(spark, "tokens")
    tokens.write_token_files(docs, path, tokenizer_path())
    (content,) = [r.content for r in read_blobs(spark, path).collect()][:1]
    plain = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    part, number, ids, table, offsets = tokens.read_tail(content)
    assert plain == b"".join(tokens.read_frame(content, table, offsets, i) for i in range(len(ids)))
    broken = bytearray(content)
    broken[-9 - 12 - 1] ^= 1  # the checksum of the last document in the seek table
    with pytest.raises(ValueError):
        *_, table, offsets = tokens.read_tail(bytes(broken))
        for i in range(len(ids)):
            tokens.read_frame(bytes(broken), table, offsets, i)
    for cut in (content[:-1], content[5:], b"", content[:40]):
        with pytest.raises(ValueError):
            tokens.read_tail(cut)
