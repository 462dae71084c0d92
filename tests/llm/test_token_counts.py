import random

import pytest
from tokenizers import Tokenizer

from clickspark.llm import token_counts
from clickspark.llm.queries import op13_token_counts, tokenizer_path
from tests.conftest import SF_SMALL

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "\n\n a", "it'll 12½ ²x's", "İstanbul ẞ ς", "été é 漢字 🙂🙂‍", "a<|endoftext|>b<|endoftext|><|endoftext|> c", "<|startoftext|>",
       "\x00\x85\xa0  x \x1c\x1f", "x" * 50_000, " " * 5_000, "ab" * 20_000, "-" * 999 + "\t" * 999]


def library(name):
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", FILES)
def test_counts_equal_the_library(name):
    counter, count = token_counts.TokenCounter(tokenizer_path(name)), library(name)
    pick = random.Random(5)
    spans = [(1, 128), (1, 0x3000), (1, 0xD800), (0xE000, 0x110000), (32, 33), (10, 11), (39, 40)]
    texts = ODD + ["".join(chr(pick.randrange(*pick.choice(spans))) for _ in range(pick.randrange(40))) for _ in range(4_000)]
    assert [t for t in texts if counter.count(t) != count(t)] == []


def test_few_words_are_kept(monkeypatch):
    monkeypatch.setattr(token_counts, "WORDS_KEPT", 2)
    counter, count = token_counts.TokenCounter(tokenizer_path(FILES[0])), library(FILES[0])
    text = "one two three one four five one six two " * 3
    assert counter.count(text) == count(text) and len(counter.raw) <= 2 and len(counter.raw.older) <= 2


def test_merging_takes_the_lowest_rank_then_the_leftmost():
    symbols = {"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4}
    merges = token_counts.Merges([("a", "a"), ("a", "b"), ("a", "ab")], symbols)
    assert token_counts.merged_count([0, 0, 0, 1], merges) == 2  # aa ab
    assert token_counts.merged_count([0, 0, 0, 0, 0], merges) == 3  # aa aa a
    assert token_counts.merged_count([], merges) == 0 and token_counts.merged_count([1], merges) == 1


def test_files_that_are_not_covered(tmp_path):
    import json

    with open(tokenizer_path(FILES[0]), encoding="utf-8") as f:
        spec = json.load(f)
    for part, change in (("model", {"dropout": 0.5}), ("model", {"type": "Unigram"}), ("pre_tokenizer", {"add_prefix_space": True}), ("pre_tokenizer", {"type": "Whitespace"})):
        path = tmp_path / "tokenizer.json"
        path.write_text(json.dumps(spec | {part: spec[part] | change}))
        with pytest.raises(ValueError):
            token_counts.TokenCounter(str(path))


def test_whole_table(spark):
    count = library("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    expected = sorted((r.doc_id, len((r.text or "").encode()), n := count(r.text or ""), n > 1024) for r in docs)
    assert sorted(tuple(r) for r in op13_token_counts(spark, SF_SMALL).collect()) == expected
    assert any(e[3] for e in expected) and not all(e[3] for e in expected)


def test_nulls_repeats_clashing_names_and_empty(spark):
    count = library("byte_bpe_50k.json")
    rows = [(None, None), (None, "a b"), (1, ""), (1, ""), (2, ODD[5]), (3, ODD[9])]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, id string, n_tokens int")
    path = tokenizer_path("byte_bpe_50k.json")
    got = token_counts.count_tokens(docs, path).collect()
    assert sorted([(r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got]) == sorted(
        [(i is not None, i or 0, len((t or "").encode()), count(t or "")) for i, t in rows])
    assert all(r.over_limit is None for r in got)
    assert token_counts.count_tokens(docs.limit(0), path, limit=5).collect() == []
