import itertools
import random
import re

import pytest

from clickspark.llm import decontaminate as dc
from clickspark.llm.queries import ORACLES, op4_decontamination
from tests.compare import compare, duck
from tests.conftest import SF_ORACLE

VOCABULARY = [f"{a}{b}" for a in "bcdfghklmnprstvz" for b in ("an", "elo", "iru", "ost")]


def test_whole_table_equals_sql(spark):
    ok, n, detail = compare(spark, duck(SF_ORACLE), "op4", op4_decontamination, ORACLES["op4_decontamination"], SF_ORACLE)
    assert ok and n > 10, detail


def brute_force(docs, items, window=13):
    """Every alignment is verified, without seeds."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = {}
    for d, text in docs:
        h = split(text)
        for i, item in items:
            t = split(item)
            if i is None or not t:
                continue
            wide, fifths = (len(t), 5) if len(t) < 7 else (min(window, len(t)), 4)
            for shift in range(1 - len(t), len(h)):
                agree = [h[j + shift] == t[j] for j in range(max(0, -shift), min(len(t), len(h) - shift))]
                if any(5 * sum(agree[k:k + wide]) >= fifths * wide for k in range(len(agree) - wide + 1)):
                    found[d, i] = max(found.get((d, i), (0, 0)), (sum(agree), len(t)))
    return sorted((d is not None, d or 0, i, *m) for (d, i), m in found.items())


def passages(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n))


def planted(rng):
    items = [(i, passages(rng, rng.choice([15, 25, 60]))) for i in range(12)]
    docs = []
    for d in range(60):
        words = passages(rng, rng.randrange(120)).split()
        if d % 3:
            item = rng.choice(items)[1].split()
            kind = d % 4
            if kind == 1:  # every fifth, sixth, ... word substituted
                period = rng.choice([5, 6, 7, 9])
                item = [w if k % period else "changed" for k, w in enumerate(item, rng.randrange(period))]
            elif kind == 2:  # a part of the item
                item = item[rng.randrange(3):]
            at = rng.randrange(len(words) + 1)
            words[at:at] = item
        docs.append((d, rng.choice([" ", ", ", " - "]).join(words).title()))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_seeds_find_what_all_alignments_find(spark, seed):
    docs, items = planted(random.Random(seed))
    found = dc.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.item_id, r.matched_words, r.item_words) for r in found.collect())
    assert got == brute_force(docs, items) and len(got) > 20


def test_same_result_without_broadcast(spark, monkeypatch):
    docs, items = planted(random.Random(4))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(dc.find_overlaps(*frames).collect())
    monkeypatch.setattr(dc, "broadcast_if_small", lambda df, row_bytes: df.hint("merge"))
    assert sorted(dc.find_overlaps(*frames).collect()) == expected


def test_nulls_repeats_long_texts_and_empty(spark):
    rng = random.Random(5)
    item = passages(rng, 20)
    docs = [(1, None), (2, ""), (None, item), (None, item), (3, item), (3, item), (3, "other words"), (4, "word " * 200_000 + item), (5, "a b")]
    items = [(1, item), (1, item + " tail"), (None, item), (2, None), (3, "a b")]
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, key string, item_id int")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, h string")
    got = sorted((r.doc_id or 0, r.item_id, r.matched_words) for r in dc.find_overlaps(table, bench).collect())
    assert got == [(0, 1, 20), (3, 1, 20), (4, 1, 20), (5, 3, 2)]
    kept = dc.drop_contaminated(table, bench)
    assert kept.schema == table.schema
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(3, "other words")] and kept.count() == 3
    assert dc.find_overlaps(table.limit(0), bench).collect() == [] and dc.find_overlaps(table, bench.limit(0)).collect() == []


@pytest.mark.parametrize("n", range(7, 14))
def test_every_placement_of_substitutions_leaves_a_seed(n):
    masks = dc.masks_for(n)
    for gone in itertools.combinations(range(n), n // 5):
        seen = "".join("0" if i in gone else "1" for i in range(n))
        assert any(all(c == "1" for c, m in zip(seen[at:], mask) if m == "1") for mask in masks for at in range(n - len(mask) + 1)), gone


def test_random_substitutions_in_short_items(spark):
    rng = random.Random(8)
    items = [(n, " ".join(f"w{n}x{j}" for j in range(n))) for n in (7, 8, 9, 10, 11, 12, 13, 20)]
    docs = []
    for n, text in items:
        ways = [*itertools.combinations(range(n), n // 5)]
        for gone in ways if n < 14 else rng.sample(ways, 150):
            words = ["other" if i in gone else w for i, w in enumerate(text.split())]
            docs.append((len(docs), " ".join(["before", *words, "after"])))
    docs += [(len(docs) + i, " ".join("other" if rng.random() < 0.25 else w for w in text.split())) for i, (_, text) in enumerate(items * 5)]
    found = dc.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.item_id, r.matched_words, r.item_words) for r in found.collect())
    assert got == brute_force(docs, items) and len(got) > 300


@pytest.mark.parametrize("n", [14, 15, 17, 20, 22, 25, 40, 60])
def test_masks_of_other_windows_leave_a_seed(n):
    rng = random.Random(n)
    masks = dc.masks_for(n)
    assert len(masks) <= 20 and all(m.count("1") >= 4 for m in masks)
    for _ in range(3000):
        gone = {*rng.sample(range(n), n // 5)}
        assert any(all(at + i not in gone for i, m in enumerate(mask) if m == "1") for mask in masks for at in range(n - len(mask) + 1)), gone


def test_items_below_seven_words_are_found_whole(spark):
    rng = random.Random(9)
    items = [(n, " ".join(f"s{n}x{j}" for j in range(n))) for n in range(1, 7)] + [(7, "")]
    docs = [(0, items[5][1]), (1, "x " + items[5][1] + " y"), (2, items[5][1].replace("s6x3", "other")), (3, items[0][1] + " z"), (4, "s4x0 s4x1 s4x2")]
    docs += [(i, " ".join(rng.choices(["s2x0", "s2x1", "s3x0 s3x1", "s3x2", "q"], k=12))) for i in range(5, 40)]
    found = dc.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((True, r.doc_id, r.item_id, r.matched_words, r.item_words) for r in found.collect())
    assert got == brute_force(docs, items) and {(d, i) for _, d, i, *_ in got} >= {(0, 6), (1, 6), (3, 1)} and (2, 6) not in {(d, i) for _, d, i, *_ in got}


def test_common_phrases_at_the_start_of_items_write_few_hits(spark, monkeypatch):
    seen = {}
    real = dc.materialise
    monkeypatch.setattr(dc, "materialise", lambda df, name: seen.setdefault(name, real(df, name)))
    texts = spark.range(500).selectExpr("id AS doc_id", "concat(repeat('one of the ', 200), 'and ', id) AS text")
    items = spark.createDataFrame([(i, f"one of the q{i} r{i} s{i} t{i}") for i in range(200)], "item_id long, text string")
    assert dc.find_overlaps(texts, items).count() == 0 and seen["hits"].count() < 1000
