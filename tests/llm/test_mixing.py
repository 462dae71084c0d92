import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clickspark.llm import mixing
from clickspark.llm.queries import op5_mixing
from tests.conftest import SF_ORACLE, SF_SMALL


def reshared(sizes, weights, share=1.5, cap=2.0):
    """Targets by the rule as told: share by weight, stop at the cap, share the excess again."""
    budget, open_, target = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        parts = {i: budget * weights[i] / total for i in open_}
        above = [i for i in open_ if parts[i] > cap * sizes[i]]
        if not above:
            for i in open_:
                target[i] = parts[i]
            break
        for i in above:
            target[i] = cap * sizes[i]
            budget -= target[i]
            open_.remove(i)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, docs):
    size, of = defaultdict(int), {}
    for d, text, source in docs:
        size[source] += words(text)
        of[d] = source
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    targets = dict(zip(names, reshared([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = of[r.doc_id]
        assert r.source_size == size[s] and math.isclose(r.target, targets[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, words(t)) for d, t, _ in docs)
    for s in size:
        assert abs(taken[s] - targets[s]) <= largest[s]
    return {s: abs(taken[s] - targets[s]) / max(1, targets[s]) for s in size}


@pytest.mark.parametrize("sf", [SF_SMALL, SF_ORACLE])
def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    off = check(op5_mixing(spark, sf).collect(), docs)
    assert max(off.values()) < 0.02


def test_targets_follow_the_rule(spark):
    rng = random.Random(1)
    for n in (1, 2, 5, 23):
        sizes = [rng.choice([0, 1, 10, 1000, 50_000]) for _ in range(n)]
        rows = mixing.source_targets(spark.createDataFrame([(f"s{i:03d}", s) for i, s in enumerate(sizes)], "source_key string, source_size long")).collect()
        got = [r.target for r in sorted(rows)]
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, reshared(sizes, [(5, 2, 1)[i % 3] for i in range(n)]), strict=True))


def test_rates_are_the_constrained_optimum(spark):
    rng = random.Random(2)
    sizes = [rng.choice([1, 3, 10, 40, 400]) for _ in range(300)]
    total = sum(sizes)
    pairs = spark.createDataFrame([("a", s, n) for s, n in Counter(sizes).items()], "source_key string, size long, n long")
    for target in (0.2 * total, total, 1.4 * total, 1.99 * total):
        (row,) = mixing.balance(pairs, spark.createDataFrame([("a", total, float(target))], "source_key string, source_size long, target double")).collect()
        rates = [min(2.0, math.exp(row.multiplier * s / row.scale)) for s in sizes]
        assert math.isclose(sum(r * s for r, s in zip(rates, sizes, strict=True)), target, rel_tol=1e-5)
        if target == total:
            assert abs(row.multiplier) < 1e-6


def test_reruns_agree_and_no_python(spark):
    first = op5_mixing(spark, SF_SMALL)
    assert first.exceptAll(op5_mixing(spark, SF_SMALL)).count() == 0
    assert not re.search("Python|Pandas|Arrow", first._jdf.queryExecution().toString())


def test_nulls_repeats_empty_and_the_mix(spark):
    docs = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d\x0be f\x85g", None), (5, "h " * 30_000, "y"), (6, "i j", "é"), (7, "k", "Z")]
    docs += [(10 + i, "w " * (i % 7), "many") for i in range(200)]
    table = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, source string, size int, copies string")
    check(mixing.mix(table).collect(), docs)
    twice = table.unionByName(table.filter("doc_id = 4")).unionByName(table.filter("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    rows = mixing.mix(twice).collect()
    assert len(rows) == len(docs) + 2
    kept = mixing.mixed_documents(twice)
    assert kept.schema == table.schema
    expected = Counter()
    for r in rows:
        expected[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in kept.collect()) == +expected
    assert mixing.mix(table.limit(0)).collect() == [] and mixing.mixed_documents(table.limit(0)).collect() == []
    assert {r.taken for r in mixing.mix(table.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}
