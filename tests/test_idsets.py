"""Exact mergeable sets: dictionary, lists and bitmaps, unions."""

import random

import pytest
from pyspark.sql import functions as F

from clickspark.operators import idsets


@pytest.mark.parametrize("dense", [1, 5, 10_000])
def test_merged_sets_are_the_union(spark, dense, monkeypatch):
    monkeypatch.setattr(idsets, "DENSE", dense)
    pick = random.Random(dense)
    rows = [(pick.choice(["a", "b", None]), pick.randrange(3), pick.choice([None, 1, 32_768, 32_769, pick.randrange(1, 50), pick.randrange(1, 200_000)])) for _ in range(900)]
    rows += [("a", 0, i) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "k string, batch int, id long")
    parts = [idsets.id_sets(df.where(F.col("batch") == b), ["k"]) for b in range(3)]
    two = idsets.merge_sets(parts[0].unionByName(parts[1]), ["k"])
    merged = idsets.merge_sets(two.unionByName(parts[2]), ["k"])
    want = {}
    for k, _, i in rows:
        if i is not None:
            want.setdefault(k, set()).add(i)
    got = {r.k: r.n for r in merged.groupBy("k").agg(F.sum(idsets.set_size()).alias("n")).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    per = {(r.k, r.bucket): r for r in merged.collect()}
    assert len(per) == merged.count() and all((r.positions is None) != (r.bitmap is None) for r in per.values())
    assert any(r.bitmap is not None for r in per.values()) == (dense < 10_000)
    lists = {(k, (p + 1) + 32_768 * (b - 1)) for (k, b), r in per.items() for p in r.positions or []}
    assert all(i in want[k] for k, i in lists)


def test_ids_are_dense_and_stay(spark, monkeypatch):
    monkeypatch.setattr(idsets, "_NUMBERED", 7)
    first = idsets.extend_dictionary(spark.createDataFrame([(f"v{i % 30}",) for i in range(90)] + [(None,)], "ip string"), "ip")
    known = {r.ip: r.id for r in first.collect()}
    assert sorted(known.values()) == list(range(1, 31))
    more = idsets.extend_dictionary(spark.createDataFrame([(f"v{i}",) for i in range(20, 50)], "ip string"), "ip", first)
    every = {r.ip: r.id for r in more.collect()}
    assert sorted(every.values()) == list(range(1, 51)) and all(every[k] == v for k, v in known.items())
    none = idsets.extend_dictionary(spark.createDataFrame([], "ip string"), "ip")
    assert none.count() == 0 and idsets.id_sets(none.withColumn("k", F.lit(1)), ["k"]).count() == 0
