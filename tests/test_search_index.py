"""The stored inverted index against a search of the whole table."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from clickspark.operators import search
from clickspark.operators import search_index as si
from clickspark.operators import snapshots as sn

SCHEMA = "short_code string, long_url string, created_at timestamp"
QUERIES = [(1, "https"), (2, "rare7 rare8"), (3, "https rare1 common"), (4, "nothing"), (5, ""), (6, "C5 https"), (7, "common"), (8, "rare8 rare7")]


def _urls(n, seed, first=0):
    pick, start = random.Random(seed), dt.datetime(2024, 1, 1)
    return [(f"c{i}", f"https://{'common' if pick.random() < 0.4 else 'x'}/rare{pick.randrange(20)}", start + dt.timedelta(minutes=pick.randrange(n))) for i in range(first, first + n)]


def _found(df):
    return sorted((r.query_id, r.rank, r.short_code, r.created_at, r.total) for r in df.collect())


def test_index_equals_a_search_of_the_table(spark, scratch):
    store, queries = os.path.join(scratch, "index"), spark.createDataFrame(QUERIES, "query_id int, q string")
    urls = {r[0]: r for r in _urls(400, 1)}
    urls["c7"] = ("c7", None, None)
    table = lambda rows: spark.createDataFrame(list(rows.values()), SCHEMA).repartition(3)
    si.build(table(urls).unionByName(spark.createDataFrame([(None, "https", None)], SCHEMA)), store, slot_rows=25)
    for k in (3, 30, 1000):
        assert _found(si.bulk_search(spark, store, queries, k)) == _found(search.bulk_url_search(table(urls), queries, k))
    # a delta: newer and older URLs, changes, deletions
    before, changes = dict(urls), {r[0]: r for r in _urls(30, 2, first=390)}
    gone = ["c1", "c2", "c395", "c9999"]
    version = si.refresh(spark, store, spark.createDataFrame(list(changes.values()), SCHEMA), spark.createDataFrame([(c,) for c in gone], "short_code string"), slot_rows=25)
    urls = {c: r for c, r in urls.items() if c not in gone} | changes
    assert _found(si.bulk_search(spark, store, queries, 10)) == _found(search.bulk_url_search(table(urls), queries, 10))
    assert _found(si.bulk_search(spark, store, queries, 10, version=version - 1)) == _found(search.bulk_url_search(table(before), queries, 10))
    assert si.refresh(spark, store, None, spark.createDataFrame([(c,) for c in urls], "short_code string"), slot_rows=25) == version + 1
    assert _found(si.bulk_search(spark, store, queries, 10)) == []


def test_few_blocks_are_read_and_few_slots_rewritten(spark, scratch):
    store = os.path.join(scratch, "index")
    rows = _urls(600, 3)
    si.build(spark.createDataFrame(rows, SCHEMA), store, slot_rows=20)
    directory = sn.read(spark, store, "blocks").select("token", "slot", "n", "newest", "oldest")
    everywhere = directory.where("token = 'https'")
    assert everywhere.count() == 30 and si.needed_blocks(everywhere, 20).count() <= 3
    old = sn.snapshot(spark, store).live["blocks"]
    code = max(rows, key=lambda r: r[2])[0]
    si.refresh(spark, store, None, spark.createDataFrame([(code,)], "short_code string"), slot_rows=20)
    assert len(set(old) - set(sn.snapshot(spark, store).live["blocks"])) == 1  # one slot of thirty


def test_empty_table(spark, scratch):
    store = os.path.join(scratch, "index")
    none = spark.createDataFrame([], SCHEMA)
    si.build(none, store)
    queries = spark.createDataFrame(QUERIES, "query_id int, q string")
    assert si.bulk_search(spark, store, queries, 5).collect() == []
    si.refresh(spark, store, spark.createDataFrame(_urls(5, 1), SCHEMA))
    assert si.bulk_search(spark, store, queries, 5).where(F.col("query_id") == 1).count() == 5


def _shuffled(df):
    """Rows written to shuffles when ``df`` is computed."""
    df.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        metrics, below = node.metrics(), node.children()
        own = metrics.apply("shuffleRecordsWritten").value() if metrics.contains("shuffleRecordsWritten") else 0
        return own + sum(walk(below.apply(i)) for i in range(below.size()))
    return walk(df._jdf.queryExecution().executedPlan())


def test_no_pair_of_query_and_url_is_shuffled(spark, scratch):
    urls = spark.createDataFrame(_urls(600, 4), SCHEMA)
    queries = spark.createDataFrame([(i, f"https common rare{i % 20} c{i}") for i in range(600)], "query_id int, q string")
    found = search.bulk_url_search(urls, queries, 5)
    assert _shuffled(found) < 600 * 600 / 4
    assert {r.total for r in found.collect()} == {600}
    store = os.path.join(scratch, "index")
    si.build(urls, store, slot_rows=100)
    stored = si.bulk_search(spark, store, queries, 5)
    assert _shuffled(stored) < 600 * 600 / 4
    assert _found(stored) == _found(found)


def test_totals_of_lists_that_overlap(spark, scratch):
    """Against plain sets: sparse and dense rows of sets, paths that are shared, long lists, odd URLs and queries."""
    pick = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    share = {w: (0.97, 0.6, 0.3, 0.02)[i % 4] for i, w in enumerate(words)}
    start = dt.datetime(2024, 1, 1)
    urls = [(f"c{i}", "/".join(w for w in words if pick.random() < share[w]), start + dt.timedelta(minutes=i)) for i in range(5000)]
    asked = [(i, " ".join(pick.sample([*words, "none", f"c{i}"], 1 + i % 6))) for i in range(40)] + [(100, " ".join(words)), (101, "w3 w7"), (102, "W3 w3 w3")]
    has = {c: {c, *u.split("/")} for c, u, _ in urls}
    want = {i: sum(not t.isdisjoint(q.lower().split()) for t in has.values()) for i, q in asked}
    table, queries = spark.createDataFrame(urls, SCHEMA), spark.createDataFrame(asked, "query_id int, q string")
    totals = lambda df: {r.query_id: r.total for r in df.collect()}
    assert totals(search.bulk_url_search(table, queries, 3)) == want
    store = os.path.join(scratch, "index")
    si.build(table, store)
    assert totals(si.bulk_search(spark, store, queries, 3)) == want


def test_repeated_and_null_keys_of_a_search(spark):
    day = dt.datetime(2024, 1, 1)
    urls = spark.createDataFrame([("a", "x/y", day), ("a", "x/z", day), ("a", "z", None), (None, "x", day), (None, "x", None)], SCHEMA)
    queries = spark.createDataFrame([(1, "x"), (1, "y q"), (2, "z"), (None, "x"), (3, None)], "query_id int, q string")
    assert sorted(((r.query_id, r.rank, r.short_code, r.created_at, r.total) for r in search.bulk_url_search(urls, queries, 9).collect()), key=lambda r: r[:2]) == [
        (1, 1, None, day, 3), (1, 2, "a", day, 3), (1, 3, None, None, 3), (2, 1, "a", day, 2), (2, 2, "a", None, 2)]


def test_a_url_that_a_delta_brings_twice_is_one_in_a_total(spark, scratch):
    store, rows = os.path.join(scratch, "index"), _urls(50, 6)
    si.build(spark.createDataFrame(rows, SCHEMA), store, slot_rows=20)
    si.refresh(spark, store, spark.createDataFrame(rows[:10] * 2, SCHEMA), slot_rows=20)
    queries = spark.createDataFrame([(1, "https common"), (2, "c3 c4 nothing"), (3, "https rare1 rare2 c5")], "query_id int, q string")
    assert {r.query_id: r.total for r in si.bulk_search(spark, store, queries, 3).collect()} == {1: 50, 2: 2, 3: 50}
