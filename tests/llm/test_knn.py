import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickspark.llm import knn
from clickspark.llm.queries import ORACLES, op10_top_k
from tests.compare import compare, duck
from tests.conftest import SF_SMALL


def brute_force(rows, step, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(usable):
        if q % step == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for b, (i, w) in enumerate(usable) if b != a and len(w) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_whole_table_equals_sql(spark):
    ok, n, detail = compare(spark, duck(SF_SMALL), "op10", op10_top_k, ORACLES["op10_top_k"], SF_SMALL)
    assert ok and n, detail


@pytest.mark.parametrize("clustered", [True, False])
def test_random_vectors_ties_and_small_blocks(spark, clustered):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [(c if clustered else 0) + rng.gauss(0, 0.05 if clustered else 1) for c in rng.choice(centres)]) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 480)]  # one very common vector
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.top_k(table, F.col("vec_id") % 10 == 0, k=5, pivots=8, group_queries=7, chunk_rows=100)
    assert sorted(tuple(r) for r in got.collect()) == brute_force(rows, 10, 5)


def test_nulls_lengths_repeats_large_values_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-1.0, 0.25]), (5, [-1.0, 0.25]), (6, [3.0, 1.0]),
            (6, [0.1, 1.0]), (None, [9.0, 9.0]), (7, [1.0]), (8, []), (10, []), (12, [2.0]), (20, [-3.5, -0.001]), (30, [1e12, -1e12])]
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, score int, cell string")
    got = sorted(tuple(r) for r in knn.top_k(table, F.col("vec_id") % 2 == 0, k=3, pivots=3).collect())
    longs = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    assert got == [(q, r, i, longs(s)) for q, r, i, s in brute_force(rows, 2, 3)]
    assert knn.top_k(table.limit(0), F.col("vec_id") % 2 == 0).collect() == []


def test_pruning_only_drops_what_cannot_win(spark):
    # two far clusters: the bounds keep vectors of the low one away from queries of the high one
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 0.01, 8) + (4 if i % 2 else -4)).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.top_k(table, F.col("vec_id") % 15 == 0, k=4, pivots=6, group_queries=5)
    assert sorted(tuple(r) for r in got.collect()) == brute_force(rows, 15, 4)


def test_rows_that_repeat_an_id_all_count(spark):
    rng = random.Random(4)
    rows = [(1, [0.1, 0.0]), (1, [5.0, 0.0]), (0, [256.0, 0.0]), (0, [256.0, 0.0]), (0, [-1.0, 1.0])]
    rows += [(rng.randrange(2, 12), [rng.gauss(0, 1), rng.gauss(0, 1)]) for _ in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in knn.top_k(table, F.col("vec_id") % 5 == 0, k=4, pivots=6, group_queries=9, chunk_rows=40).collect())
    assert got == brute_force(rows, 5, 4) and (0, 2, 1, 256 * 256 * 256 * 5) in got


def test_cells_that_cannot_win_are_dropped_as_a_whole():
    cells = knn.Cells([[100, 0], [-100, 0], [0, 3]])
    held = {(2, 1): (1.0, 50), (2, 2): (1.0, 50), (2, 3): (2.0, 2)}
    near, floors = knn.related_cells(cells, {(2, 1): (1.0, 4)}, held, k=5)
    assert near == {(2, 1): [1], (2, 2): [], (2, 3): []} and 9700 < floors[2, 1] < 9801
    near, floors = knn.related_cells(cells, {(2, 1): (1.0, 4)}, {(2, 3): (2.0, 2)}, k=5)
    assert near == {(2, 3): [1]} and floors[2, 1] == -math.inf
