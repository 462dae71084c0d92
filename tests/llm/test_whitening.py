import math
from collections import Counter

import numpy as np
import pytest

from clickspark.llm import whitening
from clickspark.llm.queries import op11_whitening
from tests.conftest import SF_SMALL


def plain(rows, components=4, weigh_counts=False):
    """{(id, component): ...} by numpy over all rows of one length, in double precision."""
    kept = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    counts = Counter(x for _, x in kept)
    fit = [x for x in counts for _ in range(counts[x] if weigh_counts else 1)]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    fitted = np.array(fit, dtype=float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(fitted.T @ fitted / n)
    order = np.argsort(-values)[:components]
    coordinates = fitted @ vectors[:, order] / np.sqrt(values[order])
    error = np.abs(np.cov(coordinates.T, bias=True) - np.eye(len(order))).max()
    out = []
    for i, x in kept:
        white = (np.array(x) - np.array(sums) / n) @ vectors[:, order] / np.sqrt(values[order])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        out += [(i, k + 1, n, deviation, white[k], values[order[k]] / values.sum(), error) for k in range(len(order))]
    return out


def agree(got, expected):
    got = sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4])))
    expected = sorted(expected, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4])))
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    sign = {}
    for g, e in zip(got, expected, strict=True):
        if abs(e[4]) > 1e-6:
            assert sign.setdefault(g[1], g[4] * e[4] > 0) == (g[4] * e[4] > 0)  # one sign for all rows
        assert abs(g[4]) == pytest.approx(abs(e[4]), abs=1e-8)
        assert g[5] == pytest.approx(e[5], rel=1e-9) and g[6] <= 1e-6


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    agree(op11_whitening(spark, SF_SMALL).collect(), plain(rows))


@pytest.fixture(scope="module")
def crowded():
    pick = np.random.default_rng(4)
    rows = [(i, [float(c) for c in pick.normal(size=5) * [3, 2, 1, 1, 1]]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(7, rows[7][1]), (None, rows[3][1]), (None, rows[4][1])]
    return rows + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [math.nan, 0.0, 0.0, 0.0, 0.0]), (903, [math.inf, 0.0, 0.0, 0.0, 0.0]), (904, [0.0, 0.0, 0.0, 0.0, -math.inf])]


@pytest.mark.parametrize("weigh_counts", [False, True])
def test_repeats_nulls_and_clashing_names(spark, crowded, weigh_counts, monkeypatch):
    spread = whitening._spread
    monkeypatch.setattr(whitening, "_spread", lambda a, b: spread(a, b, crowd=7))  # 41 equal rows over six copies
    df = spark.createDataFrame([(*r, "y", 1) for r in crowded], "vec_id long, embedding array<double>, x string, n int").repartition(5)
    agree(whitening.whiten(df, weigh_counts=weigh_counts).collect(), plain(crowded, weigh_counts=weigh_counts))


def test_spread_keeps_every_row(spark):
    rows = spark.range(1000).selectExpr("id", "CAST(id % 3 = 0 AS string) AS key")
    vectors = rows.groupBy("key").count().selectExpr("key", "count AS rows", "2 AS dim", "1 AS deviation", "array(1.0) AS white")
    a, b = whitening._spread(rows, vectors, crowd=100)
    assert a.join(b, ["key", "salt"]).count() == 1000 and b.count() == 4 + 7


def test_lengths_constants_and_empty(spark):
    rows = [(1, []), (2, [1.0]), (3, [2.0]), (4, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [0.0, 0.0, 0.0]), (7, [1.0, 1.0, 0.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert sorted(got) == [(2, 1), (3, 1), (4, 1), (4, 2), (5, 1), (5, 2), (6, 1), (6, 2), (6, 3), (7, 1), (7, 2), (7, 3)]
    assert abs(got[2, 1].whitened) == pytest.approx(1) and got[2, 1].n == 2 and got[2, 1].explained == pytest.approx(1)
    assert (got[4, 1].n, got[4, 1].deviation, got[4, 1].whitened, got[4, 1].explained, got[4, 1].identity_error) == (1, 0, None, None, None)
    assert got[6, 2].whitened is None and got[6, 2].explained == 0 and got[6, 1].identity_error < 1e-9
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(none).collect() == []


def test_large_entries(spark):
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 2.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1, 1].deviation is None and abs(got[1, 1].whitened) == pytest.approx(math.sqrt(1.5))
    assert got[3, 1].deviation == (3 * 512 - 768) ** 2
    assert whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")).count() == 2
