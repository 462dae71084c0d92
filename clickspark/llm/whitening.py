"""Whitening of embeddings by a covariance over distinct vectors, weighted by one or by their counts.

Vectors are put on a whole-number grid, equal ones are grouped, and everything that costs a matrix
product is done once for each distinct vector: sums, the centred and weighted product, the projection.
The rows then fetch the result of their vector by its digest. Vectors of different lengths are fitted
apart, each length a space of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickspark.llm.storage import broadcast_if_small, materialise

_ROWS = 4_096  # vectors in one matrix product
_LONG = (1 << 63) - 1


def on_grid(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * c) of every entry as double; -0.0 becomes 0, what no long holds its nearest end."""
    return F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))


def _finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, their vectors as a matrix of longs) for every length in ``batch``."""
    column = batch.column("x")
    lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        for at in range(0, len(rows), _ROWS):
            some = rows[at:at + _ROWS]
            yield int(dim), some, flat[starts[some][:, None] + np.arange(dim)]


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` as it is if results up to ``bound`` fit a long, else as Python's own numbers."""
    return x if bound <= _LONG else x.astype(object)


def _size(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def vector_sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """length -> (total weight, weighted sum per dimension), exact. ``distinct`` has x and weight.

    A task sends one row per length and dimension; as many numbers reach the driver."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            weights = batch.column("weight").to_numpy()
            for dim, rows, x in _matrices(batch):
                w = weights[rows]
                bound = _size(x) * int(w.sum())
                sums = (_exact(x, bound) * _exact(w, bound)[:, None]).sum(axis=0)
                held = total.setdefault(dim, [0] * (dim + 1))
                for i, v in enumerate([*sums.tolist(), int(w.sum())]):
                    held[i] += int(v)
        rows = [(dim, i, str(v)) for dim, held in total.items() for i, v in enumerate(held)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["dim", "i", "v"])

    found: dict[int, dict[int, int]] = {}
    rows = distinct.mapInArrow(partial, "dim int, i int, v string")
    for r in rows.groupBy("dim", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        found.setdefault(r["dim"], {})[r["i"]] = int(r["v"])
    return {dim: (v[dim], [v[i] for i in range(dim)]) for dim, v in found.items()}


def covariances(distinct: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """length -> weighted covariance (divisor the total weight), centred before multiplying.

    Each task adds up one matrix per length; only the upper halves are shuffled, summed by entry, and the
    d * (d + 1) / 2 sums of a length of d reach the driver."""
    means = {dim: np.array([s / n for s in total]) for dim, (n, total) in sums.items()}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = {}
        for batch in batches:
            weights = batch.column("weight").to_numpy().astype(float)
            for dim, rows, x in _matrices(batch):
                centred = x - means[dim]
                add = (centred * weights[rows][:, None]).T @ centred
                product[dim] = product[dim] + add if dim in product else add
        for dim, p in product.items():
            for i in range(dim):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * (dim - i), pa.int32()), pa.array([i] * (dim - i), pa.int32()), pa.array(np.arange(i, dim), pa.int32()), pa.array(p[i, i:])],
                    ["dim", "i", "j", "v"])

    found = {dim: np.zeros((dim, dim)) for dim in sums}
    rows = distinct.mapInArrow(partial, "dim int, i int, j int, v double")
    for r in rows.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        found[r["dim"]][r["i"], r["j"]] = found[r["dim"]][r["j"], r["i"]] = r["v"] / sums[r["dim"]][0]
    return found


def principal_axes(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(axes as rows, their variances, trace), by falling variance; each axis has its largest entry
    positive. An axis whose variance is lost in rounding has variance 0."""
    if not len(covariance):
        return np.zeros((0, 0)), np.zeros(0), 0.0
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    axes, values, trace = vectors[:, order].T, values[order], float(np.trace(covariance))
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return axes * sign[:, None], np.where(values > trace * len(covariance) * 1e-14, values, 0.0), trace


def whiten(rows: DataFrame, components: int = 4, weigh_counts: bool = False, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Up to ``components`` whitened coordinates of every row whose vector has only finite entries.

    The fit takes each distinct grid vector once, or as often as it occurs with ``weigh_counts``. Returns
    ``id_col``, ``component`` (from 1, by falling variance), ``n`` (weight of the fit), ``deviation`` (sum
    over dimensions of (n * x - S)^2, exact; null if no long holds it), ``whitened``, ``explained`` (share
    of the trace) and ``identity_error`` (largest entry of the fitted coordinates' covariance minus the
    identity, one value for each length).

    Null vectors and those with null or non-finite entries take no part. Repeated rows and null ids are rows
    like others. A vector of d entries has min(d, ``components``) rows; an empty one none. Components
    without variance have a null coordinate and no part in ``identity_error``, which is null if all are
    such; ``explained`` is null if the trace is 0. An empty table gives no rows; other columns are not read.

    Only digests of 32 bytes are shuffled with the rows; equal vectors are one row on the other side of that
    join, and a vector that fills a third of the rows is spread over tasks by a salt.
    """
    spark = rows.sparkSession
    vector = F.col(f"`{vector_col}`")
    kept = rows.select(F.col(f"`{id_col}`").alias("id"), vector.alias("v")).filter(_finite(F.col("v")))
    kept = kept.select("id", on_grid("v", scale).alias("x")).filter(F.size("x") > 0)
    digest = F.unhex(F.sha2(F.array_join("x", ","), 256))
    grouped = kept.withColumn("key", digest).groupBy("key", "x").agg(F.count("*").alias("rows"))
    distinct = materialise(grouped.withColumn("weight", F.col("rows") if weigh_counts else F.lit(1).cast("long")), "whiten-distinct")

    fit = distinct.select("x", "weight")
    sums = vector_sums(fit)
    axes = {dim: principal_axes(v, components) for dim, v in covariances(fit, sums).items()}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, weights = batch.column("key"), batch.column("rows"), batch.column("weight")
            for dim, some, x in _matrices(batch):
                n, total = sums[dim]
                basis, variance, _ = axes[dim]
                size = max(_size(x), max(map(abs, total)) // n + 1)
                bound = dim * (2 * n * size) ** 2
                away = _exact(x, bound) * n - np.array(total, dtype="i8" if bound <= _LONG else object)
                deviation = [v if v <= _LONG else None for v in map(int, (away * away).sum(axis=1))]
                coordinates = (x - np.array([s / n for s in total])) @ basis.T / np.where(variance > 0, np.sqrt(variance), np.nan)
                flat = coordinates.ravel()
                white = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(basis), pa.int32()), pa.array(flat, mask=np.isnan(flat)))
                pick = pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pick), counts.take(pick), weights.take(pick), pa.array([dim] * len(x), pa.int32()), pa.array(deviation, pa.int64()), white],
                    ["key", "rows", "weight", "dim", "deviation", "white"])

    projected = materialise(distinct.mapInArrow(project, "key binary, rows long, weight long, dim int, deviation long, white array<double>"), "whiten-projected")
    errors = _identity_errors(projected, sums, {dim: len(a) for dim, (a, _, _) in axes.items()}, components)
    facts = [(dim, sums[dim][0], errors[dim], [float(v) / trace if trace > 0 else None for v in values]) for dim, (_, values, trace) in axes.items()]
    # one row per length of vector
    by_length = F.broadcast(spark.createDataFrame(facts, "dim int, n long, identity_error double, shares array<double>"))

    salted_rows, salted_vectors = _spread(kept.select("id", digest.alias("key")), projected)
    found = salted_rows.join(salted_vectors, ["key", "salt"]).join(by_length, "dim")
    each = found.select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("white", "shares")).alias("at", "c"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("c.white").alias("whitened"), F.col("c.shares").alias("explained"), "identity_error")


def _spread(keyed: DataFrame, vectors: DataFrame, crowd: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join with a ``salt``: a vector of more than ``crowd`` rows stands once for
    every ``crowd`` of them, and its rows are dealt over these copies by a hash of their id."""
    parts = F.ceil(F.col("rows") / F.lit(crowd)).cast("int")
    crowded = materialise(vectors.filter(F.col("rows") > crowd).select("key", parts.alias("parts")), "whiten-crowded")
    salted = keyed.join(broadcast_if_small(crowded, 160), "key", "left").select(
        "id", "key", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("salt"))
    return salted, vectors.select("key", "dim", "deviation", "white", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))


def _identity_errors(projected: DataFrame, sums: dict[int, tuple[int, list[int]]], widths: dict[int, int], components: int) -> dict[int, float | None]:
    """length -> largest absolute entry of (covariance of the coordinates over the fit - identity)."""
    w = [F.get("white", i) for i in range(components)]
    weight = F.col("weight").cast("double")
    means = {r["dim"]: r for r in projected.groupBy("dim").agg(*[(F.sum(weight * c) / F.sum(F.when(c.isNotNull(), weight))).alias(f"m{i}") for i, c in enumerate(w)]).collect()}
    if not means:
        return {}
    table = F.broadcast(projected.sparkSession.createDataFrame([tuple(r) for r in means.values()], ", ".join(["dim int", *[f"m{i} double" for i in range(components)]])))
    centred = [c - F.col(f"m{i}") for i, c in enumerate(w)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    products = projected.join(table, "dim").groupBy("dim").agg(*[F.sum(weight * centred[i] * centred[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    errors = {}
    for r in products:
        n = sums[r["dim"]][0]
        off = [abs(r[f"p{i}_{j}"] / n - (i == j)) for i, j in pairs if j < widths[r["dim"]] and r[f"p{i}_{j}"] is not None]
        errors[r["dim"]] = max(off) if off else None
    return errors
