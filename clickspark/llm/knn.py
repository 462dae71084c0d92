"""Exact top-k inner products by a Voronoi join.

Queries and data are grouped by their nearest pivot. A data cell (pivot o, radius s) and a query cell
(pivot p, radius r) differ from p.o by at most s|p| + r|o| + rs in every product of their members. The
lower bounds of the data cells and their counts give a floor that each query of a cell reaches without
its own row, and data cells whose upper bound lies below the floor are dropped as a whole. Vectors of
the others are tried one by one: p.x - r|x| <= q.x <= p.x + r|x|; the (k + 1)-th largest of their lower
bounds raises the floor, and a vector whose upper bound lies below it is not sent to that cell. What is
sent is solved exactly, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspark.llm.storage import materialise

_LONG = (-(1 << 63), (1 << 63) - 1)
_SLACK = 1e-9  # relative room for rounding in the bounds


def whole_numbers(vector: str) -> Column:
    """floor(256 * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable(vector: str) -> Column:
    infinity = F.lit(float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity))


def by_length(vectors: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, matrix) of the vectors of each length."""
    lengths = vectors.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), at, np.array(vectors.iloc[at].tolist(), dtype=np.int64).reshape(len(at), int(n))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows, saturated to the range of a long."""
    most = max((int(max(abs(int(m.max())), abs(int(m.min())))) for m in (q, x) if m.size), default=0)
    if q.shape[1] * most * most < 1 << 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return np.clip(q.astype(object) @ x.T.astype(object), *_LONG).astype(np.int64)


def best_of(q_rows: np.ndarray, q_ids: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of ``x`` for each query, its own row left out, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    rows, ids, x = rows[order], ids[order], x[order]
    found = []
    for at in range(0, len(q), 256):
        score = products(q[at:at + 256], x)
        other = q_rows[at:at + 256, None] != rows[None, :]
        m = score.shape[1]
        # a query's own row lowers the floor by one place
        floor = np.partition(score, m - k - 1, axis=1)[:, m - k - 1] if m > k + 1 else np.full(len(score), _LONG[0])
        row, col = np.nonzero((score >= floor[:, None]) & other)
        value = score[row, col]
        order = np.lexsort((col, -value.astype(np.float64), row)) if abs(value).max(initial=0) < 1 << 53 else np.array(
            sorted(range(len(row)), key=lambda i: (row[i], -int(value[i]), col[i])), dtype=int)
        row, col, value = row[order], col[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        asked = row[keep] + at
        found.append(pd.DataFrame({"query_row": q_rows[asked], "query_id": q_ids[asked], "vec_id": ids[col[keep]], "score": value[keep]}))
    return pd.concat(found, ignore_index=True) if found else NOTHING


NOTHING = pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)


class Cells:
    """Pivots by vector length; the zero vector is a pivot of every length and has number 0."""

    def __init__(self, pivots: list[list[int]]):
        self.lengths: dict[int, np.ndarray] = {}
        for n in {len(p) for p in pivots}:
            rows = [p for p in pivots if len(p) == n]
            self.lengths[n] = np.array([[0] * n, *rows], dtype=np.float64).reshape(len(rows) + 1, n)

    def of(self, n: int) -> np.ndarray:
        return self.lengths.get(n, np.zeros((1, n)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of every row."""
        p = self.of(x.shape[1])
        squares = (x ** 2).sum(axis=1)[:, None] - 2 * (x @ p.T) + (p ** 2).sum(axis=1)[None, :]
        cell = squares.argmin(axis=1)
        return cell, np.sqrt(((x - p[cell]) ** 2).sum(axis=1))


def by_cell(batch: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(length, cell, positions, matrix) of the vectors of each data cell."""
    for n, at, x in by_length(batch["v"]):
        cells = batch["cell"].to_numpy()[at]
        for cell in np.unique(cells):
            here = cells == cell
            yield n, int(cell), at[here], x[here]


def related_cells(cells: Cells, asked: dict[tuple[int, int], tuple[float, int]], held: dict[tuple[int, int], tuple[float, int]],
                  k: int) -> tuple[dict[tuple[int, int], list[int]], dict[tuple[int, int], float]]:
    """({data cell: query cells that need it}, {query cell: floor}) from the summaries (radius, rows) of
    the query cells and the data cells alone.

    A floor is the largest bound that k + 1 rows at least reach, going by the lower bounds of their cells.
    """
    near: dict[tuple[int, int], list[int]] = {c: [] for c in held}
    floors: dict[tuple[int, int], float] = {}
    for n in {m for m, _ in held}:
        data = [c for m, c in held if m == n]
        o, rows = cells.of(n)[data], np.array([held[n, c][1] for c in data])
        radius = np.array([held[n, c][0] for c in data])
        for cell in (c for m, c in asked if m == n):
            p, r = cells.of(n)[cell], asked[n, cell][0]
            size, far = float(np.sqrt(p @ p)), np.sqrt((o ** 2).sum(axis=1))
            centre, spread = o @ p, radius * size + r * far + r * radius + _SLACK * (size + r + 1) * (far + radius + 1)
            low = centre - spread
            order = np.argsort(-low)
            enough = np.flatnonzero(np.cumsum(rows[order]) > k)
            floors[n, cell] = float(low[order[enough[0]]]) if len(enough) else -math.inf
            for c, reached in zip(data, centre + spread >= floors[n, cell], strict=True):
                if reached:
                    near[n, c].append(cell)
    return near, floors


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          pivots: int = 64, group_queries: int = 4096, chunk_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query with all other rows.

    ``is_query`` is a condition on ``id_col``. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part. Rows are told apart by themselves, not by their
    ids: of rows that repeat an id each is a candidate, also for the others, and each that is a query
    has its own ranks. Only vectors of equal length have a product; empty ones have product
    0. Ties go to the smaller id; scores beyond a long saturate. A query with fewer than k partners
    gets them all; an empty table gives no rows. Other columns are not read.

    Pivots are the ``pivots`` vectors with the smallest id hashes. A query cell above
    ``group_queries`` is cut and small ones share a group; the vectors sent to a group are dealt
    to chunks of about ``chunk_rows``, so no task holds more than one chunk and one group.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), whole_numbers(vector_col).alias("v"), is_query.alias("is_query"))
    # written, so that a row keeps its number whatever is computed again
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    cells = Cells([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(pivots).select("v").collect()])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.assign(n=0, cell=0, away=0.0)
            for n, at, x in by_length(batch["v"]):
                cell, away = cells.nearest(x.astype(np.float64))
                out.iloc[at, out.columns.get_loc("n")] = n
                out.iloc[at, out.columns.get_loc("cell")] = cell
                out.iloc[at, out.columns.get_loc("away")] = away
            yield out

    placed = materialise(rows.mapInPandas(assign, "id long, v array<long>, is_query boolean, row long, n int, cell int, away double"), "cells")
    # one row per cell: at most pivots + 1 for each vector length
    reach, asks = F.max("away"), F.col("is_query")
    cell_rows = placed.groupBy("n", "cell").agg(reach.alias("radius"), F.count("*").alias("rows"), F.max(F.when(asks, F.col("away"))).alias("asked_radius"),
                                                F.count(F.when(asks, True)).alias("queries")).collect()
    summary = {(r["n"], r["cell"]): (r["asked_radius"] * (1 + _SLACK), r["queries"]) for r in cell_rows if r["queries"]}
    held = {(r["n"], r["cell"]): (r["radius"] * (1 + _SLACK), r["rows"]) for r in cell_rows}
    total = sum(count for _, count in held.values())
    near, cell_floors = related_cells(cells, summary, held, k)

    def bounds(n: int, cell: int, x: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(query cells that need the data cell, p.x, r|x| widened for rounding) of vectors of one data cell."""
        known = near[n, cell]
        x = x.astype(np.float64)
        size = np.sqrt((x ** 2).sum(axis=1))
        p = cells.of(n)[known]
        radius = np.array([summary[n, c][0] for c in known])
        room = _SLACK * (np.sqrt((p ** 2).sum(axis=1))[None, :] + 1) * (size[:, None] + 1)
        return known, x @ p.T, size[:, None] * radius[None, :] + room

    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, cell, _, x in by_cell(batch):
                known, centre, spread = bounds(n, cell, x)
                best = -np.sort(-(centre - spread), axis=0)[:k + 1]
                yield pd.DataFrame({"n": n, "cell": np.tile(known, len(best)), "bound": best.ravel()}).astype({"cell": "int64"})

    ranked = Window.partitionBy("n", "cell").orderBy(F.col("bound").desc())
    floors = (placed.select("v", "n", "cell").mapInPandas(lower, "n int, cell int, bound double")
              .withColumn("place", F.row_number().over(ranked)).filter(F.col("place") == k + 1))
    floors = {(r["n"], r["cell"]): r["bound"] for r in floors.collect()}
    floors = {c: max(floors.get(c, -np.inf), cell_floors[c]) for c in summary}

    # groups of query cells: cells are cut at group_queries, and filled up to it
    groups: dict[tuple[int, int], list[int]] = {}
    number, load, length = 0, 0, None
    for (n, cell), (_, queries) in sorted(summary.items()):
        parts = math.ceil(queries / group_queries)
        if length is not None and (n != length or parts > 1 or load + queries > group_queries):
            number, load = number + 1, 0
        groups[n, cell] = list(range(number, number + parts))
        number, load, length = number + parts - 1, load + (queries if parts == 1 else group_queries), n
    chunks = max(1, math.ceil(total / chunk_rows))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.empty(len(batch), dtype=object)
            for n, cell, at, x in by_cell(batch):
                known, centre, spread = bounds(n, cell, x)
                needed = centre + spread >= np.array([floors[n, c] for c in known])[None, :]
                for i, row in zip(at, needed, strict=True):
                    out[i] = sorted({g for c, yes in zip(known, row, strict=True) if yes for g in groups[n, c]})
            yield batch[["row", "id", "v"]].assign(groups=out)

    data = placed.select("row", "id", "v", "n", "cell").mapInPandas(send, "row long, id long, v array<long>, groups array<int>")
    data = data.select("row", "id", "v", F.explode("groups").alias("grp"), F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"))

    homes = spark.createDataFrame([(n, c, g[0], len(g)) for (n, c), g in groups.items()], "n int, cell int, home int, parts int")
    asked = placed.filter("is_query").join(F.broadcast(homes), ["n", "cell"]).select(  # as bounded as the summary
        "row", "id", "v", (F.col("home") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int").alias("grp"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def solve(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return NOTHING
        matrix = lambda t: np.array(t["v"].tolist(), dtype=np.int64).reshape(len(t), -1)  # noqa: E731  a group has one length
        return best_of(q["row"].to_numpy(), q["id"].to_numpy(), matrix(q), x["row"].to_numpy(), x["id"].to_numpy(), matrix(x), k)

    found = data.groupBy("grp", "chunk").cogroup(asked.groupBy("grp", "chunk")).applyInPandas(solve, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
