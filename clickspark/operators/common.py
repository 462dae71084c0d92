"""Small building blocks shared by the operators."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ts(value) -> Column:
    """Timestamp literal (session zone is UTC)."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def dt(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def prune_months(df: DataFrame, start=None, end=None, col: str = "clicked_month") -> DataFrame:
    """Add the ``clicked_month`` partition bounds implied by a date/time range, when the frame
    is a partitioned click table (Catalyst cannot derive the month from the date itself).
    The bounds are literals computed here, so the scan prunes whole month directories."""
    if col not in df.columns:
        return df
    import datetime as _dt
    def month(v):
        v = str(v)
        return _dt.date.fromisoformat(v[:10]).strftime("%Y%m")
    if start is not None and not isinstance(start, Column):
        df = df.where(F.col(col) >= month(start))
    if end is not None and not isinstance(end, Column):
        df = df.where(F.col(col) <= month(end))
    return df


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL is a value like others; the keys come back once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def share_pct(part: Column, total: Column) -> Column:
    """``part * 100 / total`` in DOUBLE, rounded to 6 places; NULL when total is 0.
    The reference's scalar-subquery denominator becomes a window sum over the already
    aggregated rows of each code (no join, no second scan)."""
    return F.round(F.try_divide(part.cast("double") * F.lit(100.0), total.cast("double")), 6)


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank_col: str | None = None) -> DataFrame:
    """Keep the first ``n`` rows of every key group under ``order``.

    ``row_number() <= n`` is planned with a partial per-partition group limit before the
    shuffle (WindowGroupLimit), so a hot key ships at most ``n`` rows per map task. The
    order must contain a full tie-break so the cut is deterministic.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank_col or "_rn"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def filter_codes(df: DataFrame, codes: Sequence[str] | None, col: str = "short_code") -> DataFrame:
    """Optional single/multi-code form: a pushed-down ``IN`` filter."""
    return df if not codes else df.where(F.col(col).isin(list(codes)))


def with_scalar_total(page: DataFrame, matched: DataFrame, name: str = "total") -> DataFrame:
    """Attach the match count behind a page (one-row count of ``matched``) as a scalar
    subquery column (no join)."""
    return page.withColumn(name, matched.select(F.count(F.lit(1))).scalar())


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles (``points``: column name -> share) of ``value`` per ``keys``.

    Level 1 counts values in logarithmic buckets (4096 per factor of e, so some 10^5 of them at
    most), and a running sum over the buckets finds those that hold the wanted ranks. Level 2
    ranks the distinct values of those buckets only. No group's values meet in one task."""
    keys = list(keys)
    x = F.col(value).cast("double")
    rows = rows.where(x.isNotNull()).select(*keys, x.alias("_x"), (
        F.signum(x) * F.floor(F.log1p(F.abs(x)) * 4096)).cast("bigint").alias("_b"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))) \
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    place = {name: F.lit(float(p)) * (F.col("_total") - 1) for name, p in points.items()}
    wanted = F.explode(F.array(*[F.struct(
        F.lit(name).alias("name"), F.lit(side).alias("side"), (h - F.floor(h)).alias("part"),
        F.least(F.floor(h) + side, F.col("_total") - 1).alias("rank")) for name, h in place.items() for side in (0, 1)]))
    picks = counted.select(*keys, "_b", "_n", "_before", wanted.alias("w")).where(
        (F.col("_before") <= F.col("w.rank")) & (F.col("w.rank") < F.col("_before") + F.col("_n")))
    inside = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    values = rows.join(picks.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi") \
        .groupBy(*keys, "_b", "_x").agg(F.count(F.lit(1)).alias("_m")) \
        .withColumn("_ahead", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
    at = F.col("w.rank") - F.col("_before")
    found = picks.join(values, [*keys, "_b"]).where((F.col("_ahead") <= at) & (at < F.col("_ahead") + F.col("_m")))

    def one(name: str) -> Column:
        pick = lambda side, what: F.max(F.when((F.col("w.name") == name) & (F.col("w.side") == side), what))
        low, high, part = pick(0, F.col("_x")), pick(1, F.col("_x")), pick(0, F.col("w.part"))
        return (low + (high - low) * part).alias(name)
    return found.groupBy(*keys).agg(*[one(n) for n in points])


def newest_first(df: DataFrame, time_col: str, tie: str) -> DataFrame:
    """L1: newest-first presentation order (with a key tie-break, trap T10)."""
    return df.orderBy(F.desc(time_col), F.asc(tie))


def by_count(df: DataFrame, count_col: str, keys: Sequence[str]) -> DataFrame:
    """L2: per-code top-k presentation order: code, count descending, then the keys."""
    return df.orderBy("short_code", F.desc(count_col), *keys)


def chronological(df: DataFrame, time_col: str) -> DataFrame:
    """L3: per-code series in ascending time order."""
    return df.orderBy("short_code", time_col)
