"""Positions and running totals over a whole table, without one task seeing all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspark.llm.storage import materialise

_INDEX_BITS = 33  # monotonically_increasing_id() keeps the row's index in its low 33 bits


def in_order(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` range-sorted by ``keys`` and written, with ``part`` (range) and ``at`` (row in the range)."""
    return materialise(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
          .withColumn("part", F.spark_partition_id())
          .withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << _INDEX_BITS) - 1)),
        name)


def with_position(df: DataFrame, keys: list[Column], name: str, totals: dict[str, str] | None = None) -> DataFrame:
    """Add ``position`` (rows ahead in the order of ``keys``) and, per entry of ``totals``
    (new column -> summed column), the sum over the rows ahead.

    The rows are range-partitioned, so a value of the leading key may fill any number of ranges;
    only one row per range is brought together to carry the totals over. Rows that agree in all
    keys get neighbouring positions in no fixed order. An empty table stays empty.
    """
    totals = totals or {}
    placed = in_order(df, keys, name)
    carried = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("part").agg(F.count("*").alias("rows"), *[F.sum(v).alias(f"sum_{k}") for k, v in totals.items()])
    ranges = ranges.select(
        "part", F.coalesce(F.sum("rows").over(carried), F.lit(0)).alias("rows_ahead"),
        *[F.coalesce(F.sum(f"sum_{k}").over(carried), F.lit(0)).alias(f"ahead_{k}") for k in totals])
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    for k, v in totals.items():
        placed = placed.withColumn(k, F.coalesce(F.sum(v).over(inside), F.lit(0)))
    # one row per range: bounded by the number of shuffle partitions
    placed = placed.join(F.broadcast(ranges), "part")
    return placed.select(
        *[c for c in df.columns],
        (F.col("rows_ahead") + F.col("at")).alias("position"),
        *[(F.col(k) + F.col(f"ahead_{k}")).alias(k) for k in totals])
