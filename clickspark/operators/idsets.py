"""Exact sets of whole numbers as mergeable rows, for distinct counts that add up over batches.

A set is a few rows per key, one for every 32 768 numbers it reaches into: a list of positions while the
bucket is sparse, a bitmap of 4 KiB from ``DENSE`` members on. Rows of several sets with one key are merged by
lists and ``bitmap_or_agg``, never by adding counts, so a count of merged sets is the count of their union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspark.operators.common import join_keys

DENSE = 2_048
_NUMBERED = 100_000  # rows numbered by one task


def extend_dictionary(values: DataFrame, col: str, known: DataFrame | None = None) -> DataFrame:
    """(``col``, id) for every value of ``values`` besides those ``known`` already: whole numbers from 1
    without gaps; known ids stay. NULL has no id.

    New values are dealt by hash into parts of about 100 000, numbered inside a part, and each part starts
    where the counts of the parts before it end."""
    new = values.select(col).where(F.col(col).isNotNull()).distinct()
    if known is not None:
        new = new.join(known.select(col), col, "left_anti")
    parts = max(1, -(-new.count() // _NUMBERED))
    last = 0 if known is None else (known.agg(F.max("id")).first()[0] or 0)
    dealt = new.withColumn("_part", F.pmod(F.xxhash64(col), F.lit(parts)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", (F.lit(last) + F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(col))
    added = dealt.withColumn("_place", place).join(starts, "_part").select(col, (F.col("_start") + F.col("_place")).cast("bigint").alias("id"))
    return added if known is None else known.select(col, "id").unionByName(added)


def id_sets(rows: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Sets of ``id_col`` (from 1; NULL is no member) by ``keys``: keys, bucket, positions, bitmap."""
    number = F.col(id_col)
    members = rows.where(number.isNotNull()).select(
        *keys, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).cast("smallint").alias("position")).distinct()
    return _rows_of(members, keys)


def _rows_of(members: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and bucket from distinct members, at most 32 768 of each. Members are brought
    together first, so no half-filled bitmap is shuffled."""
    group = [*keys, "bucket"]
    found = members.repartition(*group).groupBy(*group).agg(F.sort_array(F.collect_list("position")).alias("positions"), F.bitmap_construct_agg("position").alias("bitmap"))
    dense = F.size("positions") >= DENSE
    return found.select(*group, F.when(~dense, F.col("positions")).alias("positions"), F.when(dense, F.col("bitmap")).alias("bitmap"))


def merge_sets(sets: DataFrame, keys: list[str]) -> DataFrame:
    """The union of all sets with equal keys, in the same form. Buckets that are a bitmap somewhere become
    one; the others stay lists."""
    group = [*keys, "bucket"]
    tagged = sets.select(*group, "positions", "bitmap").withColumn("_dense", F.max(F.col("bitmap").isNotNull()).over(Window.partitionBy(*group)))
    each = tagged.where(F.col("positions").isNotNull()).select(*group, "_dense", F.explode("positions").alias("position"))
    lists = _rows_of(each.where(~F.col("_dense")).drop("_dense").distinct(), keys)
    bitmaps = each.where("_dense").groupBy(*group).agg(F.bitmap_construct_agg("position").alias("bitmap")).unionByName(
        tagged.where(F.col("bitmap").isNotNull()).select(*group, "bitmap"))
    merged = bitmaps.groupBy(*group).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return lists.unionByName(merged.withColumn("positions", F.lit(None).cast("array<smallint>")))


def set_size() -> Column:
    """Members in one row of a set."""
    return F.coalesce(F.bitmap_count("bitmap"), F.size("positions").cast("bigint"))


def common_positions(positions: str, bitmap: str, other_positions: str, other_bitmap: str) -> Column:
    """Positions of one row of a set that are in a row of another set, of the same bucket, too."""

    def held(bits: str, p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(p.cast("int"), 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(p.cast("int"), F.lit(8)))), F.lit(2)) == 1

    every = F.sequence(F.lit(0), F.lit(32_767)).cast("array<smallint>")
    own = F.when(F.col(bitmap).isNotNull(), F.filter(every, lambda p: held(bitmap, p))).otherwise(F.col(positions))
    return F.when(F.col(other_bitmap).isNotNull(), F.filter(own, lambda p: held(other_bitmap, p))).otherwise(F.array_intersect(own, other_positions))


def with_ids(rows: DataFrame, dictionary: DataFrame, col: str) -> DataFrame:
    """``rows`` with the ``id`` of their ``col``; NULL without one."""
    return join_keys(rows, dictionary.select(col, "id"), [col], "left")
