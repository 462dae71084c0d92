"""Sharding by longest processing time: whole groups, largest first, to the least-loaded shard."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.llm.ranks import with_position
from clickspark.llm.storage import materialise


def least_loaded(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """(unit, shard) for units given as (unit, size): sorted by falling size, each unit goes to the
    shard on top of a heap of (load, shard). Equal sizes go in the order of their unit numbers."""
    heap = [(0, shard) for shard in range(shards)]
    placed = []
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed.append((unit, shard))
    return placed


def shard_groups(items: DataFrame, group: str, size: str, shards: int, fineness: int = 32) -> DataFrame:
    """(``group``, ``shard``) for every group of ``items``; a group is never split.

    Groups are ordered by falling size. Neighbours are bundled into units that take at most
    1 / (shards * fineness) of what is still to be placed, so a group above that is a unit of its
    own and the units shrink towards the end, where balance is decided. The heap sees only units:
    at most ``shards * fineness * ln(total / smallest)`` of them, some 40,000 at 100 TB and 40
    shards. Up to that number of groups this is plain LPT. Sizes must be positive.
    """
    spark = items.sparkSession
    groups = items.groupBy(group).agg(F.sum(size).alias("group_size"))
    ordered = with_position(groups, [F.col("group_size").desc(), F.col(group)], "shard-groups", {"before": "group_size"})
    ordered = materialise(ordered, "shard-order")
    total = ordered.agg(F.sum("group_size")).first()[0] or 0
    unit = F.floor(F.lit(float(shards * fineness)) * F.log(F.lit(float(total)) / (F.lit(float(total)) - F.col("before"))))
    ordered = ordered.withColumn("unit", unit.cast("long"))
    units = [(r["unit"], r["size"]) for r in ordered.groupBy("unit").agg(F.sum("group_size").alias("size")).collect()]
    placed = spark.createDataFrame(least_loaded(units, shards), "unit long, shard int")
    return ordered.join(F.broadcast(placed), "unit").select(group, "shard")  # bounded by the units


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                    overhead: int = 16, fineness: int = 32) -> DataFrame:
    """Shard and slot of every document; documents of equal text stay together.

    A document weighs its UTF-8 bytes plus ``overhead``. Returns ``id_col``, ``size``,
    ``text_crc32`` (unsigned), ``shard`` and ``slot`` (gapless from 0 in each shard, in the order of
    the id, nulls first). A null text counts as an empty one and joins its group; repeated rows each
    get a slot of their own; an empty table gives no rows. Other columns are not read.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = materialise(docs.select(
        F.col(id_col), (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("text_key")), "shard-docs")
    groups = shard_groups(keyed, "text_key", "size", shards, fineness)
    placed = keyed.join(groups, "text_key").select(id_col, "size", "text_crc32", "shard")
    numbered = materialise(with_position(
        placed, [F.col("shard"), F.col(id_col), F.col("text_crc32"), F.col("size")], "shard-slots"), "shard-placed")
    first = numbered.groupBy("shard").agg(F.min("position").alias("first"))  # one row per shard
    return numbered.join(F.broadcast(first), "shard").select(
        id_col, "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"))
