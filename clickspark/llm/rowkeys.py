"""Whole rows picked by document id and text, for stages whose decisions are made on slim tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspark.llm.storage import broadcast_if_small, materialise


_ROW_BYTES = 160  # of a key in a broadcast table, as measured


def _key(id_col: str, text_hash: Column) -> Column:
    return F.struct(F.col(id_col).cast("long").alias("id"), text_hash.alias("text_hash")).alias("_key")


def take_rows(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` named by ``chosen`` (doc_id, text_hash = xxhash64 of the text, copies, rows).

    Each named row comes back ``copies`` times with all its columns. Where a key has several
    ``rows`` the one with the smallest other columns stands for all. A null id is a value like
    others. ``chosen`` is broadcast if its counted size allows, else both sides are shuffled once.
    """
    named = materialise(chosen.filter("copies > 0").select(_key("doc_id", F.col("text_hash")), "copies", "rows"), "chosen")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(id_col, F.xxhash64(text_col)))
    found = keyed.join(broadcast_if_small(named.filter("rows = 1"), _ROW_BYTES), "_key").select("row", "copies")
    several = named.filter("rows > 1")
    if not several.isEmpty():
        order = Window.partitionBy("_key").orderBy(F.to_json("row"))
        first = keyed.join(broadcast_if_small(several, _ROW_BYTES), "_key").withColumn("place", F.row_number().over(order)).filter("place = 1")
        found = found.unionByName(first.select("row", "copies"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def leave_rows(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that ``dropped`` (doc_id, text_hash) does not name, with all their columns."""
    gone = materialise(dropped.select(_key("doc_id", F.col("text_hash"))).distinct(), "dropped")
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], _key(id_col, F.xxhash64(text_col)))
    return keyed.join(broadcast_if_small(gone, _ROW_BYTES), "_key", "left_anti").drop("_key")
