"""Stored inverted index of the URL table (F12), kept up to date by deltas (K5, K7).

URLs are numbered by creation time and 32 768 of them make a slot. The index has one row per slot and token: how
many URLs, the newest and oldest time, the URLs newest first, and the set of their numbers. A slot's rows are
written together, so a change touches the slots of the URLs it changes and no other, by one commit of the
store (``operators.snapshots``); searches read one version throughout.

A top-k search reads, for each token, the short columns of its rows and then only the rows that can hold one of the
k newest. Totals of single tokens are sums of counts, of several tokens unions of sets; (query, URL) pairs are never
written out beyond k for a token.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickspark.operators import idsets
from clickspark.operators import snapshots as sn
from clickspark.operators.common import top_n_per_key
from clickspark.operators.search import path_steps, path_totals, term_paths, tokens

SLOT = 32_768  # numbers in a bucket of a set
_NO_TIME = -(1 << 62)  # URLs without a creation time are the oldest
_INDEX_BITS = 33  # monotonically_increasing_id() counts a partition's rows in its low 33 bits


def _numbered(spark: SparkSession, store: str, urls: DataFrame, after: int, slot_rows: int) -> DataFrame:
    """``urls`` with ``number`` from rank ``after`` on, in the order of creation. They are range-sorted and
    written beside the store first, so that numbers do not depend on a second sort; one row per range carries the
    ranks over."""
    stage = f"{store}/_stage-{uuid.uuid4().hex}"
    order = [F.coalesce(F.unix_micros("created_at"), F.lit(_NO_TIME)), F.col("short_code")]
    sorted_rows = urls.select("short_code", "long_url", "created_at").repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND((1 << _INDEX_BITS) - 1)).write.parquet(stage)
    rows = spark.read.parquet(stage)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.lit(after) + F.col("_start") + F.col("_at")
    return rows.join(F.broadcast(starts), "_part").select(  # one row per shuffle partition
        "short_code", "long_url", "created_at", (F.floor(rank / slot_rows) * SLOT + rank % slot_rows + 1).cast("bigint").alias("number"))


def _next_rank(docs: DataFrame, slot_rows: int) -> int:
    last = docs.agg(F.max("number")).first()[0]
    return 0 if last is None else (last - 1) // SLOT * slot_rows + (last - 1) % SLOT + 1


def _blocks(docs: DataFrame) -> DataFrame:
    """One row per slot and token from numbered URLs, at most 32 768 URLs in each."""
    time = F.coalesce(F.unix_micros("created_at"), F.lit(_NO_TIME))
    words = F.array_union(tokens(F.col("long_url")), tokens(F.col("short_code")))
    each = docs.select("slot", F.explode(words).alias("token"), time.alias("_time"), "short_code",
                       F.bitmap_bit_position("number").cast("smallint").alias("_position")).repartition("slot", "token")
    found = each.groupBy("slot", "token").agg(
        F.count(F.lit(1)).alias("n"), F.max("_time").alias("newest"), F.min("_time").alias("oldest"),
        F.sort_array(F.collect_list(F.struct((-F.col("_time")).alias("age"), "short_code"))).alias("urls"),
        F.sort_array(F.collect_list("_position")).alias("positions"), F.bitmap_construct_agg("_position").alias("bitmap"))
    dense = F.col("n") >= idsets.DENSE
    return found.withColumn("positions", F.when(~dense, F.col("positions"))).withColumn("bitmap", F.when(dense, F.col("bitmap")))


def _publish(spark: SparkSession, store: str, docs: DataFrame, old: dict[str, list[str]]) -> int:
    """Write the slots of ``docs`` and put them in the place of ``old``."""
    batch_id = sn.own_id()
    slotted = docs.withColumn("slot", F.bitmap_bucket_number("number")).withColumn("batch_id", F.lit(batch_id))
    slotted.hint("rebalance", "slot").sortWithinPartitions("slot", "short_code").write.mode("append").partitionBy("slot", "batch_id").parquet(f"{store}/docs")
    stored = spark.read.option("basePath", f"{store}/docs")
    folders = sn.written(spark, store, "docs", batch_id, ["slot"])
    if folders:
        blocks = _blocks(stored.parquet(*[f"{store}/docs/{f}" for f in folders])).withColumn("batch_id", F.lit(batch_id))
        (blocks.hint("rebalance", "slot").sortWithinPartitions("slot", "token").write.mode("append").partitionBy("slot", "batch_id")
         .option("compression", "zstd").option("parquet.bloom.filter.adaptive.enabled", "true")
         .option("parquet.bloom.filter.enabled#token", "true").parquet(f"{store}/blocks"))
    add = {t: sn.written(spark, store, t, batch_id, ["slot"]) for t in ("docs", "blocks")}
    return sn.commit(spark, store, add, old)


def build(urls: DataFrame, store: str, slot_rows: int = SLOT) -> int:
    """Index ``urls`` (short_code unique and not NULL, long_url, created_at); returns the version."""
    spark = urls.sparkSession
    live = sn.snapshot(spark, store).live
    kept = urls.where(F.col("short_code").isNotNull())
    return _publish(spark, store, _numbered(spark, store, kept, 0, slot_rows), {t: f for t, f in live.items() if f})


_DOCS = "short_code string, long_url string, created_at timestamp, number bigint, slot bigint, batch_id bigint"


def refresh(spark: SparkSession, store: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, slot_rows: int = SLOT) -> int:
    """Apply a delta: ``upserts`` (short_code unique, long_url, created_at) are new URLs or replace those with
    their code, ``deletes`` (short_code) go; a code in both stays, as upserted. Unknown deletes are fine (K7).

    Changed URLs keep their number, new ones go on after the last; only slots with a change are written again. The
    numbers of the changed slots reach the driver."""
    docs = sn.read(spark, store, "docs", schema=_DOCS)
    fresh = (docs.select("short_code", "long_url", "created_at").limit(0) if upserts is None
             else upserts.where(F.col("short_code").isNotNull()).select("short_code", "long_url", "created_at"))
    gone = fresh.select("short_code") if deletes is None else fresh.select("short_code").unionByName(deletes.select("short_code")).distinct()
    touched = docs.select("short_code", "number", "slot").join(gone, "short_code")
    changed = fresh.join(touched.select("short_code", "number"), "short_code")
    new = _numbered(spark, store, fresh.join(docs.select("short_code"), "short_code", "left_anti"), _next_rank(docs, slot_rows), slot_rows)
    slots = {r[0] for r in touched.select("slot").unionByName(new.select(F.bitmap_bucket_number("number").alias("slot"))).distinct().collect()}
    live = sn.snapshot(spark, store).live
    old = {t: [f for f in folders if int(f.split("/")[0].removeprefix("slot=")) in slots] for t, folders in live.items()}
    kept = sn.read(spark, store, "docs", schema=_DOCS, only=old.get("docs", [])).select("short_code", "long_url", "created_at", "number")
    rows = kept.join(gone, "short_code", "left_anti").unionByName(changed.select(*kept.columns)).unionByName(new.select(*kept.columns))
    return _publish(spark, store, rows, {t: f for t, f in old.items() if f})


_BLOCKS = ("token string, n bigint, newest bigint, oldest bigint, urls array<struct<age: bigint, short_code: string>>, "
           "positions array<smallint>, bitmap binary, slot bigint, batch_id bigint")


def needed_blocks(directory: DataFrame, k: int) -> DataFrame:
    """(token, slot) of the rows that can hold one of a token's ``k`` newest URLs.

    Taken by falling oldest time, the first rows that hold ``k`` URLs together prove that k are at least as new as
    the last of them; rows whose newest URL is older cannot matter. Slots may overlap in time in any way."""
    upto = Window.partitionBy("token").orderBy(F.desc("oldest"), "slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enough = F.when(F.sum("n").over(upto) >= k, F.col("oldest"))
    sure = F.max("_enough").over(Window.partitionBy("token"))
    marked = directory.withColumn("_enough", enough).withColumn("_sure", sure)
    return marked.where(F.col("_sure").isNull() | (F.col("newest") >= F.col("_sure"))).select("token", "slot")


def bulk_search(spark: SparkSession, store: str, queries: DataFrame, per_query: int = 20, version: int | None = None) -> DataFrame:
    """F12 from the stored index: what ``search.bulk_url_search`` returns for the URLs of that version."""
    blocks = sn.read(spark, store, "blocks", version, schema=_BLOCKS).drop("batch_id")
    asked = queries.select("query_id", F.sort_array(tokens(F.col("q"))).alias("_terms"))
    terms = asked.select(F.explode("_terms").alias("token")).distinct()
    directory = blocks.select("token", "slot", "n", "newest", "oldest").join(terms, "token")
    found = blocks.select("token", "slot", F.slice("urls", 1, per_query).alias("urls")).join(needed_blocks(directory, per_query), ["token", "slot"])
    each = found.select("token", F.explode("urls").alias("u")).select("token", "u.age", "u.short_code")
    newest = [F.asc("age"), F.asc("short_code")]
    per_token = top_n_per_key(each, ["token"], newest, per_query)
    hits = asked.select("query_id", F.explode("_terms").alias("token")).join(per_token, "token").select("query_id", "age", "short_code").distinct()
    top = top_n_per_key(hits, ["query_id"], newest, per_query, rank_col="rank")
    created = F.when(F.col("age") != -_NO_TIME, F.timestamp_micros(-F.col("age")))
    totals = asked.join(_totals(blocks, directory, asked.select("_terms").distinct()), "_terms").select("query_id", "total")
    return top.select("query_id", "short_code", created.alias("created_at"), "rank").join(totals, "query_id")


_PATH_TERMS = 16  # of a list of more known terms the sets are united


def _totals(blocks: DataFrame, directory: DataFrame, asked: DataFrame) -> DataFrame:
    """(``_terms``, total): URLs with any of the terms. Lists of terms are looked up once, however many queries
    share them; a list of which the index knows one term needs counts alone.

    Of the others (see ``search.term_paths``) each path takes the set of its last term, slot by slot, to those
    of the terms before it in the same slot: only members of that last and rarest term go on from there, so a frequent
    term's set is not copied for every list it stands in. Terms before are paired with the last one, which is many
    pairs for a long list; there the sets are united instead. A URL that a delta brought twice is two in a count
    and one in a set."""
    counts = directory.groupBy("token").agg(F.sum("n").alias("n"))
    each = asked.select("_terms", F.explode("_terms").alias("token"))
    single = each.join(counts, "token").groupBy("_terms").agg(F.count(F.lit(1)).alias("_known"), F.sum("n").alias("total")).where("_known = 1")
    sets = blocks.select("token", F.col("slot").alias("bucket"), F.array_distinct("positions").alias("positions"), "bitmap") \
        .join(each.select("token").distinct(), "token", "left_semi")
    known, paths = term_paths(asked, sets.groupBy("token").agg(F.sum(idsets.set_size()).alias("n")))
    short, long = known.where(F.col("_found").between(2, _PATH_TERMS)), known.where(F.col("_found") > _PATH_TERMS)
    paths = paths.join(short.select("_terms"), "_terms", "left_semi")
    last = path_steps(paths).join(sets, "token").select("_path", "bucket", "positions", "bitmap", F.explode("_before").alias("token"))
    others = sets.withColumnsRenamed({"positions": "_positions", "bitmap": "_bitmap"})
    common = last.join(others, ["token", "bucket"]).select("_path", "bucket", idsets.common_positions("positions", "bitmap", "_positions", "_bitmap").alias("_common"))
    shared = common.groupBy("_path", "bucket").agg(F.size(F.array_distinct(F.flatten(F.collect_list("_common")))).alias("_n")) \
        .groupBy("_path").agg(F.sum("_n").alias("_shared"))
    listed = long.select("_terms", F.explode("_terms").alias("token")).join(sets, "token").drop("token")
    united = idsets.merge_sets(listed, ["_terms"]).groupBy("_terms").agg(F.sum(idsets.set_size()).alias("total"))
    return single.select("_terms", "total").unionByName(path_totals(short, paths, shared)).unionByName(united)
