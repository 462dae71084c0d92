"""Table maintenance on plain Parquet (K3-K9, M1-M8).

Parquet tables have no UPDATE / DELETE / MERGE, so every change is "new version =
expression over the old version". Writes are idempotent: a version directory is named by
the micro-batch id (or a caller-given version) and rewritten whole on replay.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickspark.operators.common import prune_months, ts

CLICK_BLOOM_COLUMNS = ("short_code", "country", "browser", "os")
# Parquet writes a column's bloom filter only when the chunk is not fully dictionary-encoded
# (dictionary filtering already covers low-cardinality chunks); adaptive sizing fits the
# filter to the chunk's real distinct count instead of a fixed 1 MiB.
CLICK_WRITE_OPTIONS = {"compression": "zstd", "parquet.bloom.filter.adaptive.enabled": "true",
                       **{f"parquet.bloom.filter.enabled#{c}": "true" for c in CLICK_BLOOM_COLUMNS}}


def write_click_table(clicks: DataFrame, path: str, mode: str = "append", compact: bool = False,
                      only_months: bool = False) -> None:
    """K3 / K4: monthly partitions, rows ordered by (code, time) inside each file, zstd, and
    Parquet bloom filters on the high-selectivity filter columns.

    Ingest (``compact=False``) never shuffles: each task sorts its own rows by
    (month, code, time), which also satisfies the partitioned writer's ordering, so row-group
    min/max on ``short_code`` / ``clicked_at`` stay tight for pushed-down filters.
    Compaction (``compact=True``, M5) additionally clusters codes into files with the
    AQE ``rebalance`` hint, which splits hot codes and merges small partitions.
    ``mode="overwrite"`` replaces the table, with ``only_months`` just the months in ``clicks``."""
    df = clicks
    if "clicked_month" not in df.columns:
        df = df.withColumn("clicked_month", F.date_format("clicked_date", "yyyyMM"))
    if compact:
        df = df.hint("rebalance", "clicked_month", "short_code")
    df = df.sortWithinPartitions("clicked_month", "short_code", "clicked_at")
    writer = df.write.mode(mode).partitionBy("clicked_month") \
        .option("partitionOverwriteMode", "dynamic" if only_months else "static")
    for key, value in CLICK_WRITE_OPTIONS.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read_click_table(spark: SparkSession, path: str, start_date=None, end_date=None,
                     codes: list[str] | None = None) -> DataFrame:
    """Click table scan. Date bounds also become bounds on the ``clicked_month`` partition
    column (Catalyst cannot derive the month from the date), so whole months are pruned; the
    code filter is pushed to Parquet (row-group stats + bloom filters). Of a table under a commit log
    (``operators.snapshots``) only committed folders of the months asked for are listed."""
    from clickspark.operators import snapshots as sn
    store, _, table = path.rstrip("/").rpartition("/")
    if sn.is_committed(spark, store):
        month = lambda day: None if day is None else str(day)[:7].replace("-", "")
        df = sn.read(spark, store, table, months=(month(start_date), month(end_date)))
    else:
        df = spark.read.parquet(path)
    if start_date is not None:
        df = df.where((F.col("clicked_month") >= F.date_format(F.lit(str(start_date)).cast("date"), "yyyyMM"))
                      & (F.col("clicked_date") >= F.lit(str(start_date)).cast("date")))
    if end_date is not None:
        df = df.where((F.col("clicked_month") <= F.date_format(F.lit(str(end_date)).cast("date"), "yyyyMM"))
                      & (F.col("clicked_date") <= F.lit(str(end_date)).cast("date")))
    if codes:
        df = df.where(F.col("short_code").isin(list(codes)))
    return df


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """URL table with NULL text normalised to the empty string."""
    df = spark.read.parquet(path)
    return df.withColumn("user_id", F.coalesce("user_id", F.lit("")))


def find_users(users: DataFrame, emails: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Users by email or id; the password hash is never loaded."""
    out = users.select(*[c for c in users.columns if c != "password_hash"])
    if emails:
        out = out.where(F.col("email").isin(emails))
    if ids:
        out = out.where(F.col("id").isin(ids))
    return out


def upsert_by_key(base: DataFrame, delta: DataFrame, key: str, version: str) -> DataFrame:
    """K5 / M8: last write wins per key (largest ``version``; delta wins ties).

    Implemented as union + ``max_by`` aggregation: partial aggregation keeps one row per key
    per map task, so a key updated millions of times is never sorted inside one task."""
    tagged = (base.withColumn("_src", F.lit(0)).unionByName(delta.withColumn("_src", F.lit(1)),
                                                            allowMissingColumns=True))
    cols = [c for c in tagged.columns if c not in (key, "_src")]
    order = F.struct(F.col(version), F.col("_src"))
    picked = tagged.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_row"))
    return picked.select(key, "_row.*")


def delete_keys(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """K7 / M2: remove documents whose key is in ``keys``; missing keys are fine."""
    return docs.join(keys.select(key).distinct(), key, "left_anti")


def delete_report(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """M2: for each requested key, whether it existed (found / not found)."""
    present = docs.select(key).distinct().withColumn("found", F.lit(True))
    return keys.select(key).distinct().join(present, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def partial_update_clicks(docs: DataFrame, counts: DataFrame, as_of=None) -> DataFrame:
    """K8: set ``clicks`` from ``counts`` (``short_code, clicks``) where present; unknown keys
    in ``counts`` are ignored; updated documents get ``updated_at`` (M7)."""
    c = counts.select("short_code", F.col("clicks").alias("_new"))
    out = docs.join(c, "short_code", "left")
    out = out.withColumn("clicks", F.coalesce("_new", "clicks"))
    if as_of is not None:
        prev = F.col("updated_at") if "updated_at" in docs.columns else F.lit(None).cast("timestamp")
        out = out.withColumn("updated_at", F.when(F.col("_new").isNotNull(), ts(as_of)).otherwise(prev))
    return out.drop("_new")


def expired_split(urls: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """M1: (kept, deleted) with deleted = ``expires_at < as_of`` (strict; equal is kept, T9)."""
    gone = F.col("expires_at").isNotNull() & (F.col("expires_at") < ts(as_of))
    return urls.where(~gone), urls.where(gone)


def _cutoff_date(as_of, days: int) -> dt.date:
    return dt.date.fromisoformat(str(as_of)[:10]) - dt.timedelta(days=days)


def retention(clicks: DataFrame, as_of, days: int) -> DataFrame:
    """M3 / M4: rows with ``clicked_date >= as_of_date - days``. On a table partitioned by month the
    older months are pruned and only the boundary month is filtered row by row."""
    cutoff = _cutoff_date(as_of, days)
    return prune_months(clicks, start=cutoff).where(F.col("clicked_date") >= F.lit(cutoff))


def drop_expired(spark: SparkSession, path: str, as_of, days: int) -> list[str]:
    """M3 / M4 as a job on the stored click table: the boundary month is rewritten without its
    expired rows and every month before it is removed as a folder. Returns the removed months.
    Running it again changes nothing. A table under a commit log changes by one commit."""
    from clickspark.operators import snapshots as sn
    store, _, table = path.rstrip("/").rpartition("/")
    if sn.is_committed(spark, store):
        return sn.drop_expired(spark, store, as_of, days, table)
    cutoff = _cutoff_date(as_of, days)
    month = cutoff.strftime("%Y%m")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    months = {st.getPath().getName().removeprefix("clicked_month="): st.getPath()
              for st in fs.listStatus(root) if st.getPath().getName().startswith("clicked_month=")}
    if month in months:
        boundary = spark.read.parquet(path).where(F.col("clicked_month") == month)
        expired = boundary.where(F.col("clicked_date") < F.lit(cutoff))
        if not expired.isEmpty():
            kept = boundary.where(F.col("clicked_date") >= F.lit(cutoff))
            if kept.isEmpty():
                fs.delete(months[month], True)
            else:
                write_click_table(kept, path, mode="overwrite", only_months=True)
    old = sorted(m for m in months if m < month)
    for m in old:
        fs.delete(months[m], True)
    return old


def rewrite_cold(clicks: DataFrame, path: str, as_of, cold_days: int = 7) -> None:
    """M5: rewrite the months that end before ``as_of - cold_days``, clustered by code.

    Only whole cold months are touched, so each replaced partition is replaced by all of its own
    rows; the month of the cutoff and later ones stay as they are. ``path`` may be the folder that
    ``clicks`` is read from: the new files are put in place after they are complete. A table under a
    commit log is rewritten from its committed rows, by one commit."""
    from clickspark.operators import snapshots as sn
    store, _, table = path.rstrip("/").rpartition("/")
    if sn.is_committed(clicks.sparkSession, store):
        sn.rewrite_cold(clicks.sparkSession, store, as_of, cold_days, table)
        return
    month = _cutoff_date(as_of, cold_days).strftime("%Y%m")
    if "clicked_month" not in clicks.columns:
        clicks = clicks.withColumn("clicked_month", F.date_format("clicked_date", "yyyyMM"))
    cold = clicks.where(F.col("clicked_month").cast("string") < F.lit(month))
    write_click_table(cold, path, mode="overwrite", compact=True, only_months=True)


def trim_landing(landing: DataFrame, keep_newest: int, time_col: str = "ingested_at",
                 file_col: str | None = None) -> DataFrame:
    """M6: landing files that hold none of the ``keep_newest`` newest rows, hence may be deleted.

    A file qualifies if the files that lie wholly after its newest row hold ``keep_newest`` rows
    already. Exact counts and times per file are one aggregate; the running sum over files, newest
    first, sees one row per file and bound. ``file_col`` names the file of a row (default: the
    input file)."""
    micros = F.unix_micros(F.col(time_col))
    name = F.col(file_col) if file_col else F.input_file_name()
    files = landing.select(name.alias("file"), micros.alias("_t")).groupBy("file").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_oldest"), F.max("_t").alias("_newest"))
    bounds = files.select(F.explode(F.array(
        F.struct(F.col("_oldest").alias("_at"), F.col("_n").alias("_n"), F.lit(None).cast("string").alias("file")),
        F.struct(F.col("_newest").alias("_at"), F.lit(0).cast("bigint").alias("_n"), F.col("file").alias("file")))).alias("b")).select("b.*")
    newer = Window.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    counted = bounds.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    return counted.where(F.col("file").isNotNull() & (F.col("_newer") >= keep_newest)).select(
        "file", F.timestamp_micros("_at").alias("newest"))


def export_bulk_ndjson(docs: DataFrame, index: str, id_col: str) -> DataFrame:
    """K6: action line + document line per row (bulk-upsert NDJSON), one text column."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(id_col).alias("_id")).alias("index")))
    doc = F.to_json(F.struct(*[F.col(c) for c in docs.columns]))
    return docs.select(F.concat_ws("\n", action, doc).alias("value"))


def dedup_events(events: DataFrame, key: str = "event_id", order_col: str = "processed_at") -> DataFrame:
    """X4 (batch twin): one row per event id, the earliest processed copy.

    Aggregation with ``min_by`` (partial per map task) instead of a window over the key."""
    cols = [c for c in events.columns if c != key]
    picked = events.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_row"))
    return picked.select(key, "_row.*")


def stream_health(landing: DataFrame, time_col: str = "clicked_at", backlog_threshold: int = 10000,
                  processed: DataFrame | None = None, id_col: str = "event_id") -> DataFrame:
    """Length, first and last entry time of the landing table, its unprocessed entries
    (those whose id is not in ``processed``; all of them without it) and an alert when they are
    more than ``backlog_threshold``."""
    stats = landing.agg(F.count(F.lit(1)).alias("length"), F.min(time_col).alias("first_entry"),
                        F.max(time_col).alias("last_entry"))
    waiting = landing if processed is None else landing.join(processed.select(id_col).distinct(), id_col, "left_anti")
    return stats.withColumn("backlog", waiting.select(F.count(F.lit(1))).scalar()) \
        .withColumn("backlog_alert", F.col("backlog") > backlog_threshold)


def by_number(col: str) -> Column:
    """Order of text ids in which ``9`` comes before ``10``."""
    return F.struct(F.length(col).alias("n"), F.col(col).alias("id"))


def user_update_audit(users: DataFrame, updates: DataFrame) -> DataFrame:
    """M8 checks per update (id, name, email), the first that fails: missing id, unknown user, email
    against Q4, email held by another user (exact text), several updates of one user (the smallest
    name and email stays), several acceptable updates to one email (the smallest id stays)."""
    from clickspark.functions import validation as v
    owners = users.groupBy("email").agg(F.min("id").alias("_low"), F.max("id").alias("_high"))  # one row per email
    known = users.select("id").distinct().withColumn("_known", F.lit(True))
    checked = updates.join(owners, "email", "left").join(known, "id", "left")
    reason = (F.when(F.col("id").isNull(), F.lit("missing_id")).when(F.col("_known").isNull(), F.lit("unknown_user"))
              .when(~v.is_valid_email("email"), F.lit("invalid_email"))
              .when((F.col("_low") != F.col("id")) | (F.col("_high") != F.col("id")), F.lit("email_taken")))
    checked = checked.withColumn("reason", reason).drop("_low", "_high", "_known")
    same = F.struct("name", "email")
    first = checked.where(F.col("reason").isNull()).groupBy("id").agg(F.min(same).alias("_one"))
    checked = checked.join(first, "id", "left").withColumn(
        "reason", F.coalesce("reason", F.when(same != F.col("_one"), F.lit("duplicate_update")))).drop("_one")
    winner = checked.where(F.col("reason").isNull()).groupBy("email").agg(F.min(by_number("id"))["id"].alias("_winner"))
    return checked.join(winner, "email", "left").withColumn("reason", F.coalesce(
        "reason", F.when(F.col("id") != F.col("_winner"), F.lit("duplicate_email")))).drop("_winner").select("id", "name", "email", "reason")


def update_users(users: DataFrame, updates: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """M8: apply (id, name, email) updates by key; returns (new users, rejects with reason).

    Accepted updates set name, email and ``updated_at`` (M7) of their user; every other column and
    every other user stays as it is. No two users get one email (see ``user_update_audit``)."""
    audited = user_update_audit(users, updates)
    accepted = audited.where(F.col("reason").isNull()).select(
        "id", F.col("name").alias("_name"), F.col("email").alias("_email"), F.lit(True).alias("_hit")).distinct()
    base = users if "updated_at" in users.columns else users.withColumn("updated_at", F.col("created_at"))
    merged = base.join(accepted, "id", "left").withColumns({
        "name": F.when(F.col("_hit"), F.col("_name")).otherwise(F.col("name")),
        "email": F.when(F.col("_hit"), F.col("_email")).otherwise(F.col("email")),
        "updated_at": F.when(F.col("_hit"), ts(as_of)).otherwise(F.col("updated_at"))}).select(*base.columns)
    return merged, audited.where(F.col("reason").isNotNull())


def publish_clicks(events: DataFrame) -> DataFrame:
    """One JSON stream message per click: mandatory code and time (epoch seconds as
    text), optional fields only when non-empty (``to_json`` drops NULL keys). A click id travels as
    ``message_id``, so that identical clicks stay apart and replays do not."""
    optional = [("event_id", "message_id"), ("ip_address", "ip"), ("user_agent", "user_agent"), ("original_url", "original_url"),
                ("referer", "referer"), ("query_params", "query_params")]
    ts_text = F.unix_seconds(F.col("clicked_at")).cast("string")
    payload = F.struct(
        F.col("short_code").alias("short_code"), ts_text.alias("timestamp"),
        *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(key) for c, key in optional if c in events.columns])
    return events.select(F.to_json(payload).alias("value"))


def replay_clicks(events: DataFrame, landing_dir: str) -> None:
    """K2: bulk re-publish of click messages into the stream's landing folder (one append)."""
    publish_clicks(events).write.mode("append").text(landing_dir)


def expire_urls(urls: DataFrame, as_of, clicks: DataFrame | None = None,
                search_docs: DataFrame | None = None) -> dict[str, DataFrame]:
    """M1 + C7 + K7 (trap T27): the daily expiry job. Returns the kept URL table, the deleted
    keys (their count is the job's result) and, when given, the click detail and search
    documents without the deleted codes, so caches and indexes do not keep stale entries."""
    kept, deleted = expired_split(urls, as_of)
    keys = deleted.select("short_code")
    out = {"urls": kept, "deleted_keys": keys}
    if clicks is not None:
        out["clicks"] = clicks.join(keys.distinct(), "short_code", "left_anti")
    if search_docs is not None:
        out["search_docs"] = delete_keys(search_docs, keys, "short_code")
    return out
