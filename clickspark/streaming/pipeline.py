"""Micro-batch pipelines (X1-X7, X9, X11, X12) built from the batch operators.

The sinks of the enrichment pipeline are tables of one committed store (``operators.snapshots``): a
micro-batch writes its folders and publishes all of them by one commit, so readers see a batch in
every sink or in none, and a batch that is delivered again after its commit is left out. The other
sinks are keyed by the micro-batch id and written with dynamic partition overwrite, so a replayed
batch rewrites exactly its own output.
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from clickspark.operators import enrich as en
from clickspark.operators import reports as rp
from clickspark.operators import resolve as rs
from clickspark.operators import rollups as ru
from clickspark.operators import snapshots as sn
from clickspark.operators import tables as tb
from clickspark.operators.common import prune_months
from clickspark.streaming import sources as src

log = logging.getLogger(__name__)

ROLLUPS = list(ru.ROLLUP_KEYS)


def _write_batch(df: DataFrame, path: str, batch_id: int, partition_cols: list[str] | None = None,
                 fmt: str = "parquet", sort_cols: list[str] | None = None, options: dict | None = None) -> None:
    """Idempotent per-batch write: the batch's partitions are replaced, others untouched."""
    out = df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    parts = (partition_cols or []) + ["batch_id"]
    if sort_cols:
        out = out.sortWithinPartitions(*parts, *sort_cols)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    for key, value in (options or {}).items():
        writer = writer.option(key, value)
    writer.partitionBy(*parts).format(fmt).save(path)


CLICK_FILE_OPTIONS = tb.CLICK_WRITE_OPTIONS


ARRIVAL_COL = "_arrival"

#: The enrichment sinks: partition columns before the batch id.
SINKS = {"clicks": ["clicked_month"], "rollups": ["rollup"], "search": [], "quarantine": []}
STREAM = "enrichment"


class StopRequested(RuntimeError):
    """Raised before a batch begins when the job was asked to stop; the batch before is committed."""


def request_stop(spark: SparkSession, out_dir: str) -> None:
    """X11: ask the running enrichment query to stop. The batch under way is finished and committed; the next
    one does not begin, and stays in the checkpoint for the next start."""
    fs, mark = _fs(spark, f"{out_dir}/_stop")
    fs.create(mark, True).close()


def _stop_requested(spark: SparkSession, out_dir: str) -> bool:
    fs, mark = _fs(spark, f"{out_dir}/_stop")
    return fs.exists(mark)


def await_stop(query, out_dir: str | None = None, timeout: float | None = None) -> bool:
    """Wait for the query's end; True if it ended or stopped as asked, False after ``timeout`` seconds. Any
    other failure is raised."""
    try:
        return query.awaitTermination(timeout) if timeout is not None else (query.awaitTermination() or True)
    except StreamingQueryException as exc:
        if "StopRequested" not in str(exc):
            raise
        return True


def enrichment_batch(out_dir: str, arrival=None, search_export: bool = True, max_attempts: int = 3):
    """The ``foreachBatch`` function of the enrichment pipeline.

    1. quarantine malformed messages and those without a short code, never block;
    2. enrich (J1) and write the click table (K3/K4); a failure here fails the batch, so it is
       retried from the checkpoint. Every try is noted under the batch id; from the
       ``max_attempts``-th on the messages that cannot be enriched are found by bisection and go to the
       quarantine, and the others are written (X12);
    3. write mergeable rollup partials (R1-R4 with HLL visitor sketches);
    4. export the bulk search documents (K6) - a failure is logged, the batch still commits;
    5. commit the folders of all sinks at once.

    Messages without an id of their own are numbered per file (``enrich.with_positions``), so
    identical clicks are kept apart and a replay gives the same ids."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _stop_requested(spark, out_dir):
            raise StopRequested(f"stop mark under {out_dir}")
        attempt = note_attempt(spark, out_dir, batch_id)
        if sn.snapshot(spark, out_dir).has(STREAM, batch_id):
            log.info("batch %s is committed already", batch_id)
            return
        for sink, parts in SINKS.items():  # what a try before left half-written
            sn.discard(spark, out_dir, sink, sn.written(spark, out_dir, sink, batch_id, parts))
        batch = batch.persist()  # the source is read once for all sinks
        clicks = None
        try:
            good, bad = en.split_bad_messages(batch)
            bad = bad.drop(ARRIVAL_COL, src.FILE_COL).withColumn("attempts", F.lit(attempt))
            try:
                clicks = _write_clicks(good, arrival, out_dir, batch_id)
            except Exception as exc:
                if attempt < max_attempts:
                    raise
                log.error("batch %s failed %s times, looking for the messages at fault: %s", batch_id, attempt, exc)
                good, failed = _isolate(good, lambda rows: _enriched(rows, arrival))
                bad = bad.unionByName(failed.drop(ARRIVAL_COL, src.FILE_COL).withColumn("attempts", F.lit(attempt)), allowMissingColumns=True)
                if good is not None:
                    clicks = _write_clicks(good, arrival, out_dir, batch_id)
            if not bad.isEmpty():
                _write_batch(bad, f"{out_dir}/quarantine", batch_id)

            def rollups():
                _write_batch(ru.partial_rollups(clicks), f"{out_dir}/rollups", batch_id, ["rollup"])

            def search():
                docs = clicks.select("event_id", "short_code", "original_url", "clicked_at", "ip_address",
                                     "country", "country_code", "region", "city", "latitude", "longitude",
                                     "user_agent", "browser", "os", "device_type", "referer")
                _write_batch(tb.export_bulk_ndjson(docs, "clicks", "event_id"), f"{out_dir}/search", batch_id,
                             fmt="text")

            # the two sinks read the written click rows and run as concurrent Spark jobs
            skipped = set()
            with ThreadPoolExecutor(max_workers=2) as pool:
                rollup_job = pool.submit(rollups) if clicks is not None else None
                search_job = pool.submit(search) if clicks is not None and search_export else None
                if search_job is not None:
                    try:
                        search_job.result()
                    except Exception as exc:  # search sink is best effort (X1)
                        log.warning("search export failed for batch %s: %s", batch_id, exc)
                        skipped.add("search")
                if rollup_job is not None:
                    rollup_job.result()  # a rollup failure fails the batch (retried from the checkpoint)
            sn.commit(spark, out_dir, {sink: sn.written(spark, out_dir, sink, batch_id, parts) for sink, parts in SINKS.items() if sink not in skipped},
                      stream=STREAM, batch_id=batch_id)
        finally:
            batch.unpersist()

    return run


def _write_clicks(good: DataFrame, arrival, out_dir: str, batch_id: int) -> DataFrame | None:
    """Write a batch's enriched rows and return them as written; ``None`` if there are none.

    The other sinks read a few columns of the files, which costs less than a cache of all columns in memory."""
    spark, clicks = good.sparkSession, _enriched(good, arrival)
    _write_batch(clicks, f"{out_dir}/clicks", batch_id, SINKS["clicks"], sort_cols=["short_code", "clicked_at"], options=CLICK_FILE_OPTIONS)
    folders = sn.written(spark, out_dir, "clicks", batch_id, SINKS["clicks"])
    if not folders:
        return None
    stored = spark.read.schema(clicks.schema).option("basePath", f"{out_dir}/clicks")
    return stored.parquet(*[f"{out_dir}/clicks/{f}" for f in folders]).select(*clicks.columns)


def _isolate(rows: DataFrame, build, most: int = 64, bits: int = 40) -> tuple[DataFrame | None, DataFrame]:
    """(rows that ``build`` can compute, the others with a ``reason``).

    Rows are dealt by a hash of all their columns and halved by its bits: a part that computes is done, one
    that does not is halved again until its rows are all alike. A bad row costs about two small jobs per halving.
    With more than ``most`` failing parts the fault is not in single messages; those parts are then given up
    whole, so a batch never takes more than a few hundred jobs. ``None`` if no part computes."""
    slot = F.xxhash64(*rows.columns).bitwiseAND((1 << bits) - 1)
    inside = lambda taken, value: slot.bitwiseAND((1 << taken) - 1) == value
    failing, open_parts, computed = [], [(0, 0)], False
    while open_parts:
        taken, value = open_parts.pop(0)
        part = rows.where(inside(taken, value))
        if taken:
            if part.isEmpty():
                continue
            try:
                build(part).write.format("noop").mode("overwrite").save()
                computed = True
                continue
            except Exception as exc:
                log.debug("part %s/%s does not compute: %s", taken, value, exc)
        if taken == bits or len(failing) + len(open_parts) >= most or part.select(slot.alias("s")).distinct().limit(2).count() < 2:
            failing.append((taken, value))
        else:
            open_parts += [(taken + 1, value), (taken + 1, value | 1 << taken)]
    at_fault = F.lit(False)
    for taken, value in failing:
        at_fault = at_fault | inside(taken, value)
    reason = F.lit("failed message" if computed else "failed batch")
    return (rows.where(~at_fault) if computed else None), rows.where(at_fault).withColumn("reason", reason)


def _enriched(good: DataFrame, arrival) -> DataFrame:
    """Enriched rows with ids by position; positions only where the source or the publisher gives any."""
    stamped = ARRIVAL_COL in good.columns and arrival is None
    if not {"message_id", "position", src.FILE_COL} & set(good.columns):
        return en.enrich_clicks(good, arrival=arrival, arrival_col=ARRIVAL_COL if stamped else None)
    placed = en.with_positions(good, src.FILE_COL if src.FILE_COL in good.columns else None)
    return en.enrich_clicks(placed, arrival=arrival, position="position", arrival_col=ARRIVAL_COL if stamped else None)


def note_attempt(spark: SparkSession, out_dir: str, batch_id: int) -> int:
    """Note one more try of a micro-batch (a marker file) and return how many there are."""
    fs, folder = _fs(spark, f"{out_dir}/attempts/batch_id={batch_id}")
    fs.mkdirs(folder)
    made = len(fs.listStatus(folder)) + 1
    mark = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"try-{made:06d}"), False)
    mark.write(bytearray(b"1"))  # readers skip empty files
    mark.close()
    return made


def start_enrichment(raw: DataFrame, out_dir: str, checkpoint: str, trigger: dict | None = None,
                     arrival=None, query_name: str | None = None, max_attempts: int = 3):
    """Start the enrichment query. ``trigger`` defaults to ``availableNow`` (drain
    and stop, for jobs); pass ``{"processingTime": "1 second"}`` for a service."""
    fs, mark = _fs(raw.sparkSession, f"{out_dir}/_stop")
    fs.delete(mark, False)  # of a stop that was asked for before
    if arrival is None:
        # stamped in the streaming plan: Spark replaces current_timestamp() by the micro-batch
        # time recorded in the offset log, so a replayed batch sees the same arrival time
        raw = raw.withColumn(ARRIVAL_COL, F.current_timestamp())
    writer = (raw.writeStream.foreachBatch(enrichment_batch(out_dir, arrival, max_attempts=max_attempts))
              .option("checkpointLocation", checkpoint))
    if query_name:
        writer = writer.queryName(query_name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _sink(spark: SparkSession, out_dir: str, name: str, schema=None) -> DataFrame:
    """Committed rows of a sink; of a folder that was never under a commit log, all of them."""
    if sn.is_committed(spark, out_dir):
        return sn.read(spark, out_dir, name, schema=schema)
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(f"{out_dir}/{name}")


def _rollup_inputs(spark: SparkSession, out_dir: str, name: str, upto: int | None = None) -> DataFrame:
    """Latest compacted version of a rollup plus the partial rows of later batches."""
    compacted_dir = f"{out_dir}/rollups_compacted/{name}"
    versions = committed_versions(spark, compacted_dir)
    if upto is not None:
        versions = [v for v in versions if v < upto]
    partials = _sink(spark, out_dir, "rollups")
    keep = ru.select_rollup(partials, name).columns
    parts = partials.where(F.col("rollup") == name).select(*keep, "batch_id")
    if versions:
        parts = parts.where(F.col("batch_id") > versions[-1])
    if upto is not None:
        parts = parts.where(F.col("batch_id") <= upto)
    parts = parts.drop("batch_id")
    if versions:
        parts = parts.unionByName(spark.read.parquet(f"{compacted_dir}/v={versions[-1]}"))
    return parts


def read_rollup(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """R5 read side: merge compacted rows and newer partial rows by key (counts add, visitor
    sketches union) and estimate visitors."""
    merged = ru.merge_partials(_rollup_inputs(spark, out_dir, name), ru.ROLLUP_KEYS[name])
    return ru.estimate_visitors(merged) if "visitors_sketch" in merged.columns else merged


def compact_rollup(spark: SparkSession, out_dir: str, name: str, upto_batch: int) -> None:
    """Merge the partial rows of batches ``<= upto_batch`` into compacted version
    ``v=<upto_batch>`` (sketches stay mergeable); idempotent like ``compact_counters``."""
    merged = ru.merge_partials(_rollup_inputs(spark, out_dir, name, upto_batch), ru.ROLLUP_KEYS[name])
    merged.write.mode("overwrite").parquet(f"{out_dir}/rollups_compacted/{name}/v={upto_batch}")


# --- X2: counter pipeline over versioned URL tables -------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def committed_versions(spark: SparkSession, table_dir: str) -> list[int]:
    """Versions ``v=<n>`` of a versioned table that carry a ``_SUCCESS`` marker."""
    fs, root = _fs(spark, table_dir)
    if not fs.exists(root):
        return []
    out = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def read_version(spark: SparkSession, table_dir: str, before: int | None = None) -> DataFrame | None:
    """Latest committed version (strictly before ``before`` when given)."""
    versions = [v for v in committed_versions(spark, table_dir) if before is None or v < before]
    return spark.read.parquet(f"{table_dir}/v={versions[-1]}") if versions else None


def counter_batch(deltas_dir: str):
    """Fold the batch into per-code increments and append them to the delta log
    under ``batch_id=<n>`` (replaced on replay, so a redelivered batch is never counted twice).
    Only the increments are written per micro-batch, never the URL table itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        _write_batch(rp.fold_increments(batch), deltas_dir, batch_id)

    return run


def _deltas_after(spark: SparkSession, deltas_dir: str, version: int | None) -> DataFrame | None:
    fs, root = _fs(spark, deltas_dir)
    if not fs.exists(root):
        return None
    deltas = spark.read.parquet(deltas_dir)
    return deltas if version is None else deltas.where(F.col("batch_id") > version)


def read_counters(spark: SparkSession, urls_dir: str, deltas_dir: str, as_of=None) -> DataFrame:
    """C3 read side: latest compacted URL version + the increments of later batches
    (pre-aggregated per code before the join)."""
    versions = committed_versions(spark, urls_dir)
    base = spark.read.parquet(f"{urls_dir}/v={versions[-1]}")
    deltas = _deltas_after(spark, deltas_dir, versions[-1])
    if deltas is None:
        return base
    when = as_of if as_of is not None else F.current_timestamp()
    return rs.apply_counters(base, deltas.drop("batch_id"), when)


def compact_counters(spark: SparkSession, urls_dir: str, deltas_dir: str, upto_batch: int, as_of=None) -> None:
    """Fold the increments of batches ``<= upto_batch`` into URL version ``v=<upto_batch>``.
    Idempotent: the new version is computed from the latest version before it."""
    versions = [v for v in committed_versions(spark, urls_dir) if v < upto_batch]
    base = spark.read.parquet(f"{urls_dir}/v={versions[-1]}")
    deltas = _deltas_after(spark, deltas_dir, versions[-1])
    if deltas is not None:
        deltas = deltas.where(F.col("batch_id") <= upto_batch).drop("batch_id")
        when = as_of if as_of is not None else F.current_timestamp()
        base = rs.apply_counters(base, deltas, when)
    base.write.mode("overwrite").parquet(f"{urls_dir}/v={upto_batch}")


def seed_url_table(urls: DataFrame, urls_dir: str, version: int = -1) -> None:
    """Write the initial URL table version (before the first micro-batch)."""
    cols = urls.columns
    out = urls if "updated_at" in cols else urls.withColumn("updated_at", F.col("created_at"))
    out.write.mode("overwrite").parquet(f"{urls_dir}/v={version}")


def start_counters(raw: DataFrame, deltas_dir: str, checkpoint: str, trigger: dict | None = None):
    """Second query on the same click source (every sink sees every click, trap T2);
    messages without a short code are skipped (S2)."""
    clicks = raw.where(F.col("short_code").isNotNull() & (F.col("short_code") != ""))
    return (clicks.writeStream.foreachBatch(counter_batch(deltas_dir))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


# --- X4 / X5 / X6 / X7: stateful streaming operators ------------------------------------------------

def dedup_stream(clicks: DataFrame, watermark: str = "3 days") -> DataFrame:
    """Drop replayed events by id within the watermark (state is bounded by it)."""
    return clicks.withWatermark("clicked_at", watermark).dropDuplicatesWithinWatermark(["event_id"])


def windowed_rollup(clicks: DataFrame, bucket: str = "1 hour", watermark: str = "3 days") -> DataFrame:
    """Tumbling-window clicks and approximate visitors per code; a bucket is
    emitted once the watermark (late-data horizon) passes its end (append mode).
    Exact ``count(distinct)`` is not supported on streams, so visitors are HLL++ estimates."""
    return (clicks.withWatermark("clicked_at", watermark)
            .groupBy(F.window("clicked_at", bucket).alias("bucket"), "short_code")
            .agg(F.count(F.lit(1)).alias("click_count"),
                 F.approx_count_distinct("ip_address").alias("unique_visitors"))
            .select("short_code", F.col("bucket.start").alias("bucket_start"),
                    F.col("bucket.end").alias("bucket_end"), "click_count", "unique_visitors"))


def _bucket(bucket: str):
    return F.window("clicked_at", bucket)


def start_windowed(clicks: DataFrame, out_dir: str, checkpoint: str, bucket: str = "1 hour", watermark: str = "3 days", trigger: dict | None = None):
    """``windowed_rollup`` of a click stream into ``out_dir/windows``."""
    return (windowed_rollup(clicks, bucket, watermark).writeStream.format("parquet").outputMode("append").option("path", f"{out_dir}/windows")
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def late_batch(out_dir: str, bucket: str = "1 hour", watermark: str = "3 days"):
    """The ``foreachBatch`` function that keeps what a watermark drops, for a second query on the clicks.

    A click is late if its bucket ends at or before the horizon, the latest click time so far minus
    ``watermark``. The stream's own watermark is never ahead of that, so whatever it drops is found here. Only the
    late (code, bucket) pairs are stored, by batch id; the horizon is one row per batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            newest = batch.agg(F.max("clicked_at").alias("newest"))
            seen = _horizon(spark, out_dir, batch_id)
            newest = newest if seen is None else newest.unionByName(seen).agg(F.max("newest").alias("newest"))
            _write_batch(newest, f"{out_dir}/horizon", batch_id)
            micros = _horizon(spark, out_dir, batch_id + 1).select(F.unix_micros(F.col("newest") - F.expr(f"INTERVAL {watermark}"))).first()[0]
            placed = batch.select("short_code", _bucket(bucket).alias("w")).select("short_code", F.col("w.start").alias("bucket_start"), F.col("w.end").alias("bucket_end"))
            late = placed.distinct().where(F.unix_micros("bucket_end") <= F.lit(micros).cast("bigint"))
            _write_batch(late, f"{out_dir}/late", batch_id)
        finally:
            batch.unpersist()

    return run


def _horizon(spark: SparkSession, out_dir: str, before: int) -> DataFrame | None:
    """The newest click time of all batches before ``before``: the row of the last of them."""
    fs, root = _fs(spark, f"{out_dir}/horizon")
    if not fs.exists(root):
        return None
    ids = [int(st.getPath().getName().removeprefix("batch_id=")) for st in fs.listStatus(root) if st.getPath().getName().startswith("batch_id=")]
    ids = [i for i in ids if i < before]
    return spark.read.schema("newest timestamp").parquet(f"{out_dir}/horizon/batch_id={max(ids)}") if ids else None


def start_late(clicks: DataFrame, out_dir: str, checkpoint: str, bucket: str = "1 hour", watermark: str = "3 days", trigger: dict | None = None):
    return (clicks.writeStream.foreachBatch(late_batch(out_dir, bucket, watermark)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def refresh_late(spark: SparkSession, out_dir: str, clicks: DataFrame, bucket: str = "1 hour") -> None:
    """R7 for what came too late: the (code, bucket) pairs of the side table are computed anew from ``clicks``
    (the stored table) into ``out_dir/corrected``; months without one are not read. Running it again gives the same."""
    late = spark.read.schema("short_code string, bucket_start timestamp, bucket_end timestamp").parquet(f"{out_dir}/late").distinct()
    first, last = late.agg(F.min("bucket_start"), F.max("bucket_end")).first()
    rows = prune_months(clicks, first, last).where((F.col("clicked_at") >= F.lit(first)) & (F.col("clicked_at") < F.lit(last)))
    placed = rows.withColumn("w", _bucket(bucket)).select("short_code", F.col("w.start").alias("bucket_start"), F.col("w.end").alias("bucket_end"), "ip_address")
    keys = ["short_code", "bucket_start", "bucket_end"]
    fresh = placed.join(late, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("click_count"), F.count_distinct("ip_address").alias("unique_visitors"))
    fresh.write.mode("overwrite").parquet(f"{out_dir}/corrected")


def read_windowed(spark: SparkSession, out_dir: str) -> DataFrame:
    """The closed buckets: as the stream emitted them, but for those that were computed anew."""
    emitted = spark.read.parquet(f"{out_dir}/windows")
    fs, path = _fs(spark, f"{out_dir}/corrected")
    if not fs.exists(path):
        return emitted
    corrected = spark.read.parquet(f"{out_dir}/corrected")
    return emitted.join(corrected, ["short_code", "bucket_start"], "left_anti").unionByName(corrected)


# --- X9 / X12 / S9: quarantine and backlog monitoring -------------------------------------------

def read_quarantine(spark: SparkSession, out_dir: str) -> DataFrame:
    """Quarantined raw messages (explicit schema: the folder may hold no data files yet)."""
    from pyspark.sql import types as T
    from clickspark.schemas import RAW_CLICK
    schema = T.StructType(RAW_CLICK.fields + [T.StructField("reason", T.StringType()),
                                              T.StructField("_text", T.StringType()),
                                              T.StructField("attempts", T.IntegerType()),
                                              T.StructField("batch_id", T.LongType())])
    fs, path = _fs(spark, f"{out_dir}/quarantine")
    if not fs.exists(path):  # nothing quarantined yet
        return spark.createDataFrame([], schema)
    return _sink(spark, out_dir, "quarantine", schema)


def quarantine_report(spark: SparkSession, out_dir: str, alert_threshold: int = 100) -> DataFrame:
    """Quarantined messages per batch and reason, with an alert flag when a batch
    quarantined more than ``alert_threshold`` messages; ``attempts`` counts every delivery of the batch,
    also those after its commit."""
    q = read_quarantine(spark, out_dir)
    per = q.groupBy("batch_id", "reason").agg(F.count(F.lit(1)).alias("messages"), F.max("attempts").alias("attempts"))
    fs, folder = _fs(spark, f"{out_dir}/attempts")
    if fs.exists(folder):
        tries = spark.read.format("binaryFile").load(f"{out_dir}/attempts").groupBy("batch_id").agg(F.count(F.lit(1)).cast("int").alias("_tries"))
        per = per.join(tries, "batch_id", "left").withColumn("attempts", F.greatest("attempts", "_tries")).drop("_tries")
    return per.withColumn("alert", F.col("messages") > alert_threshold)


_BARE = "batch_id long"  # enough to count rows


def backlog(query, landing: DataFrame, out_dir: str, threshold_rows: int = 10_000) -> dict:
    """S8 / S9 for a running query over landing files: entries that no committed micro-batch has
    taken yet, against the threshold, besides the last progress.

    Taken are the click rows and quarantined messages under ``out_dir``; both sides are counts."""
    spark = landing.sparkSession
    p = query.lastProgress or {}
    taken = 0
    for folder in ("clicks", "quarantine"):
        fs, path = _fs(spark, f"{out_dir}/{folder}")
        taken += _sink(spark, out_dir, folder, _BARE).count() if fs.exists(path) else 0
    waiting = max(0, landing.count() - taken)
    return {"batch_id": p.get("batchId"), "input_rows": int(p.get("numInputRows", 0) or 0),
            "input_rows_per_second": p.get("inputRowsPerSecond"),
            "processed_rows_per_second": p.get("processedRowsPerSecond"),
            "backlog_rows": waiting, "backlog_alert": waiting > threshold_rows}


class ProgressLog(StreamingQueryListener):
    """S8 / S9 for running queries without a scan: adds up what each finished batch reports.

    ``backlog(query_id)`` has the rows taken so far, the entries that the source knows of and has not handed out
    (files for a file source, offsets for Kafka), the rate, and the alert. Register with
    ``spark.streams.addListener``; the numbers are those of committed batches."""

    def __init__(self, threshold: int = 10_000):
        self.threshold, self.state = threshold, {}

    def onQueryStarted(self, event) -> None:
        self.state.setdefault(str(event.id), {"rows": 0, "batch_id": None, "waiting": 0, "rows_per_second": None, "running": True})["running"] = True

    def onQueryProgress(self, event) -> None:
        p = event.progress
        held = self.state.setdefault(str(p.id), {"rows": 0, "batch_id": None, "waiting": 0, "rows_per_second": None, "running": True})
        if held["batch_id"] is None or p.batchId > held["batch_id"]:  # an idle query reports its last batch again
            held["rows"] += p.numInputRows
        held |= {"batch_id": p.batchId, "waiting": sum(_outstanding(s) for s in p.sources), "rows_per_second": p.processedRowsPerSecond}

    def onQueryIdle(self, event) -> None:
        self.state.get(str(event.id), {})["waiting"] = 0

    def onQueryTerminated(self, event) -> None:
        self.state.get(str(event.id), {})["running"] = False

    def backlog(self, query_id) -> dict:
        held = self.state.get(str(query_id), {"rows": 0, "batch_id": None, "waiting": 0, "rows_per_second": None, "running": False})
        return held | {"backlog_alert": held["waiting"] > self.threshold}


def _outstanding(source) -> int:
    """Entries that a source knows of and that are not in a finished batch."""
    metrics = source.metrics or {}
    for name in ("numFilesOutstanding", "maxOffsetsBehindLatest"):
        if name in metrics:
            return int(float(metrics[name]))
    return 0


def resolve_stream(clicks: DataFrame, urls: DataFrame) -> DataFrame:
    """C1 on a stream: stream-static join of enriched clicks with the URL table, honouring
    expiry at click time. The static side is re-read per micro-batch; Catalyst broadcasts it
    only while its measured size is under the broadcast threshold."""
    return rs.resolve_clicks(clicks, urls)
