"""Sliding-window rate verdicts on a request stream, by the batch operator W1 over stored history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspark.operators.common import ts
from clickspark.operators.limits import sliding_window_verdicts


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _path(spark, folder)
    return fs.exists(path)


VERDICT = ["prior_count", "allowed", "remaining", "reset_at"]
HOUR = "req_hour"
_MOST_SPANS = 100


_HOUR_US = 3_600_000_000


def _slot_us(window_us: int) -> int:
    """Width of a storage slot: whole hours, about a quarter of the window, so that the slots around a
    batch are few and hold little else."""
    return max(1, window_us // 4 // _HOUR_US) * _HOUR_US


def _slot(time, width: int):
    """First hour (``yyyyMMddHH``) of the slot that a time lies in."""
    return F.date_format(F.timestamp_micros((F.floor(F.unix_micros(time) / width) * width).cast("bigint")), "yyyyMMddHH")


def _spans(batch: DataFrame, time_col: str, window_us: int) -> list[tuple[int, int]]:
    """(first, last) request times of the batch in microseconds, cut where no request lies within two
    windows, so that what happens around one span cannot touch the next. One row per slot reaches the driver; with more than 100 spans neighbours are put together, which reads more but is as right."""
    micros = F.unix_micros(F.col(time_col))
    hours = batch.where(F.col(time_col).isNotNull()).groupBy(_slot(F.col(time_col), _slot_us(window_us)).alias("h")).agg(
        F.min(micros).alias("first"), F.max(micros).alias("last")).collect()
    spans: list[tuple[int, int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in hours):
        if spans and first - spans[-1][1] <= 2 * window_us:
            spans[-1] = spans[-1][0], max(last, spans[-1][1])
        else:
            spans.append((first, last))
    step = max(1, -(-len(spans) // _MOST_SPANS))
    return [(spans[i][0], spans[min(i + step, len(spans)) - 1][1]) for i in range(0, len(spans), step)]


def _between(time, spans: list[tuple[int, int]]):
    found = F.lit(False)
    for low, high in spans:
        found = found | ((time > F.timestamp_micros(F.lit(low))) & (time < F.timestamp_micros(F.lit(high))))
    return found


def _stored(spark: SparkSession, folder: str, spans: list[tuple[int, int]], before: int, width: int) -> DataFrame | None:
    """Rows that earlier batches stored for the slots of ``spans``. Only folders of these slots are
    listed and read, so the cost follows the batch and the window, not the age of the job."""
    numbers = {s for low, high in spans for s in range(low // width, high // width + 1)}
    hours = [dt.datetime.fromtimestamp(s * width // 1_000_000, dt.UTC).strftime("%Y%m%d%H") for s in sorted(numbers)]
    paths = [p for h in hours if _exists(spark, p := f"{folder}/{HOUR}={h}")]
    if not paths:
        return None
    return spark.read.option("basePath", folder).parquet(*paths).where(F.col("batch_id") < before)


def verdict_batch(out_dir: str, limit: int, window_seconds: float, key: str = "ip",
                  time_col: str = "requested_at", id_col: str = "event_id"):
    """``foreachBatch`` function: verdicts of the micro-batch's requests, exact for late ones too.

    The batch operator runs over the batch and the stored requests within one window of any of its
    requests. It writes the verdicts of the batch and, again, those of stored requests that the batch
    changed. Requests and verdicts are stored by request hour (or some hours, see ``_slot_us``) and batch id; a
    request and all its verdicts share the folder, and only those around the batch are listed and read. A replay leaves out
    rows of its own and later batches, so it rewrites the same partitions. Requests without a time get
    verdicts of NULL and touch no other."""

    window = int(round(window_seconds * 1_000_000))
    width = _slot_us(window)

    def write(df: DataFrame, batch_id: int, folder: str) -> None:
        (df.withColumn(HOUR, _slot(F.col(time_col), width)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .hint("rebalance", HOUR).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(HOUR, "batch_id").parquet(folder))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            spans = _spans(batch, time_col, window)
            around = [(low - window, high + window) for low, high in spans]
            time = F.col(time_col)
            combined = batch.withColumn("_new", F.lit(True))
            history, stored = f"{out_dir}/requests", f"{out_dir}/verdicts"
            near = _stored(spark, history, around, batch_id, width)
            if near is not None:
                near = near.where(_between(time, around)).select(*batch.columns)
                combined = combined.unionByName(near.withColumn("_new", F.lit(False)))
            verdicts = sliding_window_verdicts(combined, limit, window_seconds, key, time_col, id_col)
            new = F.col("_new")
            after = [(low, high + window) for low, high in spans]
            known = None if near is None else _stored(spark, stored, after, batch_id, width)
            if known is None:
                fresh = verdicts.where(new)
            else:  # new and changed rows come from one pass over the verdicts
                known = _latest(known, id_col).select(F.col(id_col).alias("_id"), F.struct(*VERDICT).alias("_known"))
                compared = verdicts.where(new | _between(time, after)).join(known, ~new & (F.col(id_col) == F.col("_id")), "left")
                changed = F.col("_known").isNotNull() & ~F.struct(*VERDICT).eqNullSafe(F.col("_known"))
                fresh = compared.where(new | changed).drop("_id", "_known")
            write(fresh.drop("_new"), batch_id, stored)
            write(batch, batch_id, history)
        finally:
            batch.unpersist()

    return run


def _latest(rows: DataFrame, id_col: str) -> DataFrame:
    """The row of the latest batch for every request. Few requests have several, so rows are brought together
    first: adding up per task beforehand would sort them all once more."""
    kept = [c for c in rows.columns if c not in (id_col, HOUR, "batch_id")]
    return rows.repartition(id_col).groupBy(id_col).agg(F.max_by(F.struct(*kept), F.col("batch_id")).alias("_row")).select(id_col, "_row.*")


def read_verdicts(spark: SparkSession, out_dir: str, id_col: str = "event_id", start=None, end=None, window_seconds: float = 3600) -> DataFrame:
    """The latest verdict of every request (a later batch may have corrected it); of the folders that
    hold the hours from ``start`` to ``end`` only, for verdicts of ``window_seconds``."""
    rows, stored = spark.read.parquet(f"{out_dir}/verdicts"), F.col(HOUR).cast("string")
    width = _slot_us(int(round(window_seconds * 1_000_000)))
    if start is not None:
        rows = rows.where(stored >= _slot(ts(start), width))
    if end is not None:
        rows = rows.where(stored <= _slot(ts(end), width))
    return _latest(rows, id_col)


def start_rate_verdicts(requests: DataFrame, out_dir: str, checkpoint: str, limit: int, window_seconds: float,
                        trigger: dict | None = None):
    """X8 as a micro-batch job over stored history; no per-key state (see ``verdict_batch``)."""
    return (requests.writeStream.foreachBatch(verdict_batch(out_dir, limit, window_seconds))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
