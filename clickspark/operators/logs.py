"""Log-line normalisation (J13) and the daily log partitions (K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.operators.common import ts

ENVELOPE_KEYS = ["level", "msg", "timestamp", "service"]
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def normalise_logs(lines: DataFrame, line_col: str = "line", default_service: str = "unknown",
                   ingest_time=None) -> DataFrame:
    """JSON line -> ``timestamp, level, message, service, fields``.

    Malformed lines are dropped; the timestamp is the line's RFC 3339 ``timestamp`` (trap T20)
    or the ingest time; ``fields`` holds every other key (nested values stay JSON text) and is
    NULL when empty."""
    m = F.from_json(F.col(line_col), "map<string,string>")
    parsed = lines.withColumn("_m", m).where(F.col("_m").isNotNull())
    ts_text = F.col("_m")["timestamp"]
    event_ts = F.when(ts_text.rlike(RFC3339), ts_text.try_cast("timestamp"))
    ingest = F.current_timestamp() if ingest_time is None else ts(ingest_time)
    rest = F.map_filter("_m", lambda k, _v: ~k.isin(*ENVELOPE_KEYS))
    keep = [c for c in lines.columns if c != line_col]
    return parsed.select(
        *keep,
        F.coalesce(event_ts, ingest).alias("timestamp"),
        F.coalesce(F.col("_m")["level"], F.lit("")).alias("level"),
        F.coalesce(F.col("_m")["msg"], F.lit("")).alias("message"),
        F.coalesce(F.col("_m")["service"], F.lit(default_service)).alias("service"),
        F.when(F.size(rest) > 0, rest).alias("fields"),
    )


def log_partitions(logs: DataFrame, prefix: str = "app") -> DataFrame:
    """K9 layout: partition columns ``service`` and ``log_date`` (event date, trap T21) and the
    index name ``<prefix>-logs-<service>-<yyyy.MM.dd>``."""
    return (logs.withColumn("log_date", F.to_date("timestamp"))
            .withColumn("index_name", F.concat_ws("-", F.lit(prefix), F.lit("logs"), F.col("service"),
                                                  F.date_format("timestamp", "yyyy.MM.dd"))))


def write_logs(logs: DataFrame, path: str, batch_id: int | None = None) -> None:
    """K9: append-only JSON partitions per service and day. With ``batch_id`` the rows of a batch have
    folders of their own, which a replay replaces: a flush that is repeated adds nothing."""
    rows = log_partitions(logs).drop("index_name")
    if batch_id is None:
        rows.write.mode("append").partitionBy("service", "log_date").json(path)
    else:
        (rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("service", "log_date", "batch_id").json(path))


def daily_counts(logs: DataFrame) -> DataFrame:
    """Lines per (service, day, level) of the normalised log."""
    return log_partitions(logs).groupBy("service", "log_date", "level").agg(F.count(F.lit(1)).alias("lines"))
