"""Streaming sources: raw click messages (S1-S3, X13) and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickspark.schemas import RAW_CLICK

FILE_COL, TEXT_COL = "_file", "_text"


def parsed(text: Column) -> list[Column]:
    """Columns of one JSON message. What is no JSON object keeps its text in ``_text`` for the
    quarantine (X9); for a good message ``_text`` is NULL."""
    schema = T.StructType([*RAW_CLICK.fields, T.StructField("_corrupt", T.StringType())])
    m = F.from_json(text, schema, {"columnNameOfCorruptRecord": "_corrupt"})
    bad = m.isNull() | m["_corrupt"].isNotNull()
    return [*[m[f.name].alias(f.name) for f in RAW_CLICK.fields], F.when(bad, text).alias(TEXT_COL)]


def click_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                 modified_after: str | None = None) -> DataFrame:
    """JSON click messages landing as files under ``path``, one per line, with the file they
    came from (``_file``) and the text of malformed ones (``_text``).

    A new checkpoint starts from the earliest file (S3); ``max_files_per_trigger`` bounds a
    micro-batch (the reference reads at most 100 messages per poll); ``modified_after``
    reprocesses from a point in time with a fresh checkpoint (X13)."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    lines = reader.text(path).where(F.trim("value") != "")
    return lines.select(*parsed(F.col("value")), F.col("_metadata.file_path").alias(FILE_COL))


def kafka_click_stream(spark: SparkSession, bootstrap_servers: str, topic: str,
                       max_offsets_per_trigger: int | None = None, starting_offsets: str = "earliest",
                       starting_timestamp: int | None = None) -> DataFrame:
    """S1 on Kafka (requires the Kafka connector on the classpath): JSON value -> raw click
    columns plus the message position (partition, offset) for deterministic event ids.
    ``starting_timestamp`` (epoch milliseconds) reprocesses from a point in time with a fresh checkpoint (X13)."""
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap_servers)
              .option("subscribe", topic)
              .option("startingOffsets", starting_offsets))
    if starting_timestamp is not None:
        reader = reader.option("startingTimestamp", str(starting_timestamp))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    raw = reader.load()
    place = F.concat_ws(":", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return raw.select(*parsed(F.col("value").cast("string")), place.alias("position"))


def log_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
               max_bytes_per_trigger: int | None = None) -> DataFrame:
    """One JSON log entry per text line. ``max_bytes_per_trigger`` flushes on size
    (K10), the query's trigger interval on time."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    return reader.text(path).withColumnRenamed("value", "line")
