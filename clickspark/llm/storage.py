"""Tables and binary files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a scratch folder only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` rows where the session has Spark's own number: a row here is a whole
    text or page, and a worker holds its batches in memory several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    Unlike cached blocks the files outlive any executor, and their known size lets Spark choose joins.
    """
    spark = df.sparkSession
    text_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only if the counted rows times ``row_bytes`` stay below ``limit_bytes``.

    ``row_bytes`` is what a row takes in the broadcast table. Larger tables come back as they are and
    are joined by shuffle. ``df`` should be materialised.
    """
    most = limit_bytes // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def write_blobs(df: DataFrame, blob: str | Column, path: str, trailer: bytes) -> None:
    """One file per row: the bytes of ``blob`` followed by ``trailer``.

    Spark's text sink puts a string's bytes into the file as they are and ends every row with the
    line separator, so a format whose files end in a constant can be written through Spark's own
    commit protocol to any file system it knows. ``trailer`` is that constant.
    """
    text_batches(df.sparkSession)
    column = F.col(blob) if isinstance(blob, str) else blob
    (df.select(column.cast("string").alias("value")).write
       .option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
       .option("lineSep", trailer.decode("latin-1")).option("compression", "none").text(path))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``length`` and ``content`` of every file that :func:`write_blobs` left."""
    return spark.read.format("binaryFile").load(path)
