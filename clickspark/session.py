"""Session construction and the few settings every job relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# AQE (on by default) coalesces small shuffles, splits skewed join partitions (one hot short code
# can own a third of the clicks) and broadcasts only below the measured threshold.
SESSION_DEFAULTS = {
    # Post-shuffle partitions are coalesced/split towards this size; scan splits are capped at
    # the same size, so task counts follow data volume (not a fixed partition number).
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def ensure_session_defaults(spark: SparkSession) -> SparkSession:
    """The one setting that results depend on: UTC makes TIMESTAMP arithmetic match the SQL oracles.

    Sizes, overwrite modes and folders of a given session are the caller's and stay as they are;
    writers that need dynamic partition overwrite ask for it per write."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build_session(master: str | None = None, partitions: int = 8, app: str = "clickspark") -> SparkSession:
    """Local/test session builder; on a cluster use the provided session plus ``ensure_session_defaults``."""
    builder = (
        SparkSession.builder.appName(app)
        .master(master or os.environ.get("CLICKSPARK_MASTER", "local[8]"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CLICKSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_session_defaults(spark)
