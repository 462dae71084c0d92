"""Hot-key behaviour: one short code holding a third of all clicks."""

from pyspark.sql import functions as F

from clickspark.operators import enrich as en
from clickspark.operators import reports as rp
from clickspark.operators import resolve as rs
from clickspark.sources import fixtures as fx
from tests.conftest import SF_ORACLE


def _hot_clicks(spark):
    clicks = fx.click_events(spark, SF_ORACLE)
    hot = F.when(F.col("event_id").cast("long") % 3 == 0, F.lit("c07")).otherwise(F.col("short_code"))
    return clicks.withColumn("short_code", hot)


def test_skewed_join_is_split_by_aqe(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = rs.resolve_clicks(_hot_clicks(spark), fx.urls(spark, SF_ORACLE))
        n = df.count()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        assert n == df.count()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_code_reports_stay_exact(spark):
    clicks = _hot_clicks(spark)
    got = {r.short_code: r.total_clicks for r in rp.url_stats_windows(clicks, fx.AS_OF).collect()}
    assert got["c07"] == clicks.where("short_code = 'c07'").count()
    assert got["c07"] >= clicks.count() // 3
    top = rp.country_share(clicks, "2024-01-01", "2024-01-30", 5).where("short_code = 'c07'").collect()
    assert len(top) == 5 and abs(sum(r.percentage for r in top)) <= 100.0 + 1e-6


def test_a_message_that_repeats_is_numbered_in_parts(spark):
    """Every number 1..n once for each message, of one or many parts; null fields group as equal."""
    copies = {"a": 1, "b": 10, "c": 11, "d": 5003, None: 21}
    rows = spark.createDataFrame([(k, f) for k, n in copies.items() for f in ("f1", "f2") for _ in range(n)], "short_code string, file string")
    for file_col in (None, "file"):
        cols = ["short_code"] if file_col else ["short_code", "file"]
        numbered = en._numbered(rows, cols, file_col, part_rows=10)
        got = {}
        for r in numbered.collect():
            key, n = (r.position.split("#") if r.position else (r.file, "1"))
            got.setdefault((r.short_code, key or r.file), []).append(int(n))
        assert {k: sorted(v) for k, v in got.items()} == {(k, f): list(range(1, n + 1)) for k, n in copies.items() for f in ("f1", "f2")}
    sizes = [r["count"] for r in numbered.where("short_code = 'd'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 10_006  # more than one task shares the copies
    assert en._numbered(rows.limit(0), cols, "file").count() == 0
