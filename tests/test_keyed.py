"""Merge on read: the base is not moved, runs replace rows, compaction changes nothing."""

import os

from pyspark.sql import functions as F

from clickspark.operators import keyed
from clickspark.operators import tables as tb
from clickspark.sources import fixtures as fx
from tests.conftest import SF_SMALL

COLUMNS = ["short_code", "long_url", "clicks", "created_at"]


def _rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def test_runs_deletions_and_compaction(spark, scratch):
    path, urls = os.path.join(scratch, "urls"), fx.urls(spark, SF_SMALL).select(*COLUMNS)
    keyed.create(urls, path, "short_code", buckets=4)
    changed = urls.where("short_code IN ('c01', 'c02', 'c03')").withColumn("clicks", F.lit(7).cast("bigint"))
    added = urls.limit(2).withColumn("short_code", F.concat(F.lit("n"), "short_code"))
    keyed.write_run(changed.unionByName(added), path, 1)
    keyed.write_run(changed.limit(1).withColumn("clicks", F.lit(9).cast("bigint")), path, 2)
    keyed.write_run(spark.createDataFrame([("c02",), ("c05",), ("zzz",)], "short_code string"), path, 3, gone=True)
    keyed.write_run(spark.createDataFrame([("c02",), ("c05",), ("zzz",)], "short_code string"), path, 3, gone=True)  # replay
    nine = changed.limit(1).first().short_code
    want = urls.unionByName(added).where("short_code NOT IN ('c02', 'c05')").withColumn(
        "clicks", F.when(F.col("short_code") == nine, 9).when(F.col("short_code").isin("c01", "c02", "c03"), 7).otherwise(F.col("clicks")).cast("bigint"))
    assert _rows(keyed.read(spark, path, "short_code", 4)) == _rows(want)
    assert keyed.read(spark, path, "short_code", 4, upto=2).where("short_code = 'c05'").count() == 1
    for _ in range(2):
        keyed.compact(spark, path, "short_code", 2, 4)
        assert keyed._numbers(spark, path, "base") == [0, 2]
        assert _rows(keyed.read(spark, path, "short_code", 4)) == _rows(want)
    spark.sql(f"DROP TABLE {keyed._name(path, 2)}")  # a session that did not write it
    assert _rows(keyed.read(spark, path, "short_code", 4)) == _rows(want)


def test_the_base_is_not_exchanged(spark, scratch):
    path = os.path.join(scratch, "urls")
    keyed.create(fx.urls(spark, SF_SMALL).select(*COLUMNS), path, "short_code", buckets=8)
    keyed.write_run(fx.urls(spark, SF_SMALL).select(*COLUMNS).limit(3), path, 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the delta were large
    try:
        counts = spark.createDataFrame([("c01", 5)], "short_code string, clicks long")
        stored = keyed.base(spark, path, "short_code", 8)
        for plan in (keyed.read(spark, path, "short_code", 8), tb.partial_update_clicks(stored, counts)):
            text = plan._jdf.queryExecution().executedPlan().toString()
            under = text[:text.index("keyed_")].splitlines()  # from the root down to the scan of the base
            depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
            at, above = depth(text[:text.index("keyed_")].splitlines()[-1]), []
            for line in reversed(under[:-1]):
                if depth(line) < at:
                    above.append(line)
                    at = depth(line)
            assert any("SortMergeJoin" in line for line in above) and not any("Exchange" in line for line in above), text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
