"""Plan-shape guards for every registered query."""

import pytest

from clickspark.operators import reports as rp
from clickspark.operators import rollups as ru
from clickspark.operators import search as se
from clickspark.operators import tables as tb
from clickspark.plans.catalog import QUERIES
from clickspark.sources import fixtures as fx
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "FlatMapGroupsInPandasWithState", "PythonUDF")
ALLOWED_PYTHON = {"token_bucket", "token_bucket_blocks"}  # recursion, mapInPandas over sorted (ip, burst, block) rows


def _plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "extended")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_is_jvm_side_without_pair_joins(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    found = [n for n in PYTHON_NODES if n in plan]
    if name in ALLOWED_PYTHON:
        assert found, "expected the per-key pandas step"
    else:
        assert not found, f"{name} uses Python in its plan: {found}"
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture()
def history(spark, scratch):
    path = f"{scratch}/history"
    tb.write_click_table(fx.click_history(spark, SF_SMALL), path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("job", [
    lambda c: tb.retention(c, fx.AS_OF, 20), lambda c: rp.timeline_daily(c, fx.AS_OF, 7),
    lambda c: ru.refresh_window(c, "2024-01-30 12:00:00"), lambda c: se.click_search(c, device="mobile", start="2024-01-10 00:00:00"),
    lambda c: c.where(c.clicked_month.cast("string") < "202312"),
])
def test_jobs_read_only_the_months_they_need(history, job):
    plan = _plan(job(history))
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert filters and all("clicked_month" in f.split("PartitionFilters: [")[1].split("]")[0] for f in filters)


def test_composite_reports_scan_the_clicks_twice_and_once(spark, scratch):
    path = f"{scratch}/clicks"
    fx.click_events(spark, SF_SMALL).write.parquet(path)
    for report, scans in ((rp.composite_stats, 2), (rp.geo_city_share, 1)):
        assert _plan(report(spark.read.parquet(path))).split("== Physical Plan ==")[1].count("FileScan") <= scans


def test_no_exact_percentile_map_and_no_moving_frame(spark):
    for name in ("slo_report", "pipeline_lag", "rate_verdict", "rate_headers"):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "percentile(" not in plan
        assert not [f for f in plan.split("specifiedwindowframe(")[1:] if f.startswith("RangeFrame, -")]


def test_enrichment_is_one_scan_without_exchange(spark):
    from clickspark.operators import enrich as en

    plan = _plan(en.enrich_clicks(fx.raw_clicks(spark, SF_SMALL), arrival=fx.AS_OF))
    physical = plan.split("== Physical Plan ==")[1]
    assert "Exchange" not in physical and physical.count("FileScan") == 1
