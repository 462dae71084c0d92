"""Headline benchmark: prints ONE JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).

Measured (seconds, each forced to full execution with the ``noop`` sink):
  enrich               raw click messages (one file per core) -> enriched click rows (J1)
  click_table_write    enriched rows written in the K4 layout (month partitions, code-clustered, zstd)
  rollup_build         R1-R4 partial rollups (one grouping-sets job) from the stored click table
  country_top20        A3 country share, top 20, every code (stored click table)
  country_from_rollup  A3 answered from the R2 rollup
  daily_series         A11 daily clicks + exact visitors, every code
  daily_from_rollup    A11 from merged R1 sketches
  url_stats            A1 totals / distinct / 24h-7d-30d windows, every code
  resolve_clicks       C1 click -> long URL with expiry residual
  dead_links           C2 anti join + per-code hits
  counter_batch        X2 one micro-batch of all clicks folded into the delta log
  read_counters        C3 URL table plus the deltas of later batches
  assign_codes         J7 one id and code per event
  rate_verdict         W1 sliding-window verdict per request
  recent_clicks        F2 newest 50 clicks over all codes
  composite_stats      A15 composite reply, every code
  stream_ingest        X1 end to end: JSON messages -> foreachBatch (enrich, click table, rollup
                       partials, search export) with availableNow, 4 micro-batches
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from clickspark.operators import enrich as en  # noqa: E402
from clickspark.operators import ids  # noqa: E402
from clickspark.operators import limits as lm  # noqa: E402
from clickspark.operators import reports as rp  # noqa: E402
from clickspark.operators import resolve as rs  # noqa: E402
from clickspark.operators import rollups as ru  # noqa: E402
from clickspark.operators import tables as tb  # noqa: E402
from clickspark.session import ensure_session_defaults  # noqa: E402
from clickspark.sources import fixtures as fx  # noqa: E402
from clickspark.streaming import pipeline as pl  # noqa: E402
from clickspark.streaming import sources as src  # noqa: E402

AS_OF = fx.AS_OF


def timed(fn):
    t0 = time.perf_counter()
    fn()
    return round(time.perf_counter() - t0, 3)


def run_noop(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("clickspark-bench")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_session_defaults(spark)
    work = tempfile.mkdtemp(prefix="clickspark-bench-")  # local benchmark only
    clicks_path = os.path.join(work, "clicks")
    rollup_path = os.path.join(work, "rollups")

    # untimed warm-up on the smallest fixture: JIT and codegen caches of a fresh JVM
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        run_noop(en.enrich_clicks(fx.raw_clicks(spark, warm_dir), arrival=AS_OF))
        run_noop(rp.country_share(fx.click_events(spark, warm_dir), "2024-01-05", "2024-01-25", 20))
        warm_landing = os.path.join(work, "warm_landing")
        fx.raw_clicks(spark, warm_dir).write.json(warm_landing)
        pl.start_enrichment(src.click_stream(spark, warm_landing), os.path.join(work, "warm_out"),
                            os.path.join(work, "warm_ckpt"), arrival=AS_OF).awaitTermination()

    q: dict[str, float] = {}
    # the messages lie in as many files as there are cores, as a landing folder's would; a single file is a single task
    raw_path = os.path.join(work, "raw_clicks")
    fx.raw_clicks(spark, sf_dir).repartition(cpus).write.parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    raw_rows = raw.count()
    q["enrich"] = timed(lambda: run_noop(en.enrich_clicks(raw, arrival=AS_OF)))
    q["click_table_write"] = timed(lambda: tb.write_click_table(en.enrich_clicks(raw, arrival=AS_OF), clicks_path,
                                                                mode="overwrite"))
    # the report fixture (with geo / device mix) is stored the same way for the report queries
    fixture_path = os.path.join(work, "click_events")
    tb.write_click_table(fx.click_events(spark, sf_dir), fixture_path, mode="overwrite")
    clicks = spark.read.parquet(fixture_path)
    urls = fx.urls(spark, sf_dir)

    def build_rollups():  # R1-R4 partials in one GROUPING SETS job, one table partitioned by rollup
        ru.partial_rollups(clicks).write.mode("overwrite").partitionBy("rollup").parquet(rollup_path)

    q["rollup_build"] = timed(build_rollups)
    partials = spark.read.parquet(rollup_path)
    by_country = ru.select_rollup(partials, "clicks_by_country")
    daily = ru.select_rollup(partials, "daily_by_url")
    start, end = "2024-01-05", "2024-01-25"
    q["country_top20"] = timed(lambda: run_noop(rp.country_share(clicks, start, end, 20)))
    q["country_from_rollup"] = timed(lambda: run_noop(ru.country_share_from_rollup(by_country, start, end, 20)))
    q["daily_series"] = timed(lambda: run_noop(rp.series_daily(clicks, start, end)))
    q["daily_from_rollup"] = timed(lambda: run_noop(ru.daily_series_from_rollup(daily, start, end)))
    q["url_stats"] = timed(lambda: run_noop(rp.url_stats_windows(clicks, AS_OF)))
    q["resolve_clicks"] = timed(lambda: run_noop(rs.resolve_clicks(clicks, urls)))
    q["dead_links"] = timed(lambda: run_noop(rs.dead_link_hits(clicks, urls)))
    base = os.path.join(work, "counters")
    pl.seed_url_table(fx.urls(spark, sf_dir), f"{base}/urls")
    q["counter_batch"] = timed(lambda: pl.counter_batch(f"{base}/deltas")(raw, 0))
    q["read_counters"] = timed(lambda: run_noop(pl.read_counters(spark, f"{base}/urls", f"{base}/deltas", AS_OF)))
    ids_in = fx.table(spark, sf_dir, "events").selectExpr("event_id request_id", "cast(ts as timestamp) requested_at")
    q["assign_codes"] = timed(lambda: run_noop(ids.assign_short_codes(ids_in)))
    q["rate_verdict"] = timed(lambda: run_noop(lm.sliding_window_verdicts(fx.requests(spark, sf_dir), 3, 86400)))
    q["recent_clicks"] = timed(lambda: run_noop(rp.recent_clicks(clicks, 50)))
    q["composite_stats"] = timed(lambda: run_noop(rp.composite_stats(clicks, n=5)))

    landing = os.path.join(work, "landing")
    raw.repartition(8).write.json(landing)

    def stream_ingest():
        stream = src.click_stream(spark, landing, max_files_per_trigger=2)
        pl.start_enrichment(stream, os.path.join(work, "stream_out"), os.path.join(work, "stream_ckpt"),
                            arrival=AS_OF).awaitTermination()

    q["stream_ingest"] = timed(stream_ingest)

    total = round(sum(q.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": q, "sf": sf,
                      "raw_rows": raw_rows, "enrich_rows_per_sec": round(raw_rows / max(q["enrich"], 1e-9), 1),
                      "stream_rows_per_sec": round(raw_rows / max(q["stream_ingest"], 1e-9), 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
