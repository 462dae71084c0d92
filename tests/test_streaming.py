"""Streaming = batch equivalence and replay (idempotency) tests."""

import os

import pytest
from pyspark.sql import functions as F

from clickspark.operators import enrich as en
from clickspark.operators import limits
from clickspark.operators import rollups as ru
from clickspark.sources import fixtures as fx
from clickspark.streaming import pipeline as pl
from clickspark.streaming import ratelimit as rl
from clickspark.streaming import sources as src
from clickspark.streaming.logs import start_log_shipping
from tests.conftest import SF_SMALL

AS_OF = fx.AS_OF
COLS = ["event_id", "short_code", "clicked_at", "ip_address", "country", "browser", "os", "device_type",
        "is_bot", "referer", "query_params"]


def _land_raw(spark, scratch, parts=4):
    landing = os.path.join(scratch, "landing")
    fx.raw_clicks(spark, SF_SMALL).repartition(parts).write.json(landing)
    return landing


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def test_enrichment_stream_equals_batch(spark, scratch):
    landing = _land_raw(spark, scratch)
    out = os.path.join(scratch, "out")
    stream = src.click_stream(spark, landing, max_files_per_trigger=1)
    q = pl.start_enrichment(stream, out, os.path.join(scratch, "ckpt"), arrival=AS_OF)
    q.awaitTermination()
    streamed = spark.read.parquet(f"{out}/clicks")
    good, _ = en.split_bad_messages(fx.raw_clicks(spark, SF_SMALL))
    batch = en.enrich_clicks(good, arrival=AS_OF)
    assert _rows(streamed.drop("event_id").withColumn("event_id", F.lit(""))) == _rows(batch.drop("event_id").withColumn("event_id", F.lit("")))
    assert streamed.select("event_id").distinct().count() == streamed.count()  # ids come from file and place
    assert streamed.select("batch_id").distinct().count() == 4  # one file per micro-batch
    # rollup partials merged across batches equal the batch rollup
    merged = pl.read_rollup(spark, out, "clicks_by_country").select(
        "short_code", "clicked_date", "country", "country_code", "click_count")
    direct = ru.clicks_by_country(batch)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, direct.collect()))
    # compaction of the first batches leaves the merged result unchanged
    for name in pl.ROLLUPS:
        before = sorted(map(tuple, pl.read_rollup(spark, out, name).collect()))
        pl.compact_rollup(spark, out, name, 1)
        assert sorted(map(tuple, pl.read_rollup(spark, out, name).collect())) == before
    # search export: two NDJSON lines per click
    lines = spark.read.text(f"{out}/search").count()
    assert lines == 2 * batch.count()
    # quarantine holds the messages without a short code; the report and backlog helpers work
    bad = fx.raw_clicks(spark, SF_SMALL).where(F.col("short_code").isNull() | (F.col("short_code") == "")).count()
    assert pl.read_quarantine(spark, out).count() == bad
    assert pl.quarantine_report(spark, out, 0).where("alert").count() == (0 if bad == 0 else
                                                                        pl.quarantine_report(spark, out, 0).count())
    entries = spark.read.text(landing)
    info = pl.backlog(q, entries, out, threshold_rows=10)
    assert info["input_rows"] > 10 and info["backlog_rows"] == 0 and not info["backlog_alert"]
    info = pl.backlog(q, entries.unionByName(entries.limit(50)), out, threshold_rows=10)
    assert info["backlog_rows"] == 50 and info["backlog_alert"]


def test_replayed_batch_is_idempotent(spark, scratch):
    out = os.path.join(scratch, "out")
    raw = fx.raw_clicks(spark, SF_SMALL)
    run = pl.enrichment_batch(out, arrival=AS_OF, search_export=False)
    run(raw, 0)
    first = spark.read.parquet(f"{out}/clicks").count()
    run(raw, 0)  # replay after a failure: same batch id
    assert spark.read.parquet(f"{out}/clicks").count() == first
    run(raw, 1)
    assert spark.read.parquet(f"{out}/clicks").count() == 2 * first


def test_counter_pipeline_replay_does_not_double_count(spark, scratch):
    urls_dir, deltas_dir = os.path.join(scratch, "urls"), os.path.join(scratch, "deltas")
    pl.seed_url_table(fx.urls(spark, SF_SMALL), urls_dir)
    run = pl.counter_batch(deltas_dir)
    raw = fx.raw_clicks(spark, SF_SMALL)
    run(raw, 0)
    run(raw, 0)  # replay
    known = [r.short_code for r in fx.urls(spark, SF_SMALL).collect()]
    expected = raw.where(F.col("short_code").isin(known)).count()

    def total():
        return pl.read_counters(spark, urls_dir, deltas_dir, AS_OF).agg(F.sum("clicks")).first()[0]

    assert total() == expected
    run(raw, 1)
    assert total() == 2 * expected
    pl.compact_counters(spark, urls_dir, deltas_dir, 1, AS_OF)
    pl.compact_counters(spark, urls_dir, deltas_dir, 1, AS_OF)  # idempotent
    assert pl.committed_versions(spark, urls_dir)[-1] == 1
    assert total() == 2 * expected
    run(raw, 2)
    assert total() == 3 * expected


def test_counter_stream(spark, scratch):
    landing = _land_raw(spark, scratch, parts=2)
    urls_dir, deltas_dir = os.path.join(scratch, "urls"), os.path.join(scratch, "deltas")
    pl.seed_url_table(fx.urls(spark, SF_SMALL), urls_dir)
    q = pl.start_counters(src.click_stream(spark, landing, max_files_per_trigger=1), deltas_dir,
                          os.path.join(scratch, "ckpt"))
    q.awaitTermination()
    assert spark.read.parquet(deltas_dir).select("batch_id").distinct().count() == 2
    known = [r.short_code for r in fx.urls(spark, SF_SMALL).collect()]
    expected = fx.raw_clicks(spark, SF_SMALL).where(F.col("short_code").isin(known)).count()
    assert pl.read_counters(spark, urls_dir, deltas_dir, AS_OF).agg(F.sum("clicks")).first()[0] == expected


def test_dedup_and_windowed_rollup_streams(spark, scratch):
    clicks = fx.click_events(spark, SF_SMALL)
    landing = os.path.join(scratch, "clicks")
    clicks.unionByName(clicks).write.parquet(landing)  # every event twice
    stream = spark.readStream.schema(clicks.schema).parquet(landing)
    deduped = pl.dedup_stream(stream)
    q = (deduped.writeStream.format("memory").queryName("dedup_out").outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ckpt1")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("dedup_out").count() == clicks.count()
    rolled = pl.windowed_rollup(spark.readStream.schema(clicks.schema).parquet(landing), "1 day", "1 day")
    q2 = (rolled.writeStream.format("memory").queryName("roll_out").outputMode("append")
          .option("checkpointLocation", os.path.join(scratch, "ckpt2")).trigger(availableNow=True).start())
    q2.awaitTermination()
    got = spark.table("roll_out")
    assert got.count() > 0
    assert got.agg(F.sum("click_count")).first()[0] <= 2 * clicks.count()


def test_log_shipping_stream(spark, scratch):
    lines = fx.log_lines(spark, SF_SMALL).select("line")
    landing = os.path.join(scratch, "logs_in")
    lines.coalesce(2).write.text(landing)
    out = os.path.join(scratch, "logs_out")
    q = start_log_shipping(src.log_stream(spark, landing, max_bytes_per_trigger=1024), out, os.path.join(scratch, "ckpt"))
    q.awaitTermination()
    shipped = spark.read.json(out)
    assert shipped.count() == lines.where(~F.col("line").startswith("not")).count()
    assert set(shipped.columns) >= {"service", "log_date", "level", "message"}


def test_identical_clicks_keep_ids_of_their_own_and_replays_do_not(spark, scratch):
    landing = os.path.join(scratch, "landing")
    raw = fx.raw_clicks(spark, SF_SMALL).limit(100)
    raw.unionByName(raw).unionByName(raw).coalesce(1).write.json(landing)
    with open(os.path.join(landing, "part-extra.json"), "w") as f:
        f.write('{"short_code": "c01", "message_id": "m1"}\n{"short_code": "c01", "message_id": "m2"}\nnot json\n{"short_code": "c01", "message_id": "m2"}\n')
    ids = []
    for i in range(2):  # the same files into two outputs: a full replay
        out = os.path.join(scratch, f"out{i}")
        pl.start_enrichment(src.click_stream(spark, landing), out, os.path.join(scratch, f"ckpt{i}"), arrival=AS_OF).awaitTermination()
        rows = spark.read.parquet(f"{out}/clicks")
        assert rows.count() == 303 and rows.select("event_id").distinct().count() == 302
        bad = pl.read_quarantine(spark, out).collect()
        assert [(r.reason, r._text) for r in bad] == [("malformed message", "not json")]
        ids.append(sorted(r.event_id for r in rows.select("event_id").collect()))
    assert ids[0] == ids[1]


def test_kafka_positions_keep_identical_messages_apart(spark):
    raw = fx.raw_clicks(spark, SF_SMALL).limit(5).withColumn("position", F.lit("0:7"))
    again = raw.withColumn("position", F.lit("0:8"))
    rows = en.enrich_clicks(en.with_positions(raw.unionByName(again).unionByName(raw)), arrival=AS_OF, position="position")
    assert rows.count() == 15 and rows.select("event_id").distinct().count() == 10


def test_a_failing_batch_is_quarantined_after_its_attempts(spark, scratch, monkeypatch):
    out = os.path.join(scratch, "out")
    raw = fx.raw_clicks(spark, SF_SMALL).limit(20)
    run = pl.enrichment_batch(out, arrival=AS_OF, search_export=False, max_attempts=3)

    def broken(*args):
        raise RuntimeError("sink is down")

    monkeypatch.setattr(pl, "_enriched", broken)
    for _ in range(2):
        with pytest.raises(RuntimeError):
            run(raw, 0)
    run(raw, 0)
    report = pl.quarantine_report(spark, out, 5).collect()
    assert [(r.reason, r.messages, r.attempts, r.alert) for r in report] == [("failed batch", 20, 3, True)]


def test_bad_messages_are_quarantined_not_blocking(spark, scratch):
    raw = fx.raw_clicks(spark, SF_SMALL)
    bad = raw.limit(7).withColumn("short_code", F.lit(None).cast("string"))
    out = os.path.join(scratch, "out")
    pl.enrichment_batch(out, arrival=AS_OF, search_export=False)(raw.unionByName(bad), 0)
    assert pl.read_quarantine(spark, out).count() == 7
    report = pl.quarantine_report(spark, out, 5).collect()
    assert [(r.reason, r.messages, r.alert) for r in report] == [("missing short_code", 7, True)]
    assert spark.read.parquet(f"{out}/clicks").count() == raw.count()


def test_resolve_stream_and_rollup_refresh(spark, scratch):
    clicks = fx.click_events(spark, SF_SMALL)
    landing = os.path.join(scratch, "clicks")
    clicks.write.parquet(landing)
    stream = spark.readStream.schema(clicks.schema).parquet(landing)
    q = (pl.resolve_stream(stream, fx.urls(spark, SF_SMALL)).writeStream.format("memory").queryName("resolved")
         .option("checkpointLocation", os.path.join(scratch, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    from clickspark.operators import resolve as rs
    assert spark.table("resolved").count() == rs.resolve_clicks(clicks, fx.urls(spark, SF_SMALL)).count()
    # First a full build, then a refresh replaces only the window's whole days
    path = os.path.join(scratch, "daily_stats")
    full = ru.daily_stats(clicks).withColumn("bucket_day", F.date_format("day", "yyyy-MM-dd"))
    full.write.partitionBy("bucket_day").parquet(path)
    late = clicks.unionByName(clicks.where("clicked_date = '2024-01-28'"))  # late copies for one day
    ru.refresh_daily_stats(late, path, "2024-01-30 12:00:00")
    stored = spark.read.parquet(path)
    assert stored.count() == full.count()
    day = lambda df, d: df.where(F.col("bucket_day") == d).agg(F.sum("total_clicks")).first()[0]
    assert day(stored, "2024-01-28") == 2 * day(full, "2024-01-28")
    assert day(stored, "2024-01-20") == day(full, "2024-01-20")


def test_stream_arrival_time_is_the_batch_time(spark, scratch):
    landing = _land_raw(spark, scratch, parts=2)
    out = os.path.join(scratch, "out")
    q = pl.start_enrichment(src.click_stream(spark, landing, max_files_per_trigger=1), out,
                            os.path.join(scratch, "ckpt"))  # no fixed arrival: batch time is used
    q.awaitTermination()
    clicks = spark.read.parquet(f"{out}/clicks")
    per_batch = clicks.groupBy("batch_id").agg(F.countDistinct("processed_at").alias("n")).collect()
    assert per_batch and all(r.n == 1 for r in per_batch)  # one arrival time per micro-batch
    bad_time = clicks.where(F.col("event_id").isNotNull() & (F.col("clicked_at") == F.col("processed_at")))
    raw_bad = fx.raw_clicks(spark, SF_SMALL).where(~F.col("timestamp").rlike("^[0-9]+$") | F.col("timestamp").isNull())
    assert bad_time.count() == raw_bad.count()
    assert "_arrival" not in clicks.columns


def test_history_based_rate_verdicts_equal_batch(spark, scratch):
    reqs = fx.requests(spark, SF_SMALL)
    landing = os.path.join(scratch, "requests")
    days = [("2024-01-01", "2024-01-07"), ("2024-01-07", "2024-01-13"), ("2024-01-13", "2024-01-19"),
            ("2024-01-19", "2024-01-25"), ("2024-01-25", "2024-02-01")]
    for lo, hi in days:  # one file per period, appended in time order (the source orders files by mtime)
        reqs.where((F.col("requested_at") >= lo) & (F.col("requested_at") < hi)).coalesce(1) \
            .write.mode("append").parquet(landing)
    stream = spark.readStream.schema(reqs.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    out = os.path.join(scratch, "rl")
    rl.start_rate_verdicts(stream, out, os.path.join(scratch, "ckpt"), 3, 86400).awaitTermination()
    got = {r.event_id: (r.prior_count, r.allowed, r.reset_at) for r in rl.read_verdicts(spark, out).collect()}
    want = {r.event_id: (r.prior_count, r.allowed, r.reset_at)
            for r in limits.sliding_window_verdicts(reqs, 3, 86400).collect()}
    assert got == want
    assert spark.read.parquet(f"{out}/verdicts").select("batch_id").distinct().count() == 5


def test_late_requests_correct_earlier_verdicts(spark, scratch):
    reqs = fx.requests(spark, SF_SMALL).select("event_id", "ip", "requested_at")
    out = os.path.join(scratch, "rl")
    run = rl.verdict_batch(out, 3, 86400)
    parts = [reqs.where(F.pmod(F.hash("event_id"), F.lit(4)) == i) for i in range(4)]  # times in no order at all
    for i, part in enumerate(parts):
        run(part, i)
    run(parts[3], 3)  # replay of the last batch
    got = {r.event_id: (r.prior_count, r.allowed, r.reset_at) for r in rl.read_verdicts(spark, out).collect()}
    want = {r.event_id: (r.prior_count, r.allowed, r.reset_at) for r in limits.sliding_window_verdicts(reqs, 3, 86400).collect()}
    assert got == want


def test_rate_verdicts_read_only_the_hours_around_a_batch(spark, scratch, monkeypatch):
    """The files opened by a late batch are as many as those of an early one; late requests still correct."""
    import datetime as dt
    import random

    pick, out, start = random.Random(4), os.path.join(scratch, "rl"), dt.datetime(2024, 1, 1)
    opened, stored = [], rl._stored

    def watched(spark_, *where):
        rows = stored(spark_, *where)
        opened[-1].append(0 if rows is None else len(rows.inputFiles()))
        return rows

    monkeypatch.setattr(rl, "_stored", watched)
    run, every = rl.verdict_batch(out, 2, 900), []
    for batch_id in range(14):
        rows = [(batch_id * 100 + i, pick.choice(["a", "b", None]), start + dt.timedelta(hours=3 * batch_id, minutes=pick.randrange(60))) for i in range(12)]
        if batch_id in (6, 13):  # late by hours, and without a time
            rows += [(batch_id * 100 + 50, "a", start + dt.timedelta(minutes=20)), (batch_id * 100 + 51, "b", start + dt.timedelta(hours=9, minutes=5)), (batch_id * 100 + 52, "a", None)]
        every += rows
        opened.append([])
        run(spark.createDataFrame(rows, "event_id long, ip string, requested_at timestamp").coalesce(1), batch_id)
    opened.append([])
    run(spark.createDataFrame(rows, "event_id long, ip string, requested_at timestamp").coalesce(1), 13)  # replay
    whole = spark.createDataFrame(every, "event_id long, ip string, requested_at timestamp")
    verdict = lambda df: {r.event_id: (r.prior_count, r.allowed, r.reset_at) for r in df.collect()}
    assert verdict(rl.read_verdicts(spark, out)) == verdict(limits.sliding_window_verdicts(whole, 2, 900))
    assert opened[2] == opened[5] == opened[12] and sum(opened[13]) < 15
    day = rl.read_verdicts(spark, out, start="2024-01-01 00:00:00", end="2024-01-01 00:59:59")
    assert {r.event_id // 100 for r in day.collect()} == {0, 6, 13}


def test_a_stop_request_leaves_the_batch_committed_and_listener_counts(spark, scratch):
    from clickspark.operators import tables as tb
    landing, out, ckpt = _land_raw(spark, scratch, parts=3), os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    watch = pl.ProgressLog(threshold=0)
    spark.streams.addListener(watch)
    try:
        run, calls = pl.note_attempt, []

        def asked(spark_, out_dir, batch_id):  # the request comes while the first batch is under way
            calls.append(batch_id)
            if len(calls) == 1:
                pl.request_stop(spark_, out_dir)
            return run(spark_, out_dir, batch_id)

        pl.note_attempt = asked
        try:
            query = pl.start_enrichment(src.click_stream(spark, landing, max_files_per_trigger=1), out, ckpt, arrival=AS_OF)
            assert pl.await_stop(query, timeout=120)
        finally:
            pl.note_attempt = run
        first = tb.read_click_table(spark, f"{out}/clicks").count()
        assert calls == [0] and 0 < first < fx.raw_clicks(spark, SF_SMALL).count()
        query = pl.start_enrichment(src.click_stream(spark, landing, max_files_per_trigger=1), out, ckpt, arrival=AS_OF)
        assert pl.await_stop(query, timeout=300)
        assert tb.read_click_table(spark, f"{out}/clicks").count() == fx.raw_clicks(spark, SF_SMALL).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        log = watch.backlog(query.id)
        assert log["rows"] == fx.raw_clicks(spark, SF_SMALL).count() and log["batch_id"] == 2 and not log["running"] and not log["backlog_alert"]
    finally:
        spark.streams.removeListener(watch)


def test_verdicts_scan_the_requests_a_few_times_only(spark, scratch):
    requests = spark.range(50).select(F.col("id").alias("event_id"), F.lit("a").alias("ip"), F.timestamp_seconds("id").alias("requested_at"))
    plan = limits.sliding_window_verdicts(requests, 3, 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 50") <= 5  # requests and their spans, twice; those without a time


def test_new_and_corrected_verdicts_come_from_one_pass(spark, scratch, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    plain = rl.sliding_window_verdicts

    def counted(*args):
        verdicts = plain(*args)
        names = verdicts.columns

        def count(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf
        return verdicts.mapInPandas(count, verdicts.schema).select(*names)

    monkeypatch.setattr(rl, "sliding_window_verdicts", counted)
    run, out = rl.verdict_batch(os.path.join(scratch, "verdicts"), 2, 60), os.path.join(scratch, "verdicts")
    rows = lambda ids: spark.createDataFrame([(i, "a", i) for i in ids], "event_id int, ip string, s int").select(
        "event_id", "ip", F.timestamp_seconds("s").alias("requested_at"))
    run(rows(range(0, 100, 2)), 0)
    run(rows([1, 51]), 1)
    assert seen.value == 50 + 52
    want = plain(rows([*range(0, 100, 2), 1, 51]), 2, 60)
    columns = ["event_id", "prior_count", "allowed", "remaining", "reset_at"]
    assert sorted(rl.read_verdicts(spark, out).select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_rollups_read_the_written_clicks(spark, scratch, monkeypatch):
    seen, plain = [], ru.partial_rollups
    monkeypatch.setattr(ru, "partial_rollups", lambda clicks: seen.append((clicks.is_cached, len(clicks.inputFiles()), clicks.count())) or plain(clicks))
    raw = fx.raw_clicks(spark, SF_SMALL)
    pl.enrichment_batch(os.path.join(scratch, "out"), arrival=AS_OF, search_export=False)(raw, 0)
    assert len(seen) == 1 and not seen[0][0] and seen[0][1] > 0 and seen[0][2] == raw.count()
    none = raw.withColumn("short_code", F.lit(""))  # nothing but bad messages
    pl.enrichment_batch(os.path.join(scratch, "none"), arrival=AS_OF)(none, 0)
    assert len(seen) == 1 and pl._sink(spark, os.path.join(scratch, "none"), "quarantine").count() == raw.count()
