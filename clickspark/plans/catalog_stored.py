"""Catalogue part 5: tables under a commit log and jobs that keep state between micro-batches."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.operators import enrich as en
from clickspark.operators import idsets as ids
from clickspark.operators import keyed
from clickspark.operators import limits as lm
from clickspark.operators import listing as ls
from clickspark.operators import rollups as ru
from clickspark.operators import search_index as si
from clickspark.operators import snapshots as sn
from clickspark.operators import tables as tb
from clickspark.plans import catalog_rows as cr
from clickspark.plans import sql_rules as sr
from clickspark.plans.catalog import AS_OF, ORACLES, register, scratch
from clickspark.plans.fixture_sql import with_views
from clickspark.sources import fixtures as fx
from clickspark.streaming import pipeline as pl
from clickspark.streaming import ratelimit as rl
from clickspark.streaming import sources as src
from clickspark.streaming.logs import start_log_shipping

# --- one store for all sinks of the enrichment pipeline (K3, M3-M5, X1, X3) ----------------------------


def _store(spark, d) -> str:
    """Three micro-batches, one of them delivered twice, and a fourth that was killed between its sinks."""
    store, raw = scratch(spark, "store"), fx.raw_clicks(spark, d)
    run = pl.enrichment_batch(store, arrival=AS_OF, search_export=False)
    part = F.pmod(F.xxhash64(*raw.columns), F.lit(3))
    for batch_id in (0, 1, 1, 2):
        run(raw.where(part == batch_id), batch_id)
    pl._write_batch(en.enrich_clicks(raw, arrival=AS_OF), f"{store}/clicks", 3, pl.SINKS["clicks"])
    return store


def _counted(rows):
    return rows.groupBy("short_code", "clicked_at").agg(F.count(F.lit(1)).alias("clicks"))


_CLICKED = f"coalesce(make_timestamp(TRY_CAST(\"timestamp\" AS BIGINT) * 1000000), TIMESTAMP '{AS_OF}')"
_ALL = f"SELECT short_code, {_CLICKED} AS clicked_at, CAST(count(*) AS BIGINT) AS clicks FROM raw_click GROUP BY ALL"


def _rewritten(spark, d):
    store = _store(spark, d)
    tb.rewrite_cold(tb.read_click_table(spark, f"{store}/clicks"), f"{store}/clicks", "2024-06-15", 7)
    return _counted(tb.read_click_table(spark, f"{store}/clicks"))


register("streamed_table_rewrite", with_views(["raw_click"], _ALL))(_rewritten)


def _retained(spark, d):
    store = _store(spark, d)
    tb.drop_expired(spark, f"{store}/clicks", AS_OF, 28)
    return _counted(tb.read_click_table(spark, f"{store}/clicks"))


register("streamed_table_retention", with_views(["raw_click"], f"""
SELECT * FROM ({_ALL}) a WHERE CAST(clicked_at AS DATE) >= CAST(TIMESTAMP '{AS_OF}' AS DATE) - INTERVAL 28 DAY"""))(_retained)


def _before_and_after(spark, d):
    """Rows of every version of the click table: three batches, a rewrite, an expiry."""
    store = _store(spark, d)
    sn.rewrite_cold(spark, store, "2024-06-15", 7)
    sn.drop_expired(spark, store, AS_OF, 28)
    versions = range(sn.snapshot(spark, store).version + 1)
    each = [sn.read(spark, store, "clicks", version=v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("clicks")) for v in versions]
    return functools.reduce(DataFrame.unionByName, each)


# versions 0 and 1 hold batches that are dealt by a hash that SQL has not
register("streamed_table_versions", with_views(["raw_click"], f"""
SELECT CAST(v AS INTEGER) AS version, CAST(CASE v WHEN 4 THEN (SELECT count(*) FROM raw_click WHERE CAST({_CLICKED} AS DATE) >= CAST(TIMESTAMP '{AS_OF}' AS DATE) - INTERVAL 28 DAY)
  ELSE (SELECT count(*) FROM raw_click) END AS BIGINT) AS clicks FROM (VALUES (2), (3), (4)) t(v)"""))(
    lambda spark, d: _before_and_after(spark, d).where("version >= 2"))


def _published(spark, d):
    """Clicks by code as the rollup sink and the click table of one version have them."""
    store = _store(spark, d)
    return pl.read_rollup(spark, store, "clicks_by_device").groupBy("short_code").agg(F.sum("click_count").cast("bigint").alias("clicks"))


register("committed_rollup", with_views(["raw_click"], "SELECT short_code, CAST(count(*) AS BIGINT) AS clicks FROM raw_click GROUP BY short_code"))(_published)

# --- rate limits on streams, hot clients and incomplete requests (W1, W5, W6, L6, X8) -------------------

_GAPS = """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ip END AS ip, CASE WHEN event_id % 7 = 0 THEN NULL ELSE requested_at END AS requested_at FROM requests"""
_GAPPY = [("gappy", _GAPS)]


def _gappy(spark, d):
    e = F.col("event_id")
    return fx.requests(spark, d).select(
        e, F.when(e % 5 != 0, F.col("ip")).alias("ip"), F.when(e % 7 != 0, F.col("requested_at")).alias("requested_at"))


_US = cr.WINDOW_S * 1_000_000
register("rate_verdict_incomplete", with_views(["requests"], f"""
SELECT event_id, ip, requested_at, CASE WHEN requested_at IS NOT NULL THEN CAST(n AS BIGINT) END AS prior_count,
  CASE WHEN requested_at IS NOT NULL THEN n < {cr.LIMIT} END AS allowed
FROM (SELECT *, count(*) OVER (PARTITION BY ip ORDER BY epoch_us(requested_at) RANGE BETWEEN {_US - 1} PRECEDING AND 1 PRECEDING) AS n FROM gappy) x""", ctes=_GAPPY))(
    lambda spark, d: lm.sliding_window_verdicts(_gappy(spark, d), cr.LIMIT, cr.WINDOW_S).select("event_id", "ip", "requested_at", "prior_count", "allowed"))

register("rate_fixed_window_incomplete", with_views(["requests"], f"""
SELECT event_id, ip, CASE WHEN requested_at IS NOT NULL THEN position END AS position, CASE WHEN requested_at IS NOT NULL THEN position <= {cr.LIMIT} END AS allowed
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ip, epoch_us(requested_at) // {_US} ORDER BY requested_at, event_id) AS INTEGER) AS position FROM gappy) x""", ctes=_GAPPY))(
    lambda spark, d: lm.fixed_window_verdicts(_gappy(spark, d), cr.LIMIT, cr.WINDOW_S).select("event_id", "ip", "position", "allowed"))

register("viewer_pages_incomplete", with_views(["requests"], """
SELECT event_id, CAST((row_number() OVER (PARTITION BY ip ORDER BY requested_at DESC NULLS LAST, event_id) - 1) // 10 AS INTEGER) AS page_no,
  CAST(ceil(count(*) OVER (PARTITION BY ip) / 10.0) AS INTEGER) AS page_count FROM gappy""", ctes=_GAPPY))(
    lambda spark, d: ls.viewer_pages(_gappy(spark, d), [("requested_at", "desc"), ("event_id", "asc")], "ip", 10).select("event_id", "page_no", "page_count"))

# every client in blocks of 20 requests: the bucket is carried from block to block
register("token_bucket_blocks", ORACLES["token_bucket"])(
    lambda spark, d: lm.token_bucket_verdicts(fx.requests(spark, d), cr._CAP, cr._RATE, block_rows=20)
    .select("event_id", "ip", "requested_at", F.round("tokens_before", 6).alias("tokens_before"), "allowed"))


def _streamed_verdicts(spark, d):
    """Three micro-batches in the order of time, each with requests that are late by days; the last one is
    delivered twice."""
    out = scratch(spark, "verdicts")
    run, requests = rl.verdict_batch(out, cr.LIMIT, cr.WINDOW_S), fx.requests(spark, d).select("event_id", "ip", "requested_at")
    late = F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0
    part = F.least(F.floor((F.dayofmonth("requested_at") - 1) / 10) + F.when(late, 1).otherwise(0), F.lit(2))
    for batch_id in (0, 1, 2, 2):
        run(requests.where(part == batch_id), batch_id)
    return rl.read_verdicts(spark, out).select("event_id", "ip", "requested_at", "prior_count", "allowed", "remaining", "reset_at")


register("rate_verdict_stream", ORACLES["rate_verdict"])(_streamed_verdicts)

# --- exact visitors that merge over batches (R1, R4, R5, R6, trap T5) ---------------------------------


def _merged_exact(spark, d, rollup):
    """Three batches: the dictionary grows with each, partial rows are stored and merged, the first two beforehand."""
    base, every, known = scratch(spark, "exact"), fx.click_events(spark, d), None
    for batch_id in range(3):
        batch = every.where(F.col("event_id").cast("bigint") % 3 == batch_id)
        ids.extend_dictionary(batch, "ip_address", known).write.parquet(f"{base}/visitors/v={batch_id}")
        known = spark.read.parquet(f"{base}/visitors/v={batch_id}")
        ru.exact_partials(batch, known, rollup).write.parquet(f"{base}/partials/{batch_id}")
    parts = [spark.read.parquet(f"{base}/partials/{i}") for i in range(3)]
    two = ru.merge_exact_partials(parts[0].unionByName(parts[1]), rollup)
    return ru.rollup_from_exact(ru.merge_exact_partials(two.unionByName(parts[2]), rollup), rollup)


for _rollup, _twin in (("daily_stats", "rollup_daily_stats"), ("daily_by_url", "rollup_daily"), ("hourly_clicks", "rollup_hourly")):
    register(f"exact_merge_{_rollup}", ORACLES[_twin])(lambda spark, d, r=_rollup: _merged_exact(spark, d, r))

# --- the stored search index (F12, K5, K7) --------------------------------------------------------------


def _queries(spark, d):
    number = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select(number.alias("query_id"), F.when(number % 3 == 0, F.lit("HTTPS nothing")).when(
        number % 3 == 1, F.format_string("c%02d", "s_suppkey")).otherwise(F.lit("none")).alias("q"))


def _searched(spark, d, many):
    """Index of two thirds of the URLs, some with another address, and of some that are none; a delta mends it."""
    store, urls, code = scratch(spark, "search-index"), fx.urls(spark, d), F.xxhash64("short_code")
    stale = urls.where(F.pmod(code, F.lit(3)) > 0).withColumn("long_url", F.when(F.pmod(code, F.lit(7)) == 0, F.lit("none c01 FR")).otherwise(F.col("long_url")))
    wrong = urls.select(F.concat(F.lit("x"), "short_code").alias("short_code"), "long_url", "created_at")
    si.build(stale.select(*wrong.columns).unionByName(wrong), store, slot_rows=1000)
    si.refresh(spark, store, urls.where((F.pmod(code, F.lit(3)) == 0) | (F.pmod(code, F.lit(7)) == 0)), wrong, slot_rows=1000)
    asked = _queries(spark, d)
    if many:
        asked = asked.withColumn("q", F.concat_ws(" ", F.lit("https c1 top c10"), "q"))
    return si.bulk_search(spark, store, asked, per_query=5)


register("bulk_url_search_stored", ORACLES["bulk_url_search"])(lambda spark, d: _searched(spark, d, many=False))

_MANY = "list_concat(['https', 'c1', 'top', 'c10'], CASE s_suppkey % 3 WHEN 0 THEN ['https', 'nothing'] WHEN 1 THEN ['c' || lpad(CAST(s_suppkey AS VARCHAR), 2, '0')] ELSE ['none'] END)"
register("bulk_url_search_stored_terms", with_views(["urls"], f"""
SELECT query_id, short_code, created_at, rank, total FROM (
  SELECT query_id, short_code, created_at, CAST(row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, short_code) AS INTEGER) AS rank,
    CAST(count(*) OVER (PARTITION BY query_id) AS BIGINT) AS total
  FROM (SELECT s_suppkey AS query_id, {_MANY} AS terms FROM supplier) q
  JOIN urls ON list_has_any(list_concat({sr.tokens_sql('long_url')}, {sr.tokens_sql('short_code')}), terms)) x
WHERE rank <= 5"""))(lambda spark, d: _searched(spark, d, many=True))

# --- IPv6 ranges (C10, J9): one range per nation inside a wide one that holds them all ------------------


def _located_v6(spark, d):
    user, event = F.col("user_id") % 256, F.col("event_id") % 65536
    clicks = fx.table(spark, d, "events").select("event_id", F.format_string("2001:db8:%x::%x", user.cast("int"), event.cast("int")).alias("ip_address"))
    n = F.col("n_nationkey").cast("int") * 10
    own = fx.table(spark, d, "nation").select(
        F.format_string("2001:DB8:%x::", n).alias("start_ip"), F.format_string("2001:db8:%x:ffff:ffff:ffff:ffff:ffff", n + 9).alias("end_ip"),
        F.col("n_name").alias("country"), F.lit("").alias("country_code"), F.lit("").alias("region"), F.lit("").alias("city"))
    wide = own.limit(1).select(F.lit("2001:db8::").alias("start_ip"), F.lit("2001:db8:ffff:ffff:ffff:ffff:ffff:ffff").alias("end_ip"),
                               F.lit("ELSEWHERE").alias("country"), "country_code", "region", "city")
    return en.geo_by_range(clicks, own.unionByName(wide)).select("event_id", "country")


register("geo_by_range_v6", """
SELECT event_id, coalesce(n_name, 'ELSEWHERE') AS country FROM events LEFT JOIN nation ON user_id % 256 BETWEEN n_nationkey * 10 AND n_nationkey * 10 + 9""")(_located_v6)

# --- late clicks (X5-X7, R7): what the watermark drops is computed anew --------------------------------


def _late_rollup(spark, d):
    """Three landed files in the order of time; a tenth of the clicks lands one file late, days behind."""
    base, clicks = scratch(spark, "late"), fx.click_events(spark, d)
    late = F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0
    part = F.least(F.floor((F.dayofmonth("clicked_at") - 1) / 10) + F.when(late, 1).otherwise(0), F.lit(2))
    for i in range(3):
        clicks.where(part == i).coalesce(1).write.mode("append").parquet(f"{base}/landing")
    landed = spark.readStream.schema(clicks.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing")
    pl.start_windowed(landed, base, f"{base}/ck-windows", "1 day", "2 days").awaitTermination()
    pl.start_late(landed, base, f"{base}/ck-late", "1 day", "2 days").awaitTermination()
    pl.refresh_late(spark, base, clicks, "1 day")
    return pl.read_windowed(spark, base).select("short_code", "bucket_start", "click_count")


register("late_click_rollup", with_views(["click_events"], """
SELECT short_code, date_trunc('day', clicked_at)::TIMESTAMP AS bucket_start, CAST(count(*) AS BIGINT) AS click_count FROM click_events
WHERE date_trunc('day', clicked_at) + INTERVAL 1 DAY <= (SELECT max(clicked_at) FROM click_events) - INTERVAL 2 DAY GROUP BY ALL"""))(_late_rollup)

# --- whole streams from landed files (S1-S3, S7, K2, K10, X1, X2, X10) ------------------------------------


def _replayed(spark, d) -> str:
    """Every click published again into a landing folder, a few files to a micro-batch."""
    base = scratch(spark, "stream")
    tb.replay_clicks(fx.click_events(spark, d).repartition(4), f"{base}/landing")
    return base


def _streamed_clicks(spark, d):
    base = _replayed(spark, d)
    landed = src.click_stream(spark, f"{base}/landing", max_files_per_trigger=2)
    pl.await_stop(pl.start_enrichment(landed, f"{base}/out", f"{base}/ck", arrival=AS_OF))
    return _counted(tb.read_click_table(spark, f"{base}/out/clicks"))


register("stream_enrichment", with_views(["click_events"], """
SELECT short_code, date_trunc('second', clicked_at) AS clicked_at, CAST(count(*) AS BIGINT) AS clicks FROM click_events GROUP BY ALL"""))(_streamed_clicks)


def _streamed_counters(spark, d):
    base = _replayed(spark, d)
    pl.seed_url_table(fx.urls(spark, d), f"{base}/urls")
    pl.start_counters(src.click_stream(spark, f"{base}/landing", max_files_per_trigger=2), f"{base}/deltas", f"{base}/ck").awaitTermination()
    return pl.read_counters(spark, f"{base}/urls", f"{base}/deltas", AS_OF).select("short_code", "clicks")


register("stream_counters", ORACLES["counter_pipeline"])(_streamed_counters)


def _streamed_logs(spark, d):
    """Landed in eight files, flushed whenever about a third of their bytes are read."""
    base = scratch(spark, "log-stream")
    lines = fx.log_lines(spark, d).select("line")
    lines.repartition(8).write.text(f"{base}/landing")
    size = lines.agg(F.sum(F.octet_length("line") + 1)).first()[0]
    start_log_shipping(src.log_stream(spark, f"{base}/landing", max_bytes_per_trigger=max(1, size // 3)), f"{base}/out", f"{base}/ck").awaitTermination()
    return spark.read.schema("level string, service string, log_date date, batch_id bigint").json(f"{base}/out").groupBy(
        "service", "log_date", "level").agg(F.count(F.lit(1)).alias("lines"))


register("stream_logs", ORACLES["log_daily_counts"])(_streamed_logs)

# --- keyed tables merged on read (K5, K7, K8) ------------------------------------------------------------


def _merged_on_read(spark, d):
    """A base without a quarter of the URLs and with others that are wrong; two runs mend it, one is folded in."""
    path, code = scratch(spark, "keyed"), F.xxhash64("short_code")
    urls = fx.urls(spark, d).select("short_code", "long_url", "clicks")
    extra = urls.withColumn("short_code", F.concat(F.lit("x"), "short_code"))
    keyed.create(urls.where(F.pmod(code, F.lit(4)) > 0).withColumn("long_url", F.when(F.pmod(code, F.lit(5)) > 0, F.col("long_url"))).unionByName(extra), path, "short_code", 8)
    keyed.write_run(urls.where((F.pmod(code, F.lit(4)) == 0) | (F.pmod(code, F.lit(5)) == 0)), path, 1)
    keyed.compact(spark, path, "short_code", 1, 8)
    keyed.write_run(extra.select("short_code"), path, 2, gone=True)
    counts = fx.click_events(spark, d).groupBy("short_code").agg(F.count(F.lit(1)).alias("clicks"))
    return tb.partial_update_clicks(keyed.read(spark, path, "short_code", 8), counts)


register("merge_on_read", with_views(["urls", "click_events"], """
SELECT u.short_code, u.long_url, CAST(coalesce(n, u.clicks) AS BIGINT) AS clicks
FROM urls u LEFT JOIN (SELECT short_code, count(*) AS n FROM click_events GROUP BY short_code) c ON c.short_code = u.short_code"""))(_merged_on_read)
