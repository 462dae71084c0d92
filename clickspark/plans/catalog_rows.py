"""Catalogue part 3: enrichment, ids, logs, rate limits, service levels and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickspark.functions import network
from clickspark.functions import useragent as uar
from clickspark.functions.base62 import EPOCH_MS
from clickspark.operators import enrich as en
from clickspark.operators import ids
from clickspark.operators import limits as lm
from clickspark.operators import logs as lg
from clickspark.operators import quality as qa
from clickspark.operators import reports as rp
from clickspark.operators import search as se
from clickspark.plans.catalog import AS_OF, clicks, register
from clickspark.plans.fixture_sql import with_views
from clickspark.plans import sql_rules as sr
from clickspark.sources import fixtures as fx

RAW = ["raw_click"]


# --- enrichment (J1-J6) ---------------------------------------------------------------------------

def _enriched(spark, d):
    return en.enrich_clicks(fx.raw_clicks(spark, d), arrival=AS_OF)


_UA = sr.ua_sql("user_agent")
_ENRICHED_SQL = f"""
SELECT sha256(concat_ws(chr(1), coalesce(short_code, ''), coalesce("timestamp", ''), coalesce(ip, ''),
         coalesce(user_agent, ''), coalesce(original_url, ''), coalesce(referer, ''), coalesce(query_params, ''))) AS event_id,
  coalesce(short_code, '') AS short_code,
  coalesce(make_timestamp(TRY_CAST("timestamp" AS BIGINT) * 1000000), TIMESTAMP '{AS_OF}') AS clicked_at,
  CAST(coalesce(make_timestamp(TRY_CAST("timestamp" AS BIGINT) * 1000000), TIMESTAMP '{AS_OF}') AS DATE) AS clicked_date,
  coalesce(ip, '') AS ip_address,
  {sr.geo_label_sql("coalesce(ip, '')")} AS country, 'XX' AS country_code, {sr.geo_label_sql("coalesce(ip, '')")} AS city,
  'UTC' AS timezone,
  {_UA['browser']} AS browser, {_UA['browser_version']} AS browser_version, {_UA['os']} AS os,
  {_UA['os_version']} AS os_version, {_UA['device_type']} AS device_type, {_UA['device_brand']} AS device_brand,
  {_UA['device_model']} AS device_model,
  ({_UA['device_type']}) = 'mobile' AS is_mobile, ({_UA['device_type']}) = 'tablet' AS is_tablet,
  ({_UA['device_type']}) NOT IN ('mobile', 'tablet', 'bot') AS is_desktop, ({_UA['device_type']}) = 'bot' AS is_bot,
  coalesce(referer, '') AS referer, coalesce(query_params, '') AS query_params, TIMESTAMP '{AS_OF}' AS processed_at
FROM raw_click"""

ENRICHED_COLS = ["event_id", "short_code", "clicked_at", "clicked_date", "ip_address", "country", "country_code",
                 "city", "timezone", "browser", "browser_version", "os", "os_version", "device_type", "device_brand",
                 "device_model", "is_mobile", "is_tablet", "is_desktop", "is_bot", "referer", "query_params",
                 "processed_at"]

register("enrich_clicks", with_views(RAW, _ENRICHED_SQL))(
    lambda spark, d: _enriched(spark, d).select(*ENRICHED_COLS))

register("pipeline_lag", with_views(RAW, f"""
SELECT round(quantile_cont(lag_ms, 0.5) / 1000.0, 6) AS p50_seconds,
  round(quantile_cont(lag_ms, 0.95) / 1000.0, 6) AS p95_seconds,
  round(quantile_cont(lag_ms, 0.99) / 1000.0, 6) AS p99_seconds, CAST(count(*) AS BIGINT) AS events,
  round(quantile_cont(lag_ms, 0.95) / 1000.0, 6) <= 10.0 AS within_expectation
FROM (SELECT CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(clicked_at)) / 1000) AS BIGINT) AS lag_ms
      FROM ({_ENRICHED_SQL}) e) x"""))(
    lambda spark, d: rp.pipeline_lag(_enriched(spark, d), 10.0))

register("ua_columns", with_views(RAW, f"""
SELECT user_agent, {_UA['browser']} AS browser, {_UA['browser_version']} AS browser_version, {_UA['os']} AS os,
  {_UA['os_version']} AS os_version, {_UA['device_type']} AS device_type, {_UA['device_model']} AS device_model,
  CAST(count(*) AS BIGINT) AS clicks
FROM raw_click GROUP BY user_agent"""))(
    lambda spark, d: fx.raw_clicks(spark, d).groupBy("user_agent").agg(F.count(F.lit(1)).alias("clicks")).select(
        "user_agent", *[v.alias(k) for k, v in uar.parse("user_agent").items() if k != "device_brand"], "clicks"))

register("brand_columns", with_views(RAW, f"""
SELECT user_agent, {_UA['device_brand']} AS device_brand, CAST(count(*) AS BIGINT) AS clicks
FROM raw_click GROUP BY user_agent"""))(
    lambda spark, d: fx.raw_clicks(spark, d).groupBy("user_agent").agg(F.count(F.lit(1)).alias("clicks")).select(
        "user_agent", uar.device_brand("user_agent").alias("device_brand"), "clicks"))

register("geo_class", with_views(RAW, f"""
SELECT ip, {sr.geo_label_sql('ip')} AS country, CAST(count(*) AS BIGINT) AS clicks FROM raw_click GROUP BY ip"""))(
    lambda spark, d: fx.raw_clicks(spark, d).groupBy("ip").agg(F.count(F.lit(1)).alias("clicks"))
    .select("ip", network.geo_class("ip").alias("country"), "clicks"))

register("client_ip", with_views(["access_log"], f"""
SELECT event_id,
  {sr.client_ip_sql('x_forwarded_for', 'x_real_ip', 'remote_addr', False)} AS client_ip,
  {sr.client_ip_sql('x_forwarded_for', 'x_real_ip', 'remote_addr', True)} AS client_ip_validated
FROM access_log"""))(
    lambda spark, d: fx.access_log(spark, d).select(
        "event_id",
        network.client_ip("x_forwarded_for", "x_real_ip", "remote_addr", validate=False).alias("client_ip"),
        network.client_ip("x_forwarded_for", "x_real_ip", "remote_addr", validate=True).alias("client_ip_validated")))

# --- ids (J7, J8, J11, J12) -----------------------------------------------------------------------


def _id_requests(spark, d):
    e = fx.table(spark, d, "events")
    return e.select(F.col("event_id").alias("request_id"),
                    F.date_trunc("minute", F.col("ts")).cast("timestamp").alias("requested_at"))


_SLOTS = f"""
SELECT request_id, gen, idx + max(4096 * ms - idx) OVER (PARTITION BY gen ORDER BY ms, request_id
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS slot
FROM (SELECT request_id, gen, ms, row_number() OVER (PARTITION BY gen ORDER BY ms, request_id) - 1 AS idx
      FROM (SELECT event_id AS request_id, event_id % 1024 AS gen,
              epoch_ms(CAST(date_trunc('minute', ts) AS TIMESTAMP)) - {EPOCH_MS} AS ms FROM events) r) x"""
_ID = "((slot // 4096) << 22) | ((gen >> 5) << 17) | ((gen & 31) << 12) | (slot % 4096)"

register("short_code_encode", f"""
SELECT request_id, id, {sr.base62_encode_sql('id')} AS short_code,
  CAST(gen >> 5 AS INTEGER) AS datacenter, CAST(gen & 31 AS INTEGER) AS worker, CAST(slot % 4096 AS INTEGER) AS sequence
FROM (SELECT request_id, gen, slot, {_ID} AS id FROM ({_SLOTS}) s) t""")(
    lambda spark, d: ids.assign_short_codes(_id_requests(spark, d)).select(
        "request_id", "id", "short_code", "datacenter", "worker", "sequence"))

_DEC_VALUE, _DEC_ERROR = sr.base62_decode_sql("alias")
register("short_code_decode", with_views(["aliases"], f"""
SELECT request_id, alias, v AS id, make_timestamp(((v >> 22) + {EPOCH_MS}) * 1000) AS created_at,
  CAST((v >> 17) & 31 AS INTEGER) AS datacenter, CAST((v >> 12) & 31 AS INTEGER) AS worker,
  CAST(v & 4095 AS INTEGER) AS sequence, err AS error
FROM (SELECT request_id, alias, {_DEC_VALUE} AS v, {_DEC_ERROR} AS err FROM aliases) x"""))(
    lambda spark, d: ids.decode_short_codes(fx.aliases(spark, d), "alias").select(
        "request_id", "alias", "id", "created_at", "datacenter", "worker", "sequence", "error"))

register("shard_balance", with_views(["urls"], f"""
SELECT CAST({sr.crc32_sql('short_code')} % 4 AS INTEGER) AS shard, CAST(count(*) AS BIGINT) AS rows
FROM urls GROUP BY shard"""))(lambda spark, d: ids.shard_balance(fx.urls(spark, d), 4))

register("sample_estimate", with_views(["click_events"], f"""
SELECT short_code, CAST(count(*) AS BIGINT) AS sampled_clicks, round(CAST(count(*) AS DOUBLE) * {65536.0 / int(0.1 * 65536)!r}, 6) AS estimated_clicks
FROM click_events WHERE substr(md5(event_id), 1, 4) < '{format(int(0.1 * 65536), '04x')}' GROUP BY short_code"""))(
    lambda spark, d: ids.sample_estimate(clicks(spark, d), 0.10))

# --- logs (J13, K9) -------------------------------------------------------------------------------

_LOGS_SQL = f"""
SELECT line_no,
  coalesce(CASE WHEN regexp_matches(json_extract_string(line, '$.timestamp'),
                                    '{lg.RFC3339}') THEN TRY_CAST(json_extract_string(line, '$.timestamp') AS TIMESTAMP) END,
           TIMESTAMP '{AS_OF}') AS "timestamp",
  coalesce(json_extract_string(line, '$.level'), '') AS level,
  coalesce(json_extract_string(line, '$.msg'), '') AS message,
  coalesce(json_extract_string(line, '$.service'), 'unknown') AS service,
  json_extract_string(line, '$.user') AS user_field,
  CAST(nullif(len(list_filter(json_keys(line), lambda k: k NOT IN ('level', 'msg', 'timestamp', 'service'))), 0) AS INTEGER) AS n_fields
FROM log_lines WHERE json_valid(line)"""


def _logs(spark, d):
    return lg.normalise_logs(fx.log_lines(spark, d), ingest_time=AS_OF)


register("log_normalise", with_views(["log_lines"], _LOGS_SQL))(
    lambda spark, d: _logs(spark, d).select(
        "line_no", "timestamp", "level", "message", "service", F.col("fields")["user"].alias("user_field"),
        F.when(F.col("fields").isNotNull(), F.size("fields")).alias("n_fields")))

register("log_daily_counts", with_views(["log_lines"], f"""
SELECT service, CAST("timestamp" AS DATE) AS log_date, level, CAST(count(*) AS BIGINT) AS lines
FROM ({_LOGS_SQL}) l GROUP BY service, log_date, level"""))(
    lambda spark, d: lg.daily_counts(_logs(spark, d)))

# --- rate limits and service levels (W1, W2, W5, W6, Q7) -----------------------------------------

LIMIT, WINDOW_S = 3, 86400
_W = WINDOW_S * 1_000_000
_VERDICT_SQL = f"""
SELECT event_id, ip, requested_at, CAST(prior_count AS BIGINT) AS prior_count, prior_count < {LIMIT} AS allowed,
  CAST(CASE WHEN prior_count < {LIMIT} THEN greatest({LIMIT} - prior_count - 1, 0) ELSE 0 END AS INTEGER) AS remaining,
  make_timestamp(CASE WHEN prior_count < {LIMIT} THEN epoch_us(requested_at) + {_W} ELSE oldest + {_W} END) AS reset_at
FROM (SELECT *, count(*) OVER w AS prior_count, min(epoch_us(requested_at)) OVER w AS oldest FROM requests
      WINDOW w AS (PARTITION BY ip ORDER BY epoch_us(requested_at) RANGE BETWEEN {_W - 1} PRECEDING AND 1 PRECEDING)) x"""


def _verdicts(spark, d):
    return lm.sliding_window_verdicts(fx.requests(spark, d), LIMIT, WINDOW_S)


register("rate_verdict", with_views(["requests"], _VERDICT_SQL))(
    lambda spark, d: _verdicts(spark, d).select(
        "event_id", "ip", "requested_at", "prior_count", "allowed", "remaining", "reset_at"))

register("rate_headers", with_views(["requests"], f"""
SELECT event_id, {LIMIT} AS x_ratelimit_limit, remaining AS x_ratelimit_remaining,
  CAST(floor(epoch_us(reset_at) / 1000000) AS BIGINT) AS x_ratelimit_reset,
  CASE WHEN NOT allowed THEN CAST(floor((epoch_us(reset_at) - epoch_us(requested_at)) / 1000000) AS BIGINT) END AS retry_after,
  CASE WHEN allowed THEN 200 ELSE 429 END AS http_status
FROM ({_VERDICT_SQL}) v"""))(
    lambda spark, d: lm.rate_headers(_verdicts(spark, d), LIMIT).select(
        "event_id", "x_ratelimit_limit", "x_ratelimit_remaining", "x_ratelimit_reset", "retry_after", "http_status"))

_FIXED_SQL = f"""
SELECT event_id, ip, window_start, position, position <= {LIMIT} AS allowed FROM (
  SELECT event_id, ip, requested_at, make_timestamp((epoch_us(requested_at) // {_W}) * {_W}) AS window_start,
    CAST(row_number() OVER (PARTITION BY ip, epoch_us(requested_at) // {_W} ORDER BY requested_at, event_id) AS INTEGER) AS position
  FROM requests) x"""

register("rate_fixed_window", with_views(["requests"], _FIXED_SQL))(
    lambda spark, d: lm.fixed_window_verdicts(fx.requests(spark, d), LIMIT, WINDOW_S).select(
        "event_id", "ip", "window_start", "position", "allowed"))

register("rate_boundary_bursts", with_views(["requests"], f"""
SELECT f.event_id, s.ip, f.allowed AS fixed_allowed, s.allowed AS sliding_allowed
FROM ({_FIXED_SQL}) f JOIN ({_VERDICT_SQL}) s ON s.event_id = f.event_id
WHERE f.allowed AND NOT s.allowed"""))(
    lambda spark, d: lm.boundary_bursts(
        lm.fixed_window_verdicts(fx.requests(spark, d), LIMIT, WINDOW_S), _verdicts(spark, d)))

_CAP, _RATE = 3.0, 3.0 / 86400
_REFILL = f"least(CAST({_CAP!r} AS DOUBLE), tb.tokens_after + CAST(s.us - tb.us AS DOUBLE) / 1e6 * {_RATE!r})"
_SEQ = """SELECT event_id, ip, requested_at, epoch_us(requested_at) AS us,
          row_number() OVER (PARTITION BY ip ORDER BY requested_at, event_id) AS rn FROM requests"""
_TB = f"""
  SELECT ip, rn, us, CAST({_CAP!r} AS DOUBLE) AS tokens_before, CAST({_CAP!r} AS DOUBLE) - 1.0 AS tokens_after
  FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.ip, s.rn, s.us, {_REFILL} AS tokens_before,
    CASE WHEN {_REFILL} >= 1.0 THEN {_REFILL} - 1.0 ELSE {_REFILL} END AS tokens_after
  FROM tb JOIN seq s ON s.ip = tb.ip AND s.rn = tb.rn + 1"""
register("token_bucket", with_views(["requests"], """
SELECT s.event_id, s.ip, s.requested_at, round(tb.tokens_before, 6) AS tokens_before, tb.tokens_before >= 1.0 AS allowed
FROM seq s JOIN tb ON tb.ip = s.ip AND tb.rn = s.rn""", ctes=[("seq", _SEQ), ("tb", _TB)]).replace(
    "WITH ", "WITH RECURSIVE ", 1))(
    lambda spark, d: lm.token_bucket_verdicts(fx.requests(spark, d), capacity=_CAP, refill_per_second=_RATE)
    .select("event_id", "ip", "requested_at", F.round("tokens_before", 6).alias("tokens_before"), "allowed"))

register("slo_report", with_views(["requests"], """
SELECT CAST(requested_at AS DATE) AS day, CAST(count(*) AS BIGINT) AS requests,
  round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms, round(quantile_cont(duration_ms, 0.99), 6) AS p99_ms,
  round(avg(CASE WHEN status >= 500 THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
  round(avg(CASE WHEN status >= 500 THEN 0.0 ELSE 1.0 END), 6) AS success_rate,
  round(quantile_cont(duration_ms, 0.95), 6) < 500.0 AND round(quantile_cont(duration_ms, 0.99), 6) < 1000.0
    AND round(avg(CASE WHEN status >= 500 THEN 1.0 ELSE 0.0 END), 6) < 0.01 AS passed
FROM requests GROUP BY day"""))(
    lambda spark, d: qa.slo_report(fx.requests(spark, d)))

# --- search (F11, F12) ----------------------------------------------------------------------------

register("click_search", with_views(["click_events"], """
SELECT event_id, short_code, clicked_at, country_code, device_type, ip_address, t.total
FROM click_events, (SELECT CAST(count(*) AS BIGINT) AS total FROM click_events
                    WHERE device_type = 'mobile' AND clicked_at >= TIMESTAMP '2024-01-10 00:00:00'
                      AND clicked_at <= TIMESTAMP '2024-01-20 12:00:00') t
WHERE device_type = 'mobile' AND clicked_at >= TIMESTAMP '2024-01-10 00:00:00' AND clicked_at <= TIMESTAMP '2024-01-20 12:00:00'
ORDER BY clicked_at DESC, event_id LIMIT 20 OFFSET 5"""))(
    lambda spark, d: se.click_search(clicks(spark, d), device="mobile", start="2024-01-10 00:00:00.500",
                                     end="2024-01-20 12:00:00.900", limit=20, offset=5))

for _name, _query in (("url_search", "FR top"), ("url_search_code", "C42 utm-source")):
    _terms = "[" + ", ".join(f"'{t}'" for t in _query.lower().replace("-", " ").split()) + "]"
    _match = f"list_has_any(list_concat({sr.tokens_sql('long_url')}, {sr.tokens_sql('short_code')}), {_terms})"
    register(_name, with_views(["urls"], f"""
SELECT short_code, long_url, created_at, t.total
FROM urls, (SELECT CAST(count(*) AS BIGINT) AS total FROM urls WHERE {_match}) t
WHERE {_match} ORDER BY created_at DESC, short_code LIMIT 20"""))(
        lambda spark, d, q=_query: se.url_search(fx.urls(spark, d), q, 20, 0))

# One query per supplier: its number as a code, and words that stand in many URLs or in none.
register("bulk_url_search", with_views(["urls"], f"""
SELECT query_id, short_code, created_at, rank, total FROM (
  SELECT query_id, short_code, created_at, CAST(row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, short_code) AS INTEGER) AS rank,
    CAST(count(*) OVER (PARTITION BY query_id) AS BIGINT) AS total
  FROM (SELECT s_suppkey AS query_id, CASE s_suppkey % 3 WHEN 0 THEN ['https', 'nothing'] WHEN 1 THEN ['c' || lpad(CAST(s_suppkey AS VARCHAR), 2, '0')] ELSE ['none'] END AS terms
        FROM supplier) q
  JOIN urls ON list_has_any(list_concat({sr.tokens_sql('long_url')}, {sr.tokens_sql('short_code')}), terms)) x
WHERE rank <= 5"""))(
    lambda spark, d: se.bulk_url_search(fx.urls(spark, d), fx.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("query_id"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit("HTTPS nothing")).when(F.col("s_suppkey") % 3 == 1, F.format_string("c%02d", "s_suppkey"))
        .otherwise(F.lit("none")).alias("q")), per_query=5))
