"""Catalogue part 2: URL / user tables, joins, listing, quality and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickspark.operators import listing as ls
from clickspark.operators import quality as qa
from clickspark.operators import reports as rp
from clickspark.operators import resolve as rs
from clickspark.operators import tables as tb
from clickspark.plans.catalog import AS_OF, ORACLES, clicks, register
from clickspark.plans.fixture_sql import with_views
from clickspark.plans.sql_rules import alias_reason_sql
from clickspark.sources import fixtures as fx

EMAIL_SQL = r"(?i)^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
ACTIVE = f"(expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')"
LIVE_AT_CLICK = "(u.expires_at IS NULL OR u.expires_at > c.clicked_at)"


def urls(spark, d):
    return fx.urls(spark, d)


def users(spark, d):
    return fx.users(spark, d)


# --- joins ----------------------------------------------------------------------------------------

register("resolve_clicks", with_views(["click_events", "urls"], f"""
SELECT c.event_id, c.short_code, c.clicked_at, u.long_url
FROM click_events c JOIN urls u ON u.short_code = c.short_code WHERE {LIVE_AT_CLICK}"""))(
    lambda spark, d: rs.resolve_clicks(clicks(spark, d), urls(spark, d)))

# URL table in which every tenth code has been renamed, so that its clicks find no link.
RENAMED = """SELECT CASE WHEN CAST(substr(short_code, 2) AS BIGINT) % 10 = 7 THEN 'gone-' || short_code ELSE short_code END AS short_code,
  long_url, clicks, created_at, expires_at, user_id FROM urls"""


def renamed_urls(spark, d):
    gone = F.substring("short_code", 2, 18).cast("bigint") % 10 == 7
    return urls(spark, d).withColumn("short_code", F.when(gone, F.concat(F.lit("gone-"), "short_code")).otherwise(F.col("short_code")))


register("dead_link_hits", with_views(["click_events", "urls"], f"""
SELECT m.short_code, CAST(count(*) AS BIGINT) AS hits, min(m.clicked_at) AS first_hit, max(m.clicked_at) AS last_hit,
  m.short_code IN (SELECT short_code FROM renamed) AS known
FROM (SELECT c.* FROM click_events c
      WHERE NOT EXISTS (SELECT 1 FROM renamed u WHERE u.short_code = c.short_code AND {LIVE_AT_CLICK})) m
GROUP BY m.short_code""", ctes=[("renamed", RENAMED)]))(
    lambda spark, d: rs.dead_link_hits(clicks(spark, d), renamed_urls(spark, d)))

register("apply_counters", with_views(["click_events", "urls"], f"""
SELECT u.short_code, CAST(u.clicks + coalesce(d.delta, 0) AS BIGINT) AS clicks,
  CASE WHEN d.delta IS NULL THEN u.created_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at
FROM urls u LEFT JOIN (SELECT short_code, count(*) AS delta FROM click_events
                       WHERE short_code IS NOT NULL AND short_code <> '' GROUP BY short_code) d
  ON d.short_code = u.short_code"""))(
    lambda spark, d: rs.apply_counters(urls(spark, d), rp.fold_increments(clicks(spark, d)), AS_OF)
    .select("short_code", "clicks", "updated_at"))

register("reconcile_counters", with_views(["click_events", "urls"], """
SELECT * FROM (
  SELECT coalesce(u.short_code, c.short_code) AS short_code,
    CAST(coalesce(u.clicks, 0) AS BIGINT) AS counter_clicks, CAST(coalesce(c.n, 0) AS BIGINT) AS table_clicks,
    CAST(coalesce(u.clicks, 0) - coalesce(c.n, 0) AS BIGINT) AS diff
  FROM urls u FULL OUTER JOIN (SELECT short_code, count(*) AS n FROM click_events GROUP BY short_code) c
    ON c.short_code = u.short_code) x
WHERE diff <> 0"""))(
    lambda spark, d: rs.reconcile_counters(urls(spark, d), clicks(spark, d)))

register("orphan_urls", with_views(["urls", "users"], """
SELECT short_code, user_id FROM urls u
WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users s WHERE s.id = u.user_id)"""))(
    lambda spark, d: rs.orphan_urls(urls(spark, d), users(spark, d)))

register("cascade_delete", with_views(["click_events", "urls"], f"""
SELECT event_id, short_code FROM click_events
WHERE short_code NOT IN (SELECT short_code FROM urls WHERE expires_at IS NOT NULL AND expires_at < TIMESTAMP '{AS_OF}')"""))(
    lambda spark, d: rs.cascade_delete(clicks(spark, d), tb.expired_split(urls(spark, d), AS_OF)[1])
    .select("event_id", "short_code"))

register("alias_clash", with_views(["aliases", "urls"], """
SELECT alias, request_id, alias || '-1,' || alias || '-2,' || alias || '-3' AS suggestions
FROM aliases WHERE alias IN (SELECT short_code FROM urls)"""))(
    lambda spark, d: rs.alias_clashes(fx.aliases(spark, d), urls(spark, d), 3)
    .withColumn("suggestions", F.array_join("suggestions", ",")))

# Requests in which a bad one comes before a good one with the same alias.
_REQUESTS = """
SELECT request_id, CASE WHEN request_id % 16 IN (1, 9) THEN 'pair-' || CAST(request_id // 16 AS VARCHAR) ELSE alias END AS alias,
  CASE WHEN request_id % 9 = 4 OR request_id % 32 = 1 THEN 'not-a-valid-url' ELSE 'https://example.com/item/' || CAST(request_id AS VARCHAR) END AS long_url
FROM aliases"""


def _requests(spark, d):
    rid = F.col("request_id")
    return fx.aliases(spark, d).select(
        "request_id",
        F.when((rid % 16).isin(1, 9), F.concat(F.lit("pair-"), F.floor(rid / 16).cast("string"))).otherwise(F.col("alias")).alias("alias"),
        F.when((rid % 9 == 4) | (rid % 32 == 1), F.lit("not-a-valid-url"))
        .otherwise(F.concat(F.lit("https://example.com/item/"), rid.cast("string"))).alias("long_url"))


register("bulk_create_audit", with_views(["aliases", "urls"], f"""
SELECT a.request_id, a.alias, a.long_url,
  coalesce(a.own, CASE WHEN EXISTS (SELECT 1 FROM judged b WHERE b.alias = a.alias AND b.own IS NULL AND b.request_id < a.request_id)
                       THEN 'duplicate_in_batch' END) AS reason
FROM judged a""", ctes=[("reqs", _REQUESTS), ("judged", f"""
SELECT *, CASE WHEN NOT coalesce(regexp_matches(lower(long_url), '^https?://[^/?#]+'), false) THEN 'invalid_url'
       ELSE coalesce({alias_reason_sql('alias')}, CASE WHEN alias IN (SELECT short_code FROM urls) THEN 'alias_taken' END) END AS own FROM reqs""")]))(
    lambda spark, d: rs.creation_audit(_requests(spark, d), urls(spark, d)).select("request_id", "alias", "long_url", "reason"))

# --- listing --------------------------------------------------------------------------------------

register("active_urls", with_views(["urls"], f"SELECT * FROM urls WHERE {ACTIVE}"))(
    lambda spark, d: ls.active_listing(urls(spark, d), AS_OF))

register("url_page", with_views(["urls"], f"""
SELECT short_code, long_url, clicks, created_at, expires_at, coalesce(user_id, '') AS user_id,
  'http://localhost:8080/' || short_code AS short_url, t.total, 30 < t.total AS has_more
FROM urls, (SELECT CAST(count(*) AS BIGINT) AS total FROM urls WHERE {ACTIVE}) t
WHERE {ACTIVE} ORDER BY created_at DESC, short_code LIMIT 20 OFFSET 10"""))(
    lambda spark, d: ls.listing_page(urls(spark, d), AS_OF, 20, 10))

register("owner_page", with_views(["urls"], f"""
SELECT user_id, short_code, created_at, position, total FROM (
  SELECT user_id, short_code, created_at,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, short_code) AS INTEGER) AS position,
    CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS total
  FROM urls WHERE {ACTIVE} AND user_id IS NOT NULL) x
WHERE position <= 10"""))(
    lambda spark, d: ls.owner_pages(urls(spark, d), AS_OF, 10, 0))

register("owner_top_urls", with_views(["urls", "click_events"], """
SELECT user_id, short_code, clicks, rank FROM (
  SELECT u.user_id, u.short_code, CAST(coalesce(c.n, 0) AS BIGINT) AS clicks,
    CAST(row_number() OVER (PARTITION BY u.user_id ORDER BY coalesce(c.n, 0) DESC, u.short_code) AS INTEGER) AS rank
  FROM urls u LEFT JOIN (SELECT short_code, count(*) AS n FROM click_events GROUP BY short_code) c
    ON c.short_code = u.short_code
  WHERE u.user_id IS NOT NULL) x
WHERE rank <= 5"""))(
    lambda spark, d: ls.owner_top_urls(urls(spark, d), clicks(spark, d), 5))


def _label(secs: str, suffix_min: str, suffix_h: str, suffix_d: str) -> str:
    return (f"CASE WHEN {secs} < 3600 THEN CAST({secs} // 60 AS VARCHAR) || '{suffix_min}' "
            f"WHEN {secs} < 86400 THEN CAST({secs} // 3600 AS VARCHAR) || '{suffix_h}' "
            f"ELSE CAST({secs} // 86400 AS VARCHAR) || '{suffix_d}' END")


_AGE = f"(epoch(TIMESTAMP '{AS_OF}')::BIGINT - epoch(created_at)::BIGINT)"
_LEFT = f"(epoch(expires_at)::BIGINT - epoch(TIMESTAMP '{AS_OF}')::BIGINT)"

register("url_labels", with_views(["urls"], f"""
SELECT short_code, {_label(_AGE, ' min ago', ' hours ago', ' days ago')} AS age,
  CASE WHEN expires_at IS NULL THEN 'Never' WHEN {_LEFT} < 0 THEN 'Expired'
       ELSE {_label(_LEFT, ' min', ' hours', ' days')} END AS expires,
  CASE WHEN strlen(long_url) > 50 THEN substr(long_url, 1, 47) || '...' ELSE long_url END AS long_url_short
FROM urls"""))(
    lambda spark, d: ls.display_labels(urls(spark, d), AS_OF, 50))

register("click_display", with_views(["click_events"], """
SELECT event_id,
  CASE WHEN (CASE WHEN city = '' THEN country WHEN country <> '' THEN city || ', ' || country ELSE city END) = ''
       THEN 'Unknown' ELSE (CASE WHEN city = '' THEN country WHEN country <> '' THEN city || ', ' || country ELSE city END) END AS location,
  CASE WHEN coalesce(browser, '') = '' THEN 'Unknown' ELSE browser END AS browser,
  CASE WHEN coalesce(device_type, '') = '' THEN 'Unknown' ELSE device_type END AS device,
  CASE WHEN strlen(ip_address) > 16 THEN substr(ip_address, 1, 13) || '...' ELSE ip_address END AS ip
FROM click_events"""))(
    lambda spark, d: ls.click_display(clicks(spark, d)))

register("click_viewer_pages", with_views(["click_events"], """
SELECT event_id, short_code,
  CAST((row_number() OVER (PARTITION BY short_code ORDER BY clicked_at DESC, event_id) - 1) // 10 AS INTEGER) AS page_no,
  CAST(ceil(count(*) OVER (PARTITION BY short_code) / 10.0) AS INTEGER) AS page_count
FROM click_events"""))(
    lambda spark, d: ls.viewer_pages(clicks(spark, d).select("event_id", "short_code", "clicked_at"),
                                     [("clicked_at", "desc"), ("event_id", "asc")], "short_code", 10).drop("clicked_at"))

# --- quality --------------------------------------------------------------------------------------

register("alias_audit", with_views(["aliases"], f"""
SELECT request_id, alias, {alias_reason_sql('alias')} AS reason FROM aliases"""))(
    lambda spark, d: qa.alias_audit(fx.aliases(spark, d)).select("request_id", "alias", "reason"))

register("client_alias_audit", with_views(["aliases"], f"""
SELECT request_id, alias,
  CASE WHEN coalesce(alias, '') = '' THEN NULL WHEN strlen(alias) < 3 THEN 'too_short' WHEN strlen(alias) > 50 THEN 'too_long'
       WHEN NOT starts_with(alias, '/') AND NOT regexp_matches(alias, '^[a-zA-Z0-9_-]+$') THEN 'invalid_chars' END AS client_reason,
  {alias_reason_sql('alias')} AS server_reason
FROM aliases"""))(
    lambda spark, d: qa.client_alias_audit(fx.aliases(spark, d)).select(
        "request_id", "alias", "client_reason", "server_reason"))


def _url_candidates(spark, d):
    p = fx.table(spark, d, "pages").select("page_id", "url")
    pid, url = F.col("page_id"), F.col("url")
    cand = (F.when(pid % 5 == 0, url)
            .when(pid % 5 == 1, F.replace(url, F.lit("http"), F.lit("ftp")))
            .when(pid % 5 == 2, F.lit("not-a-valid-url"))
            .when(pid % 5 == 3, F.concat(F.lit("http:///nohost/"), pid.cast("string")))
            .otherwise(F.concat(F.upper(F.substring(url, 1, 5)), F.substring(url, 6, 1 << 20))))
    return p.select("page_id", cand.alias("long_url"))


register("url_validity", """
SELECT page_id, long_url, coalesce(regexp_matches(lower(long_url), '^https?://[^/?#]+'), false) AS is_valid FROM (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http', 'ftp') WHEN 2 THEN 'not-a-valid-url'
    WHEN 3 THEN 'http:///nohost/' || CAST(page_id AS VARCHAR) ELSE upper(substr(url, 1, 5)) || substr(url, 6) END AS long_url
  FROM pages) c""")(
    lambda spark, d: qa.url_validity(_url_candidates(spark, d)))

_DIRTY = """
SELECT CASE WHEN CAST(substr(short_code, 2) AS BIGINT) % 23 = 5 THEN 'c01' ELSE short_code END AS short_code,
  CASE WHEN CAST(substr(short_code, 2) AS BIGINT) % 17 = 3 THEN '' ELSE long_url END AS long_url,
  CASE WHEN CAST(substr(short_code, 2) AS BIGINT) % 19 = 4 THEN CAST(-1 AS BIGINT) ELSE clicks END AS clicks, created_at, expires_at, user_id
FROM urls"""


def _dirty_urls(spark, d):
    """URL rows that break each constraint."""
    n = F.substring("short_code", 2, 18).cast("bigint")
    return urls(spark, d).withColumns({
        "long_url": F.when(n % 17 == 3, F.lit("")).otherwise(F.col("long_url")),
        "clicks": F.when(n % 19 == 4, F.lit(-1).cast("bigint")).otherwise(F.col("clicks")),
        "short_code": F.when(n % 23 == 5, F.lit("c01")).otherwise(F.col("short_code"))})


register("url_constraints", with_views(["urls"], """
SELECT u.*, CASE WHEN coalesce(long_url, '') = '' THEN 'empty_long_url' WHEN clicks < 0 THEN 'negative_clicks'
  WHEN short_code IN (SELECT short_code FROM dirty GROUP BY short_code HAVING count(*) > 1) THEN 'duplicate_short_code' END AS reason
FROM dirty u
WHERE coalesce(long_url, '') = '' OR clicks < 0
   OR short_code IN (SELECT short_code FROM dirty GROUP BY short_code HAVING count(*) > 1)""", ctes=[("dirty", _DIRTY)]))(
    lambda spark, d: qa.url_constraints(_dirty_urls(spark, d)))

register("email_audit", with_views(["users"], f"""
SELECT a.id, a.email,
  coalesce(a.own, CASE WHEN EXISTS (SELECT 1 FROM judged b WHERE b.email = a.email AND b.own IS NULL AND CAST(b.id AS BIGINT) < CAST(a.id AS BIGINT))
                       THEN 'duplicate_email' END) AS reason
FROM judged a""", ctes=[("judged", f"""
SELECT id, email, CASE WHEN coalesce(email, '') = '' THEN 'missing_email' WHEN coalesce(name, '') = '' THEN 'missing_name'
       WHEN NOT coalesce(regexp_matches(email, '{EMAIL_SQL}'), false) THEN 'invalid_email' END AS own
FROM users""")]))(
    lambda spark, d: qa.email_audit(users(spark, d)).select("id", "email", "reason"))

# --- table maintenance ----------------------------------------------------------------------------

register("expired_urls", with_views(["urls"], f"""
SELECT short_code, expires_at FROM urls WHERE expires_at IS NOT NULL AND expires_at < TIMESTAMP '{AS_OF}'"""))(
    lambda spark, d: tb.expired_split(urls(spark, d), AS_OF)[1].select("short_code", "expires_at"))

for _days in (180, 90, 20):
    register(f"retention_{_days}", with_views(["click_history"], f"""
SELECT event_id, short_code, clicked_date FROM click_history
WHERE clicked_date >= CAST(TIMESTAMP '{AS_OF}' AS DATE) - INTERVAL '{_days}' DAY"""))(
        (lambda n: lambda spark, d: tb.retention(fx.click_history(spark, d), AS_OF, n)
         .select("event_id", "short_code", "clicked_date"))(_days))

_REPLAYED = f"""
SELECT event_id, short_code, clicked_at, TIMESTAMP '{AS_OF}' AS processed_at FROM click_events
UNION ALL
SELECT event_id, short_code, clicked_at, TIMESTAMP '{AS_OF}' + INTERVAL '1' HOUR AS processed_at FROM click_events"""


def _replayed(spark, d):
    c = clicks(spark, d).select("event_id", "short_code", "clicked_at")
    first = c.withColumn("processed_at", F.lit(AS_OF).cast("timestamp"))
    again = c.withColumn("processed_at", F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(1)))
    return first.unionByName(again)


register("dedup_events", with_views(["click_events"], f"""
SELECT event_id, arg_min(short_code, processed_at) AS short_code, arg_min(clicked_at, processed_at) AS clicked_at,
  min(processed_at) AS processed_at
FROM ({_REPLAYED}) r GROUP BY event_id"""))(
    lambda spark, d: tb.dedup_events(_replayed(spark, d)))


def _docs_and_delta(spark, d):
    u = urls(spark, d).select("short_code", "long_url", "clicks", F.col("created_at").alias("version"))
    counts = clicks(spark, d).groupBy("short_code").agg(F.count(F.lit(1)).alias("n"))
    delta = (u.join(counts, "short_code")
             .select("short_code", "long_url", F.col("n").alias("clicks"), F.lit(AS_OF).cast("timestamp").alias("version")))
    return u, delta


register("upsert_documents", with_views(["urls", "click_events"], f"""
SELECT short_code, long_url, clicks, version FROM (
  SELECT *, row_number() OVER (PARTITION BY short_code ORDER BY version DESC, src DESC) AS rn FROM (
    SELECT short_code, long_url, clicks, created_at AS version, 0 AS src FROM urls
    UNION ALL
    SELECT u.short_code, u.long_url, CAST(c.n AS BIGINT) AS clicks, TIMESTAMP '{AS_OF}' AS version, 1 AS src
    FROM urls u JOIN (SELECT short_code, count(*) AS n FROM click_events GROUP BY short_code) c
      ON c.short_code = u.short_code) a) b
WHERE rn = 1"""))(
    lambda spark, d: tb.upsert_by_key(*_docs_and_delta(spark, d), key="short_code", version="version"))

register("partial_update", with_views(["urls", "click_events"], f"""
SELECT u.short_code, CAST(coalesce(c.n, u.clicks) AS BIGINT) AS clicks,
  CASE WHEN c.n IS NOT NULL THEN TIMESTAMP '{AS_OF}' END AS updated_at
FROM urls u LEFT JOIN (SELECT short_code, count(*) AS n FROM click_events GROUP BY short_code) c
  ON c.short_code = u.short_code"""))(
    lambda spark, d: tb.partial_update_clicks(
        urls(spark, d), clicks(spark, d).groupBy("short_code").agg(F.count(F.lit(1)).alias("clicks")), AS_OF)
    .select("short_code", "clicks", "updated_at"))

register("delete_report", with_views(["aliases", "urls"], """
SELECT DISTINCT alias AS short_code, alias IN (SELECT short_code FROM urls) AS found FROM aliases"""))(
    lambda spark, d: tb.delete_report(urls(spark, d),
                                      fx.aliases(spark, d).select(F.col("alias").alias("short_code")), "short_code"))

for _name, _share, _most in (("stream_health", 3, 100), ("stream_health_quiet", 100, 1_000_000)):
    # processed: all entries but every third (hundredth) one
    register(_name, with_views(["click_events"], f"""
SELECT CAST(count(*) AS BIGINT) AS length, min(clicked_at) AS first_entry, max(clicked_at) AS last_entry,
  CAST(count(*) FILTER (WHERE CAST(event_id AS BIGINT) % {_share} = 0) AS BIGINT) AS backlog,
  count(*) FILTER (WHERE CAST(event_id AS BIGINT) % {_share} = 0) > {_most} AS backlog_alert FROM click_events"""))(
        lambda spark, d, k=_share, n=_most: tb.stream_health(
            clicks(spark, d), "clicked_at", n, clicks(spark, d).where(F.col("event_id").cast("bigint") % k != 0).select("event_id")))

assert "country_share" in ORACLES

# --- creation / expiry / publishing ---------------------------------------------------------------
from clickspark.operators import enrich as en  # noqa: E402

register("derive_expiry", with_views(["urls"], """
SELECT short_code, created_at, coalesce(expires_at, created_at + INTERVAL '72' HOUR) AS expires_at FROM urls"""))(
    lambda spark, d: en.derive_expiry(urls(spark, d), 72).select("short_code", "created_at", "expires_at"))

register("increment_rejects", with_views(["click_events", "urls"], """
SELECT short_code, CAST(count(*) AS BIGINT) AS delta FROM click_events
WHERE short_code NOT IN (SELECT short_code FROM renamed) GROUP BY short_code""", ctes=[("renamed", RENAMED)]))(
    lambda spark, d: rs.increment_rejects(renamed_urls(spark, d), rp.fold_increments(clicks(spark, d))))

register("publish_clicks", with_views(["click_events"], """
SELECT CAST(to_json(json_object('short_code', short_code, 'timestamp', CAST(epoch_us(clicked_at) // 1000000 AS VARCHAR),
  'ip', ip_address)) AS VARCHAR) AS value FROM click_events"""))(
    lambda spark, d: tb.publish_clicks(clicks(spark, d).select("short_code", "clicked_at", "ip_address")))


def _ranges(spark, d):
    """IP range table derived from the nation table: 203.0.113.(10n) .. 203.0.113.(10n+9) -> nation n."""
    n = fx.table(spark, d, "nation")
    return n.select(F.concat(F.lit("203.0.113."), (F.col("n_nationkey") * 10).cast("string")).alias("start_ip"),
                    F.concat(F.lit("203.0.113."), (F.col("n_nationkey") * 10 + 9).cast("string")).alias("end_ip"),
                    F.col("n_name").alias("country"),
                    F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("country_code"),
                    F.lit("").alias("region"), F.lit("").alias("city"))


register("geo_by_range", with_views(["click_events"], """
SELECT c.event_id, c.ip_address, r.country, r.country_code
FROM click_events c LEFT JOIN (
  SELECT n_nationkey * 10 + (CAST(203 AS BIGINT) * 16777216 + 113 * 256) AS lo, n_nationkey * 10 + 9 + (CAST(203 AS BIGINT) * 16777216 + 113 * 256) AS hi,
    n_name AS country, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS country_code FROM nation) r
  ON (CASE WHEN regexp_matches(c.ip_address, '^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$')
      THEN TRY_CAST(string_split(c.ip_address, '.')[1] AS BIGINT) * 16777216 + TRY_CAST(string_split(c.ip_address, '.')[2] AS BIGINT) * 65536
         + TRY_CAST(string_split(c.ip_address, '.')[3] AS BIGINT) * 256 + TRY_CAST(string_split(c.ip_address, '.')[4] AS BIGINT) END)
   BETWEEN r.lo AND r.hi"""))(
    lambda spark, d: en.geo_by_range(clicks(spark, d).select("event_id", "ip_address"), _ranges(spark, d))
    .select("event_id", "ip_address", "country", "country_code"))

register("fold_increments", with_views(["click_events"], """
SELECT short_code, CAST(count(*) AS BIGINT) AS delta FROM click_events
WHERE short_code IS NOT NULL AND short_code <> '' GROUP BY short_code"""))(
    lambda spark, d: rp.fold_increments(clicks(spark, d)))

register("bulk_export_ndjson", with_views(["click_events"], """
SELECT '{"index":{"_index":"clicks","_id":"' || event_id || '"}}' || chr(10)
  || CAST(to_json(json_object('event_id', event_id, 'short_code', short_code, 'country', country)) AS VARCHAR) AS value
FROM click_events"""))(
    lambda spark, d: tb.export_bulk_ndjson(clicks(spark, d).select("event_id", "short_code", "country"),
                                           "clicks", "event_id"))

# Updates: a third take the email of the next update, some an email in use, some are malformed.
_UPDATES = """
SELECT id, upper(name) AS name, CASE CAST(id AS BIGINT) % 6 WHEN 0 THEN 'broken' WHEN 1 THEN 'v2.u' || CAST(CAST(id AS BIGINT) // 12 AS VARCHAR) || '@example.com'
  WHEN 2 THEN 'u' || CAST(CAST(id AS BIGINT) + 5 AS VARCHAR) || '@example.com' ELSE 'v3.' || email END AS email FROM users
UNION ALL SELECT 'x' || id, name, 'v4.u' || id || '@example.com' FROM users WHERE CAST(id AS BIGINT) % 50 = 0"""


def _updates(spark, d):
    u, n = users(spark, d), F.col("id").cast("bigint")
    mail = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"), F.lit("@example.com"))
    own = u.select("id", F.upper("name").alias("name"),
                   F.when(n % 6 == 0, F.lit("broken")).when(n % 6 == 1, mail("v2.u", F.floor(n / 12))).when(n % 6 == 2, mail("u", n + 5))
                   .otherwise(F.concat(F.lit("v3."), F.col("email"))).alias("email"))
    unknown = u.where(n % 50 == 0).select(F.concat(F.lit("x"), "id").alias("id"), "name", mail("v4.u", F.col("id")).alias("email"))
    return own.unionByName(unknown)


_JUDGED_UPDATES = [("updates", _UPDATES), ("judged", f"""
SELECT u.*, CASE WHEN u.id NOT IN (SELECT id FROM users) THEN 'unknown_user'
    WHEN NOT regexp_matches(u.email, '{EMAIL_SQL}') THEN 'invalid_email'
    WHEN EXISTS (SELECT 1 FROM users o WHERE o.email = u.email AND o.id <> u.id) THEN 'email_taken' END AS own FROM updates u"""), ("decided", """
SELECT id, name, email, coalesce(own, CASE WHEN EXISTS (SELECT 1 FROM judged b WHERE b.own IS NULL AND b.email = a.email
    AND TRY_CAST(b.id AS BIGINT) < TRY_CAST(a.id AS BIGINT)) THEN 'duplicate_email' END) AS reason FROM judged a""")]

register("update_users", with_views(["users"], f"""
SELECT u.id, coalesce(d.email, u.email) AS email, coalesce(d.name, u.name) AS name, 'hash-' || u.id AS password_hash, u.created_at,
  CASE WHEN d.id IS NULL THEN u.created_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at
FROM users u LEFT JOIN decided d ON d.id = u.id AND d.reason IS NULL""", ctes=_JUDGED_UPDATES))(
    lambda spark, d: tb.update_users(
        users(spark, d).withColumn("password_hash", F.concat(F.lit("hash-"), "id")), _updates(spark, d), AS_OF)[0])

register("update_user_rejects", with_views(["users"], "SELECT * FROM decided WHERE reason IS NOT NULL", ctes=_JUDGED_UPDATES))(
    lambda spark, d: tb.update_users(users(spark, d), _updates(spark, d), AS_OF)[1])
