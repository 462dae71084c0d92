"""Catalogue part 4: jobs on stored tables, registrations and the batch twins of stream jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickspark.operators import enrich as en
from clickspark.operators import listing as ls
from clickspark.operators import logs as lg
from clickspark.operators import quality as qa
from clickspark.operators import reports as rp
from clickspark.operators import resolve as rs
from clickspark.operators import tables as tb
from clickspark.plans.catalog import AS_OF, ORACLES, clicks, register, scratch
from clickspark.plans.catalog_urls import ACTIVE, EMAIL_SQL, urls, users
from clickspark.plans.fixture_sql import with_views
from clickspark.sources import fixtures as fx
from clickspark.streaming import pipeline as pl

# --- stored click tables (S4, M3-M6) -----------------------------------------------------------------


def _stored_history(spark, d) -> str:
    path = scratch(spark, "click-table")
    tb.write_click_table(fx.click_history(spark, d), path)
    return path


_ROWS = "event_id, short_code, clicked_date"

register("read_click_table", with_views(["click_history"], f"""
SELECT {_ROWS} FROM click_history WHERE clicked_date BETWEEN DATE '2023-10-10' AND DATE '2024-01-05' AND short_code IN ('c10', 'c42')"""))(
    lambda spark, d: tb.read_click_table(spark, _stored_history(spark, d), "2023-10-10", "2024-01-05", ["c10", "c42"])
    .select("event_id", "short_code", "clicked_date"))


def _rewritten(spark, d):
    path = _stored_history(spark, d)
    tb.rewrite_cold(spark.read.parquet(path), path, AS_OF, 7)
    return spark.read.parquet(path).select("event_id", "short_code", "clicked_date")


# the whole table after the rewrite: nothing is lost, nothing is doubled
register("rewrite_cold", with_views(["click_history"], f"SELECT {_ROWS} FROM click_history"))(_rewritten)


def _after_expiry(spark, d):
    path = _stored_history(spark, d)
    tb.drop_expired(spark, path, AS_OF, 90)
    return spark.read.parquet(path).select("event_id", "short_code", "clicked_date")


register("drop_expired_90", with_views(["click_history"], f"""
SELECT {_ROWS} FROM click_history WHERE clicked_date >= CAST(TIMESTAMP '{AS_OF}' AS DATE) - INTERVAL '90' DAY"""))(_after_expiry)

# Landing files by position: 100 entries each, and one late entry of every file in the one after it.
_FILE = "CAST(CAST(event_id AS BIGINT) // 100 + CASE WHEN CAST(event_id AS BIGINT) % 100 = 50 THEN 1 ELSE 0 END AS VARCHAR)"
_KEEP = 300
register("trim_landing", with_views(["click_events"], f"""
SELECT file, newest FROM (SELECT {_FILE} AS file, max(clicked_at) AS newest FROM click_events GROUP BY ALL) f
WHERE (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n, min(clicked_at) AS oldest FROM click_events GROUP BY {_FILE}) g
       WHERE g.oldest > f.newest) >= {_KEEP}"""))(
    lambda spark, d: tb.trim_landing(
        clicks(spark, d).withColumn("file", (F.floor(F.col("event_id").cast("bigint") / 100) + F.when(
            F.col("event_id").cast("bigint") % 100 == 50, 1).otherwise(0)).cast("string")), _KEEP, "clicked_at", "file"))

# --- lookups and deletions (S5, S6, F4, F6, K7) ------------------------------------------------------


def _stored_urls(spark, d):
    path = scratch(spark, "urls")
    urls(spark, d).write.parquet(path)
    return tb.read_urls(spark, path)


register("read_urls", with_views(["urls"], "SELECT short_code, long_url, clicks, created_at, expires_at, coalesce(user_id, '') AS user_id FROM urls"))(_stored_urls)

register("find_users", with_views(["users"], """
SELECT id, email, name, created_at FROM users WHERE email IN ('u1@example.com', 'u7@example.com', 'nobody@example.com') AND id IN ('1', '2')"""))(
    lambda spark, d: tb.find_users(users(spark, d).withColumn("password_hash", F.lit("x")),
                                   ["u1@example.com", "u7@example.com", "nobody@example.com"], ["1", "2"]))

register("url_lookup", with_views(["urls"], f"SELECT * FROM urls WHERE short_code IN ('c00', 'c01', 'c02', 'c100', 'zzz') AND {ACTIVE}"))(
    lambda spark, d: ls.lookup(urls(spark, d), ["c00", "c01", "c02", "c100", "zzz"], AS_OF))

register("owner_listing", with_views(["urls"], f"SELECT * FROM urls WHERE {ACTIVE} AND user_id = '20'"))(
    lambda spark, d: ls.active_listing(urls(spark, d), AS_OF, owner="20"))

register("delete_documents", with_views(["urls", "aliases"], """
SELECT short_code, long_url FROM urls WHERE short_code NOT IN (SELECT alias FROM aliases)"""))(
    lambda spark, d: tb.delete_keys(urls(spark, d).select("short_code", "long_url"),
                                    fx.aliases(spark, d).select(F.col("alias").alias("short_code")), "short_code"))

# --- registration (K12, C5, Q5) ----------------------------------------------------------------------
# Pairs share an email; of some pairs the first has no name, a short password or a bad id order.
_NEW = """
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 7 = 1 THEN '' ELSE c_name END AS name,
  CASE WHEN c_custkey % 13 = 0 THEN 'u' || CAST(c_custkey + 1 AS VARCHAR) || '@example.com' WHEN c_custkey % 17 = 0 THEN NULL
       WHEN c_custkey % 19 = 0 THEN 'no-at-sign' ELSE 'new' || CAST(c_custkey // 2 AS VARCHAR) || '@example.com' END AS email,
  CASE WHEN c_custkey % 5 = 2 THEN 'short' WHEN c_custkey % 11 = 3 THEN NULL ELSE 'long-enough-' || CAST(c_custkey AS VARCHAR) END AS password
FROM customer"""


def _registrations(spark, d):
    c, k = fx.table(spark, d, "customer"), F.col("c_custkey")
    mail = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"), F.lit("@example.com"))
    none = F.lit(None).cast("string")
    return c.select(
        k.cast("string").alias("id"), F.when(k % 7 == 1, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 13 == 0, mail("u", k + 1)).when(k % 17 == 0, none).when(k % 19 == 0, F.lit("no-at-sign")).otherwise(mail("new", F.floor(k / 2))).alias("email"),
        F.when(k % 5 == 2, F.lit("short")).when(k % 11 == 3, none).otherwise(F.concat(F.lit("long-enough-"), k.cast("string"))).alias("password"))


_REGISTERED = [("arrivals", _NEW), ("judged", f"""
SELECT *, CASE WHEN coalesce(email, '') = '' THEN 'missing_email' WHEN coalesce(name, '') = '' THEN 'missing_name'
  WHEN coalesce(password, '') = '' THEN 'missing_password' WHEN length(password) < 8 THEN 'short_password'
  WHEN NOT regexp_matches(email, '{EMAIL_SQL}') THEN 'invalid_email'
  WHEN email IN (SELECT email FROM users) THEN 'email_taken' END AS own FROM arrivals"""), ("decided", """
SELECT id, email, coalesce(own, CASE WHEN EXISTS (SELECT 1 FROM judged b WHERE b.own IS NULL AND b.email = a.email
  AND CAST(b.id AS BIGINT) < CAST(a.id AS BIGINT)) THEN 'duplicate_email' END) AS reason FROM judged a""")]

register("bulk_register", with_views(["users"], "SELECT id, email FROM decided WHERE reason IS NULL", ctes=_REGISTERED))(
    lambda spark, d: rs.bulk_register(_registrations(spark, d), users(spark, d))[0].select("id", "email"))

register("bulk_register_audit", with_views(["users"], "SELECT id, email, reason FROM decided", ctes=_REGISTERED))(
    lambda spark, d: qa.email_audit(_registrations(spark, d), existing=users(spark, d)).select("id", "email", "reason"))

# --- batch twins of the stream jobs (X2, X5, X9, X12) --------------------------------------------------


def _counted_in_batches(spark, d):
    """Three micro-batches, one of them delivered twice, over a seeded URL table."""
    base = scratch(spark, "counters")
    pl.seed_url_table(urls(spark, d), f"{base}/urls")
    run, raw = pl.counter_batch(f"{base}/deltas"), clicks(spark, d)
    for batch_id in (0, 1, 1, 2):
        run(raw.where(F.col("event_id").cast("bigint") % 3 == batch_id), batch_id)
    pl.compact_counters(spark, f"{base}/urls", f"{base}/deltas", 1, AS_OF)
    return pl.read_counters(spark, f"{base}/urls", f"{base}/deltas", AS_OF).select("short_code", "clicks")


register("counter_pipeline", with_views(["click_events", "urls"], """
SELECT u.short_code, CAST(u.clicks + coalesce(n, 0) AS BIGINT) AS clicks
FROM urls u LEFT JOIN (SELECT short_code, count(*) AS n FROM click_events GROUP BY short_code) c ON c.short_code = u.short_code"""))(_counted_in_batches)

register("windowed_clicks", with_views(["click_events"], """
SELECT short_code, date_trunc('hour', clicked_at) AS bucket_start, date_trunc('hour', clicked_at) + INTERVAL 1 HOUR AS bucket_end, CAST(count(*) AS BIGINT) AS click_count
FROM click_events GROUP BY ALL"""))(
    lambda spark, d: pl.windowed_rollup(clicks(spark, d), "1 hour").drop("unique_visitors"))

_MESSY = """
SELECT * REPLACE (CASE WHEN TRY_CAST("timestamp" AS BIGINT) // 60 % 13 = 0 THEN '  ' WHEN TRY_CAST("timestamp" AS BIGINT) // 60 % 17 = 0 THEN NULL ELSE short_code END AS short_code),
  CASE WHEN TRY_CAST("timestamp" AS BIGINT) // 60 % 19 = 0 THEN '{"cut' END AS _text FROM raw_click"""


def _messy(spark, d):
    minute = F.floor(F.col("timestamp").try_cast("bigint") / 60)
    return fx.raw_clicks(spark, d).withColumn(
        "short_code", F.when(minute % 13 == 0, F.lit("  ")).when(minute % 17 == 0, F.lit(None)).otherwise(F.col("short_code"))) \
        .withColumn("_text", F.when(minute % 19 == 0, F.lit('{"cut')))


def _quarantined(spark, d):
    """The quarantine of a batch that is tried twice."""
    out = scratch(spark, "quarantine")
    run = pl.enrichment_batch(out, arrival=AS_OF, search_export=False)
    run(_messy(spark, d), 0)
    run(_messy(spark, d), 0)
    return pl.quarantine_report(spark, out, 100)


_BAD = """CASE WHEN _text IS NOT NULL THEN 'malformed message' WHEN coalesce(trim(short_code), '') = '' THEN 'missing short_code' END"""
register("quarantine_report", with_views(["raw_click"], f"""
SELECT CAST(0 AS BIGINT) AS batch_id, reason, CAST(count(*) AS BIGINT) AS messages, 2 AS attempts, count(*) > 100 AS alert
FROM (SELECT {_BAD} AS reason FROM messy) m WHERE reason IS NOT NULL GROUP BY reason""", ctes=[("messy", _MESSY)]))(_quarantined)

register("split_bad_messages", with_views(["raw_click"], f"""
SELECT reason, CAST(count(*) AS BIGINT) AS messages FROM (SELECT {_BAD} AS reason FROM messy) m WHERE reason IS NOT NULL GROUP BY reason""", ctes=[("messy", _MESSY)]))(
    lambda spark, d: en.split_bad_messages(_messy(spark, d))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("messages")))



def _shipped(spark, d):
    """K9: two flushes, the second one repeated; counted from the files."""
    path, logs = scratch(spark, "logs"), lg.normalise_logs(fx.log_lines(spark, d), ingest_time=AS_OF)
    for batch_id in (0, 1, 1):
        lg.write_logs(logs.where(F.col("line_no") % 2 == batch_id).drop("fields"), path, batch_id)
    return spark.read.schema("level string, service string, log_date date, batch_id bigint").json(path).groupBy(
        "service", "log_date", "level").agg(F.count(F.lit(1)).alias("lines"))


register("log_files", ORACLES["log_daily_counts"])(_shipped)

# Every message twice; each copy gets an id of its own
register("identical_clicks", with_views(["raw_click"], """
SELECT CAST(2 * count(*) AS BIGINT) AS messages, CAST(2 * count(*) AS BIGINT) AS ids FROM raw_click"""))(
    lambda spark, d: rs.track_clicks(fx.raw_clicks(spark, d).unionByName(fx.raw_clicks(spark, d))).agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct("click_id").alias("ids")))

register("fold_increments_total", with_views(["click_events"], """
SELECT CAST(sum(n) AS BIGINT) AS clicks, CAST(count(*) AS BIGINT) AS codes FROM (SELECT short_code, count(*) AS n FROM click_events GROUP BY short_code) c"""))(
    lambda spark, d: rp.fold_increments(clicks(spark, d)).agg(F.sum("delta").cast("bigint").alias("clicks"), F.count(F.lit(1)).alias("codes")))
