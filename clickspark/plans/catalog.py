"""Named query catalogue: Spark builder + DuckDB twin per operator.

Every entry reads the driver tables of ``sf_dir`` (through ``clickspark.sources.fixtures``)
over their whole extent; only top-k reports, paging and sampling keep a limit, because
the limit is the feature. ``QUERIES[name](spark, sf_dir) -> DataFrame`` and
``ORACLES[name] -> str`` share column names, so results compare column by column.
"""

from __future__ import annotations

from collections.abc import Callable

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspark.plans.fixture_sql import with_views
from clickspark.sources import fixtures as fx
from clickspark.operators import reports as rp

AS_OF = fx.AS_OF
START_DATE, END_DATE = "2024-01-05", "2024-01-25"
START_TS, END_TS = "2024-01-05 00:00:00", "2024-01-25 23:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.click_events(spark, sf_dir)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in shared storage for queries that write a table and read it back."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _top(partition: str, order: str, n: int, inner: str, cols: str) -> str:
    """DuckDB top-n per group: ``row_number`` over ``inner``."""
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS rn "
            f"FROM ({inner}) g) t WHERE rn <= {n}")


CE = ["click_events"]

# --- reports --------------------------------------------------------------------------------------

register("country_share", with_views(CE, _top(
    "short_code", "total_clicks DESC, country, country_code", 20,
    f"""SELECT short_code, country, country_code, total_clicks,
          round(CAST(total_clicks AS DOUBLE) * 100.0 / CAST(sum(total_clicks) OVER (PARTITION BY short_code) AS DOUBLE), 6) AS percentage
        FROM (SELECT short_code, country, country_code, CAST(count(*) AS BIGINT) AS total_clicks FROM click_events
              WHERE clicked_date BETWEEN DATE '{START_DATE}' AND DATE '{END_DATE}' AND country <> ''
              GROUP BY short_code, country, country_code) x""",
    "short_code, country, country_code, total_clicks, percentage")))(
    lambda spark, d: rp.country_share(clicks(spark, d), START_DATE, END_DATE, 20))

register("device_share", with_views(CE, _top(
    "short_code", "total_clicks DESC, device_type, browser, os", 50,
    f"""SELECT short_code, device_type, browser, os, total_clicks,
          round(CAST(total_clicks AS DOUBLE) * 100.0 / CAST(sum(total_clicks) OVER (PARTITION BY short_code) AS DOUBLE), 6) AS percentage
        FROM (SELECT short_code, device_type, browser, os, CAST(count(*) AS BIGINT) AS total_clicks FROM click_events
              WHERE clicked_date BETWEEN DATE '{START_DATE}' AND DATE '{END_DATE}'
              GROUP BY short_code, device_type, browser, os) x""",
    "short_code, device_type, browser, os, total_clicks, percentage")))(
    lambda spark, d: rp.device_share(clicks(spark, d), START_DATE, END_DATE, 50))

register("geo_top10", with_views(CE, _top(
    "short_code", "clicks DESC, country", 10,
    """SELECT short_code, country, CAST(count(*) AS BIGINT) AS clicks FROM
         (SELECT short_code, nullif(country, '') AS country FROM click_events) c
       WHERE country IS NOT NULL GROUP BY short_code, country""",
    "short_code, country, clicks")))(
    lambda spark, d: rp.geo_top(clicks(spark, d), 10))

register("device_pivot", with_views(CE, """
SELECT short_code,
  CAST(count(*) FILTER (WHERE device_type = 'desktop') AS BIGINT) AS desktop,
  CAST(count(*) FILTER (WHERE device_type = 'mobile') AS BIGINT) AS mobile,
  CAST(count(*) FILTER (WHERE device_type = 'bot') AS BIGINT) AS bot,
  CAST(count(*) AS BIGINT) AS total
FROM click_events GROUP BY short_code"""))(
    lambda spark, d: rp.device_pivot(clicks(spark, d)))

register("url_stats_windows", with_views(CE, f"""
SELECT short_code, CAST(count(*) AS BIGINT) AS total_clicks,
  CAST(count(DISTINCT ip_address) AS BIGINT) AS unique_visitors,
  CAST(count(*) FILTER (WHERE clicked_at > TIMESTAMP '{AS_OF}' - INTERVAL '1' DAY) AS BIGINT) AS last_24_hours,
  CAST(count(*) FILTER (WHERE clicked_at > TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY) AS BIGINT) AS last_7_days,
  CAST(count(*) FILTER (WHERE clicked_at > TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY) AS BIGINT) AS last_30_days
FROM click_events GROUP BY short_code"""))(
    lambda spark, d: rp.url_stats_windows(clicks(spark, d), AS_OF))

register("url_lifetime_stats", with_views(CE, """
SELECT short_code, CAST(count(*) AS BIGINT) AS total_clicks,
  CAST(count(DISTINCT ip_address) AS BIGINT) AS unique_visitors, max(clicked_at) AS last_clicked
FROM click_events GROUP BY short_code"""))(
    lambda spark, d: rp.url_lifetime_stats(clicks(spark, d), exact=True))

# HyperLogLog variant: estimates differ from exact counts by design -> rows-only check.
register("url_lifetime_stats_approx")(
    lambda spark, d: rp.url_lifetime_stats(clicks(spark, d), exact=False))

register("top_referrers_nonblank", with_views(CE, _top(
    "short_code", "click_count DESC, referer", 10,
    f"""SELECT short_code, referer, CAST(count(*) AS BIGINT) AS click_count FROM click_events
        WHERE clicked_date BETWEEN DATE '{START_DATE}' AND DATE '{END_DATE}' AND referer <> ''
        GROUP BY short_code, referer""",
    "short_code, referer, click_count")))(
    lambda spark, d: rp.top_referrers(clicks(spark, d), START_DATE, END_DATE, 10))

register("top_referrers_direct", with_views(CE, _top(
    "short_code", "clicks DESC, raw_referer ASC NULLS FIRST", 10,
    """SELECT short_code, raw_referer, CAST(count(*) AS BIGINT) AS clicks FROM
         (SELECT short_code, nullif(referer, '') AS raw_referer FROM click_events) c
       GROUP BY short_code, raw_referer""",
    "short_code, COALESCE(raw_referer, 'direct') AS referer, clicks")))(
    lambda spark, d: rp.top_referrers_direct(clicks(spark, d), 10))

register("timeline_daily", with_views(CE, f"""
SELECT short_code, date_trunc('day', clicked_at) AS bucket, CAST(count(*) AS BIGINT) AS clicks
FROM click_events WHERE clicked_at > TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY
GROUP BY short_code, bucket"""))(
    lambda spark, d: rp.timeline_daily(clicks(spark, d), AS_OF, 7))

register("series_hourly", with_views(CE, f"""
SELECT short_code, clicked_hour, CAST(count(*) AS BIGINT) AS total_clicks,
  CAST(count(DISTINCT ip_address) AS BIGINT) AS unique_visitors
FROM (SELECT *, date_trunc('hour', clicked_at) AS clicked_hour FROM click_events) c
WHERE clicked_hour BETWEEN TIMESTAMP '{START_TS}' AND TIMESTAMP '{END_TS}'
GROUP BY short_code, clicked_hour"""))(
    lambda spark, d: rp.series_hourly(clicks(spark, d), START_TS, END_TS))

register("series_daily", with_views(CE, f"""
SELECT short_code, clicked_date, CAST(count(*) AS BIGINT) AS total_clicks,
  CAST(count(DISTINCT ip_address) AS BIGINT) AS unique_visitors
FROM click_events WHERE clicked_date BETWEEN DATE '{START_DATE}' AND DATE '{END_DATE}'
GROUP BY short_code, clicked_date"""))(
    lambda spark, d: rp.series_daily(clicks(spark, d), START_DATE, END_DATE))

for _unit, _name in (("week", "series_weekly"), ("day", "series_by_day"), ("hour", "series_by_hour")):
    register(_name, with_views(CE, f"""
SELECT short_code, CAST(date_trunc('{_unit}', clicked_at) AS TIMESTAMP) AS bucket, CAST(count(*) AS BIGINT) AS total_clicks,
  CAST(count(DISTINCT ip_address) AS BIGINT) AS unique_visitors
FROM click_events WHERE clicked_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '{AS_OF}'
GROUP BY short_code, bucket"""))(
        lambda spark, d, u=_unit: rp.series(clicks(spark, d), "2024-01-01 00:00:00", AS_OF, u))

register("timeline_daily_filled", with_views(CE, f"""
SELECT c.short_code, d.bucket, CAST(coalesce(n.clicks, 0) AS BIGINT) AS clicks
FROM (SELECT DISTINCT short_code FROM click_events WHERE clicked_at > TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY) c,
  (SELECT unnest(generate_series(TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY, TIMESTAMP '{AS_OF}' - INTERVAL '1' DAY, INTERVAL '1' DAY)) AS bucket) d
LEFT JOIN (SELECT short_code, date_trunc('day', clicked_at) AS bucket, count(*) AS clicks FROM click_events
           WHERE clicked_at > TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY GROUP BY ALL) n
  ON n.short_code = c.short_code AND n.bucket = d.bucket"""))(
    lambda spark, d: rp.timeline_daily(clicks(spark, d), AS_OF, 7, fill_gaps=True))

register("country_device_cross", with_views(CE, """
SELECT short_code, country, device_type, CAST(count(*) AS BIGINT) AS clicks
FROM click_events GROUP BY short_code, country, device_type"""))(
    lambda spark, d: rp.country_device_cross(clicks(spark, d)))

for _name, _limit in (("recent_clicks", 50), ("recent_clicks_2000", 2000)):
    register(_name, with_views(CE, f"""
SELECT event_id, short_code, ip_address, country, city, browser, os, device_type, referer,
  strftime(clicked_at, '%Y-%m-%d %H:%M:%S') AS clicked_at_text, CAST(count(*) OVER () AS BIGINT) AS total
FROM (SELECT * FROM click_events ORDER BY clicked_at DESC, event_id LIMIT {_limit}) t"""))(
        lambda spark, d, n=_limit: rp.recent_clicks(clicks(spark, d), n))

register("recent_clicks_per_code", with_views(CE, _top(
    "short_code", "clicked_at DESC, event_id", 10,
    "SELECT * FROM click_events",
    """event_id, short_code, ip_address, country, city, browser, os, device_type, referer,
       strftime(clicked_at, '%Y-%m-%d %H:%M:%S') AS clicked_at_text, CAST(rn AS INTEGER) AS rank""")))(
    lambda spark, d: rp.recent_clicks_per_code(clicks(spark, d), 10))


def _list_sql(label: str, keys: str, text: str, where: str, n: int) -> str:
    """Top ``n`` of one list per code as text, with clicks and share of all non-blank entries."""
    return f"""SELECT short_code, string_agg({text} || ':' || CAST(c AS VARCHAR) || ':' || printf('%.4f', p), ',' ORDER BY c DESC, {keys}) AS s
      FROM (SELECT *, round(CAST(c AS DOUBLE) * 100.0 / CAST(sum(c) OVER (PARTITION BY short_code) AS DOUBLE), 6) AS p,
              row_number() OVER (PARTITION BY short_code ORDER BY c DESC, {keys}) AS rn
            FROM (SELECT short_code, {keys}, CAST(count(*) AS BIGINT) AS c FROM click_events
                  WHERE {label} <> '' AND {where} GROUP BY short_code, {keys}) g) t
      WHERE rn <= {n} GROUP BY short_code"""


def _composite_sql(where: str, n: int) -> str:
    return f"""
SELECT t.*, co.s AS countries, re.s AS referrers
FROM (SELECT short_code, CAST(count(*) AS BIGINT) AS total_clicks, CAST(count(DISTINCT ip_address) AS BIGINT) AS unique_visitors,
        CAST(count(*) FILTER (WHERE device_type = 'mobile') AS BIGINT) AS mobile,
        CAST(count(*) FILTER (WHERE device_type = 'desktop') AS BIGINT) AS desktop,
        CAST(count(*) FILTER (WHERE device_type = 'tablet') AS BIGINT) AS tablet,
        CAST(count(*) FILTER (WHERE device_type NOT IN ('mobile', 'desktop', 'tablet')) AS BIGINT) AS other
      FROM click_events WHERE {where} GROUP BY short_code) t
LEFT JOIN ({_list_sql('country', 'country, country_code', "country_code || '|' || country", where, n)}) co ON co.short_code = t.short_code
LEFT JOIN ({_list_sql('referer', 'referer', 'referer', where, n)}) re ON re.short_code = t.short_code"""


def _flat_composite(df: DataFrame) -> DataFrame:
    """The reply with its lists as text (the lists' own order), for comparison."""
    share = lambda x: F.concat(x["click_count"].cast("string"), F.lit(":"), F.format_string("%.4f", x["percentage"]))
    text = lambda name, label: F.when(F.size(name) > 0, F.array_join(F.transform(
        name, lambda x: F.concat(label(x), F.lit(":"), share(x))), ",")).alias(name)
    return df.select("short_code", "total_clicks", "unique_visitors", "devices.*",
                     text("countries", lambda x: F.concat(x["country_code"], F.lit("|"), x["country_name"])),
                     text("referrers", lambda x: x["referer"]))


register("composite_stats", with_views(CE, _composite_sql("true", 5)))(
    lambda spark, d: _flat_composite(rp.composite_stats(clicks(spark, d), n=5)))

register("composite_stats_range", with_views(CE, _composite_sql(
    f"clicked_at BETWEEN TIMESTAMP '{START_TS}' AND TIMESTAMP '{END_TS}'", 3)))(
    lambda spark, d: _flat_composite(rp.composite_stats(clicks(spark, d), START_TS, END_TS, n=3)))

register("geo_city_share", with_views(CE, f"""
SELECT short_code, 'country' AS level, country, country_code, '' AS city, clicks, percentage FROM ({_top(
    'short_code', 'clicks DESC, country, country_code', 5,
    """SELECT short_code, country, country_code, clicks,
         round(CAST(clicks AS DOUBLE) * 100.0 / CAST(sum(clicks) OVER (PARTITION BY short_code) AS DOUBLE), 6) AS percentage
       FROM (SELECT short_code, country, country_code, CAST(count(*) AS BIGINT) AS clicks FROM click_events WHERE country <> ''
             GROUP BY short_code, country, country_code) x""", 'short_code, country, country_code, clicks, percentage')}) a
UNION ALL
SELECT short_code, 'city' AS level, country, country_code, city, clicks, percentage FROM ({_top(
    'short_code', 'clicks DESC, city, country, country_code', 5,
    """SELECT short_code, city, country, country_code, clicks,
         round(CAST(clicks AS DOUBLE) * 100.0 / CAST(sum(clicks) OVER (PARTITION BY short_code) AS DOUBLE), 6) AS percentage
       FROM (SELECT short_code, city, country, country_code, CAST(count(*) AS BIGINT) AS clicks FROM click_events
             WHERE country <> '' AND city <> '' GROUP BY short_code, city, country, country_code) x""",
    'short_code, city, country, country_code, clicks, percentage')}) b"""))(
    lambda spark, d: rp.geo_city_share(clicks(spark, d), 5))

# --- rollups --------------------------------------------------------------------------------------
from clickspark.operators import rollups as ru  # noqa: E402

register("rollup_daily", with_views(CE, """
SELECT short_code, clicked_date, CAST(count(*) AS BIGINT) AS click_count,
  CAST(count(DISTINCT ip_address) AS BIGINT) AS unique_visitors
FROM click_events GROUP BY short_code, clicked_date"""))(
    lambda spark, d: ru.daily_by_url(clicks(spark, d), exact=True))

register("rollup_country", with_views(CE, """
SELECT short_code, clicked_date, country, country_code, CAST(count(*) AS BIGINT) AS click_count
FROM click_events WHERE country <> '' GROUP BY short_code, clicked_date, country, country_code"""))(
    lambda spark, d: ru.clicks_by_country(clicks(spark, d)))

register("rollup_device", with_views(CE, """
SELECT short_code, clicked_date, device_type, browser, os, CAST(count(*) AS BIGINT) AS click_count
FROM click_events GROUP BY short_code, clicked_date, device_type, browser, os"""))(
    lambda spark, d: ru.clicks_by_device(clicks(spark, d)))

register("rollup_hourly", with_views(CE, """
SELECT short_code, clicked_hour, clicked_date,
  CAST(count(*) AS BIGINT) AS click_count, CAST(count(DISTINCT ip_address) AS BIGINT) AS unique_visitors
FROM (SELECT short_code, ip_address, date_trunc('hour', clicked_at) AS clicked_hour, CAST(clicked_at AS DATE) AS clicked_date
      FROM click_events) c
GROUP BY short_code, clicked_hour, clicked_date"""))(
    lambda spark, d: ru.hourly_clicks(clicks(spark, d), exact=True))

register("rollup_daily_stats", with_views(CE, """
SELECT short_code, date_trunc('day', clicked_at) AS day, CAST(count(*) AS BIGINT) AS total_clicks,
  CAST(count(DISTINCT ip_address) AS BIGINT) AS unique_visitors,
  CAST(count(DISTINCT CASE WHEN device_type = 'mobile' THEN ip_address END) AS BIGINT) AS mobile_clicks,
  CAST(count(DISTINCT CASE WHEN device_type = 'desktop' THEN ip_address END) AS BIGINT) AS desktop_clicks
FROM click_events GROUP BY short_code, day"""))(
    lambda spark, d: ru.daily_stats(clicks(spark, d)))

def _stored_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial rollups of two batches (even and odd events), stored and read back."""
    path = scratch(spark, "rollups")
    every = clicks(spark, sf_dir)
    for odd in (0, 1):
        batch = every.where(F.col("event_id").cast("bigint") % 2 == odd)
        ru.partial_rollups(batch).write.mode("append").partitionBy("rollup").parquet(path)
    return spark.read.parquet(path)


# The same A3 report read from a stored R2 rollup: its twin is the raw-click oracle.
register("country_share_from_rollup", ORACLES["country_share"])(
    lambda spark, d: ru.country_share_from_rollup(ru.select_rollup(_stored_partials(spark, d), "clicks_by_country"), START_DATE, END_DATE, 20))

# The merged partials of every rollup have the counts of the raw clicks, and their visitor
# estimates lie within 10 % of the exact ones (sketches of 2^12 registers).
_R5 = {"daily_by_url": "short_code, clicked_date", "hourly_clicks": "short_code, clicked_hour, clicked_date"}
for _name, _cols in _R5.items():
    register(f"rollup_merge_{_name}", with_views(CE, f"""
SELECT {_cols}, CAST(count(*) AS BIGINT) AS click_count, true AS visitors_within_bound
FROM (SELECT *, date_trunc('hour', clicked_at) AS clicked_hour FROM click_events) c GROUP BY {_cols}"""))(
        lambda spark, d, n=_name: _bounded(ru.estimate_visitors(ru.merge_partials(
            ru.select_rollup(_stored_partials(spark, d), n), ru.ROLLUP_KEYS[n])),
            ru.daily_by_url(clicks(spark, d)) if n == "daily_by_url" else ru.hourly_clicks(clicks(spark, d)), ru.ROLLUP_KEYS[n]))


def _bounded(estimated: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    both = estimated.join(exact.select(*keys, F.col("unique_visitors").alias("exact")), keys)
    near = F.abs(F.col("unique_visitors") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.1)
    return both.select(*keys, "click_count", near.alias("visitors_within_bound"))


register("rollup_merge_clicks_by_device", ORACLES["rollup_device"])(
    lambda spark, d: ru.merge_partials(ru.select_rollup(_stored_partials(spark, d), "clicks_by_device"), ru.ROLLUP_KEYS["clicks_by_device"]))

register("rollup_refresh_window", with_views(CE, f"""
SELECT short_code, date_trunc('day', clicked_at) AS day, CAST(count(*) AS BIGINT) AS total_clicks,
  CAST(count(DISTINCT ip_address) AS BIGINT) AS unique_visitors,
  CAST(count(DISTINCT CASE WHEN device_type = 'mobile' THEN ip_address END) AS BIGINT) AS mobile_clicks,
  CAST(count(DISTINCT CASE WHEN device_type = 'desktop' THEN ip_address END) AS BIGINT) AS desktop_clicks
FROM click_events
WHERE clicked_at >= TIMESTAMP '2024-01-28 00:00:00' AND clicked_at < TIMESTAMP '2024-01-30 00:00:00'
GROUP BY short_code, day"""))(
    lambda spark, d: ru.refresh_window(clicks(spark, d), "2024-01-30 12:00:00", 3, 1))

# Sketch-merged daily series: visitor estimates -> rows-only check.
register("series_daily_from_sketches")(
    lambda spark, d: ru.daily_series_from_rollup(ru.daily_by_url(clicks(spark, d), exact=False), START_DATE, END_DATE))

# --- further sections register themselves on import -----------------------------------------------
from clickspark.plans import catalog_urls  # noqa: E402,F401
from clickspark.plans import catalog_rows  # noqa: E402,F401
from clickspark.plans import catalog_jobs  # noqa: E402,F401
from clickspark.plans import catalog_stored  # noqa: E402,F401
