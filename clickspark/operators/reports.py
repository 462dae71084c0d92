"""Click reports for every short code at once.

The reference answers each report for one code per request; here every report groups by
``short_code`` so one scan serves all codes, and the single-code form is the pushed-down
``codes=[...]`` filter. All aggregates are partial/final (map-side combine), so a hot code
costs one partial row per map task, not one task holding all its clicks.
"""

from __future__ import annotations

import datetime as dtm
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspark.operators.common import (by_count, chronological, dt, filter_codes, prune_months, quantiles, share_pct,
                                        top_n_per_key, ts)
from clickspark.schemas import blank_to_null


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def _in_dates(df: DataFrame, start, end) -> DataFrame:
    """Inclusive date range on ``clicked_date`` (pushed to the scan, months pruned)."""
    return prune_months(df, start, end).where(F.col("clicked_date").between(dt(start), dt(end)))


def _cnt(name: str = "total_clicks") -> Column:
    return F.count(F.lit(1)).alias(name)


# --- A3 / A4 / A17: shares within an inclusive date range -------------------------------------

def country_share(clicks: DataFrame, start, end, top_n: int = 20, codes: Sequence[str] | None = None,
                  ordered: bool = False) -> DataFrame:
    """A3: clicks per (code, country) in ``[start, end]``, blank country excluded, share of the
    code's non-blank total, top ``top_n`` per code (ties broken by country name)."""
    base = _in_dates(filter_codes(clicks, codes), start, end).where(F.col("country") != "")
    grouped = base.groupBy("short_code", "country", "country_code").agg(_cnt())
    per_code = Window.partitionBy("short_code")
    with_pct = grouped.withColumn(
        "percentage", share_pct(F.col("total_clicks"), F.sum("total_clicks").over(per_code)))
    out = top_n_per_key(with_pct, ["short_code"],
                        [F.desc("total_clicks"), F.asc("country"), F.asc("country_code")], top_n)
    return by_count(out, "total_clicks", ["country", "country_code"]) if ordered else out


def device_share(clicks: DataFrame, start, end, top_n: int = 50, codes: Sequence[str] | None = None) -> DataFrame:
    """A4: clicks per (code, device, browser, OS) in range; share over all rows of the code."""
    base = _in_dates(filter_codes(clicks, codes), start, end)
    grouped = base.groupBy("short_code", "device_type", "browser", "os").agg(_cnt())
    with_pct = grouped.withColumn(
        "percentage", share_pct(F.col("total_clicks"), F.sum("total_clicks").over(Window.partitionBy("short_code"))))
    return top_n_per_key(with_pct, ["short_code"],
                         [F.desc("total_clicks"), F.asc("device_type"), F.asc("browser"), F.asc("os")], top_n)


# --- A1 / A2: per-code totals -------------------------------------------------------------------

def url_stats_windows(clicks: DataFrame, as_of, codes: Sequence[str] | None = None) -> DataFrame:
    """A1: total, exact distinct IPs and clicks in the last 24 h / 7 d / 30 d (strict ``>``),
    all in one aggregate over one scan. With ``codes``, every listed code gets a row, zeros
    for codes without clicks (trap T8: the row store answers an empty code with zeros)."""
    now = ts(as_of)
    at = F.col("clicked_at")
    stats = filter_codes(clicks, codes).groupBy("short_code").agg(
        _cnt(),
        F.count_distinct("ip_address").alias("unique_visitors"),
        F.count_if(at > now - days(1)).alias("last_24_hours"),
        F.count_if(at > now - days(7)).alias("last_7_days"),
        F.count_if(at > now - days(30)).alias("last_30_days"),
    )
    if not codes:
        return stats
    wanted = clicks.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(codes)], "short_code string")
    metrics = [c for c in stats.columns if c != "short_code"]
    return wanted.join(stats, "short_code", "left").select(
        "short_code", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in metrics])


def url_lifetime_stats(clicks: DataFrame, exact: bool = True, codes: Sequence[str] | None = None) -> DataFrame:
    """A2: total, distinct IPs (exact, or HyperLogLog++ with ``exact=False``) and last click."""
    visitors = F.count_distinct("ip_address") if exact else F.approx_count_distinct("ip_address", 0.01)
    return filter_codes(clicks, codes).groupBy("short_code").agg(
        _cnt(), visitors.alias("unique_visitors"), F.max("clicked_at").alias("last_clicked"))


# --- A5 / A6 / A8 / A9: row-store reports (blank is NULL, trap T6) ----------------------------

def geo_top(clicks: DataFrame, top_n: int = 10, codes: Sequence[str] | None = None) -> DataFrame:
    """A5: top countries per code, missing country excluded, no date range."""
    base = filter_codes(clicks, codes).select("short_code", blank_to_null("country").alias("country"))
    grouped = base.where(F.col("country").isNotNull()).groupBy("short_code", "country").agg(_cnt("clicks"))
    return top_n_per_key(grouped, ["short_code"], [F.desc("clicks"), F.asc("country")], top_n)


def device_pivot(clicks: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """Desktop / mobile / bot columns plus a total that also counts unlisted types."""
    d = F.col("device_type")
    return filter_codes(clicks, codes).groupBy("short_code").agg(
        F.count_if(d == "desktop").alias("desktop"),
        F.count_if(d == "mobile").alias("mobile"),
        F.count_if(d == "bot").alias("bot"),
        _cnt("total"),
    )


def top_referrers(clicks: DataFrame, start, end, limit: int = 10, codes: Sequence[str] | None = None) -> DataFrame:
    """Top non-blank referrers in an inclusive date range."""
    base = _in_dates(filter_codes(clicks, codes), start, end).where(F.col("referer") != "")
    grouped = base.groupBy("short_code", "referer").agg(_cnt("click_count"))
    return top_n_per_key(grouped, ["short_code"], [F.desc("click_count"), F.asc("referer")], limit)


def top_referrers_direct(clicks: DataFrame, limit: int = 10, codes: Sequence[str] | None = None) -> DataFrame:
    """Referrers with missing ones labelled ``direct`` *after* grouping by the raw column,
    so a literal ``direct`` referrer and missing referrers stay two rows (trap T7)."""
    base = filter_codes(clicks, codes).select("short_code", blank_to_null("referer").alias("raw_referer"))
    grouped = base.groupBy("short_code", "raw_referer").agg(_cnt("clicks"))
    top = top_n_per_key(grouped, ["short_code"],
                        [F.desc("clicks"), F.asc_nulls_first("raw_referer")], limit)
    return top.select("short_code", F.coalesce("raw_referer", F.lit("direct")).alias("referer"), "clicks")


def timeline_daily(clicks: DataFrame, as_of, n_days: int = 7, codes: Sequence[str] | None = None,
                   ordered: bool = False, fill_gaps: bool = False) -> DataFrame:
    """Daily click counts of the last ``n_days`` days (strict ``>``; first bucket partial). With
    ``fill_gaps`` every code seen in the period gets a row for each day, 0 where it has no click."""
    since = dtm.datetime.fromisoformat(str(as_of)) - dtm.timedelta(days=n_days)
    base = prune_months(filter_codes(clicks, codes), start=since).where(F.col("clicked_at") > ts(since))
    out = base.groupBy("short_code", F.date_trunc("day", "clicked_at").alias("bucket")).agg(_cnt("clicks"))
    if fill_gaps:
        out = fill_days(out, since, as_of, "clicks")
    return chronological(out, "bucket") if ordered else out


def fill_days(series: DataFrame, start, end, count: str, bucket: str = "bucket") -> DataFrame:
    """T11 option: one row per code of ``series`` and day from ``start`` to ``end`` (exclusive)."""
    last = ts(end) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001))
    every = F.sequence(F.date_trunc("day", ts(start)), F.date_trunc("day", last), F.make_dt_interval(F.lit(1)))
    grid = series.select("short_code").distinct().select("short_code", F.explode(every).alias(bucket))
    return grid.join(series, ["short_code", bucket], "left").withColumn(count, F.coalesce(count, F.lit(0)))


# --- A10 / A11 / A12: time series ---------------------------------------------------------------

def series_hourly(clicks: DataFrame, start, end, codes: Sequence[str] | None = None, ordered: bool = False) -> DataFrame:
    """A10: clicks and exact visitors per hour; bounds apply to the bucket start (inclusive).

    ``bucket >= start`` implies ``clicked_at >= start`` and ``bucket <= end`` implies
    ``clicked_at < end + 1h``: these raw-column bounds are added so the scan is pruned."""
    lo, hi = ts(start), ts(end)
    bucket = F.date_trunc("hour", "clicked_at")
    base = (prune_months(filter_codes(clicks, codes), start, end)
            .where((F.col("clicked_at") >= lo) & (F.col("clicked_at") < hi + hours(1)))
            .withColumn("clicked_hour", bucket)
            .where(F.col("clicked_hour").between(lo, hi)))
    out = base.groupBy("short_code", "clicked_hour").agg(_cnt(), F.count_distinct("ip_address").alias("unique_visitors"))
    return chronological(out, "clicked_hour") if ordered else out


def series_daily(clicks: DataFrame, start, end, codes: Sequence[str] | None = None, ordered: bool = False) -> DataFrame:
    """Clicks and exact visitors per day, inclusive dates."""
    base = _in_dates(filter_codes(clicks, codes), start, end)
    out = base.groupBy("short_code", "clicked_date").agg(_cnt(), F.count_distinct("ip_address").alias("unique_visitors"))
    return chronological(out, "clicked_date") if ordered else out


GRANULARITIES = {"hour": "hour", "day": "day", "week": "week"}


def series(clicks: DataFrame, start, end, granularity: str = "day", codes: Sequence[str] | None = None,
           ordered: bool = False) -> DataFrame:
    """Series at hour / day / week granularity (weeks start on Monday), inclusive time range."""
    unit = GRANULARITIES[granularity]
    base = prune_months(filter_codes(clicks, codes), start, end).where(F.col("clicked_at").between(ts(start), ts(end)))
    out = base.groupBy("short_code", F.date_trunc(unit, "clicked_at").alias("bucket")).agg(
        _cnt(), F.count_distinct("ip_address").alias("unique_visitors"))
    return chronological(out, "bucket") if ordered else out


# --- A13 / A19 / A20 ----------------------------------------------------------------------------

def fold_increments(clicks: DataFrame) -> DataFrame:
    """Per-code click increments of a batch (map-side folded)."""
    return clicks.where(F.col("short_code").isNotNull() & (F.col("short_code") != "")) \
        .groupBy("short_code").agg(_cnt("delta"))


def country_device_cross(clicks: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """Clicks per (code, country, device type)."""
    return filter_codes(clicks, codes).groupBy("short_code", "country", "device_type").agg(_cnt("clicks"))


def pipeline_lag(clicks: DataFrame, expected_p95_seconds: float = 10.0) -> DataFrame:
    """Exact click-to-processed lag percentiles (seconds, from whole milliseconds) against the
    expected lag."""
    lags = clicks.select(F.floor((F.unix_micros("processed_at") - F.unix_micros("clicked_at")) / 1000).alias("lag_ms"))
    marks = quantiles(lags, [], "lag_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    seconds = [F.round(F.col(p) / 1000.0, 6).alias(f"{p}_seconds") for p in ("p50", "p95", "p99")]
    out = marks.select(*seconds, lags.select(F.count(F.lit(1))).scalar().alias("events"))
    return out.withColumn("within_expectation", F.col("p95_seconds") <= expected_p95_seconds)


# --- W4 / F1 / F2 / F3: newest clicks -----------------------------------------------------------

FEED_COLUMNS = ["event_id", "short_code", "original_url", "ip_address", "country", "region", "city",
                "browser", "browser_version", "os", "os_version", "device_type", "referer"]


def _feed_projection(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """feed columns that exist, time formatted ``yyyy-MM-dd HH:mm:ss``."""
    cols = [c for c in FEED_COLUMNS if c in df.columns]
    return df.select(*cols, F.date_format("clicked_at", "yyyy-MM-dd HH:mm:ss").alias("clicked_at_text"), *extra)


def recent_clicks(clicks: DataFrame, limit: int = 50, codes: Sequence[str] | None = None) -> DataFrame:
    """the newest ``limit`` clicks (one code or all), newest first, ``total`` = rows
    returned. Any limit is honoured; ``listing.page_args`` has the endpoint's own rule.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps its own top
    ``limit`` rows, so only ``limit x tasks`` rows reach the final merge."""
    newest = filter_codes(clicks, codes).orderBy(F.desc("clicked_at"), F.asc("event_id")).limit(limit)
    page = _feed_projection(newest)
    # total = rows returned; a window over at most ``limit`` rows
    return page.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))


def recent_clicks_per_code(clicks: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` clicks of every code (partial group limit before the shuffle)."""
    top = top_n_per_key(clicks, ["short_code"], [F.desc("clicked_at"), F.asc("event_id")], n, rank_col="rank")
    return _feed_projection(top, ["rank"])


# --- A15 / A16: composite replies ---------------------------------------------------------------

def _listed(rows: DataFrame, order: Sequence, n: int) -> DataFrame:
    """Rank and share of every (code, set) list, cut to ``n`` entries. One window partitioning serves
    both, over rows that are counts already."""
    w = Window.partitionBy("short_code", "gid")
    ranked = rows.withColumn("percentage", share_pct(F.col("clicks"), F.sum("clicks").over(w))) \
        .withColumn("rank", F.row_number().over(w.orderBy(F.desc("clicks"), *order)))
    return ranked.where(F.col("rank") <= n)


def composite_stats(clicks: DataFrame, start=None, end=None, n: int = 5,
                    codes: Sequence[str] | None = None) -> DataFrame:
    """A15 per code, optional inclusive time range: totals, distinct visitors, ``countries`` (code,
    name, clicks, share), ``referrers`` (referer, clicks, share) and ``devices`` (mobile, desktop,
    tablet, other); lists hold the ``n`` highest, shares refer to all non-blank entries.

    Two scans of the clicks: one aggregate for totals and exact visitors, one GROUPING SETS
    aggregate over (country, code) and (referer) for both lists, which one window ranks."""
    base = filter_codes(clicks, codes)
    if start is not None and end is not None:
        base = prune_months(base, start, end).where(F.col("clicked_at").between(ts(start), ts(end)))
    d = F.col("device_type")
    totals = base.groupBy("short_code").agg(
        _cnt(), F.count_distinct("ip_address").alias("unique_visitors"),
        F.count_if(d == "mobile").alias("mobile"), F.count_if(d == "desktop").alias("desktop"),
        F.count_if(d == "tablet").alias("tablet"))
    named = base.groupingSets([["short_code", "country", "country_code"], ["short_code", "referer"]],
                              "short_code", "country", "country_code", "referer").agg(
        _cnt("clicks"), F.grouping("referer").cast("int").alias("gid"))
    named = named.where(F.when(F.col("gid") == 1, F.col("country")).otherwise(F.col("referer")) != "")
    top = _listed(named, ["country", "country_code", "referer"], n)
    country = F.struct("rank", "country_code", F.col("country").alias("country_name"), F.col("clicks").alias("click_count"), "percentage")
    referrer = F.struct("rank", "referer", F.col("clicks").alias("click_count"), "percentage")
    lists = top.groupBy("short_code").agg(  # at most 2n rows of a code
        F.sort_array(F.collect_list(F.when(F.col("gid") == 1, country))).alias("countries"),
        F.sort_array(F.collect_list(F.when(F.col("gid") == 0, referrer))).alias("referrers"))
    other = F.col("total_clicks") - F.col("mobile") - F.col("desktop") - F.col("tablet")
    return totals.join(lists, "short_code", "left").select(
        "short_code", "total_clicks", "unique_visitors", "countries", "referrers",
        F.struct("mobile", "desktop", "tablet", other.alias("other")).alias("devices"))


def geo_city_share(clicks: DataFrame, limit: int = 5, codes: Sequence[str] | None = None) -> DataFrame:
    """Countries and cities of every code, each with its country code and share, ``limit`` of
    each.

    One scan: a GROUPING SETS aggregate over both levels, then one window per (code, level)."""
    base = filter_codes(clicks, codes).where(F.col("country") != "")
    agg = base.groupingSets([["short_code", "country", "country_code"], ["short_code", "city", "country", "country_code"]],
                            "short_code", "country", "country_code", "city").agg(_cnt("clicks"), F.grouping("city").cast("int").alias("gid"))
    named = agg.where((F.col("gid") == 1) | (F.col("city") != ""))
    top = _listed(named, [F.asc_nulls_first("city"), "country", "country_code"], limit)
    return top.select("short_code", F.when(F.col("gid") == 1, F.lit("country")).otherwise(F.lit("city")).alias("level"),
                      "country", "country_code", F.coalesce("city", F.lit("")).alias("city"), "clicks", "percentage")
