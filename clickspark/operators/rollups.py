"""Rollups R1-R7: per-code daily / country / device / hourly aggregates.

Two forms of every rollup:

* ``exact``: recomputed from the click table with exact distinct counts (batch, oracle form).
* ``partial``: mergeable rows written per micro-batch. Counts add; visitors are kept as an
  HLL sketch (``hll_sketch_agg``) so partial rows of the same key union correctly instead of
  summing distinct counts (trap T5). ``merge_partials`` is the read/merge side (R5).

Reports can read a rollup instead of raw clicks (``country_share_from_rollup``); the result
is identical because the rollup keeps the report's grouping keys.
"""

from __future__ import annotations

import datetime as dtm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspark.operators import idsets as ids
from clickspark.operators.common import dt, prune_months, share_pct, top_n_per_key, ts

HLL_LG_K = 12  # 2^12 registers: ~1.6 % relative error, 4 KiB per sketch


def _visitors(exact: bool) -> Column:
    return (F.count_distinct("ip_address") if exact
            else F.hll_sketch_agg("ip_address", HLL_LG_K)).alias("unique_visitors" if exact else "visitors_sketch")


def daily_by_url(clicks: DataFrame, exact: bool = True) -> DataFrame:
    """Clicks and visitors per (code, date)."""
    return clicks.groupBy("short_code", "clicked_date").agg(
        F.count(F.lit(1)).alias("click_count"), _visitors(exact))


def clicks_by_country(clicks: DataFrame) -> DataFrame:
    """R2: clicks per (code, date, country, country code), blank country excluded."""
    return clicks.where(F.col("country") != "").groupBy(
        "short_code", "clicked_date", "country", "country_code").agg(F.count(F.lit(1)).alias("click_count"))


def clicks_by_device(clicks: DataFrame) -> DataFrame:
    """Clicks per (code, date, device, browser, OS)."""
    return clicks.groupBy("short_code", "clicked_date", "device_type", "browser", "os").agg(
        F.count(F.lit(1)).alias("click_count"))


def hourly_clicks(clicks: DataFrame, exact: bool = True) -> DataFrame:
    """Clicks and visitors per (code, hour) with the hour's date."""
    return clicks.groupBy(
        "short_code", F.date_trunc("hour", "clicked_at").alias("clicked_hour"),
        F.to_date("clicked_at").alias("clicked_date"),
    ).agg(F.count(F.lit(1)).alias("click_count"), _visitors(exact))


def daily_stats(clicks: DataFrame) -> DataFrame:
    """Per (code, day) clicks and distinct IPs overall, of mobile and of desktop clients.

    ``mobile_clicks`` / ``desktop_clicks`` are distinct *IPs* (trap T12)."""
    d = F.col("device_type")
    return clicks.groupBy("short_code", F.date_trunc("day", "clicked_at").alias("day")).agg(
        F.count(F.lit(1)).alias("total_clicks"),
        F.count_distinct("ip_address").alias("unique_visitors"),
        F.count_distinct(F.when(d == "mobile", F.col("ip_address"))).alias("mobile_clicks"),
        F.count_distinct(F.when(d == "desktop", F.col("ip_address"))).alias("desktop_clicks"),
    )


ROLLUP_KEYS = {
    "daily_by_url": ["short_code", "clicked_date"],
    "clicks_by_country": ["short_code", "clicked_date", "country", "country_code"],
    "clicks_by_device": ["short_code", "clicked_date", "device_type", "browser", "os"],
    "hourly_clicks": ["short_code", "clicked_hour", "clicked_date"],
}


SKETCH_ROLLUPS = ("daily_by_url", "hourly_clicks")
PARTIAL_COLUMNS = ["short_code", "clicked_date", "clicked_hour", "country", "country_code", "device_type", "browser", "os"]


def partial_rollups(clicks: DataFrame) -> DataFrame:
    """R1-R4 partial rows of one micro-batch. ``rollup`` names the set; grouping columns outside a
    set are NULL. Two GROUPING SETS aggregates: one with visitor sketches for the sets that report
    visitors, one with counts alone for the wide sets, which ship no sketch."""
    base = clicks.withColumn("clicked_hour", F.date_trunc("hour", "clicked_at"))

    def pair(names: tuple[str, str], second_only: str, *extra: Column) -> DataFrame:
        """Two rollups at once; rows of the second are those grouped by ``second_only``."""
        columns = list(dict.fromkeys(k for n in names for k in ROLLUP_KEYS[n]))
        agg = base.groupingSets([ROLLUP_KEYS[n] for n in names], *columns).agg(
            F.count(F.lit(1)).alias("click_count"), *extra, F.grouping(second_only).alias("_outside"))
        return agg.withColumn("rollup", F.when(F.col("_outside") == 1, names[0]).otherwise(names[1])).drop("_outside")

    sketch = F.hll_sketch_agg("ip_address", HLL_LG_K).alias("visitors_sketch")
    counted = pair(("clicks_by_country", "clicks_by_device"), "device_type")
    sketched = pair(("daily_by_url", "hourly_clicks"), "clicked_hour", sketch)
    out = counted.unionByName(sketched, allowMissingColumns=True)
    return out.select(*PARTIAL_COLUMNS, "click_count", "visitors_sketch", "rollup").where(
        (F.col("rollup") != "clicks_by_country") | (F.col("country") != ""))


def select_rollup(partials: DataFrame, name: str) -> DataFrame:
    """Rows of one rollup from the combined partial table, in that rollup's own columns."""
    cols = ROLLUP_KEYS[name] + ["click_count"] + (["visitors_sketch"] if name in SKETCH_ROLLUPS else [])
    return partials.where(F.col("rollup") == name).select(*cols)


def merge_partials(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Merge partial rollup rows by key: counts add, visitor sketches union."""
    aggs = [F.sum("click_count").cast("bigint").alias("click_count")]
    if "visitors_sketch" in partials.columns:
        aggs.append(F.hll_union_agg("visitors_sketch", True).alias("visitors_sketch"))
    return partials.groupBy(*keys).agg(*aggs)


def estimate_visitors(rollup: DataFrame) -> DataFrame:
    """Turn the sketch column into the visitor estimate."""
    return rollup.withColumn("unique_visitors", F.hll_sketch_estimate("visitors_sketch")).drop("visitors_sketch")


#: Who is counted by R6 besides everybody, by device type (trap T12).
AUDIENCES = {"unique_visitors": None, "mobile_clicks": "mobile", "desktop_clicks": "desktop"}


def _rolled_keys(clicks: DataFrame, rollup: str) -> tuple[DataFrame, list[str]]:
    if rollup == "daily_stats":
        return clicks.withColumn("day", F.date_trunc("day", "clicked_at")), ["short_code", "day"]
    if rollup == "hourly_clicks":
        return clicks.withColumn("clicked_hour", F.date_trunc("hour", "clicked_at")).withColumn("clicked_date", F.to_date("clicked_at")), ROLLUP_KEYS[rollup]
    return clicks, ROLLUP_KEYS[rollup]


def exact_partials(clicks: DataFrame, dictionary: DataFrame, rollup: str) -> DataFrame:
    """Partial rows of R1, R4 or R6 (``daily_by_url``, ``hourly_clicks``, ``daily_stats``) whose merged visitors
    are exact. Clicks are counts; visitors are sets of the ids that ``dictionary`` (ip_address, id; see
    ``idsets.extend_dictionary``) gives to their addresses, one set for every audience (``who``)."""
    rows, keys = _rolled_keys(clicks, rollup)
    empty = {"bucket": "bigint", "positions": "array<smallint>", "bitmap": "binary"}
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("clicks")).withColumn("who", F.lit("clicks")).withColumns(
        {c: F.lit(None).cast(t) for c, t in empty.items()})
    names = AUDIENCES if rollup == "daily_stats" else {"unique_visitors": None}
    device = F.coalesce("device_type", F.lit(""))
    who = F.filter(F.array(*[F.when(F.lit(d is None) | (device == (d or "")), F.lit(n)) for n, d in names.items()]), lambda n: n.isNotNull())
    seen = ids.with_ids(rows.select(*keys, "ip_address", F.explode(who).alias("who")).distinct(), dictionary, "ip_address")
    sets = ids.id_sets(seen, [*keys, "who"])
    return counts.unionByName(sets.withColumn("clicks", F.lit(0).cast("bigint")))


def merge_exact_partials(partials: DataFrame, rollup: str) -> DataFrame:
    """R5 with exact visitors: partial rows of any number of batches become one row of counts per key and one
    set per key and audience, still mergeable."""
    keys = ["short_code", "day"] if rollup == "daily_stats" else ROLLUP_KEYS[rollup]
    counted = F.col("who") == "clicks"
    counts = partials.where(counted).groupBy(*keys, "who").agg(F.sum("clicks").alias("clicks"))
    sets = ids.merge_sets(partials.where(~counted), [*keys, "who"]).withColumn("clicks", F.lit(0).cast("bigint"))
    return counts.unionByName(sets, allowMissingColumns=True)


def rollup_from_exact(merged: DataFrame, rollup: str) -> DataFrame:
    """The rollup's own columns from merged exact partials: equal to the rollup of all clicks."""
    keys = ["short_code", "day"] if rollup == "daily_stats" else ROLLUP_KEYS[rollup]
    names = AUDIENCES if rollup == "daily_stats" else {"unique_visitors": None}
    size = F.when(F.col("bucket").isNotNull(), ids.set_size())
    return merged.groupBy(*keys).agg(
        F.sum("clicks").cast("bigint").alias("total_clicks" if rollup == "daily_stats" else "click_count"),
        *[F.coalesce(F.sum(F.when(F.col("who") == n, size)), F.lit(0)).cast("bigint").alias(n) for n in names])


def country_share_from_rollup(by_country: DataFrame, start, end, top_n: int = 20) -> DataFrame:
    """A3 answered from R2 instead of raw clicks (same result, far fewer rows scanned)."""
    base = by_country.where(F.col("clicked_date").between(dt(start), dt(end)))
    grouped = base.groupBy("short_code", "country", "country_code").agg(
        F.sum("click_count").cast("bigint").alias("total_clicks"))
    with_pct = grouped.withColumn(
        "percentage", share_pct(F.col("total_clicks"), F.sum("total_clicks").over(Window.partitionBy("short_code"))))
    return top_n_per_key(with_pct, ["short_code"],
                         [F.desc("total_clicks"), F.asc("country"), F.asc("country_code")], top_n)


def daily_series_from_rollup(daily: DataFrame, start, end) -> DataFrame:
    """A11 answered from merged R1 partials (visitors are sketch estimates)."""
    base = daily.where(F.col("clicked_date").between(dt(start), dt(end)))
    return estimate_visitors(merge_partials(base, ["short_code", "clicked_date"])).withColumnRenamed(
        "click_count", "total_clicks")


def refresh_window(clicks: DataFrame, as_of, start_offset_days: int = 3, end_offset_hours: int = 1) -> DataFrame:
    """The whole daily buckets inside ``[as_of - start_offset, as_of - end_offset)``, recomputed.

    Only buckets lying completely inside the window are produced, so writing the result with
    dynamic partition overwrite on ``day`` replaces exactly those buckets and keeps older ones.
    The bounds are literals, so the scan reads the months of the window only."""
    now = dtm.datetime.fromisoformat(str(as_of))
    midnight = {"hour": 0, "minute": 0, "second": 0, "microsecond": 0}
    start = now - dtm.timedelta(days=start_offset_days)
    low = start.replace(**midnight)
    low = low if low >= start else low + dtm.timedelta(days=1)
    high = (now - dtm.timedelta(hours=end_offset_hours)).replace(**midnight)
    return daily_stats(prune_months(clicks, low, high).where((F.col("clicked_at") >= ts(low)) & (F.col("clicked_at") < ts(high))))


def refresh_daily_stats(clicks: DataFrame, path: str, as_of, start_offset_days: int = 3,
                        end_offset_hours: int = 1) -> None:
    """R7 job: recompute the whole daily buckets of the refresh window and replace exactly
    those ``day`` partitions of the stored R6 rollup (dynamic partition overwrite); older
    buckets stay as they are."""
    fresh = refresh_window(clicks, as_of, start_offset_days, end_offset_hours)
    (fresh.withColumn("bucket_day", F.date_format("day", "yyyy-MM-dd"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket_day").parquet(path))
