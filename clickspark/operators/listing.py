"""URL listing, lookup and paging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickspark.functions import validation as v
from clickspark.operators.common import join_keys, top_n_per_key, ts, with_scalar_total


@dataclass(frozen=True)
class Page:
    limit: int
    offset: int


def page_args(endpoint: str, limit: int | None, offset: int | None) -> Page:
    """L5 (trap T16): the argument rule of each endpoint, for callers that answer requests. The
    operators themselves take the page they are given."""
    off = offset if offset is not None and offset >= 0 else 0
    if endpoint == "list":  # clamp to [1, 1000], default 100
        lim = 100 if not limit or limit <= 0 else min(limit, 1000)
    elif endpoint == "click_feed":  # above 1000 or non-positive resets to 50
        lim = limit if limit is not None and 0 < limit <= 1000 else 50
    elif endpoint == "search":  # above 100 or non-positive resets to 20
        lim = limit if limit is not None and 0 < limit <= 100 else 20
    elif endpoint in ("timeline", "referrers"):  # no upper bound
        lim = limit if limit is not None and limit > 0 else (7 if endpoint == "timeline" else 10)
    else:
        raise ValueError(f"unknown endpoint {endpoint!r}")
    return Page(lim, off)


def active(urls: DataFrame, as_of) -> DataFrame:
    """Not expired at ``as_of``: ``expires_at IS NULL OR expires_at > as_of`` (strict, T9)."""
    return urls.where(F.col("expires_at").isNull() | (F.col("expires_at") > ts(as_of)))


def lookup(urls: DataFrame, codes: list[str], as_of) -> DataFrame:
    """point lookup with validity; unknown or expired codes give no row."""
    return active(urls.where(F.col("short_code").isin(codes)), as_of)


def active_listing(urls: DataFrame, as_of, owner: str | None = None) -> DataFrame:
    """Active URLs (of one owner), newest first."""
    base = active(urls, as_of)
    if owner is not None:
        base = base.where(F.col("user_id") == owner)
    return base.orderBy(F.desc("created_at"), F.asc("short_code"))


def listing_page(urls: DataFrame, as_of, limit: int, offset: int, base_url: str = "http://localhost:8080",
                 owner: str | None = None) -> DataFrame:
    """Page of active URLs newest first, with ``short_url``, ``total`` and ``has_more``.

    The page is a bounded top-(offset+limit) sort; the total is a scalar subquery."""
    matched = active(urls, as_of)
    if owner is not None:
        matched = matched.where(F.col("user_id") == owner)
    rows = matched.orderBy(F.desc("created_at"), F.asc("short_code")).offset(offset).limit(limit)
    rows = rows.select("short_code", "long_url", "clicks", "created_at", "expires_at",
                       F.coalesce("user_id", F.lit("")).alias("user_id"),
                       F.concat(F.lit(base_url), F.lit("/"), F.col("short_code")).alias("short_url"))
    rows = with_scalar_total(rows, matched)
    return rows.withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def owner_pages(urls: DataFrame, as_of, limit: int = 10, offset: int = 0) -> DataFrame:
    """F8, all owners at once: page ``[offset, offset+limit)`` of every owner's active URLs,
    newest first, with the owner's total. Top-k per owner keeps at most offset+limit rows per
    owner per map task before the shuffle."""
    base = active(urls, as_of).where(F.col("user_id").isNotNull())
    totals = base.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    ranked = top_n_per_key(base, ["user_id"], [F.desc("created_at"), F.asc("short_code")],
                           offset + limit, rank_col="position")
    page = ranked.where(F.col("position") > offset)
    return page.select("user_id", "short_code", "created_at", "position").join(totals, "user_id")


def owner_top_urls(urls: DataFrame, clicks: DataFrame, n: int = 5) -> DataFrame:
    """F16: every owner's URLs by click count (from the click table), highest first."""
    counts = clicks.groupBy("short_code").agg(F.count(F.lit(1)).alias("clicks"))
    owned = urls.where(F.col("user_id").isNotNull()).select("user_id", "short_code")
    joined = owned.join(counts, "short_code", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)))
    return top_n_per_key(joined, ["user_id"], [F.desc("clicks"), F.asc("short_code")], n, rank_col="rank")


def display_labels(urls: DataFrame, as_of, url_width: int = 50) -> DataFrame:
    """Age and expiry labels plus a shortened long URL."""
    now = ts(as_of)
    return urls.select(
        "short_code",
        v.age_label("created_at", now).alias("age"),
        v.expiry_label("expires_at", now).alias("expires"),
        v.truncate_text("long_url", url_width).alias("long_url_short"),
    )


def click_display(clicks: DataFrame) -> DataFrame:
    """location / browser / device fallbacks of the click viewer."""
    return clicks.select(
        "event_id",
        v.location_label("city", "country").alias("location"),
        v.or_unknown("browser").alias("browser"),
        v.or_unknown("device_type").alias("device"),
        v.truncate_text("ip_address", 16).alias("ip"),
    )


def viewer_pages(df: DataFrame, order_cols: list, key: str, size: int = 10, block_rows: int = 50_000) -> DataFrame:
    """Page number ``(row_number - 1) div size`` and page count ``ceil(n / size)`` per ``key``
    (e.g. per short code for the click viewer). ``order_cols`` starts with the time column.

    A hot key is cut into blocks of time, as many as its row count asks for; the rank runs inside
    a block and a prefix sum over one row per block carries it on. Rows without a key share the pages of a
    NULL key; rows without a time come last when the newest come first, else first."""
    first = order_cols[0]
    time_col, newest = (first[0], first[1] == "desc") if isinstance(first, tuple) else (first, False)
    t = F.unix_micros(F.col(time_col))
    span = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.min(t).alias("_from"), F.max(t).alias("_to"))
    width = F.ceil((F.col("_to") - F.col("_from") + 1) / F.ceil(F.col("_rows") / block_rows))
    block = F.floor(((F.col("_to") - t) if newest else (t - F.col("_from"))) / width).cast("bigint")
    block = F.when(t.isNull(), F.lit(1 << 62 if newest else -1)).otherwise(block)
    cut = join_keys(df, span, [key]).withColumn("_block", block).drop("_from", "_to")
    counts = cut.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    order = [(F.desc(c[0]) if c[1] == "desc" else F.asc(c[0])) if isinstance(c, tuple) else F.asc(c) for c in order_cols]
    rank = F.col("_offset") + F.row_number().over(Window.partitionBy(key, "_block").orderBy(*order))
    return (join_keys(cut, counts, [key, "_block"]).withColumn("_rn", rank)
            .withColumn("page_no", F.floor((F.col("_rn") - 1) / size).cast("int"))
            .withColumn("page_count", F.ceil(F.col("_rows") / size).cast("int")).drop("_rn", "_rows", "_block", "_offset"))
