"""Joins between clicks, URLs and users (C1-C10) and bulk creation.

Join strategy is left to Catalyst + AQE: sides whose measured size is under
``spark.sql.autoBroadcastJoinThreshold`` are broadcast at runtime, everything else is a
shuffled sort-merge join, and AQE splits partitions of hot short codes (skew join). Click
tables are pre-aggregated per code before joining wherever the operator allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.functions import validation as v
from clickspark.operators.common import ts


def _live_at_click(u_exp, clicked_at):
    return u_exp.isNull() | (u_exp > clicked_at)


def resolve_clicks(clicks: DataFrame, urls: DataFrame) -> DataFrame:
    """Each click with its long URL, if the code existed and had not expired at click time."""
    u = urls.select("short_code", "long_url", F.col("expires_at").alias("_exp"))
    joined = clicks.join(u, "short_code").where(_live_at_click(F.col("_exp"), F.col("clicked_at")))
    return joined.select("event_id", "short_code", "clicked_at", "long_url")


def dead_link_hits(clicks: DataFrame, urls: DataFrame) -> DataFrame:
    """Clicks on unknown or expired codes (the 404 branch), per code: hits, first/last hit
    and whether the code is known. Left-anti join with the expiry residual."""
    u = urls.select(F.col("short_code").alias("_code"), F.col("expires_at").alias("_exp"))
    misses = clicks.join(
        u, (clicks.short_code == u._code) & _live_at_click(u._exp, clicks.clicked_at), "left_anti")
    per_code = misses.groupBy("short_code").agg(
        F.count(F.lit(1)).alias("hits"), F.min("clicked_at").alias("first_hit"), F.max("clicked_at").alias("last_hit"))
    known = urls.select("short_code").distinct().withColumn("known", F.lit(True))
    return per_code.join(known, "short_code", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def apply_counters(urls: DataFrame, deltas: DataFrame, as_of) -> DataFrame:
    """Add per-code deltas (``short_code, delta``) to ``clicks``; unknown codes are
    ignored; touched rows get ``updated_at = as_of``."""
    d = deltas.groupBy("short_code").agg(F.sum("delta").alias("_delta"))
    out = urls.join(d, "short_code", "left")
    touched = F.col("_delta").isNotNull()
    updated = F.col("updated_at") if "updated_at" in urls.columns else F.col("created_at")
    return (out.withColumn("clicks", F.col("clicks") + F.coalesce("_delta", F.lit(0)))
            .withColumn("updated_at", F.when(touched, ts(as_of)).otherwise(updated))
            .drop("_delta"))


def increment_rejects(urls: DataFrame, deltas: DataFrame) -> DataFrame:
    """Increments whose code does not exist (reported, not applied)."""
    return deltas.join(urls.select("short_code"), "short_code", "left_anti")


def reconcile_counters(urls: DataFrame, clicks: DataFrame) -> DataFrame:
    """Stored counters vs clicks counted in the click table; rows where they differ."""
    counted = clicks.groupBy("short_code").agg(F.count(F.lit(1)).alias("table_clicks"))
    stored = urls.select("short_code", F.col("clicks").alias("counter_clicks"))
    both = stored.join(counted, "short_code", "full_outer")
    both = both.select("short_code",
                       F.coalesce("counter_clicks", F.lit(0)).cast("bigint").alias("counter_clicks"),
                       F.coalesce("table_clicks", F.lit(0)).cast("bigint").alias("table_clicks"))
    return both.withColumn("diff", F.col("counter_clicks") - F.col("table_clicks")).where(F.col("diff") != 0)


def alias_clashes(requests: DataFrame, urls: DataFrame, suggestions: int = 3, alias_col: str = "alias") -> DataFrame:
    """Requested aliases that already exist (left-semi), with suggestions."""
    taken = requests.join(urls.select(F.col("short_code").alias(alias_col)), alias_col, "left_semi")
    return taken.withColumn("suggestions", v.alias_suggestions(alias_col, suggestions))


def orphan_urls(urls: DataFrame, users: DataFrame) -> DataFrame:
    """URLs whose owner does not exist in the user table."""
    owned = urls.where(F.col("user_id").isNotNull())
    return owned.join(users.select(F.col("id").alias("user_id")), "user_id", "left_anti") \
        .select("short_code", "user_id")


def cascade_delete(clicks: DataFrame, deleted_codes: DataFrame) -> DataFrame:
    """Click detail rows that survive deleting ``deleted_codes`` (left-anti)."""
    return clicks.join(deleted_codes.select("short_code").distinct(), "short_code", "left_anti")


def creation_audit(requests: DataFrame, urls: DataFrame) -> DataFrame:
    """K11 checks per request (``request_id, long_url, alias``): invalid URL, alias rule (Q1),
    alias already taken (left join on the existing keys), alias repeated inside the batch. Only
    requests that pass the other checks may claim an alias; the smallest id of those gets it.
    NULL reason = accepted."""
    taken = urls.select(F.col("short_code").alias("alias")).distinct().withColumn("_taken", F.lit(True))
    reason = (F.when(~v.is_valid_url("long_url"), F.lit("invalid_url"))
              .otherwise(F.coalesce(v.alias_reason("alias"), F.when(F.col("_taken"), F.lit("alias_taken")))))
    checked = requests.join(taken, "alias", "left").withColumn("reason", reason).drop("_taken")
    firsts = checked.where(F.col("reason").isNull()).groupBy("alias").agg(F.min("request_id").alias("_first"))
    return checked.join(firsts, "alias", "left").withColumn("reason", F.coalesce(
        "reason", F.when(F.col("request_id") != F.col("_first"), F.lit("duplicate_in_batch")))).drop("_first")


def bulk_create_urls(requests: DataFrame, urls: DataFrame, as_of, default_ttl_hours: int = 72) -> tuple[DataFrame, DataFrame]:
    """Create URLs for ``requests`` (``request_id, long_url, alias[, expires_at, user_id]``):
    accepted rows become URL rows with zero clicks and an expiry (J10); rejected rows keep
    their reason. Requests without an alias get generated codes (``ids.assign_short_codes``)
    before this step."""
    checked = creation_audit(requests, urls)
    if "expires_at" not in checked.columns:
        checked = checked.withColumn("expires_at", F.lit(None).cast("timestamp"))
    now = ts(as_of)
    ttl = F.make_dt_interval(F.lit(0), F.lit(default_ttl_hours))
    accepted = checked.where(F.col("reason").isNull()).select(
        F.col("alias").alias("short_code"), "long_url", F.lit(0).cast("bigint").alias("clicks"),
        now.alias("created_at"), now.alias("updated_at"),
        F.coalesce(F.col("expires_at"), now + ttl).alias("expires_at"),
        (F.col("user_id") if "user_id" in requests.columns else F.lit(None).cast("string")).alias("user_id"))
    rejected = checked.where(F.col("reason").isNotNull()).select("request_id", "alias", "long_url", "reason")
    return accepted, rejected


def bulk_register(new_users: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Register users; rejects carry the Q5 reason (including emails already taken)."""
    from clickspark.operators.quality import email_audit
    audited = email_audit(new_users, existing=users)
    return audited.where(F.col("reason").isNull()).drop("reason"), audited.where(F.col("reason").isNotNull())


def track_clicks(raw: DataFrame) -> DataFrame:
    """Record clicks by request and reply with their click ids. Identical clicks get one id
    each (see ``enrich.with_positions``), the same ones whenever the batch is replayed."""
    from clickspark.operators.enrich import RAW_FIELDS, event_id, with_positions
    present = [c for c in RAW_FIELDS if c in raw.columns]
    numbered = with_positions(raw)
    return numbered.withColumn("click_id", event_id([F.col(c) for c in present], F.col("position"))).drop("position")
