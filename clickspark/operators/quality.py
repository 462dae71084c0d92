"""Data-quality jobs Q1-Q7: every job returns rows with a ``reason`` (NULL = passes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.functions import validation as v
from clickspark.operators.common import quantiles
from clickspark.operators.tables import by_number


def alias_audit(aliases: DataFrame, alias_col: str = "alias", deny_terms: list[str] | None = None) -> DataFrame:
    """Q1: first failing alias rule per request."""
    return aliases.withColumn("reason", v.alias_reason(alias_col, deny_terms))


def client_alias_audit(aliases: DataFrame, alias_col: str = "alias") -> DataFrame:
    """Q6: client-side pre-check; server rules (Q1) still apply afterwards."""
    return aliases.withColumn("client_reason", v.client_alias_reason(alias_col)) \
        .withColumn("server_reason", v.alias_reason(alias_col))


def url_validity(df: DataFrame, url_col: str = "long_url") -> DataFrame:
    """Q2: flag URLs that are not http/https with a host."""
    return df.withColumn("is_valid", v.is_valid_url(url_col))


def url_constraints(urls: DataFrame) -> DataFrame:
    """Q3: CHECK / PK violations: empty long URL, negative clicks, duplicate code.

    Duplicates come from a map-side-combined count per code joined back, not from a window,
    so a code repeated millions of times is never sorted inside one task."""
    dups = duplicate_keys(urls, "short_code").select("short_code", F.lit(True).alias("_dup"))
    reasons = (F.when(F.coalesce(F.col("long_url"), F.lit("")) == "", F.lit("empty_long_url"))
               .when(F.col("clicks") < 0, F.lit("negative_clicks"))
               .when(F.col("_dup"), F.lit("duplicate_short_code")))
    return (urls.join(dups, "short_code", "left").withColumn("reason", reasons)
            .where(F.col("reason").isNotNull()).drop("_dup"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Q3 (aggregate form): keys present more than once, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def email_audit(users: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Q4/Q5: registration audit, first failing rule wins: missing field, short password (when a
    ``password`` column is present), invalid email, email already registered (``existing`` users),
    duplicate inside the batch. Emails are compared as exact text. Only rows that pass the other
    rules may claim an email; the smallest id of those gets it (``9`` before ``10``).

    The first id per email is a grouped ``min`` joined back (partial aggregation; a hot
    email is split by AQE's skew-join handling) rather than a window over the email."""
    email = F.col("email")
    reason = F.when(F.coalesce(email, F.lit("")) == "", F.lit("missing_email")) \
        .when(F.coalesce(F.col("name"), F.lit("")) == "", F.lit("missing_name"))
    if "password" in users.columns:
        reason = reason.when(F.coalesce(F.col("password"), F.lit("")) == "", F.lit("missing_password")) \
            .when(F.length("password") < 8, F.lit("short_password"))
    reason = reason.when(~v.is_valid_email(email), F.lit("invalid_email"))
    if existing is not None:
        users = users.join(existing.select("email").distinct().withColumn("_hit", F.lit(True)), "email", "left")
        reason = reason.when(F.col("_hit"), F.lit("email_taken"))
    checked = users.withColumn("reason", reason)
    firsts = checked.where(F.col("reason").isNull()).groupBy("email").agg(F.min(by_number("id"))["id"].alias("_first"))
    return checked.join(firsts, "email", "left").withColumn("reason", F.coalesce(
        "reason", F.when(F.col("id") != F.col("_first"), F.lit("duplicate_email")))).drop("_first", "_hit")


def slo_report(requests: DataFrame, p95_ms: float = 500.0, p99_ms: float = 1000.0, max_error_rate: float = 0.01,
               by: str | None = "day") -> DataFrame:
    """Q7: exact p95 / p99 duration, error and success rate against the load-test thresholds."""
    keys = ["day"] if by == "day" else []
    rows = requests.withColumn("day", F.to_date("requested_at"))
    failed = F.col("status") >= 500
    rates = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.round(F.avg(failed.cast("double")), 6).alias("error_rate"),
        F.round(F.avg((~failed).cast("double")), 6).alias("success_rate"))
    marks = quantiles(rows, keys, "duration_ms", {"p95_ms": 0.95, "p99_ms": 0.99})
    out = rates.join(marks, keys, "left") if keys else rates.join(marks, F.lit(True), "left")
    out = out.withColumns({c: F.round(c, 6) for c in ("p95_ms", "p99_ms")}).select(
        *keys, "requests", "p95_ms", "p99_ms", "error_rate", "success_rate")
    return out.withColumn(
        "passed", (F.col("p95_ms") < p95_ms) & (F.col("p99_ms") < p99_ms) & (F.col("error_rate") < max_error_rate))
