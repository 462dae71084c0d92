"""Canonical click / URL / user / log / request tables derived from the driver tables.

The driver ships generic tables (``events``, ``nation``, ``pages``, ``customer``, ``part``);
these readers derive the link-analytics tables from them with plain column expressions, so
every derived table grows with its source. The DuckDB text of the same derivations lives in
``clickspark.plans.fixture_sql`` and is used by the oracles.

Fixed period of the data: 2024-01-01 .. 2024-01-30, reports use ``AS_OF`` below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k(props: Column) -> Column:
    return F.regexp_extract(props, r"([0-9]+)", 1)


def _code_from_props(props: Column) -> Column:
    return F.concat(F.lit("c"), F.lpad(_k(props), 2, "0"))


def _case(key: Column, mapping: list[tuple[int, Column | str | None]], default) -> Column:
    expr = None
    for value, out in mapping:
        out_col = out if isinstance(out, Column) else F.lit(out)
        expr = F.when(key == value, out_col) if expr is None else expr.when(key == value, out_col)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def click_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched click table (columnar semantics: blank text means missing)."""
    e = table(spark, sf_dir, "events")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    uid, eid = F.col("user_id"), F.col("event_id")
    blank_geo = uid % 7 == 0
    joined = e.join(n, n.n_nationkey == (uid % 25).cast("int"))
    return joined.select(
        eid.cast("string").alias("event_id"),
        _code_from_props(F.col("props")).alias("short_code"),
        F.date_trunc("millisecond", F.col("ts")).cast("timestamp").alias("clicked_at"),
        F.col("ts").cast("date").alias("clicked_date"),
        F.when(uid % 10 == 0, F.concat(F.lit("10.0.0."), (uid % 256).cast("string")))
        .when(uid % 10 == 1, F.lit("not-an-ip"))
        .when(uid % 10 == 2, F.lit("127.0.0.1"))
        .otherwise(F.concat(F.lit("203.0.113."), (uid % 256).cast("string")))
        .alias("ip_address"),
        F.when(blank_geo, F.lit("")).otherwise(F.col("n_name")).alias("country"),
        F.when(blank_geo, F.lit(""))
        .otherwise(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")))
        .alias("country_code"),
        F.when(blank_geo, F.lit("")).otherwise(F.concat(F.lit("city"), (uid % 40).cast("string"))).alias("city"),
        _case(eid % 4, [(0, "desktop"), (1, "mobile"), (2, "bot")], "tablet").alias("device_type"),
        _case(eid % 3, [(0, "Chrome"), (1, "Safari")], "Firefox").alias("browser"),
        _case(uid % 3, [(0, "Windows"), (1, "Linux")], "Android").alias("os"),
        _case(
            eid % 5,
            [(0, ""), (1, "https://search.example.com"), (2, "https://news.example.org"), (3, "direct")],
            F.lit(None).cast("string"),
        ).alias("referer"),
    )


def click_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clicks spread over 300 days before the period: event n is n mod 300 days older."""
    back = (F.col("event_id").cast("bigint") % 300).cast("int")
    moved = click_events(spark, sf_dir).withColumn("clicked_at", F.col("clicked_at") - F.make_dt_interval(back))
    return moved.withColumn("clicked_date", F.col("clicked_at").cast("date"))


# Six user agents of the raw stream (fixed values of the fixture).
FIXTURE_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Safari/605.1.15",
]


# Addresses and near-addresses of every kind the rules tell apart (fixed values of the fixture).
ODD_ADDRESSES = ["12:34", "fc00:1", ":::", "1:2:3:4:5:6:7:8", "fe80::1", "::ffff:10.0.0.1", "fd12:3456::1", "fc::1",
                 "::ffff:8.8.8.8", "0:0::0:1", "1::2::3"]


def raw_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string stream messages: seconds as text, missing and unparsable times (trap T1)."""
    e = table(spark, sf_dir, "events")
    uid, eid = F.col("user_id"), F.col("event_id")
    null_s = F.lit(None).cast("string")
    return e.select(
        _code_from_props(F.col("props")).alias("short_code"),
        F.when(eid % 50 == 0, null_s)
        .when(eid % 50 == 1, F.lit("bad"))
        .otherwise((F.lit(1704067200) + eid * 60).cast("string"))
        .alias("timestamp"),
        F.when(uid % 10 == 1, null_s)
        .when(uid % 10 == 2, F.lit("::1"))
        .when(uid % 10 == 3, F.lit("192.168.1.7"))
        .when(uid % 10 == 4, _case(eid % 11, list(enumerate(ODD_ADDRESSES[:10])), ODD_ADDRESSES[10]))
        .otherwise(F.concat(F.lit("203.0.113."), (uid % 256).cast("string")))
        .alias("ip"),
        _case(eid % 6, list(enumerate(FIXTURE_AGENTS[:5])), FIXTURE_AGENTS[5]).alias("user_agent"),
        null_s.alias("original_url"),
        F.when(eid % 5 == 0, null_s).otherwise(F.lit("https://news.example.org")).alias("referer"),
        F.concat(F.lit("k="), _k(F.col("props"))).alias("query_params"),
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One URL per page. Some expire inside the click period (dead links); owners derive from
    the page id and run past the user table (orphans), so both grow with the data."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id")
    return p.select(
        F.format_string("c%02d", pid).alias("short_code"),
        F.col("url").alias("long_url"),
        F.lit(0).cast("bigint").alias("clicks"),
        (F.lit("2023-12-01 00:00:00").cast("timestamp") + pid * F.expr("INTERVAL '1' MINUTE")).alias("created_at"),
        F.when(pid % 3 == 0, F.lit(None).cast("timestamp"))
        .otherwise(F.lit("2024-01-10 00:00:00").cast("timestamp") + pid * F.expr("INTERVAL '6' HOUR"))
        .alias("expires_at"),
        F.when(pid % 5 == 0, F.lit(None).cast("string"))
        .otherwise((F.floor(pid / 3).cast("bigint") * 20).cast("string"))
        .alias("user_id"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user per customer; every eleventh email is malformed (and therefore duplicated)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    key = F.col("c_custkey")
    return c.select(
        key.cast("string").alias("id"),
        F.when(key % 11 == 0, F.lit("broken-at-example"))
        .otherwise(F.concat(F.lit("u"), key.cast("string"), F.lit("@example.com")))
        .alias("email"),
        F.col("c_name").alias("name"),
        F.lit("2023-11-01 00:00:00").cast("timestamp").alias("created_at"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON log lines of three services; every 97th line is not JSON."""
    e = table(spark, sf_dir, "events")
    ts_text = F.col("ts").cast("string")
    line = F.concat(
        F.lit('{"level":"'),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("info")),
        F.lit('","msg":"'), F.col("event_type"),
        F.lit('","timestamp":"'), F.substring(ts_text, 1, 10), F.lit("T"), F.substring(ts_text, 12, 8),
        F.lit('Z","service":"svc'), (F.col("user_id") % 3).cast("string"),
        F.lit('","user":'), F.col("user_id").cast("string"), F.lit("}"),
    )
    return e.select(
        F.col("event_id").alias("line_no"),
        F.when(F.col("event_id") % 97 == 0, F.lit("not json")).otherwise(line).alias("line"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP request log: one request per event, errors answer 500."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("203.0.113."), (F.col("user_id") % 256).cast("string")).alias("ip"),
        F.col("ts").cast("timestamp").alias("requested_at"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)).alias("status"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom-alias requests covering every rejection reason."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    key = F.col("p_partkey")
    return p.select(
        _case(
            key % 8,
            [
                (0, "ab"),
                (1, F.concat(F.lit("link-"), key.cast("string"))),
                (2, "Admin"),
                (3, "my link"),
                (4, F.repeat(F.lit("x"), 51)),
                (5, F.concat(F.lit("casino"), key.cast("string"))),
                (6, F.concat(F.lit("c"), F.lpad((key % 100).cast("string"), 2, "0"))),
            ],
            F.replace(F.lower(F.col("p_name")), F.lit(" "), F.lit("_")),
        ).alias("alias"),
        key.alias("request_id"),
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proxy headers and peer addresses per request (client-IP rule inputs)."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        eid,
        _case(eid % 4, [(0, "203.0.113.195, 70.41.3.18"), (1, "  203.0.113.9  , 10.0.0.1"),
                        (2, _case(eid % 12, [(2, "garbage"), (6, "12:34, 1.2.3.4")], ":::"))], "").alias("x_forwarded_for"),
        F.when(eid % 3 == 0, F.lit("192.168.1.100")).when(eid % 7 == 0, F.lit("::ffff:10.0.0.1")).when(eid % 7 == 1, F.lit("fc00:1"))
        .otherwise(F.lit("")).alias("x_real_ip"),
        _case(eid % 3, [(0, "192.168.1.50:12345"), (1, "[::1]:12345")], "192.168.1.51").alias("remote_addr"),
    )


VIEWS = {
    "click_events": click_events,
    "click_history": click_history,
    "raw_click": raw_clicks,
    "urls": urls,
    "users": users,
    "log_lines": log_lines,
    "requests": requests,
    "aliases": aliases,
    "access_log": access_log,
}


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register every derived table as a temp view (for ``spark.sql`` users)."""
    for name, build in VIEWS.items():
        build(spark, sf_dir).createOrReplaceTempView(name)
