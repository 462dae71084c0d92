"""Click enrichment (J1) and related row jobs: range-table geo (J9), expiry derivation.

``enrich_clicks`` is a staged projection of Catalyst expressions (no Python UDF, no lambda),
so in batch and in streaming it runs inside whole-stage codegen with no Python in the path.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickspark.functions import network, useragent
from clickspark.operators.common import ts

UA_COLUMNS = ["browser", "browser_version", "os", "os_version", "device_type", "device_brand", "device_model"]

RAW_FIELDS = ["short_code", "timestamp", "ip", "user_agent", "original_url", "referer", "query_params"]


def event_id(cols: list[Column], position: Column | None = None) -> Column:
    """Deterministic event id (trap T4): SHA-256 over the raw fields (+ source position, where there
    is one), so a replayed message gets the same id and sinks stay idempotent."""
    fields = F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    if position is not None:
        fields = F.concat(fields, F.coalesce(F.concat(F.lit("\u0001"), position.cast("string")), F.lit("")))
    return F.sha2(fields, 256)


def parse_click_time(text: Column, arrival: Column) -> Column:
    """Trap T1: the stream carries epoch *seconds* as text; missing or unparsable -> arrival time."""
    secs = text.try_cast("bigint")
    return F.coalesce(F.timestamp_seconds(secs), arrival)


@functools.lru_cache(maxsize=32)
def _ua_stage_columns(app_id: str) -> tuple[list[Column], list[Column], list[Column]]:
    """UA stages over a ``_ua`` column: (lower case + Windows kernel, bot flag + OS, parsed columns). Built once per
    SparkContext: Columns are unresolved expressions, so reusing them across micro-batches
    saves the driver-side construction of large rule trees."""
    texts = [F.lower("_ua").alias("_low"), useragent.windows_kernel("_ua").alias("_nt")]
    first = [useragent.is_bot("_ua", F.col("_low")).alias("_bot"), useragent.os_name("_ua", F.col("_nt")).alias("_os")]
    cols = useragent.parse(F.col("_ua"), F.col("_bot"), F.col("_os"), F.col("_low"))
    return texts, first, [cols[k].alias(f"_ua_{k}") for k in UA_COLUMNS]


#: Copies of one message that one row stands for while they are numbered.
PART_ROWS = 50_000


def with_positions(raw: DataFrame, file_col: str | None = None) -> DataFrame:
    """Add ``position``, which tells identical messages apart and is the same on a replay.

    A message that carries a ``message_id`` (K1/K2) or a ``position`` (Kafka partition and offset)
    has it already. The others are counted per identical content and file and numbered 1..n:
    which of n equal rows gets which number makes no difference. The first one of rows without a
    file has position NULL. Only the messages without an id of their own are shuffled; a source
    whose messages all carry one needs no exchange at all (pass it on as it is). A message that repeats
    more than ``PART_ROWS`` times is numbered in parts by many tasks."""
    own = [F.col(c) for c in ("message_id", "position") if c in raw.columns]
    known = F.coalesce(*own) if len(own) > 1 else own[0] if own else F.lit(None).cast("string")
    cols = [c for c in raw.columns if c not in ("position", file_col)]
    rows = raw.select(*cols, known.alias("position"), *([F.col(file_col)] if file_col else []))
    if not own and file_col is None:
        return _numbered(rows.drop("position"), cols, None)
    return rows.where(F.col("position").isNotNull()).select(*cols, "position").unionByName(
        _numbered(rows.where(F.col("position").isNull()).drop("position"), cols, file_col))


def _numbered(rows: DataFrame, cols: list[str], file_col: str | None, part_rows: int = PART_ROWS) -> DataFrame:
    keys = cols + ([file_col] if file_col else [])
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # a message that repeats more often is numbered in parts, which are dealt to the tasks; the number of
    # tasks is given, because parts are few bytes and would be coalesced into one task before they unfold
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / part_rows).cast("bigint"))
    dealt = (counted.where(F.col("_n") > part_rows).withColumn("_part", F.explode(parts))
             .repartition(tasks, F.xxhash64(*keys), "_part")
             .withColumn("_from", F.col("_part") * part_rows + 1)
             .withColumn("_to", F.least(F.col("_from") + part_rows - 1, "_n")).drop("_part", "_n"))
    whole = counted.where(F.col("_n") <= part_rows).withColumn("_from", F.lit(1).cast("bigint")).withColumnRenamed("_n", "_to")
    each = whole.unionByName(dealt).withColumn("_i", F.explode(F.sequence("_from", "_to")))
    number = F.concat(F.lit("#"), F.col("_i").cast("string"))
    position = F.concat(F.col(file_col), number) if file_col else F.when(F.col("_i") > 1, number)
    return each.select(*cols, position.alias("position"))


@functools.lru_cache(maxsize=32)
def _enrich_stage_columns(app_id: str, arrival: str | None, position: str | None,
                          arrival_col: str | None = None) -> dict[str, list[Column]]:
    """Column lists of the enrichment stages, built once per (context, arrival, position)."""
    if arrival_col:
        now = F.col(arrival_col)
    else:
        now = F.current_timestamp() if arrival is None else ts(arrival)
    inputs = [*[F.col(c) for c in RAW_FIELDS], *([F.col(arrival_col)] if arrival_col else []),
              event_id([F.col(c) for c in RAW_FIELDS], F.col(position) if position else None).alias("_event_id"),
              F.coalesce(F.col("user_agent"), F.lit("")).alias("_ua"),
              F.coalesce(F.col("ip"), F.lit("")).alias("_ip"),
              parse_click_time(F.col("timestamp"), now).alias("_clicked_at")]
    ip_flags = [v.alias(k) for k, v in network.ip_flags("_ip").items()]
    geo_label = [network.geo_class_from_flags("_ip", F.col("_ip_num"), F.col("_ip_v6")).alias("_geo")]
    ua, ip = F.col("_ua"), F.col("_ip")
    parsed = {k: F.col(f"_ua_{k}") for k in UA_COLUMNS}
    geo = network.geo_columns(ip, F.col("_geo"))
    device = F.col("_ua_device_type")
    clicked_at = F.col("_clicked_at")
    final = [
        F.col("_event_id").alias("event_id"),
        F.coalesce("short_code", F.lit("")).alias("short_code"),
        F.coalesce("original_url", F.lit("")).alias("original_url"),
        clicked_at.alias("clicked_at"),
        F.to_date(clicked_at).alias("clicked_date"),
        ip.alias("ip_address"),
        *[geo[k].alias(k) for k in ("country", "country_code", "region", "city", "latitude", "longitude", "timezone")],
        ua.alias("user_agent"),
        *[parsed[k].alias(k) for k in ("browser", "browser_version", "os", "os_version")],
        device.alias("device_type"),
        parsed["device_brand"].alias("device_brand"),
        parsed["device_model"].alias("device_model"),
        (device == "mobile").alias("is_mobile"),
        (device == "tablet").alias("is_tablet"),
        (~device.isin("mobile", "tablet", "bot")).alias("is_desktop"),
        (device == "bot").alias("is_bot"),
        F.coalesce("referer", F.lit("")).alias("referer"),
        F.coalesce("query_params", F.lit("")).alias("query_params"),
        now.alias("processed_at"),
        F.date_format(F.to_date(clicked_at), "yyyyMM").alias("clicked_month"),
    ]
    return {"inputs": inputs, "ip_flags": ip_flags, "geo": geo_label, "final": final}


def enrich_clicks(raw: DataFrame, arrival=None, position: str | None = None,
                  arrival_col: str | None = None) -> DataFrame:
    """Raw stream messages -> click table rows.

    ``arrival``: processing time for rows without a usable timestamp (default: now);
    ``position``: optional column with the message's source position (message id, offset, or file
    and occurrence, see ``with_positions``), mixed into the event id so identical clicks stay
    distinct while replays do not;
    ``arrival_col``: a column holding the arrival time instead (the streaming pipeline stamps
    the micro-batch time there, so a replayed batch gets the same times and partitions).

    One scan, no exchange, no job while the plan is built. Stage 1 computes normalised inputs and
    the per-row regex results once; later stages reference them several times, so Catalyst keeps
    the projects apart instead of inlining (and re-evaluating) the regexes; all stages share one
    whole-stage-codegen span."""
    app_id = raw.sparkSession.sparkContext.applicationId
    cols = _enrich_stage_columns(app_id, None if arrival is None else str(arrival), position, arrival_col)
    texts, first, parsed = _ua_stage_columns(app_id)
    flags = raw.select(*cols["inputs"]).select("*", *cols["ip_flags"], *texts).select("*", *cols["geo"], *first)
    return flags.select("*", *parsed).select(*cols["final"])


def split_bad_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages that are no JSON (``_text`` holds them) or have no short code are quarantined
    with a reason instead of blocking."""
    malformed = F.col("_text").isNotNull() if "_text" in raw.columns else F.lit(False)
    blank = F.col("short_code").isNull() | (F.trim(F.col("short_code")) == "")
    good = raw.where(~(malformed | blank))
    quarantined = raw.where(malformed | blank).withColumn(
        "reason", F.when(malformed, F.lit("malformed message")).otherwise(F.lit("missing short_code")))
    return good.drop("_text"), quarantined


def derive_expiry(requests: DataFrame, default_ttl_hours: int = 72) -> DataFrame:
    """Requested expiry, else creation + default TTL, else none (TTL 0 disables)."""
    ttl = (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(default_ttl_hours))
           if default_ttl_hours > 0 else F.lit(None).cast("timestamp"))
    return requests.withColumn("expires_at", F.coalesce(F.col("expires_at"), ttl))


def geo_by_range(clicks: DataFrame, ranges: DataFrame, ip_col: str = "ip_address") -> DataFrame:
    """IP -> location through a user-supplied table of IPv4 and IPv6 ranges
    (``start_ip, end_ip, country, country_code, region, city``).

    Work is done once per *distinct* IP, not per click. Ranges are cut into network prefixes, and an
    address looks up its own prefix of every length in use: equi-joins on the prefix, so neither a dense
    network nor a wide range makes pairs that are thrown away. Where ranges overlap the one with the highest
    start, then the smallest, wins; each prefix keeps its winner only, so a click is never multiplied. A mapped
    IPv4 address is looked up as IPv4; ranges whose ends are of two families or in the wrong order hold nothing."""
    place = F.struct("country", "country_code", "region", "city")
    r = ranges.select(network.ip_bits("start_ip").alias("lo"), network.ip_bits("end_ip").alias("hi"), place.alias("place")).where(
        (F.col("lo") <= F.col("hi")) & (F.substring("lo", 1, 1) == F.substring("hi", 1, 1)))
    order = F.struct("lo", F.translate("hi", "01", "10"), F.to_json("place"))
    nets = r.withColumn("net", F.explode(network.range_prefixes(F.col("lo"), F.col("hi")))).groupBy("net").agg(
        F.max(order).alias("order"), F.max_by("place", order).alias("place"))
    lengths: dict[str, list[int]] = {"4": [], "6": []}
    for row in nets.select(F.substring("net", 1, 1).alias("family"), F.length("net").alias("n")).distinct().collect():  # 162 at most
        lengths[row["family"]].append(row["n"])
    sizes = lambda family: F.array(*[F.lit(n) for n in sorted(lengths[family])]).cast("array<int>")
    ips = clicks.select(F.col(ip_col).alias("ip")).distinct().withColumn("bits", network.ip_bits("ip"))
    probes = ips.select("ip", "bits", F.explode(F.when(F.col("bits").startswith("4"), sizes("4")).when(F.col("bits").startswith("6"), sizes("6"))).alias("n"))
    probes = probes.select("ip", F.substring(F.col("bits"), F.lit(1), F.col("n")).alias("net"))
    found = probes.join(nets, "net").groupBy("ip").agg(F.max_by("place", "order").alias("place"))
    located = found.select(F.col("ip").alias(ip_col), "place.country", "place.country_code", "place.region", "place.city")
    return clicks.drop("country", "country_code", "region", "city").join(located, ip_col, "left")
