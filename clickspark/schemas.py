"""Canonical schemas of the click, URL, user, log and request tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, TS, D, DBL, BOOL, LONG, INT = (
    T.StringType(),
    T.TimestampType(),
    T.DateType(),
    T.DoubleType(),
    T.BooleanType(),
    T.LongType(),
    T.IntegerType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# Raw stream message: every value arrives as text, optional keys may be absent. ``message_id`` is
# given by our own publishers.
RAW_CLICK = _struct(
    ("short_code", S), ("timestamp", S), ("ip", S), ("user_agent", S),
    ("original_url", S), ("referer", S), ("query_params", S), ("message_id", S),
)

# Enriched click row (columnar store); empty string means "missing".
CLICK_EVENT = _struct(
    ("event_id", S), ("short_code", S), ("original_url", S), ("clicked_at", TS), ("clicked_date", D),
    ("ip_address", S), ("country", S), ("country_code", S), ("region", S), ("city", S),
    ("latitude", DBL), ("longitude", DBL), ("timezone", S), ("user_agent", S), ("browser", S),
    ("browser_version", S), ("os", S), ("os_version", S), ("device_type", S), ("device_brand", S),
    ("device_model", S), ("is_mobile", BOOL), ("is_tablet", BOOL), ("is_desktop", BOOL), ("is_bot", BOOL),
    ("referer", S), ("query_params", S), ("processed_at", TS),
)

URL = _struct(
    ("short_code", S), ("long_url", S), ("clicks", LONG), ("created_at", TS),
    ("updated_at", TS), ("expires_at", TS), ("user_id", S),
)

USER = _struct(("id", S), ("email", S), ("name", S), ("created_at", TS), ("updated_at", TS))

LOG_ENTRY = _struct(
    ("timestamp", TS), ("level", S), ("message", S), ("service", S),
    ("fields", T.MapType(S, S)),
)

REQUEST = _struct(("ip", S), ("requested_at", TS), ("duration_ms", DBL), ("status", INT))


def blank_to_null(col: Column | str) -> Column:
    """Columnar 'empty means missing' to row-store NULL semantics (trap T6)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(c, F.lit(""))


def null_to_blank(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))
