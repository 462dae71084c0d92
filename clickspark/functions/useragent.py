"""User-agent columns (J2-J4) as ordered regex / CASE rules over the UA string.

The reference delegates parsing to a third-party library that is not in its tree, so this
rule table defines the behaviour: browser families Edge, Opera, Chrome, Firefox, Safari and
crawler names; OS families Windows, iOS, Android, macOS, Linux. Unknown agents give empty
strings, never errors. Tablets are never detected (trap T14).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# An agent that holds one of these in any case is a crawler ("crawling" among them).
BOT_WORDS = ["bot", "crawler", "spider", "slurp", "crawling"]
BOT_PATTERN = f"(?i)({'|'.join(BOT_WORDS)})"

# Brand keywords in priority order (first match wins), then the brand.
BRAND_KEYWORDS = [
    ("iphone", "Apple"), ("ipad", "Apple"), ("macintosh", "Apple"),
    ("samsung", "Samsung"), ("galaxy", "Samsung"),
    ("pixel", "Google"), ("nexus", "Google"),
    ("huawei", "Huawei"), ("xiaomi", "Xiaomi"), ("oneplus", "OnePlus"), ("oppo", "Oppo"), ("vivo", "Vivo"),
    ("nokia", "Nokia"), ("lg", "LG"), ("sony", "Sony"), ("htc", "HTC"), ("motorola", "Motorola"),
]

# Windows NT kernel version -> marketing name.
WINDOWS_NAMES = [("10.0", "Windows 10"), ("6.3", "Windows 8.1"), ("6.2", "Windows 8"), ("6.1", "Windows 7")]


def _ua(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _extract(ua: Column, pattern: str) -> Column:
    return F.regexp_extract(ua, pattern, 1)


def is_bot(ua_col: Column | str, low: Column | None = None) -> Column:
    """Does the agent hold a crawler word; ``low`` is the lower-cased agent, if it is a column already."""
    if low is None:
        return _ua(ua_col).rlike(BOT_PATTERN)
    return functools.reduce(Column.__or__, [low.contains(word) for word in BOT_WORDS])


def browser(ua_col: Column | str, bot: Column | None = None) -> Column:
    ua = _ua(ua_col)
    return (F.when(is_bot(ua) if bot is None else bot, _extract(ua, r"(?i)([A-Za-z]*(?:bot|crawler|spider|slurp))"))
            .when(ua.contains("Edg/"), F.lit("Edge"))
            .when(ua.contains("OPR/"), F.lit("Opera"))
            .when(ua.contains("Chrome/"), F.lit("Chrome"))
            .when(ua.contains("Firefox/"), F.lit("Firefox"))
            .when(ua.contains("Safari/"), F.lit("Safari"))
            .otherwise(F.lit("")))


def browser_version(ua_col: Column | str, bot: Column | None = None) -> Column:
    ua = _ua(ua_col)
    return (F.when(is_bot(ua) if bot is None else bot, _extract(ua, r"(?i)[A-Za-z]*(?:bot|crawler|spider|slurp)/([0-9.]+)"))
            .when(ua.contains("Edg/"), _extract(ua, r"Edg/([0-9.]+)"))
            .when(ua.contains("OPR/"), _extract(ua, r"OPR/([0-9.]+)"))
            .when(ua.contains("Chrome/"), _extract(ua, r"Chrome/([0-9.]+)"))
            .when(ua.contains("Firefox/"), _extract(ua, r"Firefox/([0-9.]+)"))
            .when(ua.contains("Safari/"), _extract(ua, r"Version/([0-9.]+)"))
            .otherwise(F.lit("")))


def platform(ua_col: Column | str) -> Column:
    ua = _ua(ua_col)
    return (F.when(ua.contains("iPhone"), F.lit("iPhone"))
            .when(ua.contains("iPad"), F.lit("iPad"))
            .when(ua.contains("Macintosh"), F.lit("Macintosh"))
            .when(ua.contains("Windows"), F.lit("Windows"))
            .when(ua.contains("Android") | ua.contains("Linux"), F.lit("Linux"))
            .otherwise(F.lit("")))


def windows_kernel(ua_col: Column | str) -> Column:
    """The kernel version of a Windows agent; the other agents cost no regex."""
    ua = _ua(ua_col)
    return F.when(ua.contains("Windows NT"), _extract(ua, r"Windows NT ([0-9.]+)"))


def os_name(ua_col: Column | str, kernel: Column | None = None) -> Column:
    ua = _ua(ua_col)
    nt = windows_kernel(ua) if kernel is None else kernel
    windows = F.concat(F.lit("Windows NT "), nt)
    for version, name in WINDOWS_NAMES:
        windows = F.when(nt == version, F.lit(name)).otherwise(windows)
    return (F.when(ua.contains("iPhone"), _extract(ua, r"(CPU iPhone OS [0-9_]+ like Mac OS X)"))
            .when(ua.contains("iPad"), _extract(ua, r"(CPU OS [0-9_]+ like Mac OS X)"))
            .when(ua.contains("Android"), _extract(ua, r"(Android [0-9.]+)"))
            .when(ua.contains("Windows NT"), windows)
            .when(ua.contains("Mac OS X"), _extract(ua, r"(Intel Mac OS X [0-9_.]+)"))
            .when(ua.contains("Linux"), _extract(ua, r"(Linux [A-Za-z0-9_]+)"))
            .otherwise(F.lit("")))


def os_version(os_col: Column) -> Column:
    """Apple handheld OS version: first space-separated token containing ``_`` or ``.``,
    underscores to dots (a regex, so the projection stays inside whole-stage codegen)."""
    first = F.regexp_extract(os_col, r"(?:^| )([^ ]*[_.][^ ]*)", 1)
    apple = os_col.contains("iPhone OS") | os_col.contains("CPU OS")
    return F.when(apple, F.replace(first, F.lit("_"), F.lit("."))).otherwise(F.lit(""))


def is_mobile(ua_col: Column | str, bot: Column | None = None) -> Column:
    ua = _ua(ua_col)
    b = is_bot(ua) if bot is None else bot
    return ~b & (ua.contains("Mobi") | ua.contains("iPhone") | ua.contains("Android"))


def device_type(ua_col: Column | str, bot: Column | None = None) -> Column:
    """Bot before mobile before desktop."""
    ua = _ua(ua_col)
    b = is_bot(ua) if bot is None else bot
    return F.when(b, F.lit("bot")).when(is_mobile(ua, b), F.lit("mobile")).otherwise(F.lit("desktop"))


def device_model(ua_col: Column | str) -> Column:
    ua = _ua(ua_col)
    return (F.when(ua.contains("iPhone"), F.lit("iPhone"))
            .when(ua.contains("iPad"), F.lit("iPad"))
            .when(ua.contains("Android"), F.trim(_extract(ua, r"Android [0-9.]+; ([^;)]+)")))
            .otherwise(F.lit("")))


def device_brand(ua_col: Column | str, low: Column | None = None) -> Column:
    """First listed keyword contained in the lower-cased agent. An Apple platform (iPhone, iPad) is
    in the list by its own name, so it needs no rule after it."""
    low = F.lower(_ua(ua_col)) if low is None else low
    expr = None
    for keyword, brand in BRAND_KEYWORDS:
        cond = low.contains(keyword)
        expr = F.when(cond, F.lit(brand)) if expr is None else expr.when(cond, F.lit(brand))
    return expr.otherwise(F.lit(""))


def parse(ua_col: Column | str, bot: Column | None = None, os_col: Column | None = None,
          low: Column | None = None) -> dict[str, Column]:
    """All UA-derived columns of the click table. ``bot`` / ``os_col`` / ``low`` may be precomputed
    columns so that what is behind them runs once per row."""
    os_col = os_name(ua_col) if os_col is None else os_col
    return {
        "browser": browser(ua_col, bot),
        "browser_version": browser_version(ua_col, bot),
        "os": os_col,
        "os_version": os_version(os_col),
        "device_type": device_type(ua_col, bot),
        "device_brand": device_brand(ua_col, low),
        "device_model": device_model(ua_col),
    }
