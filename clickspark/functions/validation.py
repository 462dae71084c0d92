"""Row rules of the data-quality jobs (Q1, Q2, Q4, Q6) and display helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_ALIAS_BYTES = 3
MAX_ALIAS_BYTES = 50
ALIAS_CHARSET = r"^[a-zA-Z0-9_-]+$"
EMAIL_PATTERN = r"(?i)^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"

# Reserved aliases (case-insensitive exact match).
RESERVED_WORDS = [
    "api", "admin", "health", "status", "metrics", "dashboard", "login", "logout", "register", "auth",
    "static", "assets", "css", "js", "img", "favicon", "robots", "sitemap", "www", "app", "mail", "ftp",
]

# Default deny-list terms (exact, then substring match on the lower-cased alias).
# Callers may pass their own list; multi-word terms can never match because the charset rule
# rejects spaces first (trap T23).
DENY_TERMS = [
    "fuck", "fucking", "fucker", "shit", "bullshit", "bitch", "bastard", "asshole", "dick", "dumbass",
    "piss", "pissed", "crap", "motherfucker", "sucker", "wtf", "stfu", "retard", "idiot", "moron",
    "porn", "xxx", "adult", "nsfw", "nude", "nudity", "boobs", "tits", "sex", "sexy",
    "hardcore", "fetish", "camgirl", "onlyfans", "strip", "stripper", "escort", "bdsm",
    "deepthroat", "hentai", "anal", "horny",
    "spam", "scam", "fraud", "fake", "phishing", "malware", "virus", "trojan", "crypto scam",
    "giveaway", "free money", "click here", "visit link", "guaranteed profit", "limited offer", "get rich",
    "loan approval", "investment scheme", "ponzi", "pump", "dump", "get followers", "win iphone",
    "drug", "drugs", "cocaine", "weed", "marijuana", "heroin", "lsd", "meth", "ecstasy", "mdma",
    "opium", "ketamine", "ghb",
    "casino", "betting", "bet", "sportsbook", "jackpot", "poker", "roulette", "slots", "lottery", "gambling",
    "kill", "murder", "execute", "suicide", "selfharm", "blood", "stab", "shoot",
    "hate", "loser", "trash", "clown", "pathetic", "disgusting",
    "forex signals", "binary options", "crypto miner", "airdrop", "wallet drain", "mirror trading",
    "mlm", "network marketing", "referral scam",
    "telegram bot", "whatsapp bot", "dm me", "seller account", "resell", "buy followers",
    "cheap followers", "boost engagement",
    "bank login", "reset password", "verify identity", "unlock account", "suspicious activity",
    "confirm your details", "security alert",
    "weapon", "gun", "bomb", "explosive",
]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def alias_reason(alias: Column | str, deny_terms: list[str] | None = None) -> Column:
    """Q1: first failing rule wins: too_short, too_long, invalid_chars, reserved, denied; NULL = valid.

    Lengths count bytes. The deny list is a literal array, so the check is a per-row
    ``exists`` with no join and no shuffle."""
    a = F.coalesce(_c(alias), F.lit(""))
    low = F.lower(a)
    nbytes = F.octet_length(a)
    terms = F.array(*[F.lit(t) for t in (DENY_TERMS if deny_terms is None else deny_terms)])
    return (F.when(nbytes < MIN_ALIAS_BYTES, F.lit("too_short"))
            .when(nbytes > MAX_ALIAS_BYTES, F.lit("too_long"))
            .when(~a.rlike(ALIAS_CHARSET), F.lit("invalid_chars"))
            .when(low.isin(*RESERVED_WORDS), F.lit("reserved"))
            .when(F.array_contains(terms, low), F.lit("denied"))
            .when(F.exists(terms, lambda t: low.contains(t)), F.lit("denied")))


def client_alias_reason(alias: Column | str) -> Column:
    """Q6: lighter client rule: empty is fine (auto code); a leading ``/`` skips the charset rule."""
    a = F.coalesce(_c(alias), F.lit(""))
    nbytes = F.octet_length(a)
    return (F.when(a == "", F.lit(None).cast("string"))
            .when(nbytes < MIN_ALIAS_BYTES, F.lit("too_short"))
            .when(nbytes > MAX_ALIAS_BYTES, F.lit("too_long"))
            .when(~a.startswith("/") & ~a.rlike(ALIAS_CHARSET), F.lit("invalid_chars")))


def alias_suggestions(alias: Column | str, n: int) -> Column:
    """C4: ``alias-1 .. alias-n``; the suffix is one character ``chr(48 + i)``."""
    if n <= 0:
        return F.array().cast("array<string>")
    return F.transform(F.sequence(F.lit(1), F.lit(n)),
                       lambda i: F.concat(_c(alias), F.lit("-"), F.char(i + 48)))


def is_valid_url(url: Column | str) -> Column:
    """Q2: http/https scheme (case-insensitive) and a non-empty host."""
    u = _c(url)
    scheme = F.lower(F.try_parse_url(u, F.lit("PROTOCOL")))
    host = F.try_parse_url(u, F.lit("HOST"))
    return F.coalesce(scheme.isin("http", "https") & (F.coalesce(host, F.lit("")) != ""), F.lit(False))


def is_valid_email(email: Column | str) -> Column:
    """Q4: the table's email CHECK pattern (case-insensitive)."""
    return F.coalesce(_c(email).rlike(EMAIL_PATTERN), F.lit(False))


def truncate_text(text: Column | str, max_len: int) -> Column:
    """longer than ``max_len`` bytes -> first ``max_len - 3`` characters + ``...``."""
    t = _c(text)
    return F.when(F.octet_length(t) > max_len, F.concat(F.substring(t, 1, max_len - 3), F.lit("..."))).otherwise(t)


def age_label(created_at: Column | str, as_of: Column) -> Column:
    """``N min ago`` / ``N hours ago`` / ``N days ago`` with truncated integers."""
    secs = F.unix_seconds(as_of) - F.unix_seconds(_c(created_at))
    return (F.when(secs < 3600, F.concat((secs / 60).cast("bigint").cast("string"), F.lit(" min ago")))
            .when(secs < 86400, F.concat((secs / 3600).cast("bigint").cast("string"), F.lit(" hours ago")))
            .otherwise(F.concat((secs / 86400).cast("bigint").cast("string"), F.lit(" days ago"))))


def expiry_label(expires_at: Column | str, as_of: Column) -> Column:
    """``Never`` / ``Expired`` / ``N min`` / ``N hours`` / ``N days`` until expiry."""
    e = _c(expires_at)
    secs = F.unix_seconds(e) - F.unix_seconds(as_of)
    return (F.when(e.isNull(), F.lit("Never"))
            .when(secs < 0, F.lit("Expired"))
            .when(secs < 3600, F.concat((secs / 60).cast("bigint").cast("string"), F.lit(" min")))
            .when(secs < 86400, F.concat((secs / 3600).cast("bigint").cast("string"), F.lit(" hours")))
            .otherwise(F.concat((secs / 86400).cast("bigint").cast("string"), F.lit(" days"))))


def location_label(city: Column | str, country: Column | str) -> Column:
    """``city, country`` / city / country / ``Unknown``."""
    ci = F.coalesce(_c(city), F.lit(""))
    co = F.coalesce(_c(country), F.lit(""))
    joined = (F.when(ci == "", co).when(co != "", F.concat(ci, F.lit(", "), co)).otherwise(ci))
    return F.when(joined == "", F.lit("Unknown")).otherwise(joined)


def or_unknown(col: Column | str) -> Column:
    """empty or missing -> ``Unknown``."""
    c = F.coalesce(_c(col), F.lit(""))
    return F.when(c == "", F.lit("Unknown")).otherwise(c)
