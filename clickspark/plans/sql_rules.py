"""DuckDB SQL text of the row rules.

Word lists and limits are shared with the Spark side; tests/test_functions.py checks them against
literal rows."""

from __future__ import annotations

from clickspark.functions import base62 as b62
from clickspark.functions import useragent as ua_rules
from clickspark.functions import validation as val

BOT = "regexp_matches({u}, '(?i)(bot|crawler|spider|slurp|crawling)')"


def ua_sql(col: str) -> dict[str, str]:
    u = f"coalesce({col}, '')"
    bot = BOT.format(u=u)
    browser = (f"CASE WHEN {bot} THEN regexp_extract({u}, '(?i)([A-Za-z]*(?:bot|crawler|spider|slurp))', 1) "
               f"WHEN contains({u}, 'Edg/') THEN 'Edge' WHEN contains({u}, 'OPR/') THEN 'Opera' "
               f"WHEN contains({u}, 'Chrome/') THEN 'Chrome' WHEN contains({u}, 'Firefox/') THEN 'Firefox' "
               f"WHEN contains({u}, 'Safari/') THEN 'Safari' ELSE '' END")
    version = (f"CASE WHEN {bot} THEN regexp_extract({u}, '(?i)[A-Za-z]*(?:bot|crawler|spider|slurp)/([0-9.]+)', 1) "
               f"WHEN contains({u}, 'Edg/') THEN regexp_extract({u}, 'Edg/([0-9.]+)', 1) "
               f"WHEN contains({u}, 'OPR/') THEN regexp_extract({u}, 'OPR/([0-9.]+)', 1) "
               f"WHEN contains({u}, 'Chrome/') THEN regexp_extract({u}, 'Chrome/([0-9.]+)', 1) "
               f"WHEN contains({u}, 'Firefox/') THEN regexp_extract({u}, 'Firefox/([0-9.]+)', 1) "
               f"WHEN contains({u}, 'Safari/') THEN regexp_extract({u}, 'Version/([0-9.]+)', 1) ELSE '' END")
    nt = f"regexp_extract({u}, 'Windows NT ([0-9.]+)', 1)"
    win = ("CASE " + " ".join(f"WHEN {nt} = '{v}' THEN '{n}'" for v, n in ua_rules.WINDOWS_NAMES)
           + f" ELSE 'Windows NT ' || {nt} END")
    os_ = (f"CASE WHEN contains({u}, 'iPhone') THEN regexp_extract({u}, '(CPU iPhone OS [0-9_]+ like Mac OS X)', 1) "
           f"WHEN contains({u}, 'iPad') THEN regexp_extract({u}, '(CPU OS [0-9_]+ like Mac OS X)', 1) "
           f"WHEN contains({u}, 'Android') THEN regexp_extract({u}, '(Android [0-9.]+)', 1) "
           f"WHEN contains({u}, 'Windows NT') THEN {win} "
           f"WHEN contains({u}, 'Mac OS X') THEN regexp_extract({u}, '(Intel Mac OS X [0-9_.]+)', 1) "
           f"WHEN contains({u}, 'Linux') THEN regexp_extract({u}, '(Linux [A-Za-z0-9_]+)', 1) ELSE '' END")
    os_version = (f"CASE WHEN contains({os_}, 'iPhone OS') OR contains({os_}, 'CPU OS') THEN "
                  f"coalesce(replace(list_filter(string_split({os_}, ' '), lambda t: contains(t, '_') OR contains(t, '.'))[1], '_', '.'), '') "
                  f"ELSE '' END")
    mobile = f"(NOT {bot} AND (contains({u}, 'Mobi') OR contains({u}, 'iPhone') OR contains({u}, 'Android')))"
    device = f"CASE WHEN {bot} THEN 'bot' WHEN {mobile} THEN 'mobile' ELSE 'desktop' END"
    model = (f"CASE WHEN contains({u}, 'iPhone') THEN 'iPhone' WHEN contains({u}, 'iPad') THEN 'iPad' "
             f"WHEN contains({u}, 'Android') THEN trim(regexp_extract({u}, 'Android [0-9.]+; ([^;)]+)', 1)) ELSE '' END")
    low = f"lower({u})"
    plat = (f"lower(CASE WHEN contains({u}, 'iPhone') THEN 'iPhone' WHEN contains({u}, 'iPad') THEN 'iPad' "
            f"WHEN contains({u}, 'Macintosh') THEN 'Macintosh' WHEN contains({u}, 'Windows') THEN 'Windows' "
            f"WHEN contains({u}, 'Android') OR contains({u}, 'Linux') THEN 'Linux' ELSE '' END)")
    brand = ("CASE " + " ".join(f"WHEN contains({low}, '{k}') THEN '{b}'" for k, b in ua_rules.BRAND_KEYWORDS)
             + f" WHEN contains({plat}, 'iphone') OR contains({plat}, 'ipad') THEN 'Apple' ELSE '' END")
    return {"browser": browser, "browser_version": version, "os": os_, "os_version": os_version,
            "device_type": device, "device_brand": brand, "device_model": model}


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def ipv4_sql(col: str) -> str:
    return f"coalesce(regexp_matches({col}, '{IPV4}'), false)"


def _ipv6_grammar() -> str:
    """The address grammar of the URI standard, form by form."""
    h, tail = "[0-9a-f]{1,4}", rf"([0-9a-f]{{1,4}}:[0-9a-f]{{1,4}}|{OCTET}(\.{OCTET}){{3}})"
    forms = [f"({h}:){{6}}{tail}"]
    for before, groups in ((0, 5), (1, 4), (2, 3), (3, 2), (4, 1), (5, 0)):
        head = f"(({h}:){{0,{before - 1}}}{h})?" if before else ""
        forms.append(f"{head}::({h}:){{{groups}}}{tail}" if groups else f"{head}::{tail}")
    forms += [f"(({h}:){{0,5}}{h})?::{h}", f"(({h}:){{0,6}}{h})?::"]
    return "^(" + "|".join(forms) + ")$"


IPV6 = _ipv6_grammar()


def ipv6_sql(col: str) -> str:
    return f"coalesce(regexp_matches(lower({col}), '{IPV6}'), false)"


def octet(col: str, i: int) -> str:
    return f"CAST(string_split({col}, '.')[{i}] AS INTEGER)"


def _local_v4(col: str) -> str:
    return (f"({octet(col, 1)} = 127 OR {octet(col, 1)} = 10 OR ({octet(col, 1)} = 172 AND {octet(col, 2)} BETWEEN 16 AND 31) "
            f"OR ({octet(col, 1)} = 192 AND {octet(col, 2)} = 168))")


def local_sql(col: str) -> str:
    tail = f"regexp_extract({col}, '([0-9.]+)$', 1)"
    mapped = f"(regexp_matches(lower({col}), '^(::|(0{{1,4}}:){{5}})ffff:[0-9.]+$') AND {ipv4_sql(tail)} AND {_local_v4(tail)})"
    v6 = (f"({ipv6_sql(col)} AND (regexp_matches({col}, '^[0:]*:0{{0,3}}1$') OR regexp_matches(lower({col}), '^f[cd][0-9a-f][0-9a-f]:') OR "
          f"CASE WHEN contains({col}, '.') THEN {mapped} ELSE false END))")
    return f"(CASE WHEN {ipv4_sql(col)} THEN {_local_v4(col)} ELSE {v6} END)"


def geo_label_sql(col: str) -> str:
    return f"CASE WHEN {local_sql(col)} THEN 'Local' ELSE 'Unknown' END"


def split_host_sql(addr: str) -> str:
    return (f"CASE WHEN regexp_matches({addr}, '^\\[[^\\]]*\\]:[^:]*$') THEN regexp_extract({addr}, '^\\[([^\\]]*)\\]:[^:]*$', 1) "
            f"WHEN regexp_matches({addr}, '^[^:\\[\\]]*:[^:]*$') THEN regexp_extract({addr}, '^([^:\\[\\]]*):[^:]*$', 1) END")


def client_ip_sql(xff: str, real: str, remote: str, validate: bool) -> str:
    x, r, a = f"coalesce({xff}, '')", f"coalesce({real}, '')", f"coalesce({remote}, '')"
    first = f"trim(string_split({x}, ',')[1])"
    host = split_host_sql(a)
    if validate:
        def ok(c):
            return f"({ipv4_sql(c)} OR {ipv6_sql(c)})"
        return (f"CASE WHEN {x} <> '' AND {ok(first)} THEN {first} WHEN {r} <> '' AND {ok(r)} THEN {r} "
                f"ELSE coalesce({host}, {a}) END")
    peer = f"CASE WHEN {host} = '::1' THEN '127.0.0.1' ELSE {host} END"
    return f"CASE WHEN {x} <> '' THEN {first} WHEN {r} <> '' THEN {r} ELSE coalesce({peer}, {a}) END"


def base62_encode_sql(num: str) -> str:
    digits = " || ".join(
        f"substr('{b62.ALPHABET}', CAST((({num}) // {62 ** i}) % 62 AS INTEGER) + 1, 1)" for i in range(10, -1, -1))
    trimmed = f"ltrim({digits}, '0')"
    return f"CASE WHEN ({num}) < 0 THEN NULL WHEN {trimmed} = '' THEN '0' ELSE {trimmed} END"


def base62_decode_sql(code: str) -> tuple[str, str]:
    """(value, error) expressions: value NULL on error."""
    stripped = f"ltrim({code}, '0')"
    big = (f"CASE WHEN {stripped} = '' THEN CAST(0 AS HUGEINT) WHEN length({stripped}) > 11 THEN NULL ELSE "
           f"list_reduce(list_transform(string_split({stripped}, ''), lambda ch: CAST(strpos('{b62.ALPHABET}', ch) - 1 AS HUGEINT)), "
           f"lambda acc, d: acc * 62 + d) END")
    error = (f"CASE WHEN {code} IS NULL OR {code} = '' THEN 'empty' "
             f"WHEN NOT regexp_matches({code}, '^[0-9A-Za-z]+$') THEN 'invalid_character' "
             f"WHEN {big} IS NULL OR {big} > 9223372036854775807 THEN 'overflow' END")
    value = f"CASE WHEN ({error}) IS NULL THEN CAST({big} AS BIGINT) END"
    return value, error


def alias_reason_sql(col: str) -> str:
    a = f"coalesce({col}, '')"
    reserved = ", ".join(f"'{w}'" for w in val.RESERVED_WORDS)
    terms = "[" + ", ".join(f"'{t}'" for t in val.DENY_TERMS) + "]"
    return (f"CASE WHEN strlen({a}) < {val.MIN_ALIAS_BYTES} THEN 'too_short' "
            f"WHEN strlen({a}) > {val.MAX_ALIAS_BYTES} THEN 'too_long' "
            f"WHEN NOT regexp_matches({a}, '^[a-zA-Z0-9_-]+$') THEN 'invalid_chars' "
            f"WHEN lower({a}) IN ({reserved}) THEN 'reserved' "
            f"WHEN list_contains({terms}, lower({a})) THEN 'denied' "
            f"WHEN len(list_filter({terms}, lambda t: contains(lower({a}), t))) > 0 THEN 'denied' END")


def tokens_sql(col: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({col}, '')), '[^a-z0-9]+'), lambda t: t <> '')"


def crc32_sql(col: str) -> str:
    """CRC-32 (IEEE, reflected, polynomial 0xEDB88320) of an ASCII text column, bit by bit."""
    step = "lambda acc, z: xor(acc >> 1, CASE WHEN (acc & 1) = 1 THEN 3988292384 ELSE 0 END)"
    per_byte = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {step})"
    return (f"xor(list_reduce(list_transform(string_split({col}, ''), lambda ch: unicode(ch)), {per_byte}, "
            f"4294967295), 4294967295)")
