"""IP address predicates, geo class (J5) and client-IP choice (J6) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"  # no leading zeros
# Groups of one to four hex digits, at most one '::'; an IPv4 tail is put in as two groups before.
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"
IPV6_FORM = rf"^(?:{_GROUPS})?(?:::(?:{_GROUPS})?)?$"
IPV4_TAIL = rf":{_OCTET}(?:\.{_OCTET}){{3}}$"
# An IPv4 address inside an IPv6 one: five zero groups (or '::' for them), ffff, the address.
MAPPED = r"(?i)^(?:::|(?:0{1,4}:){5}|(?:0{1,4}:){1,4}:|::(?:0{1,4}:){1,4})ffff:"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_ipv4(ip: Column | str) -> Column:
    return F.coalesce(_c(ip).rlike(IPV4), F.lit(False))


def is_ipv6(ip: Column | str) -> Column:
    """Eight groups, or fewer around one ``::``; the last two may be written as an IPv4 address."""
    c = _c(ip)
    plain = F.regexp_replace(c, IPV4_TAIL, ":0:0")
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    right = F.when(plain.contains("::"), groups <= 7).otherwise(groups == 8)
    return F.coalesce(c.contains(":") & plain.rlike(IPV6_FORM) & right, F.lit(False))


def is_ip(ip: Column | str) -> Column:
    return is_ipv4(ip) | is_ipv6(ip)


def ipv4_number(ip: Column | str) -> Column:
    """Dotted IPv4 -> BIGINT (``inet_aton``); NULL for anything else."""
    parts = F.split(_c(ip), r"\.")
    num = F.lit(0).cast("bigint")
    for i, shift in enumerate((24, 16, 8, 0)):
        num = num + F.shiftleft(F.get(parts, i).cast("bigint"), shift)
    return F.when(is_ipv4(ip), num)


def ip_bits(ip: Column | str) -> Column:
    """An address as ``4`` and 32 or ``6`` and 128 binary digits, NULL for anything else. A mapped IPv4
    address in IPv6 form is the IPv4 address. Prefixes of the text are the networks that hold the address."""
    c = _c(ip)
    binary = lambda number, digits, base=10: F.lpad(F.conv(number, base, 2), digits, "0")
    four = lambda text: binary(ipv4_number(text).cast("string"), 32)
    dotted = F.regexp_extract(c, r"([0-9.]+)$", 1)
    tail = lambda part: F.lower(F.hex(F.shiftright(ipv4_number(dotted), 16) if part else ipv4_number(dotted).bitwiseAND(0xFFFF)))
    plain = F.when(c.contains("."), F.concat(F.regexp_replace(c, r"[0-9.]+$", ""), tail(1), F.lit(":"), tail(0))).otherwise(c)
    halves = F.split(plain, "::")
    groups = lambda half: F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(halves, 0)), groups(F.get(halves, 1))
    full = F.concat(left, F.array_repeat(F.lit("0"), (F.lit(8) - F.size(left) - F.size(right)).cast("int")), right)
    six = F.array_join(F.transform(full, lambda g: binary(g, 16, 16)), "")
    mapped = six.startswith("0" * 80 + "1" * 16)
    return (F.when(is_ipv4(c), F.concat(F.lit("4"), four(c)))
            .when(is_ipv6(c), F.when(mapped, F.concat(F.lit("4"), F.substring(six, 97, 32))).otherwise(F.concat(F.lit("6"), six))))


def range_prefixes(low: Column, high: Column) -> Column:
    """The fewest prefixes that cover ``low`` to ``high`` (``ip_bits`` of one family, low <= high). Both are used
    many times over, so they should be columns that are computed already.

    Up to the first digit in which they differ the two share a prefix. Below it, every 0 of ``low`` leaves out a
    sibling that lies above it and every 1 of ``high`` one that lies below; zeros at the end of ``low`` and ones at
    the end of ``high`` make their own prefix shorter."""
    size, one = F.length(low), F.lit(1)
    at = lambda text, i: F.substring(text, i, one)
    upto = lambda text, n: F.substring(text, one, n)
    differ = F.array_min(F.filter(F.sequence(one, size), lambda i: at(low, i) != at(high, i)))
    last = lambda text, digit: F.when(text.contains(digit), size - F.instr(F.reverse(text), digit) + 1).otherwise(0)
    low_end, high_end = F.greatest(differ, last(low, "1")), F.greatest(differ, last(high, "0"))

    def siblings(text: Column, end: Column, digit: str, other: str) -> Column:
        inside = F.when(end > differ + 1, F.sequence(differ + 1, end - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(inside, lambda i: at(text, i) == digit), lambda i: F.concat(upto(text, i - 1), F.lit(other)))

    sides = F.concat(F.array(upto(low, low_end), upto(high, high_end)), siblings(low, low_end, "0", "1"), siblings(high, high_end, "1", "0"))
    whole = (low_end == differ) & (high_end == differ)
    return F.when(differ.isNull(), F.array(low)).when(whole, F.array(upto(low, differ - 1))).otherwise(sides)


def _in_cidr(num: Column, base: str, bits: int) -> Column:
    a, b, c, d = (int(x) for x in base.split("."))
    start = (a << 24) | (b << 16) | (c << 8) | d
    return F.shiftright(num, 32 - bits) == F.lit(start >> (32 - bits))


def _is_local_number(num: Column) -> Column:
    """Loopback or private IPv4 (as a number)."""
    return F.coalesce(_in_cidr(num, "127.0.0.0", 8) | _in_cidr(num, "10.0.0.0", 8)
                      | _in_cidr(num, "172.16.0.0", 12) | _in_cidr(num, "192.168.0.0", 16), F.lit(False))


def _is_local_v6(c: Column) -> Column:
    """For a valid IPv6 text: ``::1`` in any spelling, fc00::/7, or a mapped loopback / private IPv4."""
    loopback = ~c.contains(".") & (F.regexp_replace(c, "[0:]", "") == "1") & c.endswith("1")
    unique = F.lower(c).rlike("^f[cd][0-9a-f]{2}:")
    dotted = ipv4_number(F.regexp_extract(c, r"([0-9.]+)$", 1))
    high, low = F.regexp_extract(c, r":([0-9A-Fa-f]{1,4}):([0-9A-Fa-f]{1,4})$", 1), F.regexp_extract(c, r":([0-9A-Fa-f]{1,4})$", 1)
    hexed = F.conv(F.concat(high, F.lpad(low, 4, "0")), 16, 10).cast("bigint")
    mapped = c.rlike(MAPPED) & _is_local_number(F.when(c.contains("."), dotted).otherwise(hexed))
    return F.coalesce(loopback | unique | mapped, F.lit(False))


def is_local(ip: Column | str) -> Column:
    c = _c(ip)
    return _is_local_number(ipv4_number(c)) | (is_ipv6(c) & _is_local_v6(c))


def geo_class(ip: Column | str) -> Column:
    """``Unknown`` for unparsable or public addresses, ``Local`` for loopback / private."""
    return F.when(is_local(ip), F.lit("Local")).otherwise(F.lit("Unknown"))


def ip_flags(ip: Column | str) -> dict[str, Column]:
    """Per-row parse results reused by ``geo_class_from_flags``: IPv4 number (NULL unless a
    valid dotted quad) and the IPv6 check (only attempted when the text contains ``:``)."""
    c = _c(ip)
    return {"_ip_num": ipv4_number(c),
            "_ip_v6": F.coalesce(c.contains(":") & is_ipv6(c), F.lit(False))}


def geo_class_from_flags(ip: Column | str, ip_num: Column, v6: Column) -> Column:
    """``geo_class`` over precomputed ``ip_flags`` (same result, each regex evaluated once)."""
    local = _is_local_number(ip_num) | (v6 & _is_local_v6(_c(ip)))
    return F.when(local, F.lit("Local")).otherwise(F.lit("Unknown"))


def geo_columns(ip: Column | str, label: Column | None = None) -> dict[str, Column]:
    label = geo_class(ip) if label is None else label
    return {
        "country": label, "country_code": F.lit("XX"), "region": label, "city": label,
        "latitude": F.lit(0.0), "longitude": F.lit(0.0), "timezone": F.lit("UTC"),
    }


def split_host(addr: Column) -> Column:
    """Host part of ``host:port`` / ``[host]:port``; NULL where the address has no valid port form."""
    bracket = F.regexp_extract(addr, r"^\[([^\]]*)\]:[^:]*$", 1)
    plain = F.regexp_extract(addr, r"^([^:\[\]]*):[^:]*$", 1)
    return (F.when(addr.rlike(r"^\[[^\]]*\]:[^:]*$"), bracket)
            .when(addr.rlike(r"^[^:\[\]]*:[^:]*$"), plain))


def client_ip(x_forwarded_for: Column | str, x_real_ip: Column | str, remote_addr: Column | str,
              validate: bool = False) -> Column:
    """First forwarded-for entry (trimmed), else real-ip, else the peer host without port.

    ``validate=False`` (redirect rule) trusts header text and folds ``::1`` to ``127.0.0.1``;
    ``validate=True`` (rate-limit rule) takes a header only if it parses as an IP and keeps
    ``::1`` (trap T22)."""
    xff = F.coalesce(_c(x_forwarded_for), F.lit(""))
    real = F.coalesce(_c(x_real_ip), F.lit(""))
    remote = F.coalesce(_c(remote_addr), F.lit(""))
    first = F.trim(F.get(F.split(xff, ","), 0))
    host = split_host(remote)
    if validate:
        return (F.when((xff != "") & is_ip(first), first)
                .when((real != "") & is_ip(real), real)
                .otherwise(F.coalesce(host, remote)))
    peer = F.when(host == "::1", F.lit("127.0.0.1")).otherwise(host)
    return F.when(xff != "", first).when(real != "", real).otherwise(F.coalesce(peer, remote))
