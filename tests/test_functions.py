"""Row rules against the reference's own test vectors."""

import pytest
from pyspark.sql import functions as F

from clickspark.functions import base62, network, useragent, validation
from clickspark.sources.fixtures import FIXTURE_AGENTS

ENCODE = [(0, "0"), (1, "1"), (9, "9"), (10, "A"), (35, "Z"), (36, "a"), (61, "z"), (62, "10"), (63, "11"),
          (124, "20"), (125, "21"), (3844, "100"), (1234567890, "1LY7VK"), (9876543210, "AmOy42")]


def test_base62_encode_vectors(spark):
    df = spark.createDataFrame(ENCODE, "n bigint, expected string")
    got = df.select("expected", base62.encode("n").alias("code")).collect()
    assert all(r.code == r.expected for r in got)


def test_base62_decode_vectors_and_errors(spark):
    rows = [(code, n) for n, code in ENCODE] + [("", None), ("abc!", None), ("ab@c", None), ("ab c", None),
                                                ("ab-c", None)]
    df = spark.createDataFrame(rows, "code string, expected bigint")
    got = df.select("code", "expected", base62.decode_value("code").alias("v"),
                    base62.decode_error("code").alias("err")).collect()
    for r in got:
        assert r.v == r.expected
        assert (r.err is None) == (r.expected is not None)


def test_base62_round_trip_and_limits(spark):
    nums = [0, 1, 9, 10, 61, 62, 63, 100, 125, 1000, 10000, 100000, 1234567890, 9876543210,
            2147483647, 2147483648, 2 ** 63 - 1]
    df = spark.createDataFrame([(n,) for n in nums], "n bigint")
    got = df.select("n", base62.decode_value(base62.encode("n")).alias("back"),
                    F.length(base62.encode("n")).alias("len")).collect()
    assert all(r.back == r.n and r.len <= 12 for r in got)
    neg = spark.createDataFrame([(-1,)], "n bigint").select(base62.encode("n").alias("c")).first().c
    assert neg is None
    over = spark.createDataFrame([("AzL8n0Y58m8",)], "c string").select(base62.decode_error("c").alias("e")).first().e
    assert over == "overflow"


def test_id_layout(spark):
    df = spark.range(1).select(base62.compose_id(F.lit(123456), F.lit(5), F.lit(10), F.lit(7)).alias("id"))
    f = base62.id_fields(F.col("id"))
    r = df.select(f["datacenter"].alias("dc"), f["worker"].alias("w"), f["sequence"].alias("s"),
                  f["created_ms"].alias("ms")).first()
    assert (r.dc, r.w, r.s, r.ms) == (5, 10, 7, 123456 + base62.EPOCH_MS)


ALIAS_CASES = (
    [(a, None) for a in ["abc", "my-link", "my_link", "MyLink123", "test-url-2024", "a-b-c", "123abc"]]
    + [(a, "too_short") for a in ["a", "ab", ""]]
    + [("a" * 51, "too_long"), ("a" * 52, "too_long"), ("a" * 50, None), ("abc", None)]
    + [(a, "invalid_chars") for a in ["my link", "my.link", "my@link", "my/link", "my?link", "my#link", "my&link"]]
    + [(a, "reserved") for a in ["api", "admin", "health", "login", "logout", "register", "auth", "API", "Admin", "HEALTH"]]
    + [(a, "denied") for a in ["porn", "xxx", "spam", "scam", "PORN", "XXX", "mypornsite", "getxxxnow", "bestscam123"]]
    + [("click here", "invalid_chars")]  # multi-word deny terms never match (T23)
)


def test_alias_rules(spark):
    df = spark.createDataFrame(ALIAS_CASES, "alias string, expected string")
    bad = df.where(~F.equal_null(validation.alias_reason("alias"), F.col("expected"))).collect()
    assert not bad, bad


def test_alias_suggestions(spark):
    df = spark.createDataFrame([("mylink",)], "alias string")
    r = df.select(validation.alias_suggestions("alias", 3).alias("s3"),
                  validation.alias_suggestions("alias", 0).alias("s0"),
                  validation.alias_suggestions("alias", 1).alias("s1")).first()
    assert r.s3 == ["mylink-1", "mylink-2", "mylink-3"] and r.s0 == [] and r.s1 == ["mylink-1"]


CLIENT_IP = [
    ("203.0.113.195, 70.41.3.18, 150.172.238.178", "", "192.0.2.1:1234", "203.0.113.195"),
    ("203.0.113.195", "", "192.0.2.1:1234", "203.0.113.195"),
    ("", "192.168.1.100", "192.0.2.1:1234", "192.168.1.100"),
    ("203.0.113.195", "192.168.1.100", "192.0.2.1:1234", "203.0.113.195"),
    ("", "", "192.168.1.50:12345", "192.168.1.50"),
    ("", "", "192.168.1.50", "192.168.1.50"),
    ("", "", "[::1]:12345", "127.0.0.1"),
    ("  203.0.113.195  , 70.41.3.18", "", "192.0.2.1:1234", "203.0.113.195"),
]


def test_client_ip_vectors(spark):
    df = spark.createDataFrame(CLIENT_IP, "xff string, real string, remote string, expected string")
    got = df.select("expected", network.client_ip("xff", "real", "remote").alias("ip")).collect()
    assert [r.ip for r in got] == [r.expected for r in got]


def test_client_ip_validating_rule(spark):
    rows = [("garbage", "", "10.1.2.3:80", "10.1.2.3"), ("", "nope", "[::1]:80", "::1"),
            ("", "2001:db8::1", "1.2.3.4:5", "2001:db8::1")]
    df = spark.createDataFrame(rows, "xff string, real string, remote string, expected string")
    got = df.select("expected", network.client_ip("xff", "real", "remote", validate=True).alias("ip")).collect()
    assert [r.ip for r in got] == [r.expected for r in got]


@pytest.mark.parametrize("ip,label", [
    ("127.0.0.1", "Local"), ("10.1.2.3", "Local"), ("172.16.0.1", "Local"), ("172.32.0.1", "Unknown"),
    ("192.168.1.7", "Local"), ("::1", "Local"), ("fd00::1", "Local"), ("203.0.113.5", "Unknown"),
    ("not-an-ip", "Unknown"), ("010.0.0.1", "Unknown"), ("256.1.1.1", "Unknown"), (None, "Unknown"),
])
def test_geo_class(spark, ip, label):
    df = spark.createDataFrame([(ip,)], "ip string")
    assert df.select(network.geo_class("ip").alias("g")).first().g == label


def test_user_agent_rules(spark):
    df = spark.createDataFrame([(a,) for a in FIXTURE_AGENTS], "ua string")
    cols = useragent.parse("ua")
    got = df.select(*[v.alias(k) for k, v in cols.items()]).collect()
    expected = [
        ("Chrome", "120.0.0.0", "Windows 10", "", "desktop", "", ""),
        ("Safari", "17.0", "CPU iPhone OS 17_0 like Mac OS X", "17.0", "mobile", "Apple", "iPhone"),
        ("Googlebot", "2.1", "", "", "bot", "", ""),
        ("Firefox", "121.0", "Linux x86_64", "", "desktop", "", ""),
        ("Chrome", "120.0.0.0", "Android 14", "", "mobile", "Google", "Pixel 8"),
        ("Safari", "17.0", "Intel Mac OS X 10_15_7", "", "desktop", "Apple", ""),
    ]
    for row, exp in zip(got, expected):
        assert (row.browser, row.browser_version, row.os, row.os_version, row.device_type,
                row.device_brand, row.device_model) == exp


def test_brand_priority_is_listed_order(spark):
    ua = "Mozilla/5.0 (Linux; Android 13; SAMSUNG Galaxy Pixel-like) Mobile"
    df = spark.createDataFrame([(ua,)], "ua string")
    assert df.select(useragent.device_brand("ua").alias("b")).first().b == "Samsung"


def test_url_and_email_rules(spark):
    df = spark.createDataFrame([("https://example.com/x", True), ("not-a-valid-url", False), ("ftp://x.org", False),
                                ("HTTP://Example.com", True), ("http:///path", False)], "u string, ok boolean")
    assert all(r.v == r.ok for r in df.select("ok", validation.is_valid_url("u").alias("v")).collect())
    emails = spark.createDataFrame([("a.b@example.com", True), ("broken-at-example", False), ("X@Y.IO", True),
                                    ("a@b.c", False)], "e string, ok boolean")
    assert all(r.v == r.ok for r in emails.select("ok", validation.is_valid_email("e").alias("v")).collect())


def test_display_labels(spark):
    df = spark.createDataFrame([("2024-01-30 23:30:00", None), ("2024-01-30 20:00:00", "2024-01-31 00:10:00"),
                                ("2024-01-20 00:00:00", "2024-01-30 00:00:00")],
                               "c string, e string").select(F.col("c").cast("timestamp").alias("c"),
                                                            F.col("e").cast("timestamp").alias("e"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    got = df.select(validation.age_label("c", now).alias("a"), validation.expiry_label("e", now).alias("x")).collect()
    assert [(r.a, r.x) for r in got] == [("30 min ago", "Never"), ("4 hours ago", "10 min"), ("11 days ago", "Expired")]
    t = spark.createDataFrame([("x" * 60,)], "s string").select(validation.truncate_text("s", 50).alias("t")).first().t
    assert t == "x" * 47 + "..."


def test_base62_round_trip_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.integers(min_value=0, max_value=2 ** 63 - 1), min_size=1, max_size=200))
    def check(values):
        df = spark.createDataFrame([(v,) for v in values], "n bigint")
        got = df.select("n", base62.encode("n").alias("c")).select(
            "n", "c", base62.decode_value("c").alias("back")).collect()
        for r in got:
            assert r.back == r.n
            assert r.c == _py_encode(r.n)

    check()


def _py_encode(n: int) -> str:
    """Independent Python base62 for the property test."""
    if n == 0:
        return "0"
    out = []
    while n:
        n, rem = divmod(n, 62)
        out.append(base62.ALPHABET[rem])
    return "".join(reversed(out))


ADDRESSES = {  # text: (is an address, class)
    "12:34": (False, "Unknown"), "fc00:1": (False, "Unknown"), ":::": (False, "Unknown"), "a:b:c": (False, "Unknown"),
    "1:2:3:4:5:6:7:8": (True, "Unknown"), "fe80::1": (True, "Unknown"), "::ffff:10.0.0.1": (True, "Local"),
    "::ffff:8.8.8.8": (True, "Unknown"), "::ffff:0a00:0001": (True, "Local"), "0:0:0:0:0:ffff:192.168.1.1": (True, "Local"),
    "::1": (True, "Local"), "0:0::0:1": (True, "Local"), "::": (True, "Unknown"), "fd12:3456::1": (True, "Local"), "fc::1": (True, "Unknown"),
    "1::2::3": (False, "Unknown"), "1:2:3:4:5:6:7:8:9": (False, "Unknown"), "1:2:3:4:5:6:7::": (True, "Unknown"), ":1:2:3:4:5:6:7": (False, "Unknown"),
    "::12345": (False, "Unknown"), "::1.2.3": (False, "Unknown"), "1:2:3:4:5:6:1.2.3.4": (True, "Unknown"), "1.2.3.4": (True, "Unknown"),
    "01.2.3.4": (False, "Unknown"), "172.31.0.1": (True, "Local"), "172.32.0.1": (True, "Unknown"), "": (False, "Unknown"), "::1:0": (True, "Unknown"),
}


def test_addresses_against_literal_rows(spark):
    import ipaddress

    from clickspark.functions import network

    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string").select(
        "ip", network.is_ip("ip").alias("valid"), network.geo_class("ip").alias("place")).collect()
    assert {r.ip: (r.valid, r.place) for r in rows} == ADDRESSES
    for text, (valid, _) in ADDRESSES.items():
        try:
            ipaddress.ip_address(text)
            assert valid, text
        except ValueError:
            assert not valid, text


def test_rules_against_literal_rows(spark):
    """Rows that don't depend on the lists the SQL twins share with the code."""
    from clickspark.functions import useragent as ua
    from clickspark.functions import validation as v

    aliases = {"ab": "too_short", "x" * 51: "too_long", "a b c": "invalid_chars", "admin": "reserved", "API": "reserved",
               "my-casino-1": "denied", "good-alias_9": None, "y" * 50: None, "abc": None}
    rows = spark.createDataFrame([(a,) for a in aliases], "alias string").select("alias", v.alias_reason("alias").alias("reason")).collect()
    assert {r.alias: r.reason for r in rows} == aliases
    agents = {
        "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1":
            ("Safari", "17.0", "mobile", "Apple", "iPhone"),
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.1":
            ("Edge", "120.0.1", "desktop", "", ""),
        "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)": ("Googlebot", "2.1", "bot", "", ""),
        "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0": ("Firefox", "121.0", "desktop", "", ""),
    }
    parsed = ua.parse("a")
    rows = spark.createDataFrame([(a,) for a in agents], "a string").select("a", *[c.alias(k) for k, c in parsed.items()]).collect()
    got = {r.a: (r.browser, r.browser_version, r.device_type, r.device_brand, r.device_model) for r in rows}
    assert {k: x[:3] for k, x in got.items()} == {k: x[:3] for k, x in agents.items()}
    assert got[list(agents)[0]] == agents[list(agents)[0]]


def test_ip_bits_and_range_prefixes_against_the_library(spark):
    import ipaddress
    import random

    from pyspark.sql import functions as F

    from clickspark.functions import network
    pick = random.Random(6)
    texts = ["0.0.0.0", "255.255.255.255", "1.2.3.4", "::", "::1", "1::", "fe80::1:2", "1:2:3:4:5:6:7:8", "::ffff:10.0.0.1", "::FFFF:a00:1",
             "2001:db8::1.2.3.4", "64:ff9b::192.0.2.33", "ABCD::ef01:0:0", "0:0:0:0:0:ffff:1.2.3.4"]
    texts += [str(ipaddress.IPv6Address(pick.getrandbits(128) & ~(((1 << 64) - 1) << pick.choice([0, 32, 64])))) for _ in range(60)]

    def bits(text):
        a = ipaddress.ip_address(text)
        a = getattr(a, "ipv4_mapped", None) or a
        return f"{a.version}{int(a):0{a.max_prefixlen}b}"

    got = spark.createDataFrame([(t,) for t in [*texts, "1.2.3", "1:2", "x", "", None]], "ip string").select("ip", network.ip_bits("ip").alias("b")).collect()
    assert {r.ip: r.b for r in got} == {t: bits(t) for t in texts} | {"1.2.3": None, "1:2": None, "x": None, "": None, None: None}
    ranges = [("0.0.0.0", "255.255.255.255"), ("10.0.0.3", "10.0.0.3"), ("10.0.0.0", "10.255.255.255"), ("9.255.255.255", "10.0.0.0"), ("::", "ffff:" * 7 + "ffff")]
    for family, width in ((ipaddress.IPv4Address, 32), (ipaddress.IPv6Address, 128)):
        for _ in range(60):
            a = pick.getrandbits(width) >> pick.randrange(width) << pick.randrange(8)
            b = min(a + (pick.getrandbits(width) >> pick.randrange(width)), (1 << width) - 1)
            ranges.append((str(family(min(a, b) % (1 << width))), str(family(b))))
    ranges = [(a, b) for a, b in ranges if bits(a) <= bits(b) and bits(a)[0] == bits(b)[0]]
    ends = spark.createDataFrame([(a, b, bits(a), bits(b)) for a, b in ranges], "a string, b string, low string, high string")
    rows = ends.select("a", "b", F.array_sort(network.range_prefixes(F.col("low"), F.col("high"))).alias("p")).collect()
    for r in rows:
        ends = [getattr(x, "ipv4_mapped", None) or x for x in (ipaddress.ip_address(r.a), ipaddress.ip_address(r.b))]
        nets = ipaddress.summarize_address_range(*ends)
        assert r.p == sorted(f"{n.version}{int(n.network_address):0{n.max_prefixlen}b}"[:n.prefixlen + 1] for n in nets), (r.a, r.b)


def test_geo_ranges_of_both_families(spark):
    from clickspark.operators import enrich as en
    ranges = [("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "wide"), ("2001:db8:1::", "2001:db8:1::ff", "narrow"), ("2001:db8:1::", "2001:db8:1::f", "tie"),
              ("10.0.0.0", "10.0.0.255", "ten"), ("10.0.0.7", "11.0.0.0", "later"), ("1.1.1.1", "::5", "mixed"), ("9.0.0.9", "9.0.0.1", "backwards")]
    table = spark.createDataFrame([(a, b, c, c[:2], "r", "t") for a, b, c in ranges], "start_ip string, end_ip string, country string, country_code string, region string, city string")
    want = {"2001:db8::1": "wide", "2001:DB8:1:0::10": "narrow", "2001:db8:1::2": "tie", "2001:db9::": None, "10.0.0.6": "ten", "10.0.0.9": "later", "::ffff:10.0.0.1": "ten",
            "11.0.0.1": None, "9.0.0.5": None, "1.1.1.1": None, "not-an-ip": None, None: None}
    clicks = spark.createDataFrame([(ip,) for ip in [*want, "10.0.0.6"]], "ip_address string")
    got = en.geo_by_range(clicks, table).collect()
    assert len(got) == len(want) + 1 and {r.ip_address: r.country for r in got} == want
    assert en.geo_by_range(clicks, table.limit(0)).where("country IS NOT NULL").count() == 0
