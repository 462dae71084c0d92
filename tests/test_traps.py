"""Boundary tests for the semantic traps decided in SURVEY 1.4."""

import datetime as dt

from pyspark.sql import functions as F

from clickspark.operators import enrich as en
from clickspark.operators import limits as lm
from clickspark.operators import listing as ls
from clickspark.operators import reports as rp
from clickspark.operators import tables as tb
from clickspark.sources import fixtures as fx
from tests.conftest import SF_SMALL

AS_OF = fx.AS_OF


def _raw(spark, rows):
    return spark.createDataFrame(rows, "short_code string, timestamp string, ip string, user_agent string, "
                                       "original_url string, referer string, query_params string")


def test_t1_seconds_and_arrival_time(spark):
    raw = _raw(spark, [("a", "1704067200", None, None, None, None, None), ("b", "bad", None, None, None, None, None),
                       ("c", None, None, None, None, None, None), ("d", "1704067200000", None, None, None, None, None)])
    out = en.enrich_clicks(raw, arrival=AS_OF)
    got = {r.short_code: r.clicked_at for r in out.where("short_code <> 'd'").collect()}
    assert got["a"] == dt.datetime(2024, 1, 1)
    assert got["b"] == got["c"] == dt.datetime(2024, 1, 31)
    # a millisecond value is read as seconds, as the reference does (far-future year)
    assert out.where("short_code = 'd'").select(F.year("clicked_at")).first()[0] > 50000


def test_t4_replay_keeps_event_id(spark):
    raw = fx.raw_clicks(spark, SF_SMALL).limit(50)
    a = en.enrich_clicks(raw, arrival=AS_OF).select("event_id").collect()
    b = en.enrich_clicks(raw, arrival="2030-01-01 00:00:00").select("event_id").collect()
    assert sorted(a) == sorted(b)


def test_t6_t7_blank_is_missing_and_direct_rows_stay_apart(spark):
    clicks = spark.createDataFrame(
        [("e1", "x", "", None), ("e2", "x", "", ""), ("e3", "x", "", "direct"), ("e4", "x", "DE", "r")],
        "event_id string, short_code string, country string, referer string")
    geo = rp.geo_top(clicks).collect()
    assert [(r.country, r.clicks) for r in geo] == [("DE", 1)]
    refs = sorted((r.referer, r.clicks) for r in rp.top_referrers_direct(clicks).collect())
    assert refs == [("direct", 1), ("direct", 2), ("r", 1)]


def test_t8_listed_codes_without_clicks_get_zeros(spark):
    clicks = fx.click_events(spark, SF_SMALL)
    got = {r.short_code: r for r in rp.url_stats_windows(clicks, AS_OF, codes=["c01", "zzz"]).collect()}
    assert got["zzz"].total_clicks == 0 and got["zzz"].unique_visitors == 0
    assert got["c01"].total_clicks == clicks.where("short_code = 'c01'").count()


def test_t9_equal_expiry_is_neither_active_nor_deleted(spark):
    urls = spark.createDataFrame([("a", dt.datetime(2024, 1, 31)), ("b", None), ("c", dt.datetime(2024, 2, 1)),
                                  ("d", dt.datetime(2024, 1, 30))], "short_code string, expires_at timestamp")
    active = {r.short_code for r in ls.active(urls, AS_OF).collect()}
    kept, gone = tb.expired_split(urls, AS_OF)
    assert active == {"b", "c"}
    assert {r.short_code for r in gone.collect()} == {"d"}
    assert "a" in {r.short_code for r in kept.collect()}


def test_t11_first_bucket_is_partial_and_unfilled(spark):
    clicks = spark.createDataFrame([("x", dt.datetime(2024, 1, 24, 0, 0)), ("x", dt.datetime(2024, 1, 24, 12, 0)),
                                    ("x", dt.datetime(2024, 1, 30, 1, 0))], "short_code string, clicked_at timestamp")
    got = sorted((r.bucket, r.clicks) for r in rp.timeline_daily(clicks, AS_OF, 7).collect())
    assert got == [(dt.datetime(2024, 1, 24), 1), (dt.datetime(2024, 1, 30), 1)]


def test_t17_feed_total_is_rows_returned(spark):
    clicks = fx.click_events(spark, SF_SMALL).limit(60)
    rows = rp.recent_clicks(clicks, 5000).collect()  # the endpoint rule (T16) is listing.page_args'
    assert len(rows) == 60 and {r.total for r in rows} == {60}
    assert {r.total for r in rp.recent_clicks(clicks, 7).collect()} == {7}


def test_t19_denied_requests_count(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "ip", base + dt.timedelta(seconds=i)) for i in range(6)],
                               "event_id long, ip string, requested_at timestamp")
    got = sorted((r.event_id, r.prior_count, r.allowed) for r in lm.sliding_window_verdicts(df, 2, 60).collect())
    assert [g[1] for g in got] == [0, 1, 2, 3, 4, 5]
    assert [g[2] for g in got] == [True, True, False, False, False, False]


def test_t25_negative_and_overlong_codes_rejected(spark):
    from clickspark.functions import base62
    df = spark.createDataFrame([(-7, "zzzzzzzzzzzz")], "n long, c string")
    r = df.select(base62.encode("n").alias("e"), base62.decode_error("c").alias("err")).first()
    assert r.e is None and r.err == "overflow"


def test_l1_l3_presentation_orders(spark):
    c = fx.click_events(spark, SF_SMALL)
    days = rp.series_daily(c, "2024-01-05", "2024-01-25", codes=["c10", "c11"], ordered=True).collect()
    assert [(r.short_code, r.clicked_date) for r in days] == sorted((r.short_code, r.clicked_date) for r in days)
    top = rp.country_share(c, "2024-01-01", "2024-01-30", codes=["c10"], ordered=True).collect()
    assert [r.total_clicks for r in top] == sorted((r.total_clicks for r in top), reverse=True)
    feed = rp.recent_clicks(c, 20).collect()
    stamps = [r.clicked_at_text for r in feed]
    assert stamps == sorted(stamps, reverse=True)
