"""Table maintenance, layout and plan-shape tests."""

import os

from pyspark.sql import functions as F

from clickspark.operators import enrich as en
from clickspark.operators import listing as ls
from clickspark.operators import resolve as rs
from clickspark.operators import search as se
from clickspark.operators import tables as tb
from clickspark.sources import fixtures as fx
from clickspark.streaming import pipeline as pl
from clickspark.streaming import sources as src
from tests.conftest import SF_SMALL

AS_OF = fx.AS_OF


def _plan(df):
    """Text of ``df.explain("formatted")``."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_click_table_layout_prunes_months_and_pushes_filters(spark, scratch):
    path = os.path.join(scratch, "clicks")
    tb.write_click_table(fx.click_events(spark, SF_SMALL), path, mode="overwrite")
    assert any(f.startswith("clicked_month=") for f in os.listdir(path))
    df = tb.read_click_table(spark, path, "2024-01-05", "2024-01-25", codes=["c42"])
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(clicked_month" in plan
    pushed = plan.split("PushedFilters: ")[1].split("\n")[0]
    assert "EqualTo(short_code,c42)" in pushed and "GreaterThanOrEqual(clicked_date" in pushed
    assert df.count() == fx.click_events(spark, SF_SMALL).where(
        (F.col("short_code") == "c42") & F.col("clicked_date").between("2024-01-05", "2024-01-25")).count()


def test_report_scan_reads_only_needed_columns(spark, scratch):
    from clickspark.operators import reports as rp
    path = os.path.join(scratch, "clicks")
    tb.write_click_table(fx.click_events(spark, SF_SMALL), path, mode="overwrite")
    plan = _plan(rp.country_share(spark.read.parquet(path), "2024-01-05", "2024-01-25"))
    read_schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "referer" not in read_schema and "browser" not in read_schema


def test_publish_and_replay_round_trip(spark, scratch):
    clicks = en.enrich_clicks(fx.raw_clicks(spark, SF_SMALL).where(F.col("timestamp").rlike("^[0-9]+$")),
                              arrival=AS_OF)
    landing = os.path.join(scratch, "landing")
    tb.replay_clicks(clicks, landing)
    lines = spark.read.text(landing)
    assert lines.count() == clicks.count()
    sample = lines.first().value
    assert '"short_code"' in sample and '"timestamp"' in sample and '""' not in sample  # empty optionals omitted
    out = os.path.join(scratch, "out")
    q = pl.start_enrichment(src.click_stream(spark, landing), out, os.path.join(scratch, "ckpt"), arrival=AS_OF)
    q.awaitTermination()
    again = spark.read.parquet(f"{out}/clicks")
    key = ["short_code", "clicked_at", "ip_address", "browser", "device_type"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, clicks.select(*key).collect()))


def test_update_users(spark):
    users = fx.users(spark, SF_SMALL).withColumn("password_hash", F.concat(F.lit("h"), "id"))
    updates = spark.createDataFrame([("1", "New Name", "new1@example.com"), ("2", "X", "u3@example.com"),
                                     ("3", "Y", "bad-email"), ("999999", "Z", "z@example.com"), ("9", "N", "same@example.com"),
                                     ("10", "T", "same@example.com"), ("4", "a", "four@example.com"), ("4", "b", "vier@example.com"),
                                     (None, "n", "n@example.com")],
                                    "id string, name string, email string")
    merged, rejects = tb.update_users(users, updates, AS_OF)
    assert merged.count() == users.count() and merged.where("password_hash is null").count() == 0
    one = merged.where("id = '1'").first()
    assert one.email == "new1@example.com" and one.name == "New Name" and one.created_at is not None and one.password_hash == "h1"
    reasons = {(r.id, r.name): r.reason for r in rejects.collect()}
    assert reasons == {("2", "X"): "email_taken", ("3", "Y"): "invalid_email", ("999999", "Z"): "unknown_user",
                       ("10", "T"): "duplicate_email", ("4", "b"): "duplicate_update", (None, "n"): "missing_id"}
    assert merged.where("email = 'same@example.com'").first().id == "9"


def test_bulk_create_and_register(spark):
    reqs = spark.createDataFrame([(1, "https://a.example/x", "mylink"), (2, "ftp://bad", "other"),
                                  (3, "https://b.example", "mylink"), (4, "https://c.example", "c01"),
                                  (5, "https://d.example", "admin")], "request_id long, long_url string, alias string")
    accepted, rejected = rs.bulk_create_urls(reqs, fx.urls(spark, SF_SMALL), AS_OF)
    assert [r.short_code for r in accepted.collect()] == ["mylink"]
    assert {r.request_id: r.reason for r in rejected.collect()} == {
        2: "invalid_url", 3: "duplicate_in_batch", 4: "alias_taken", 5: "reserved"}
    exp = accepted.first().expires_at
    assert str(exp) == "2024-02-03 00:00:00"  # created + 72 h default TTL
    new = spark.createDataFrame([("x1", "Ann", "u1@example.com"), ("x2", "Bob", "bob@example.com"),
                                 ("x3", "Bob2", "bob@example.com")], "id string, name string, email string")
    ok, bad = rs.bulk_register(new, fx.users(spark, SF_SMALL))
    assert [r.id for r in ok.collect()] == ["x2"]
    assert {r.id: r.reason for r in bad.collect()} == {"x1": "email_taken", "x3": "duplicate_email"}


def test_only_acceptable_rows_claim_a_name(spark):
    reqs = spark.createDataFrame([(1, "bad url", "good-one"), (2, "https://ok.example", "good-one"), (3, "https://ok.example", "good-one")],
                                 "request_id long, long_url string, alias string")
    assert {r.request_id: r.reason for r in rs.creation_audit(reqs, fx.urls(spark, SF_SMALL)).collect()} == {
        1: "invalid_url", 2: None, 3: "duplicate_in_batch"}
    new = spark.createDataFrame([("8", "", "a@example.com", "long enough"), ("9", "Ann", "a@example.com", "long enough"),
                                 ("10", "Bob", "a@example.com", "long enough"), ("11", "Cy", "A@example.com", "short"),
                                 ("12", "Cy", "A@example.com", "long enough")], "id string, name string, email string, password string")
    ok, bad = rs.bulk_register(new, fx.users(spark, SF_SMALL))
    assert sorted(r.id for r in ok.collect()) == ["12", "9"]
    assert {r.id: r.reason for r in bad.collect()} == {"8": "missing_name", "10": "duplicate_email", "11": "short_password"}


def test_cold_months_are_rewritten_in_place(spark, scratch):
    path = os.path.join(scratch, "clicks")
    history = fx.click_history(spark, SF_SMALL)
    tb.write_click_table(history, path)
    before = sorted(map(tuple, history.select("event_id", "clicked_at").collect()))
    files = lambda: {f for d, _, fs in os.walk(path) for f in fs if f.startswith("part") and "202401" in d}
    hot = files()
    tb.rewrite_cold(spark.read.parquet(path), path, AS_OF, cold_days=7)
    assert sorted(map(tuple, spark.read.parquet(path).select("event_id", "clicked_at").collect())) == before
    assert files() == hot  # the month of the cutoff is not touched
    # expiry drops whole months and cuts the boundary month, twice with one result
    assert tb.drop_expired(spark, path, AS_OF, 90) and tb.drop_expired(spark, path, AS_OF, 90) == []
    assert spark.read.parquet(path).count() == tb.retention(history, AS_OF, 90).count() > 0
    # overwriting a table leaves no stale month
    tb.write_click_table(history.where("clicked_date >= '2024-01-01'"), path, mode="overwrite")
    assert os.listdir(path).count("clicked_month=202401") == 1 and sum(d.startswith("clicked_month") for d in os.listdir(path)) == 1


def test_landing_files_inside_the_newest_rows_stay(spark, scratch):
    landing = os.path.join(scratch, "landing")
    rows = fx.click_events(spark, SF_SMALL).select(F.col("clicked_at").alias("ingested_at"), "event_id")
    rows.repartitionByRange(6, "ingested_at").write.parquet(landing)
    for keep in (1, 300, 900, 10_000):
        doomed = {r.file for r in tb.trim_landing(spark.read.parquet(landing), keep).collect()}
        kept = spark.read.parquet(landing).withColumn("f", F.input_file_name()).where(~F.col("f").isin(*doomed, ""))
        newest = rows.orderBy(F.desc("ingested_at")).limit(keep)
        assert newest.select("event_id").exceptAll(kept.select("event_id")).count() == 0
        assert (len(doomed) > 0) == (keep < 900)
    mixed = spark.createDataFrame([("g", 10), ("g", 1), ("g", 1), ("f", 5), ("f", 5)], "file string, t long").select(
        "file", F.timestamp_seconds("t").alias("ingested_at"))
    assert tb.trim_landing(mixed, 3, file_col="file").collect() == []
    kept, gone = tb.expired_split(fx.urls(spark, SF_SMALL), AS_OF)
    assert kept.count() + gone.count() == fx.urls(spark, SF_SMALL).count()
    assert tb.delete_keys(fx.urls(spark, SF_SMALL), gone, "short_code").count() == kept.count()


def test_search_paths(spark):
    urls = fx.urls(spark, SF_SMALL)
    single = se.url_search(urls, "FR top", 5, 0).collect()
    queries = spark.createDataFrame([(1, "FR top"), (2, "nothing-matches-zzz")], "query_id int, q string")
    bulk = se.bulk_url_search(urls, queries, per_query=5).collect()
    assert [r.short_code for r in single] == [r.short_code for r in sorted(bulk, key=lambda r: r.rank)]
    assert {r.total for r in bulk} == {single[0].total}


def test_page_args_rules():
    assert ls.page_args("list", 0, -5) == ls.Page(100, 0)
    assert ls.page_args("list", 5000, 3) == ls.Page(1000, 3)
    assert ls.page_args("click_feed", 5000, None) == ls.Page(50, 0)
    assert ls.page_args("search", 101, 2) == ls.Page(20, 2)
    assert ls.page_args("timeline", 400, None) == ls.Page(400, 0)


def test_reports_prune_month_partitions(spark, scratch):
    from clickspark.operators import reports as rp
    path = os.path.join(scratch, "clicks")
    tb.write_click_table(fx.click_events(spark, SF_SMALL), path, mode="overwrite")
    plan = _plan(rp.country_share(spark.read.parquet(path), "2024-01-05", "2024-01-25"))
    assert "PartitionFilters: [isnotnull(clicked_month" in plan and "202401" in plan.split("PartitionFilters: ")[1]


def test_expire_urls_cascades(spark):
    urls, clicks = fx.urls(spark, SF_SMALL), fx.click_events(spark, SF_SMALL)
    out = tb.expire_urls(urls, AS_OF, clicks=clicks, search_docs=urls.select("short_code", "long_url"))
    gone = {r.short_code for r in out["deleted_keys"].collect()}
    assert gone and not gone & {r.short_code for r in out["urls"].collect()}
    assert not gone & {r.short_code for r in out["clicks"].select("short_code").distinct().collect()}
    assert out["search_docs"].count() == urls.count() - len(gone)


def test_small_helpers(spark, scratch):
    urls = fx.urls(spark, SF_SMALL)
    # NULL owner text becomes the empty string
    path = os.path.join(scratch, "urls")
    urls.write.parquet(path)
    assert tb.read_urls(spark, path).where("user_id IS NULL").count() == 0
    # Lookups by email / id, no password hash column
    users = fx.users(spark, SF_SMALL).withColumn("password_hash", F.lit("x"))
    found = tb.find_users(users, emails=["u1@example.com"])
    assert [r.id for r in found.collect()] == ["1"] and "password_hash" not in found.columns
    # point lookup honours expiry (strict)
    live = {r.short_code for r in ls.lookup(urls, ["c00", "c01", "c02"], AS_OF).collect()}
    expired = {r.short_code for r in tb.expired_split(urls.where(F.col("short_code").isin("c00", "c01", "c02")),
                                                      AS_OF)[1].collect()}
    assert live.isdisjoint(expired) and live | expired == {"c00", "c01", "c02"}
    # Requested expiry, else created + 72 h
    derived = en.derive_expiry(urls, 72).where(F.col("expires_at").isNull()).count()
    assert derived == 0
    # Deterministic click ids for tracked clicks
    raw = fx.raw_clicks(spark, SF_SMALL).limit(20)
    a = [r.click_id for r in rs.track_clicks(raw).orderBy("click_id").collect()]
    b = [r.event_id for r in en.enrich_clicks(raw, arrival=AS_OF).orderBy("event_id").collect()]
    assert a == b
