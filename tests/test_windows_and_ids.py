"""Operators with recursive or windowed semantics against brute-force Python loops."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from clickspark.functions import base62
from clickspark.operators import ids, limits


def _generator_loop(requests):
    """The live generator: same ms -> next sequence; sequence wraps -> next ms; new ms -> 0."""
    out, last_ms, seq = {}, -1, 0
    for rid, ms in sorted(requests, key=lambda r: (r[1], r[0])):
        t = max(ms, last_ms)
        if t == last_ms:
            seq = (seq + 1) & 4095
            if seq == 0:
                t = last_ms + 1
        else:
            seq = 0
        last_ms = t
        out[rid] = (t, seq)
    return out


def test_short_code_assignment_matches_generator_with_carry(spark):
    base = dt.datetime(2024, 3, 1, 12, 0, 0)
    rows, rid = [], 0
    for ms_off, n in [(0, 5000), (1, 3000), (5, 10), (6, 4096), (7, 1)]:  # bursts that overflow 4096/ms
        for _ in range(n):
            rows.append((rid, base + dt.timedelta(milliseconds=ms_off)))
            rid += 1
    df = spark.createDataFrame(rows, "request_id long, requested_at timestamp").withColumn("gen", F.lit(37))
    got = ids.assign_short_codes(df, generator_col="gen").collect()
    epoch_ms = int((base - dt.datetime(2024, 1, 1)).total_seconds() * 1000)
    expected = _generator_loop([(r[0], epoch_ms + int((r[1] - base).total_seconds() * 1000)) for r in rows])
    for r in got:
        t, seq = expected[r.request_id]
        assert r.id == (t << 22) | (1 << 17) | (5 << 12) | seq
        assert r.datacenter == 1 and r.worker == 5
    assert len({r.short_code for r in got}) == len(rows)  # unique codes


def test_decode_recovers_assignment(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 5, 1) + dt.timedelta(seconds=i)) for i in range(50)],
                               "request_id long, requested_at timestamp")
    assigned = ids.assign_short_codes(df)
    decoded = ids.decode_short_codes(assigned.select("request_id", "short_code", F.col("datacenter").alias("dc"),
                                                     F.col("worker").alias("wk")))
    bad = decoded.where((F.col("datacenter") != F.col("dc")) | (F.col("worker") != F.col("wk"))
                        | F.col("error").isNotNull()).count()
    assert bad == 0
    assert decoded.where(F.col("created_at") != F.lit("2024-05-01").cast("timestamp")
                         + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("request_id"))).count() == 0


def _requests(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        ip = "hot" if rnd.random() < 0.4 else f"ip{rnd.randint(0, 20)}"  # one IP holds 40 % of requests
        rows.append((i, ip, base + dt.timedelta(seconds=rnd.randint(0, 3600 * 6))))
    return rows, spark.createDataFrame(rows, "event_id long, ip string, requested_at timestamp")


@pytest.mark.parametrize("k", [3, 40, 500, 50_000])
def test_sliding_window_matches_brute_force_with_hot_ip(spark, k):
    rows, df = _requests(spark)
    limit, window = 5, 600.0
    got = {r.event_id: r for r in limits.sliding_window_verdicts(df, limit, window, bucket_rows=k).collect()}
    by_ip = {}
    for eid, ip, t in rows:
        by_ip.setdefault(ip, []).append((t, eid))
    for ip, items in by_ip.items():
        for t, eid in items:
            earlier = [u for u, _ in items if t - dt.timedelta(seconds=window) < u < t]
            r = got[eid]
            assert r.prior_count == len(earlier)
            assert r.allowed == (len(earlier) < limit)
            if not r.allowed:
                assert r.reset_at == min(earlier) + dt.timedelta(seconds=window)


def test_token_bucket_matches_brute_force(spark):
    rows, df = _requests(spark, n=1500, seed=3)
    cap, rate = 4.0, 4.0 / 900
    got = {r.event_id: r.allowed for r in limits.token_bucket_verdicts(df, cap, rate).collect()}
    by_ip = {}
    for eid, ip, t in sorted(rows, key=lambda r: (r[2], r[0])):
        by_ip.setdefault(ip, []).append((t, eid))
    for items in by_ip.values():
        tokens, last = cap, None
        for t, eid in items:
            if last is not None:
                tokens = min(cap, tokens + (t - last).total_seconds() * rate)
            last = t
            ok = tokens >= 1.0
            tokens -= 1.0 if ok else 0.0
            assert got[eid] == ok


def test_fixed_window_allows_boundary_bursts(spark):
    base = dt.datetime(2024, 1, 1, 10, 0, 59, 950000)
    rows = [(i, "a", base + dt.timedelta(milliseconds=10 * i)) for i in range(10)]  # straddles 10:01:00
    df = spark.createDataFrame(rows, "event_id long, ip string, requested_at timestamp")
    fixed = limits.fixed_window_verdicts(df, 5, 60)
    sliding = limits.sliding_window_verdicts(df, 5, 60)
    assert fixed.where("allowed").count() == 10
    assert sliding.where("allowed").count() == 5
    assert limits.boundary_bursts(fixed, sliding).count() == 5


def test_base62_encode_is_codegen_only(spark):
    plan = spark.range(3).select(base62.encode("id"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_burst_starts_match_a_per_key_scan(spark):
    rows, df = _requests(spark, n=2000, seed=11)
    gap = 120 * 1_000_000
    got = {r.event_id: r._burst for r in limits._burst_starts(df, "ip", "requested_at", "event_id", gap).collect()}
    by_ip = {}
    for eid, ip, t in sorted(rows, key=lambda r: (r[2], r[0])):
        by_ip.setdefault(ip, []).append((t, eid))
    epoch = dt.datetime(1970, 1, 1)
    for items in by_ip.values():
        start, prev = None, None
        for t, eid in items:
            us = int((t - epoch).total_seconds() * 1_000_000)
            if prev is None or us - prev >= gap:
                start = us
            prev = us
            assert got[eid] == start


def test_fixed_window_positions_with_hot_ip(spark):
    rows, df = _requests(spark, n=2500, seed=5)
    got = {r.event_id: r.position for r in limits.fixed_window_verdicts(df, 5, 1800).collect()}
    groups = {}
    for eid, ip, t in rows:
        win = int((t - dt.datetime(1970, 1, 1)).total_seconds()) // 1800
        groups.setdefault((ip, win), []).append((t, eid))
    for items in groups.values():
        for pos, (_, eid) in enumerate(sorted(items), start=1):
            assert got[eid] == pos


def test_sliding_window_is_linear_in_a_dense_client(spark):
    import time

    def seconds(n):
        df = spark.range(n).selectExpr("id event_id", "'one' ip", "timestamp_millis(1704067200000 + id * 125) requested_at")
        start = time.perf_counter()
        limits.sliding_window_verdicts(df, 3, 86400).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(160_000) < 4 * seconds(40_000) + 3


@pytest.mark.parametrize("rows", [2, 30, 50_000])
def test_fixed_window_rank_in_blocks(spark, rows):
    items, df = _requests(spark, n=1200, seed=5)
    got = {r.event_id: r.position for r in limits.fixed_window_verdicts(df, 5, 3600, bucket_rows=rows).collect()}
    seen = {}
    for eid, ip, t in sorted(items, key=lambda r: (r[2], r[0])):
        window = (ip, int(t.replace(tzinfo=dt.timezone.utc).timestamp()) // 3600)
        seen[window] = seen.get(window, 0) + 1
        assert got[eid] == seen[window]


@pytest.mark.parametrize("rows", [3, 700, 50_000])
def test_codes_of_two_runs_never_clash(spark, rows):
    base = dt.datetime(2024, 3, 1, 12, 0, 0)
    times = [base + dt.timedelta(milliseconds=m) for m in [0] * 4500 + [1] * 300 + [5] * 10]
    df = spark.createDataFrame(list(enumerate(times)), "request_id long, requested_at timestamp").withColumn("gen", F.lit(37))
    first = ids.assign_short_codes(df, generator_col="gen", block_rows=rows)
    last = ids.last_slots_of(first)
    second = ids.assign_short_codes(df, generator_col="gen", last_slots=last, block_rows=rows)
    one, two = ({r.id for r in x.select("id").collect()} for x in (first, second))
    assert len(one) == len(two) == len(times) and not one & two and min(two) > max(one)
    epoch_ms = int((base - dt.datetime(2024, 1, 1)).total_seconds() * 1000)
    expected = _generator_loop([(i, epoch_ms + int((t - base).total_seconds() * 1000)) for i, t in enumerate(times)])
    assert one == {(t << 22) | (1 << 17) | (5 << 12) | seq for t, seq in expected.values()}


def test_quantiles_match_numpy(spark):
    import numpy as np

    from clickspark.operators.common import quantiles

    rnd = random.Random(11)
    data = {"a": [rnd.expovariate(0.01) for _ in range(999)], "b": [float(rnd.randint(-5, 5)) for _ in range(400)], "c": [7.25], "d": [-1e9, 1e9, 0.0]}
    df = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs] + [("e", None)], "k string, x double")
    for r in quantiles(df, ["k"], "x", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect():
        assert np.allclose([r.p50, r.p95, r.p99], np.quantile(data[r.k], [0.5, 0.95, 0.99]))


def _one_client(n, seed, step_us):
    """A client that never pauses for long, one that does, one without an address, and requests without a time."""
    pick, at, rows = random.Random(seed), dt.datetime(2024, 1, 1), []
    for i in range(n):
        at += dt.timedelta(microseconds=pick.choice(step_us))
        rows.append((i, "hot", at))
    for i in range(40):
        rows.append((n + i, pick.choice(["cold", None]), at + dt.timedelta(minutes=pick.randrange(300))))
    return rows + [(n + 90, "hot", None), (n + 91, None, None)]


def _bucket_loop(rows, capacity, rate):
    found, state = {}, {}
    for eid, ip, t in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        tokens, last = state.get(ip, (capacity, t))
        tokens = min(capacity, tokens + (t - last).total_seconds() * rate)
        found[eid] = tokens, tokens >= 1.0
        state[ip] = tokens - (tokens >= 1.0), t
    return found | {eid: (None, None) for eid, _, t in rows if t is None}


@pytest.mark.parametrize("capacity,rate,steps", [
    (4.0, 0.25, [0, 1_000_000, 3_000_000, 4_000_000]),  # exact in doubles: tokens of exactly 1 are met
    (2.5, 0.5, [0, 500_000, 1_500_000, 4_500_000]), (7.0, 1 / 3, [1, 999_983, 2_718_281, 19_999_999])])
def test_a_client_without_a_pause_is_cut_into_blocks(spark, capacity, rate, steps):
    rows = _one_client(4000, 8, steps)
    df = spark.createDataFrame(rows, "event_id long, ip string, requested_at timestamp").repartition(5)
    got = {r.event_id: (r.tokens_before, r.allowed) for r in limits.token_bucket_verdicts(df, capacity, rate, block_rows=150).collect()}
    want = _bucket_loop(rows, capacity, rate)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(v[0] is None and want[k][0] is None or abs(v[0] - want[k][0]) < 1e-6 for k, v in got.items())


def test_token_transfer_is_the_recursion_for_every_start():
    pick = random.Random(2)
    for one, full in ((5, 20), (7, 24), (3, 3)):
        transfer, states = limits.TokenTransfer(one, full), list(range(full + 1))
        for _ in range(300):
            refill = pick.choice([0, 0, 1, 2, pick.randrange(full + 2)])
            transfer.request(refill)
            states = [t - one if (t := min(full, s + refill)) >= one else t for s in states]
            assert [transfer(x) for x in range(full + 1)] == states
            assert len(transfer.pieces) <= 2 * (full // one) + 4


def test_requests_without_key_or_time_are_kept(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "a", at), (2, None, at + dt.timedelta(seconds=1)), (3, None, at + dt.timedelta(seconds=2)), (4, "a", None), (5, None, None)]
    df = spark.createDataFrame(rows, "event_id long, ip string, requested_at timestamp")
    slid = {r.event_id: (r.prior_count, r.allowed, r.remaining) for r in limits.sliding_window_verdicts(df, 1, 60, bucket_rows=1).collect()}
    assert slid == {1: (0, True, 0), 2: (0, True, 0), 3: (1, False, 0), 4: (None, None, None), 5: (None, None, None)}
    assert {r.event_id: r.http_status for r in limits.rate_headers(limits.sliding_window_verdicts(df, 1, 60), 1).collect()} == {1: 200, 2: 200, 3: 429, 4: None, 5: None}
    fixed = {r.event_id: (r.position, r.allowed) for r in limits.fixed_window_verdicts(df, 1, 60, bucket_rows=1).collect()}
    assert fixed == {1: (1, True), 2: (1, True), 3: (2, False), 4: (None, None), 5: (None, None)}
    from clickspark.operators import listing
    pages = {r.event_id: (r.page_no, r.page_count) for r in listing.viewer_pages(df, [("requested_at", "desc"), "event_id"], "ip", 1, block_rows=1).collect()}
    assert pages == {1: (0, 2), 4: (1, 2), 3: (0, 3), 2: (1, 3), 5: (2, 3)}
    first = {r.event_id: r.page_no for r in listing.viewer_pages(df, ["requested_at", "event_id"], "ip", 1, block_rows=1).collect()}
    assert first == {4: 0, 1: 1, 5: 0, 2: 1, 3: 2}
    coded = ids.assign_short_codes(spark.createDataFrame([(1, at), (None, at), (2, None)], "request_id long, requested_at timestamp")).collect()
    assert {(r.request_id, r.requested_at is None): r.short_code is None for r in coded} == {(1, False): False, (None, False): True, (2, True): True}
