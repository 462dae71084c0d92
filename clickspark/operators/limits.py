"""Request-rate verdicts: sliding window (W1/W2), fixed window (W5), token bucket.

Hot keys: one client IP may send a third of all requests, so no operator sorts a key's whole
history in one task. A key's time is cut into buckets whose number follows the key's own
request count; running sums stay inside a bucket and one summary row per bucket carries them
over. The token bucket is a recursion per key; blocks of it are summed up as functions of the tokens
they start with, so that they need not wait for each other.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickspark.operators.common import join_keys

#: Requests per bucket that a hot key is cut into.
BUCKET_ROWS = 50_000


def _micros(col: str):
    return F.unix_micros(F.col(col))


def sliding_window_verdicts(requests: DataFrame, limit: int, window_seconds: float, key: str = "ip",
                            time_col: str = "requested_at", id_col: str = "event_id",
                            bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per request, the number of earlier requests of the same key inside the window
    (times ``t - window < t' < t``; denied requests count too, trap T19), the verdict
    ``allowed = prior < limit``, ``remaining = max(limit - prior - 1, 0)`` (0 when denied) and
    the reset time (oldest request in the window + window when denied, else t + window).

    Each request is a +1 at its time and a -1 one window later, so the prior count is a
    running sum, and the reset time of a denied request is the next expiry after it. The sum's
    frame only grows and the next expiry only moves on, hence linear in a key's requests however dense they are. A key is
    cut into time buckets of about ``bucket_rows`` requests; two rows per bucket carry the sum
    of the buckets before and the first expiry of the buckets after it.

    Requests without a key are those of one unknown client. Requests without a time are in no window: they
    are kept, with verdict columns of NULL, and count for no other."""
    w_us = int(round(window_seconds * 1_000_000))
    timed = requests.where(F.col(time_col).isNotNull()).withColumn("_t", _micros(time_col))
    span = timed.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_from"), F.max("_t").alias("_to"))
    span = span.select(key, "_from", F.greatest(F.lit(1), F.ceil(
        (F.col("_to") - F.col("_from") + 1) / F.ceil(F.col("_n") / bucket_rows))).cast("bigint").alias("_width"))
    # order inside a bucket: at one time expiries (even) come before requests (odd)
    # (a request becomes both rows in one pass: a union would scan and place the requests once per side)
    came = F.col("_came")
    both = join_keys(timed, span, [key]).withColumn("_came", F.explode(F.array(F.lit(True), F.lit(False)))) \
        .withColumn("_at", F.when(came, F.col("_t")).otherwise(F.col("_t") + w_us))
    moves = both.select(
        *[F.col(c) if c == key else F.when(came, F.col(c)).alias(c) for c in requests.columns], F.when(came, F.col("_t")).alias("_t"),
        (F.col("_at") * 2 + F.when(came, 1).otherwise(0)).alias("_o"), F.when(came, 1).otherwise(-1).cast("bigint").alias("_d"),
        F.when(~came, F.col("_at")).alias("_expiry"), F.floor((F.col("_at") - F.col("_from")) / F.col("_width")).cast("bigint").alias("_b"))
    buckets = moves.groupBy(key, "_b").agg(F.sum("_d").alias("_sum"), F.min("_expiry").alias("_first"))
    by_bucket = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(by_bucket), F.lit(0))) \
        .withColumn("_next", F.min("_first").over(back))
    none = F.lit(None).cast("bigint")
    low = F.struct(F.lit(-(1 << 62)).cast("bigint").alias("_o"), F.col("_before").alias("_d"), none.alias("_expiry"))
    high = F.struct(F.lit(1 << 62).cast("bigint").alias("_o"), none.alias("_d"), F.col("_next").alias("_expiry"))
    every = moves.unionByName(buckets.select(key, "_b", F.inline(F.array(low, high))), allowMissingColumns=True)
    ahead = Window.partitionBy(key, "_b").orderBy("_o").rangeBetween(Window.unboundedPreceding, -1)
    # expiries are in order, so the next one after a request is the smallest; both columns need one sort
    frees = F.expr(f"lead(_expiry) IGNORE NULLS OVER (PARTITION BY `{key}`, _b ORDER BY _o)")
    scored = every.select("*", F.coalesce(F.sum("_d").over(ahead), F.lit(0)).alias("prior_count"), frees.alias("_frees")).where(F.col("_t").isNotNull())
    allowed = F.col("prior_count") < limit
    judged = (scored
            .withColumn("allowed", allowed)
            .withColumn("remaining", F.when(allowed, F.greatest(F.lit(limit) - F.col("prior_count") - 1, F.lit(0)))
                        .otherwise(F.lit(0)).cast("int"))
            .withColumn("reset_at", F.timestamp_micros(F.when(allowed, F.col("_t") + w_us).otherwise(F.col("_frees"))))
            .drop("_t", "_o", "_d", "_expiry", "_b", "_frees"))
    return judged.unionByName(requests.where(F.col(time_col).isNull()), allowMissingColumns=True)


def rate_headers(verdicts: DataFrame, limit: int, time_col: str = "requested_at") -> DataFrame:
    """Reply headers: limit, remaining, reset epoch seconds, retry-after (denied only, whole
    seconds from the request to the reset time)."""
    retry = F.floor((F.unix_micros("reset_at") - F.unix_micros(time_col)) / 1_000_000).cast("bigint")
    return verdicts.select(
        "*",
        F.lit(limit).alias("x_ratelimit_limit"),
        F.col("remaining").alias("x_ratelimit_remaining"),
        F.floor(F.unix_micros("reset_at") / 1_000_000).cast("bigint").alias("x_ratelimit_reset"),
        F.when(~F.col("allowed"), retry).alias("retry_after"),
        F.when(F.col("allowed"), F.lit(200)).when(~F.col("allowed"), F.lit(429)).alias("http_status"),
    )


def fixed_window_verdicts(requests: DataFrame, limit: int, window_seconds: float, key: str = "ip",
                          time_col: str = "requested_at", id_col: str = "event_id",
                          bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The first ``limit`` requests of each (key, aligned window) pass; ``position`` is the
    request's 1-based rank in its window.

    The rank is computed in two levels: a window is cut into sub-buckets of equal length, as
    many as its own request count asks for; a prefix sum over the sub-bucket counts gives each
    one's offset, and ``row_number`` runs only inside a sub-bucket. Requests without a key are those of one
    unknown client; those without a time are in no window and keep NULL in the columns added here."""
    w_us = int(round(window_seconds * 1_000_000))
    t = _micros(time_col)
    timed = requests.where(F.col(time_col).isNotNull()).withColumn("_win", F.floor(t / w_us).cast("bigint"))
    sizes = timed.groupBy(key, "_win").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("_subs"))
    out = join_keys(timed, sizes, [key, "_win"]).withColumn(
        "_sub", F.floor((t - F.col("_win") * w_us) / F.ceil(F.lit(w_us) / F.col("_subs"))).cast("bigint")).drop("_subs")
    counts = out.groupBy(key, "_win", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key, "_win").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(key, "_win", "_sub").orderBy(time_col, id_col)
    out = (join_keys(out, offsets, [key, "_win", "_sub"])
           .withColumn("position", (F.col("_offset") + F.row_number().over(inner)).cast("int"))
           .withColumn("window_start", F.timestamp_micros(F.col("_win") * w_us))
           .drop("_win", "_sub", "_offset"))
    return out.withColumn("allowed", F.col("position") <= limit).unionByName(
        requests.where(F.col(time_col).isNull()), allowMissingColumns=True)


def boundary_bursts(fixed: DataFrame, sliding: DataFrame, id_col: str = "event_id") -> DataFrame:
    """W5 vs W1: requests the fixed window lets through although the sliding window denies
    them (bursts around window boundaries)."""
    f = fixed.select(id_col, F.col("allowed").alias("fixed_allowed"))
    s = sliding.select(id_col, "ip", F.col("allowed").alias("sliding_allowed"))
    return f.join(s, id_col).where(F.col("fixed_allowed") & ~F.col("sliding_allowed"))


TOKEN_OUT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ip", T.StringType()),
    T.StructField("requested_at", T.TimestampType()), T.StructField("tokens_before", T.DoubleType()),
    T.StructField("allowed", T.BooleanType()),
])


def _burst_cells(timed: DataFrame, key: str, gap_us: int) -> DataFrame:
    """(key, ``_cell``, ``_burst``, and of the burst ``_n``, ``_to``) for requests with ``_t`` and ``_cell``, its
    ``gap_us`` wide cell of time. A burst ends where the next request of its key is ``gap_us`` or more away.

    Two requests of a cell are nearer than that, so a burst can only start with the first request of a
    cell, and a cell two before is too far away to matter: what decides are first and last times per cell,
    an aggregate. One row per key and cell is carried through a running maximum."""
    cells = timed.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    before = cells.select(key, (F.col("_cell") + 1).alias("_cell"), F.col("_last").alias("_before"))
    starts = F.col("_before").isNull() | (F.col("_first") - F.col("_before") >= gap_us)
    upto = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = join_keys(cells, before, [key, "_cell"], "left").withColumn("_burst", F.max(F.when(starts, F.col("_first"))).over(upto))
    bursts = cells.groupBy(key, "_burst").agg(F.sum("_n").alias("_n"), F.max("_last").alias("_to"))
    return join_keys(cells.select(key, "_cell", "_burst"), bursts, [key, "_burst"])


def _burst_starts(requests: DataFrame, key: str, time_col: str, id_col: str, gap_us: int) -> DataFrame:
    """Tag every request with the start time of its burst (see ``_burst_cells``)."""
    timed = requests.withColumn("_t", _micros(time_col)).withColumn("_cell", F.floor(F.col("_t") / gap_us).cast("bigint"))
    cells = _burst_cells(timed, key, gap_us).select(key, "_cell", "_burst")
    return join_keys(timed, cells, [key, "_cell"]).drop("_t", "_cell")


class TokenTransfer:
    """Tokens after a block of requests as a function of the tokens at its first request.

    All in whole units (``one`` to a token, ``full`` in the bucket). On each of a few ranges of the input the
    result is the input plus a constant, or a constant once the bucket overflowed. The ranges differ in how
    many requests they let pass, so there are about twice as many as tokens in a full bucket, however long the
    block is. ``pieces`` are (start, result at the start, 1 or 0: does the result grow with the input)."""

    def __init__(self, one: int, full: int):
        self.one, self.full = one, full
        self.pieces: list[tuple[int, int, int]] = [(0, 0, 1)]

    def request(self, refill: int) -> None:
        """``refill`` units come in, then one request takes a token if there is one."""
        one, full, out = self.one, self.full, []

        def put(start: int, value: int, slope: int) -> None:
            if value >= one:
                value -= one
            if out:
                s, v, k = out[-1]
                if k == slope and v + slope * (start - s) == value:
                    return
            out.append((start, value, slope))

        ends = [p[0] for p in self.pieces[1:]] + [full + 1]
        for (start, value, slope), end in zip(self.pieces, ends, strict=True):
            value += refill
            if value >= full:
                put(start, full, 0)
                continue
            if not slope:
                put(start, value, 0)
                continue
            overflows = start + full - value  # the input that fills the bucket
            passes = start + one - value  # the input that has a whole token
            put(start, value, 1)
            if start < passes < min(end, overflows):
                put(passes, one, 1)
            if overflows < end:
                put(overflows, full, 0)
        self.pieces = out

    def __call__(self, tokens: int) -> int:
        start, value, slope = self.pieces[bisect.bisect_right(self.pieces, tokens, key=lambda p: p[0]) - 1]
        return value + slope * (tokens - start)


def token_bucket_verdicts(requests: DataFrame, capacity: float, refill_per_second: float, key: str = "ip",
                          time_col: str = "requested_at", id_col: str = "event_id",
                          block_rows: int = BUCKET_ROWS) -> DataFrame:
    """Token bucket per key (refill ``refill_per_second`` up to ``capacity``, 1 token per
    request): event_id, ip, requested_at, tokens_before, allowed.

    A key's history is cut into independent bursts wherever the gap to the previous request is long
    enough to refill the bucket from empty, and a burst into blocks of about ``block_rows`` requests. A block's
    effect is a :class:`TokenTransfer`, found for all blocks at once; one row per block is then passed through in
    order, and each block is walked through from the tokens it starts with, again all at once. Memory is one
    Arrow batch and a handful of numbers.

    Inside a block tokens are doubles; from block to block they are whole units of a fraction of a token (the rate
    is read as a fraction with a denominator of at most a million), so no rounding adds up over blocks. Requests
    without a key are those of one unknown client; those without a time keep NULL in both new columns and take
    no token."""
    rate = Fraction(refill_per_second).limit_denominator(1_000_000)
    per_us, one = rate.numerator, rate.denominator * 1_000_000
    full = round(Fraction(capacity) * one)
    gap_us = int(capacity / refill_per_second * 1_000_000) + 1
    slim = requests.select(F.col(id_col).cast("bigint").alias("event_id"), F.col(key).alias("ip"), F.col(time_col).alias("requested_at"))
    timed = slim.where(F.col("requested_at").isNotNull()).withColumn("_t", _micros("requested_at")) \
        .withColumn("_cell", F.floor(F.col("_t") / gap_us).cast("bigint"))
    width = F.ceil((F.col("_to") - F.col("_burst") + 1) / F.ceil(F.col("_n") / block_rows))
    placed = join_keys(timed, _burst_cells(timed, "ip", gap_us), ["ip", "_cell"]) \
        .withColumn("_block", F.floor((F.col("_t") - F.col("_burst")) / width).cast("bigint")).withColumn("_cut", F.col("_n") > block_rows)
    place = ["ip", "_burst", "_block"]
    blocks = placed.repartition(*place).sortWithinPartitions(*place, "_t", "event_id")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, transfer, first, last = None, None, 0, 0

        def done() -> pd.DataFrame:
            return pd.DataFrame([(*at, first, last, [list(p) for p in transfer.pieces])], columns=[*place, "first", "last", "pieces"])

        for pdf in batches:
            for ip, burst, block, us in zip(pdf["ip"], pdf["_burst"], pdf["_block"], pdf["_t"], strict=True):
                if (ip, burst, block) != at:
                    if at is not None:
                        yield done()
                    at, transfer, first, last = (ip, burst, block), TokenTransfer(one, full), us, us
                transfer.request((us - last) * per_us)
                last = us
        if at is not None:
            yield done()

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tokens, last = None, full, 0
        for pdf in batches:
            starts = []
            for ip, burst, first, end, pieces in zip(pdf["ip"], pdf["_burst"], pdf["first"], pdf["last"], pdf["pieces"], strict=True):
                tokens = min(full, tokens + (first - last) * per_us) if (ip, burst) == at else full
                at = ip, burst
                starts.append(tokens)
                transfer = TokenTransfer(one, full)
                transfer.pieces = [tuple(map(int, p)) for p in pieces]
                tokens, last = transfer(tokens), end
            yield pdf[place].assign(_tokens=starts)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tokens, last = None, capacity, 0
        for pdf in batches:
            before, ok = [], []
            for ip, burst, block, us, start in zip(pdf["ip"], pdf["_burst"], pdf["_block"], pdf["_t"], pdf["_tokens"], strict=True):
                if (ip, burst, block) != at:
                    at, tokens = (ip, burst, block), start / one
                else:
                    tokens = min(capacity, tokens + (us - last) / 1e6 * refill_per_second)
                last = us
                before.append(tokens)
                ok.append(tokens >= 1.0)
                tokens -= 1.0 if tokens >= 1.0 else 0.0
            yield pdf[["event_id", "ip", "requested_at"]].assign(tokens_before=before, allowed=ok)

    effects = blocks.where("_cut").select(*place, "_t").mapInPandas(
        measure, "ip string, _burst bigint, _block bigint, first bigint, last bigint, pieces array<array<bigint>>")
    carried = effects.repartition("ip", "_burst").sortWithinPartitions(*place).mapInPandas(
        carry, "ip string, _burst bigint, _block bigint, _tokens bigint")
    started = join_keys(placed, carried, place, "left").withColumn("_tokens", F.coalesce("_tokens", F.lit(full)))
    walked = started.repartition(*place).sortWithinPartitions(*place, "_t", "event_id") \
        .select("event_id", "requested_at", "_t", "_tokens", *place).mapInPandas(walk, TOKEN_OUT)
    return walked.unionByName(slim.where(F.col("requested_at").isNull()), allowMissingColumns=True)
