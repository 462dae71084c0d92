"""Bulk short-code assignment (J7), decoding / audit (J8), shard balance (J11), sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickspark.functions import base62

GENERATORS = 1 << (base62.DATACENTER_BITS + base62.WORKER_BITS)  # 1024 (datacenter, worker) pairs
PER_MS = 1 << base62.SEQUENCE_BITS  # 4096 ids per generator per millisecond


def assign_short_codes(requests: DataFrame, time_col: str = "requested_at", key_col: str = "request_id",
                       generator_col: str | None = None, last_slots: DataFrame | None = None,
                       block_rows: int = 50_000) -> DataFrame:
    """Id + base62 code for every request, as the live generators would issue them.

    Each request goes to one of the 1024 (datacenter, worker) generators (``generator_col`` or
    ``key mod 1024``). Inside a generator, requests are ordered by (ms, key) and the i-th
    (0-based) gets slot ``i + max_{j<=i}(4096 * ms_j - j)``: the running max replays the
    generator's "same ms -> next sequence, sequence wrapped -> wait for the next ms" rule
    without recursion. ``last_slots`` (``generator, slot``, see ``last_slots_of``) are the slots
    issued by earlier runs: a generator goes on after its own, so no id is issued twice.

    A generator's requests are cut into blocks of time, as many as its request count asks for;
    position and running max are found inside a block and carried over by one row per block. Requests
    without a time or a generator get no code: they are kept, with NULL in the columns added here."""
    ms = F.unix_millis(F.col(time_col)) - F.lit(base62.EPOCH_MS)
    gen = (F.col(generator_col) if generator_col else F.pmod(F.col(key_col), F.lit(GENERATORS))).cast("int")
    every = requests.withColumn("_ms", ms).withColumn("_gen", gen)
    df = every.where(F.col("_ms").isNotNull() & F.col("_gen").isNotNull())
    span = df.groupBy("_gen").agg(F.count(F.lit(1)).alias("_rows"), F.min("_ms").alias("_from"), F.max("_ms").alias("_to"))
    width = F.ceil((F.col("_to") - F.col("_from") + 1) / F.ceil(F.col("_rows") / block_rows))
    df = df.join(span.select("_gen", "_from", width.alias("_width")), "_gen") \
        .withColumn("_block", F.floor((F.col("_ms") - F.col("_from")) / F.col("_width")).cast("bigint")).drop("_from", "_width")
    inside = Window.partitionBy("_gen", "_block").orderBy("_ms", key_col)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_i", F.row_number().over(inside) - 1) \
        .withColumn("_lead", F.max(F.lit(PER_MS) * F.col("_ms") - F.col("_i")).over(upto))
    blocks = df.groupBy("_gen", "_block").agg(F.count(F.lit(1)).alias("_n"), F.max(F.lit(PER_MS) * F.col("_ms") - F.col("_i")).alias("_top"))
    before = Window.partitionBy("_gen").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    blocks = blocks.withColumn("_peak", F.max(F.col("_top") - F.col("_ahead")).over(before))
    if last_slots is not None:
        blocks = blocks.join(last_slots.select(F.col("generator").alias("_gen"), (F.col("slot") + 1).alias("_after")), "_gen", "left")
    after = F.col("_after") if last_slots is not None else F.lit(None).cast("bigint")
    carried = blocks.select("_gen", "_block", "_ahead", F.greatest("_peak", after).alias("_carry"))
    df = df.join(carried, ["_gen", "_block"])
    # lead and carry are relative to the position in the whole generator
    df = df.withColumn("_slot", F.col("_ahead") + F.col("_i") + F.greatest(F.col("_lead") - F.col("_ahead"), F.col("_carry")))
    issued_ms = F.floor(F.col("_slot") / PER_MS).cast("bigint")
    seq = F.pmod(F.col("_slot"), F.lit(PER_MS))
    datacenter = F.shiftright(F.col("_gen"), base62.WORKER_BITS)
    worker = F.col("_gen").bitwiseAND(F.lit((1 << base62.WORKER_BITS) - 1))
    df = df.withColumn("id", base62.compose_id(issued_ms, datacenter, worker, seq))
    coded = (df.withColumn("short_code", base62.encode("id"))
             .withColumn("datacenter", datacenter).withColumn("worker", worker)
             .withColumn("sequence", seq.cast("int"))
             .drop("_ms", "_gen", "_i", "_lead", "_block", "_ahead", "_carry", "_slot"))
    return coded.unionByName(every.where(F.col("_ms").isNull() | F.col("_gen").isNull()).drop("_ms", "_gen"), allowMissingColumns=True)


def last_slots_of(assigned: DataFrame) -> DataFrame:
    """(generator, slot): the last slot of every generator in ``assigned``, to be kept for the next run."""
    slot = F.shiftright("id", base62.DATACENTER_BITS + base62.WORKER_BITS + base62.SEQUENCE_BITS) * PER_MS + F.col("sequence")
    generator = (F.shiftleft(F.col("datacenter"), base62.WORKER_BITS) + F.col("worker")).cast("int")
    return assigned.groupBy(generator.alias("generator")).agg(F.max(slot).alias("slot"))


def decode_short_codes(codes: DataFrame, code_col: str = "short_code") -> DataFrame:
    """Decode codes into id, creation time, datacenter, worker and sequence, or a reason."""
    value = base62.decode_value(code_col)
    fields = base62.id_fields(value)
    return codes.select(
        "*",
        value.alias("id"),
        F.timestamp_millis(fields["created_ms"]).alias("created_at"),
        fields["datacenter"].cast("int").alias("datacenter"),
        fields["worker"].cast("int").alias("worker"),
        fields["sequence"].cast("int").alias("sequence"),
        base62.decode_error(code_col).alias("error"),
    )


def shard_balance(urls: DataFrame, shards: int = 4, code_col: str = "short_code") -> DataFrame:
    """``crc32(code) mod shards`` per key and rows per shard with the share of the largest."""
    assigned = urls.select(F.pmod(F.crc32(F.col(code_col)), F.lit(shards)).cast("int").alias("shard"))
    per = assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    return per


def sample_clicks(clicks: DataFrame, rate: float = 0.10, id_col: str = "event_id") -> DataFrame:
    """J12 sampling operator: deterministic ~``rate`` sample keyed on the event id (the first 4
    hex digits of its MD5 below ``rate * 65536``), so reruns and replays pick the same rows."""
    threshold = format(int(rate * 65536), "04x")
    return clicks.where(F.substring(F.md5(F.col(id_col).cast("string")), 1, 4) < F.lit(threshold))


def sample_estimate(clicks: DataFrame, rate: float = 0.10) -> DataFrame:
    """Per-code totals estimated from the sample, scaled by the exact sampling fraction."""
    kept = int(rate * 65536)
    scale = 65536.0 / kept
    sample = sample_clicks(clicks, rate)
    return sample.groupBy("short_code").agg(
        F.count(F.lit(1)).alias("sampled_clicks"),
        F.round(F.count(F.lit(1)) * F.lit(scale), 6).alias("estimated_clicks"))
