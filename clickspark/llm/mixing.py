"""Mixing sources to target weights by entropy balancing.

The rates r that stay closest to 1 in relative entropy while each source's words reach its target
(sum of r * size over the source) and no rate exceeds the cap are r = min(cap, exp(l * size / scale)),
one multiplier l per source. The multipliers solve the convex dual; Newton steps are taken for all
sources at once over the table of distinct (source, size) pairs. The rates are then rounded into
whole copies so that every source stays at its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspark.llm.ranks import with_position
from clickspark.llm.rowkeys import take_rows
from clickspark.llm.storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
_STEPS = 4  # Newton steps between two writes of the multipliers


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (source_key, source_size) with a ``target`` for each source.

    In the order of their keys the sources weigh ``weights``, repeating, and split ``share`` of all
    sizes; a target stops at ``cap`` times its source's size and the excess goes to the others by
    weight. That ends at min(cap * size, level * weight) with one common level: sources are filled in
    the order of cap * size / weight, and the level is what the sources not filled share. The input
    has one row per source.
    """
    by_key, everything = Window.orderBy("source_key"), Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "source_key")
    place = (F.row_number().over(by_key) - 1) % len(weights)
    weighed = sizes.select("source_key", "source_size", F.element_at(F.array(*map(F.lit, map(float, weights))), (place + 1).cast("int")).alias("weight"))
    weighed = weighed.withColumn("limit", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("limit") / F.col("weight"))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    weighed = weighed.withColumn("level", level)
    common = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    return weighed.select("source_key", "source_size", F.least(F.col("limit"), F.coalesce(common * F.col("weight"), F.col("limit"))).alias("target"))


def balance(pairs: DataFrame, sources: DataFrame, cap: float = 2.0, iterations: int = 80, tolerance: float = 1e-9) -> DataFrame:
    """(source_key, scale, multiplier): the dual's solution for every source.

    ``pairs`` has source_key, size and n (documents of that size). A source whose target is ``cap``
    times its size, or that has no words, has multiplier null: all rates at the cap. Newton steps are
    kept within 4 of the last multiplier and inside the bracket known so far, else the bracket is
    halved; the residual is monotone, so this ends. One number reaches the driver per write.
    Sums of doubles depend on their order in the last bits, so multipliers are rounded to seven places:
    reruns agree, and what that moves is mended with the copies.
    """
    words = pairs.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"))
    none = F.lit(None).cast("double")
    state = materialise(sources.join(words, "source_key").filter(
        (F.col("words") > 0) & (F.col("target") < F.lit(float(cap)) * F.col("words") * (1 - 1e-12))).select(
        "source_key", "target", (F.col("words") / F.col("docs")).alias("scale"), F.lit(0.0).alias("multiplier"),
        none.alias("low"), none.alias("high"), F.lit(False).alias("done")), "multipliers")
    for _ in range(0, iterations, _STEPS):
        if state.filter(~F.col("done")).limit(1).count() == 0:
            break
        for _ in range(_STEPS):
            state = _newton_step(pairs, state, cap, tolerance)
        state = materialise(state, "multipliers")
    return state.select("source_key", "scale", F.round("multiplier", 7).alias("multiplier"))


def _newton_step(pairs: DataFrame, state: DataFrame, cap: float, tolerance: float) -> DataFrame:
    size = F.col("size") / F.col("scale")
    rate = tilted_rate(F.col("multiplier"), size, cap)
    mass = F.col("n") * F.col("size")
    kept = [F.first(c).alias(c) for c in state.columns if c != "source_key"]
    state = pairs.join(state, "source_key").groupBy("source_key").agg(
        F.sum(mass * rate).alias("reached"), F.sum(F.when(rate < cap, mass * size * rate)).alias("slope"), *kept)
    at, over = F.col("multiplier"), F.col("reached") > F.col("target")
    low, high = F.when(over, F.col("low")).otherwise(at), F.when(over, at).otherwise(F.col("high"))
    step = (F.col("target") - F.col("reached")) / F.nullif(F.col("slope"), F.lit(0.0))
    newton = at + F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.coalesce(step, F.when(over, -4.0).otherwise(4.0))))
    inside = (F.coalesce(newton > low, F.lit(True))) & (F.coalesce(newton < high, F.lit(True)))
    done = (F.abs(F.col("reached") - F.col("target")) <= F.col("target") * tolerance) | F.coalesce(high - low < 1e-13 * F.greatest(F.lit(1.0), F.abs(at)), F.lit(False))
    return state.select(
        "source_key", "target", "scale",
        F.when(F.col("done") | done, at).when(inside, newton).otherwise((low + high) / 2).alias("multiplier"),
        low.alias("low"), high.alias("high"), (F.col("done") | done).alias("done"))


def tilted_rate(multiplier: Column, size: Column, cap: float) -> Column:
    """min(cap, exp(multiplier * size)); the cap where there is no multiplier."""
    power = F.least(multiplier * size, F.lit(50.0))
    return F.coalesce(F.least(F.lit(float(cap)), F.exp(power)), F.lit(float(cap)))


def round_pairs(pairs: DataFrame, sources: DataFrame, multipliers: DataFrame, cap: int = 2, mends: int = 4) -> DataFrame:
    """``pairs`` with ``copies``: whole copies of all documents of a (source, size) together.

    In the order of size the running copies of a source stay within one half of the running rates, so
    its words miss the target by the largest size at most. What is missing is then mended ``mends``
    times by one copy more or less of the size closest to it.
    """
    running = Window.partitionBy("source_key").orderBy("size")  # distinct sizes of one source
    rated = pairs.join(multipliers, "source_key", "left")
    rated = rated.withColumn("rates", F.col("n") * tilted_rate(F.col("multiplier"), F.col("size") / F.col("scale"), cap))
    after = F.floor(F.sum("rates").over(running) + 0.5)
    copies = after - F.coalesce(F.floor(F.sum("rates").over(running.rowsBetween(Window.unboundedPreceding, -1)) + 0.5), F.lit(0))
    rounded = rated.select("source_key", "size", "n", "start", F.greatest(F.lit(0), F.least(copies, F.col("n") * cap)).alias("copies"))
    targets = sources.select("source_key", "target")
    for _ in range(mends):
        rounded = materialise(rounded, "copies")
        missing = rounded.groupBy("source_key").agg(F.sum(F.col("copies") * F.col("size")).alias("words")).join(targets, "source_key").select(
            "source_key", (F.col("target") - F.col("words")).alias("missing"))
        able = F.when(F.col("missing") > 0, F.col("copies") < F.col("n") * cap).otherwise(F.col("copies") > 0)
        off = F.abs(F.abs("missing") - F.col("size"))
        best = rounded.join(missing, "source_key").filter(able & (off < F.abs("missing"))).groupBy("source_key").agg(
            F.min_by(F.struct("size", F.signum("missing").alias("by")), F.struct(off, "size")).alias("best")).select(
            "source_key", "best.size", F.col("best.by").cast("long").alias("by"))
        rounded = rounded.join(best, ["source_key", "size"], "left").select(
            "source_key", "size", "n", "start", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies"))
    return rounded


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, text_hash, size, source_size, target, copies, taken) for every row of ``docs``.

    ``size`` counts the words of the whole text (null: none), ``taken`` is copies * size with 0 to
    ``cap`` copies. A null source is a source of its own, after all others. Which documents of one
    source and size get the extra copies is decided by a hash of the id, so reruns agree; repeated
    rows are rows of their own. A table without words takes none; an empty table gives no rows. Only
    the named columns are read.
    """
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t"))  # null sorts after every name
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), source.alias("source_key"),
                        word_count(text_col).alias("size"))
    sized = materialise(sized, "sized")
    order = [F.col("source_key"), F.col("size"), F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_hash")]
    placed = with_position(sized, order, "mix-order")
    pairs = materialise(placed.groupBy("source_key", "size").agg(F.count("*").alias("n"), F.min("position").alias("start")), "pairs")
    sources = materialise(source_targets(pairs.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap), "sources")
    rounded = round_pairs(pairs, sources, balance(pairs, sources, cap), cap)
    shares = materialise(rounded.join(sources, "source_key"), "shares")
    place = F.col("position") - F.col("start")
    each = F.floor(F.col("copies") / F.col("n"))
    one = each + (place < F.col("copies") - each * F.col("n")).cast("int")
    return placed.join(shares, ["source_key", "size"]).select(
        "doc_id", "text_hash", "size", "source_size", "target", one.cast("int").alias("copies"), (one * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix` takes it, with all its columns."""
    taken = mix(docs, id_col=id_col, text_col=text_col, **options)
    copies = taken.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    return take_rows(docs, copies, id_col, text_col)
