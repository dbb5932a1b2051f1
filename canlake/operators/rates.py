"""Frame rate and bus load over a dense sequence of windows, smoothed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canlake.functions.codec import frame_bits
from canlake.schema import BIT_RATE, NEW, OLD

#: Windows are made and smoothed in spans of this many, each in one task.
SPAN = 1024
#: After so many windows without frames a smoothed value is 0 in double precision; the next frames start it anew.
FADED = 8 * SPAN
#: So many windows without frames are listed; of a longer silence the rest is left out, so that one wild time costs little.
QUIET = 100_000


def windows(frames: DataFrame, width_us: int = 1_000_000, by_channel: bool = False, from_zero: bool = False, quiet: int = QUIET) -> DataFrame:
    """run_id[, channel], w, frames, bits for each window from the run's first, or from 0, to its last; windows without
    frames hold 0. Of a silence of more than `quiet` windows the first `quiet` are listed, all if it lies within a span (before a
    run's first frame, with from_zero, the last ones).

    Spans of windows are laid from one span with frames to the next, so that neither times far from zero nor long gaps make
    large arrays or tasks, and a run's times don't bear on another run's.
    """
    keys = ["run_id", "channel"] if by_channel else ["run_id"]
    counted = frames.withColumn("w", F.expr(f"t_us div {width_us}")).groupBy(*keys, "w").agg(F.count("*").alias("frames"), F.sum(frame_bits(F.col("extended"), F.col("dlc"))).alias("bits"))
    heads = counted.groupBy("run_id", F.expr(f"w div {SPAN}").alias("b")).agg(F.min("w").alias("first"), F.max("w").alias("last"))
    order = W.partitionBy("run_id").orderBy("b")
    start = F.when(F.lag("b").over(order).isNull(), F.greatest(F.lit(0), F.col("first") - quiet)).otherwise(F.col("first")) if from_zero else F.col("first")
    following = F.lead("first").over(order)
    stop = F.when(following.isNull(), F.col("last")).otherwise(F.least(following - 1, F.col("last") + quiet))
    laid = heads.select("run_id", start.alias("start"), stop.alias("stop"))
    if by_channel:
        laid = laid.join(counted.select(*keys).distinct(), "run_id")
    spans = laid.select(*keys, "start", "stop", F.explode(F.sequence(F.expr(f"start div {SPAN}"), F.expr(f"stop div {SPAN}"))).alias("b")).repartition(*keys, "b")
    spine = spans.select(*keys, F.explode(F.sequence(F.greatest("start", F.col("b") * SPAN), F.least("stop", F.col("b") * SPAN + SPAN - 1))).alias("w"))
    zero = F.lit(0).cast("long")
    return spine.join(counted, [*keys, "w"], "left").select(*keys, "w", F.coalesce("frames", zero).alias("frames"), F.coalesce("bits", zero).alias("bits"))


def smoothed(dense: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """The value smoothed after each window: 0.9 old + 0.1 new, started by the first value that isn't 0, and again by the
    next one after FADED windows without any.

    Linear in the values, so a span starts from what the one before leaves at its end; what is older than a whole span
    has weights under 1e-46 and is left out.
    """
    fade = lambda n: F.pow(F.lit(OLD), n)
    rows = dense.withColumn("_b", F.expr(f"w div {SPAN}")).withColumn("_k", F.col("w") % SPAN)
    share = F.col(value) * fade(SPAN - 1 - F.col("_k"))
    heads = rows.where(F.col(value) > 0).groupBy(*keys, "_b").agg(F.min("w").alias("_first"), F.max("w").alias("_last"), F.sum(share * NEW).alias("_sum"), F.min_by(share, "w").alias("_share"))
    before = F.lag("_last").over(W.partitionBy(*keys).orderBy("_b"))
    heads = heads.withColumn("_start", F.when(before.isNull() | (F.col("_first") - before > FADED), F.col("_first")))
    left = F.col("_sum") + F.when(F.col("_start").isNotNull(), F.col("_share") * (1 - NEW)).otherwise(0.0)
    # Each span with frames tells itself its start, and the next span what it leaves; both from one row, so that heads are made once.
    none = F.lit(None)
    tells = F.array(F.struct(F.col("_b"), F.col("_start"), none.cast("double").alias("_end")), F.struct((F.col("_b") + 1).alias("_b"), none.cast("long").alias("_start"), left.alias("_end")))
    known = heads.select(*keys, F.inline(tells)).groupBy(*keys, "_b").agg(F.max("_start").alias("_start"), F.max("_end").alias("_end"))
    got = rows.join(known, [*keys, "_b"], "left")
    weight = F.when(F.col("w") == F.col("_start"), 1.0).otherwise(NEW)
    inside = F.sum(weight * F.col(value) * fade(-F.col("_k"))).over(W.partitionBy(*keys, "_b").orderBy("w").rowsBetween(W.unboundedPreceding, 0))
    old = F.when(F.col("_start").isNotNull() & (F.col("w") >= F.col("_start")), 0.0).otherwise(F.coalesce("_end", F.lit(0.0)))
    return got.select(*dense.columns, (inside * fade(F.col("_k")) + old * fade(F.col("_k") + 1)).alias(out))


def frame_rate(frames: DataFrame, width_us: int = 1_000_000, from_zero: bool = False, quiet: int = QUIET) -> DataFrame:
    dense = windows(frames, width_us, from_zero=from_zero, quiet=quiet).withColumn("per_s", F.col("frames") / (width_us / 1e6))
    return smoothed(dense, "per_s", ["run_id"], "rate").select("run_id", "w", "frames", F.round("rate", 6).alias("rate"))


def bus_load(frames: DataFrame, width_us: int = 1_000_000, bit_rate: int = BIT_RATE, by_channel: bool = False, from_zero: bool = False, quiet: int = QUIET) -> DataFrame:
    """Load in percent of the bit rate, over all buses together unless by_channel."""
    keys = ["run_id", "channel"] if by_channel else ["run_id"]
    dense = windows(frames, width_us, by_channel, from_zero, quiet).withColumn("now", F.col("bits") / (width_us / 1e6) / bit_rate * 100)
    return smoothed(dense, "now", keys, "load").select(*keys, "w", "bits", F.round("load", 6).alias("load"))
