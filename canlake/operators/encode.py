"""Physical values into payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canlake.functions.codec import be64, with_bits, with_masks, with_raw, word_to_data
from canlake.operators.aggregate import broadcast_if_small

FRAME = ["frame", "channel", "id"]


def encode_batch(writes: DataFrame, signals: DataFrame, messages: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """writes(frame, channel, id, ord, signal, phys) -> frame, channel, id, extended, dlc, data.

    The writes of a frame take effect in the order of ord; overlapping fields end as the last one leaves them. base(frame,
    data) gives payloads to start from, else zeros. Signals that the catalogue doesn't know leave the payload as it is
    (rejected() lists them); a frame of an unknown id has 8 bytes, and is extended above 0x7FF.

    Masks come from the catalogue. A write keeps the bits that no later write of its frame takes, so that all are joined by OR.
    """
    fields = broadcast_if_small(with_masks(signals).drop("ord"))
    # A frame's writes meet before they are widened by the catalogue; all the rest is done where they are.
    met = writes.withColumnRenamed("ord", "nth").select(*FRAME, "nth", "signal", "phys").repartition(*FRAME)
    none = F.lit(0).cast("long")
    rows = with_bits(with_raw(met.join(fields, ["channel", "id", "signal"], "left"))).select(*FRAME, "nth", F.coalesce("mask", none).alias("mask"), F.coalesce("bits", none).alias("bits"))
    later = F.bit_or("mask").over(W.partitionBy(*FRAME).orderBy(F.desc("nth"), "mask", "bits").rowsBetween(W.unboundedPreceding, -1))
    last = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(later, none)))
    packed = rows.withColumn("bits", last).groupBy(*FRAME).agg(F.bit_or("mask").alias("mask"), F.bit_or("bits").alias("bits"))
    word = F.col("bits")
    if base is not None:
        packed = packed.join(base.select("frame", be64(F.col("data")).alias("word")), "frame", "left")
        word = F.coalesce(F.col("word").bitwiseAND(F.bitwise_not("mask")), none).bitwiseOR(F.col("bits"))
    known = broadcast_if_small(messages.select("channel", "id", F.col("dlc").alias("known_dlc"), F.col("extended").alias("known_ext")))
    out = packed.withColumn("data", word_to_data(word)).join(known, ["channel", "id"], "left")
    return out.select(*FRAME, F.coalesce("known_ext", F.col("id") > 0x7FF).alias("extended"), F.coalesce(F.least("known_dlc", F.lit(8)), F.lit(8)).alias("dlc"), "data")


def rejected(writes: DataFrame, signals: DataFrame) -> DataFrame:
    return writes.join(broadcast_if_small(signals), ["channel", "id", "signal"], "left_anti")
