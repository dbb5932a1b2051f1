"""Frames as a table that queries prune: by run and time slot, and dealt by message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.operators.series import decode, thin
from canlake.schema import KEY, SAMPLE_GAP_US

#: Time that a slot spans (ten minutes), and buckets that messages are dealt into.
SLOT_US, BUCKETS = 600_000_000, 32


def write(frames: DataFrame, table: str, gap_us: int = SAMPLE_GAP_US, slot_us: int = SLOT_US, buckets: int = BUCKETS, mode: str = "append") -> None:
    """Frames into a table partitioned by run_id and slot (t_us div slot_us) and bucketed by message, sorted by message and
    seq within a file; `kept` says which frames thinning keeps.

    A message's frames of a slot are one task's. Aggregates by message need no shuffle, since each bucket is read by one task;
    and what a time range shows is read from its slots alone, since thinning was done over the whole run when it was written.
    A run is to be written at once.
    """
    marked = thin(frames, gap_us, mark="kept").withColumn("slot", F.expr(f"t_us div {slot_us}"))
    dealt = marked.repartition("run_id", "slot", "channel", "id")
    dealt.write.mode(mode).partitionBy("run_id", "slot").bucketBy(buckets, "channel", "id").sortBy("channel", "id", "seq").option("slot_us", slot_us).saveAsTable(table)


def frames(spark: SparkSession, table: str, run_id: str | None = None, t_min: int | None = None, t_max: int | None = None, slot_us: int = SLOT_US) -> DataFrame:
    """The table's frames, of one run and of [t_min, t_max] where given: partitions are pruned first, then row groups."""
    rows = spark.table(table)
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    if t_min is not None:
        rows = rows.where((F.col("slot") >= t_min // slot_us) & (F.col("t_us") >= t_min))
    if t_max is not None:
        rows = rows.where((F.col("slot") <= t_max // slot_us) & (F.col("t_us") <= t_max))
    return rows.select("run_id", "seq", "t_us", "channel", "id", "extended", "dlc", "data", "dir", "kept")


def samples(stored: DataFrame, signals: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """series.samples() of frames(): those that were kept are decoded, whatever range is read."""
    return decode(stored.where("kept").drop("kept"), signals, selection).select(*KEY, "signal", "seq", "t_us", "value")
