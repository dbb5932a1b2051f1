"""Rows of the CSV and ASC exports; write them with DataFrameWriter."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from canlake.functions.codec import render_data
from canlake.operators import views
from canlake.operators.aggregate import broadcast_if_small, statistics, summary
from canlake.operators.series import history, latest, samples
from canlake.operators.views import View
from canlake.schema import TRACE_LIMIT
from canlake.sources.asc import HEADER, render_line


def bus_name(rows: DataFrame, buses: DataFrame) -> DataFrame:
    """rows with bus: its name, or CAN and its number from 1."""
    return rows.join(broadcast_if_small(buses.select("channel", "bus_name")), "channel", "left").withColumn("bus", F.coalesce("bus_name", F.concat(F.lit("CAN"), (F.col("channel") + 1).cast("string")))).drop("bus_name")


def stats_rows(frames: DataFrame, messages: DataFrame, buses: DataFrame) -> DataFrame:
    rows = bus_name(statistics(frames, messages), buses).withColumn("name", F.coalesce("name", F.lit("-"))).orderBy("channel", "id")
    return rows.select("bus", "id", "name", "count", "cycle_min_ms", "cycle_avg_ms", "cycle_max_ms", "dlc")


def messages_rows(frames: DataFrame, messages: DataFrame, buses: DataFrame, view: View = View()) -> DataFrame:
    agg = summary(frames)
    rows = bus_name(views.message_rows(agg, messages, view), buses).orderBy("channel", "id")
    return rows.select("bus", "id", "name", "dir", "count", F.col("cycle_avg_ms").alias("cycle_ms"), "dlc", render_data(F.col("data"), F.col("dlc")).alias("data"))


def history_rows(frames: DataFrame, signals: DataFrame, selection: DataFrame, buses: DataFrame) -> DataFrame:
    """The histories of the selection's visible signals, in its order and by time."""
    picked = selection.where("visible").select("channel", "id", "signal", F.col("ord").alias("nth"))
    kept = history(samples(frames, signals, picked))
    return bus_name(kept.join(picked, ["channel", "id", "signal"]), buses).orderBy("nth", "seq").select(F.col("t_us").alias("time_us"), "bus", "signal", "value")


def latest_rows(frames: DataFrame, signals: DataFrame, selection: DataFrame, buses: DataFrame) -> DataFrame:
    """The last values of the selection's visible signals; 0 and no unit where none was received."""
    picked = selection.where("visible").select("channel", "id", "signal", F.col("ord").alias("nth"))
    rows = picked.join(latest(frames, signals).select("channel", "id", "signal", "value", "unit"), ["channel", "id", "signal"], "left")
    return bus_name(rows, buses).orderBy("nth").select("bus", "signal", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("unit", F.lit("")).alias("unit"))


def trace_rows(frames: DataFrame, messages: DataFrame, view: View, limit: int = TRACE_LIMIT) -> DataFrame:
    """ASC lines of the frames in the trace that pass the view, in arrival order."""
    return views.trace(views.newest(frames, limit), messages, view).select("seq", render_line().alias("line")).orderBy("seq")


def replay_until(frames: DataFrame, cutoff_us: int) -> DataFrame:
    """Each run's frames in arrival order up to the first one later than the cutoff."""
    late = frames.where(F.col("t_us") > cutoff_us).groupBy("run_id").agg(F.min("seq").alias("stop"))
    return frames.join(late, "run_id", "left").where(F.col("stop").isNull() | (F.col("seq") < F.col("stop"))).drop("stop")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header each, in the rows' order over the files; values aren't quoted unless they need it."""
    rows.write.option("header", True).csv(path)


@dataclass(frozen=True)
class Exported:
    """What an export did: rows written, and rows that it chose from (None where it takes all). path is None if nothing was
    written; then no file is there."""

    rows: int
    of: int | None
    path: str | None

    @property
    def status(self) -> str:
        if self.of == 0:
            return "export: trace is empty"
        if self.path is None:
            return "export: nothing to write" if self.of is None else "export: no frames pass the trace filter"
        return f"exported {self.rows} rows to {self.path}" if self.of is None else f"exported {self.rows} of {self.of} frames to {self.path}"


def write_one(rows: DataFrame, path: str, kind: str, seen: Observation, head: str | None = None) -> Exported:
    """The rows, in their order, as one file at `path`: written beside it, counted by the write itself, then moved there.

    kind: `text` or `csv`; head: a text that comes first; seen: what observes `rows`, and `of` if they are a choice, below the
    rows' last shuffle. A file that is there is replaced, unless there are no rows.
    """
    spark, parts = rows.sparkSession, f"{path}.{uuid.uuid4().hex}"
    (rows.write.text(parts) if kind == "text" else rows.write.option("header", True).csv(parts))
    counts = seen._jo.getAsJava()  # empty where Spark found the input empty and skipped the rest
    n, total = counts.get("rows") or 0, counts.get("of")
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, target = hadoop.Path(parts), hadoop.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        if not n:
            return Exported(0, total, None)
        made = files.globStatus(hadoop.Path(f"{parts}/part-*"))[0].getPath()
        if head:
            whole = hadoop.Path(f"{parts}/whole")
            out, part = files.create(whole), files.open(made)
            out.write(bytearray(head.encode()))
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, True)
            made = whole
        if files.exists(target):
            files.delete(target, False)
        if not files.rename(made, target):
            raise OSError(f"{path} can't be written")
        return Exported(n, total, path)
    finally:
        files.delete(folder, True)


def export_trace(frames: DataFrame, messages: DataFrame, view: View, path: str, limit: int = TRACE_LIMIT) -> Exported:
    """The frames in the trace that pass the view, as one ASC file with a header; says how many of the trace's frames those are.
    The trace is one run's, so at most `limit` frames are sorted by the one task that writes."""
    seen, held = Observation(), views.with_names(views.newest(frames, limit), messages)
    marked = held.select("seq", render_line().alias("line"), F.coalesce(views.trace_passes(view), F.lit(False)).alias("passes"))
    marked = marked.observe(seen, F.count_if("passes").alias("rows"), F.count(F.lit(1)).alias("of"))
    lines = marked.where("passes").coalesce(1).sortWithinPartitions("seq").select("line")
    done = write_one(lines, path, "text", seen, "\n".join(HEADER) + "\n")
    return done if done.of is not None else Exported(0, 0, None)


def export_csv(rows: DataFrame, path: str) -> Exported:
    """Any of the CSV exports' rows, in their order, as one file with a header line."""
    seen = Observation()
    return write_one(rows.observe(seen, F.count(F.lit(1)).alias("rows")).coalesce(1), path, "csv", seen)
