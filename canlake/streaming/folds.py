"""The batch operators as Structured Streaming queries with the same results.

State belongs to a message or a run; with `forget` it goes so long after its last frames (processing time), so that a run
that ended leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from canlake.functions.codec import frame_bits
from canlake.operators.aggregate import smoothed
from canlake.operators.rates import FADED, QUIET
from canlake.operators.series import SERIES, decode, first_from
from canlake.schema import BIT_RATE, HISTORY_LIMIT, KEY, NEW, OLD, SAMPLE_GAP_US, TRACE_LIMIT
from canlake.sources.asc import parse_lines, render_line
from canlake.streaming.source import lines_stream

KEY_FIELDS = [StructField("run_id", StringType()), StructField("channel", IntegerType()), StructField("id", LongType())]
#: A message's state, as aggregate.fold_state() gives it too.
AGG_STATE = StructType(
    [
        StructField("count", LongType()), StructField("last_t_us", LongType()), StructField("ewma_us", DoubleType()), StructField("min_us", LongType()), StructField("max_us", LongType()),
        StructField("extended", BooleanType()), StructField("dir", StringType()), StructField("dlc", IntegerType()), StructField("data", BinaryType()),
    ]
)
AGG_OUT = StructType(
    [*KEY_FIELDS, StructField("count", LongType()), StructField("extended", BooleanType()), StructField("dir", StringType()), StructField("dlc", IntegerType()), StructField("data", BinaryType())]
    + [StructField("last_t_us", LongType()), StructField("cycle_min_ms", DoubleType()), StructField("cycle_avg_ms", DoubleType()), StructField("cycle_max_ms", DoubleType())]
)


def _ms(span: str | None) -> int | None:
    return None if span is None else int(pd.Timedelta(span).total_seconds() * 1000)


def _mode(forget: str | None) -> str:
    return "none" if forget is None else "processingTime"


class Fold(StatefulProcessor):
    """Rows of a key are folded by seq; a subclass says what is kept, and gives what it emits."""

    def __init__(self, forget: str | None):
        self.ttl = _ms(forget)

    def close(self) -> None:
        pass


class MessageFold(Fold):
    """Per message: count, first extended, last frame, and least, smoothed and largest delta."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("agg", AGG_STATE, self.ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.state.update(tuple(None if row[c] is None or (np.isscalar(row[c]) and pd.isna(row[c])) else row[c].item() if hasattr(row[c], "item") else row[c] for c in AGG_STATE.names))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        n, last, ewma, low, high, ext, *_ = self.state.get() if self.state.exists() else (0, *[None] * 8)
        t = batch["t_us"].to_numpy(np.int64)
        ext = bool(batch["extended"].iloc[0]) if n == 0 else ext
        deltas = np.maximum(np.diff(t, prepend=t[0] if n == 0 else last), 0)
        if n == 0:
            deltas[0] = -1  # the first frame of all has none
        some = deltas[deltas >= 0]
        if len(some):
            ewma = float(smoothed(deltas, ewma)[-1])
            low, high = int(min(some.min(), some[0] if low is None else low)), int(max(some.max(), some[0] if high is None else high))
        end = batch.iloc[-1]
        n, last, dir_, dlc, data = n + len(t), int(t[-1]), end["dir"], int(end["dlc"]), bytes(end["data"])
        self.state.update((n, last, ewma, low, high, ext, dir_, dlc, data))
        ms = lambda x: (x or 0) / 1000.0
        yield pd.DataFrame([(*key, n, ext, dir_, dlc, data, last, ms(low), round(ms(ewma), 6), ms(high))], columns=AGG_OUT.names)


class Thinning(Fold):
    """The frames of a message at least `gap_us` after the last one kept."""

    def __init__(self, gap_us: int, forget: str | None):
        super().__init__(forget)
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", StructType([StructField("t", LongType())]), self.ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.kept.update((int(initialState["t"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        t, keep = batch["t_us"].to_numpy(np.int64), np.zeros(len(batch), bool)
        kept, at = (self.kept.get()[0], 0) if self.kept.exists() else (int(t[0]), 1)
        keep[:at] = True
        while (at := first_from(t, at, len(t), kept + self.gap_us)) < len(t):
            kept, keep[at] = int(t[at]), True
            at += 1
        self.kept.update((kept,))
        yield batch[keep]


def message_fold(frames: DataFrame, initial: DataFrame | None = None, forget: str | None = None) -> DataFrame:
    """A stream of frames -> one row per message and batch in which it got frames (update mode); equals the batch result.

    initial: aggregate.fold_state() of frames before the stream, whose fold goes on.
    """
    return frames.groupBy(*KEY).transformWithStateInPandas(MessageFold(forget), AGG_OUT, "update", _mode(forget), None if initial is None else initial.select(*KEY, *AGG_STATE.names).groupBy(*KEY))


def sample_stream(frames: DataFrame, signals: DataFrame, gap_us: int = SAMPLE_GAP_US, initial: DataFrame | None = None, forget: str | None = None) -> DataFrame:
    """A stream of frames -> the kept samples of their signals (append mode). Thinned first, decoded after.

    initial: rows(run_id, channel, id, t) with the time last kept of messages before the stream.
    """
    few = frames.join(signals.select("channel", "id").distinct(), ["channel", "id"], "left_semi").select(*KEY, "seq", "t_us", "data")
    kept = few.groupBy(*KEY).transformWithStateInPandas(Thinning(gap_us, forget), few.schema, "append", _mode(forget), None if initial is None else initial.select(*KEY, "t").groupBy(*KEY))
    return decode(kept, signals).select(*KEY, "signal", "seq", "t_us", "value")


SMOOTHED = StructType(
    [StructField("run_id", StringType()), *(StructField(c, LongType()) for c in ("w", "frames", "bits")), StructField("rate", DoubleType()), StructField("load", DoubleType()), StructField("late", LongType())]
)


class RunRates(StatefulProcessor):
    """The windows of a run in order, those without frames included, with frame rate and bus load smoothed after each.

    Each run has its own clock, the largest time seen of it; a window goes out once the clock is `late_us` past its end. Frames
    of windows that are out are counted in rows of their own. With `idle` a run that got nothing for so long (processing
    time) is flushed, and forgotten after as long again.
    """

    def __init__(self, width_us: int, late_us: int, bit_rate: int, idle: str | None, quiet: int):
        self.width_us, self.late_us, self.bit_rate, self.idle, self.quiet = width_us, late_us, bit_rate, _ms(idle), quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        long, real = LongType(), DoubleType()
        self.handle = handle
        self.clock = handle.getValueState("clock", StructType([StructField("top", long), StructField("out", long), StructField("seen", long), StructField("rate", real), StructField("load", real)]))
        self.open = handle.getMapState("open", StructType([StructField("w", long)]), StructType([StructField("frames", long), StructField("bits", long)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top, out, seen, rate, load = self.clock.get() if self.clock.exists() else (0, None, None, 0.0, 0.0)
        batch = pd.concat(list(rows))
        late = []
        for w, frames, bits in batch.groupby("w", sort=True)[["frames", "bits"]].sum().itertuples():
            if out is not None and w <= out:
                late.append((*key, w, None, None, None, None, frames))
                continue
            at = (int(w),)
            had = self.open.getValue(at) if self.open.containsKey(at) else (0, 0)
            self.open.updateValue(at, (had[0] + int(frames), had[1] + int(bits)))
        if late:
            yield self._frame(late)
        top = max(top, int(batch["top"].max()))
        self.clock.update((top, out, seen, rate, load))
        yield from self._emit(key, (top - self.late_us) // self.width_us - 1)
        self._set_timer(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if next(iter(self.open.keys()), None) is None:
            self.clock.clear()
            return
        yield from self._emit(key, None)
        self._set_timer(timerValues)

    def _set_timer(self, timerValues) -> None:
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def _emit(self, key, last: int | None) -> Iterator[pd.DataFrame]:
        """Windows up to `last`, or all there are."""
        due = sorted((w, *n) for (w,), n in self.open.iterator() if last is None or w <= last)
        top, out, seen, rate, load = self.clock.get()
        per_s, rows = 1e6 / self.width_us, []
        for w, frames, bits in due:
            self.open.removeKey((w,))
            if seen is not None:
                for at in range(seen + 1, min(w, seen + 1 + self.quiet)):
                    rate, load = rate * OLD, load * OLD
                    rows.append((*key, at, 0, 0, round(rate, 6), round(load, 6), None))
                    if len(rows) == 10_000:  # long gaps go out in parts
                        yield self._frame(rows)
                        rows = []
                if w - seen > FADED:
                    rate = load = 0.0
            now, now_load = frames * per_s, bits * per_s / self.bit_rate * 100
            rate = now if rate == 0 else OLD * rate + NEW * now
            load = now_load if load == 0 else OLD * load + NEW * now_load
            rows.append((*key, w, frames, bits, round(rate, 6), round(load, 6), None))
            seen = w
        out = max(x for x in (out, seen, last) if x is not None) if seen is not None else out
        self.clock.update((top, out, seen, rate, load))
        if rows:
            yield self._frame(rows)

    def _frame(self, rows: list) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=SMOOTHED.names)
        return frame.astype({c: "Int64" for c in ("w", "frames", "bits", "late")}).astype({"rate": "float64", "load": "float64"})

    def close(self) -> None:
        pass


def _counted(frames: DataFrame, width_us: int) -> DataFrame:
    """run_id, w, frames, bits, top (largest time): what a task's batch of frames adds to each window, so that few rows of a
    busy run reach its state."""

    def work(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by(["run_id", "w"]).aggregate([("bits", "count"), ("bits", "sum"), ("t_us", "max")])
            yield from t.select(["run_id", "w", "bits_count", "bits_sum", "t_us_max"]).rename_columns(["run_id", "w", "frames", "bits", "top"]).combine_chunks().to_batches()

    bits = frame_bits(F.col("extended"), F.col("dlc")).cast("long")
    return frames.select("run_id", F.expr(f"t_us div {width_us}").alias("w"), bits.alias("bits"), "t_us").mapInArrow(work, "run_id string, w long, frames long, bits long, top long")


def smoothed_rates(
    frames: DataFrame, width_us: int = 1_000_000, late: str = "10 seconds", bit_rate: int = BIT_RATE, idle: str | None = None, quiet: int = QUIET
) -> DataFrame:
    """A stream of frames -> run_id, w, frames, bits, rate, load for each window from the run's first on (append mode), once
    the run's own time is `late` past it; equals the batch's frame_rate and bus_load for those windows. After `idle` without
    frames a run's last windows go out too. Rows with `late` count frames whose window was out already, and hold nothing else.

    Runs don't bear on each other: they may start at any time, in any order, and have any length.
    """
    processor = RunRates(width_us, _ms(late) * 1000, bit_rate, idle, quiet)
    return _counted(frames, width_us).groupBy("run_id").transformWithStateInPandas(processor, SMOOTHED, "append", _mode(idle))


def rate_stream(frames: DataFrame, width: str = "1 second", late: str = "10 seconds", idle: str | None = None) -> DataFrame:
    """run_id, window, frames, bits of smoothed_rates(), windows as times."""
    us = int(pd.Timedelta(width).total_seconds() * 1_000_000)
    start = lambda w: F.timestamp_micros(w * us)
    rows = smoothed_rates(frames, us, late, idle=idle).where("late is null")
    return rows.select("run_id", F.struct(start(F.col("w")).alias("start"), start(F.col("w") + 1).alias("end")).alias("window"), "frames", "bits")


class Ring(Fold):
    """The newest `limit` rows of a key by seq: new rows pass, with the least seq that is still in the ring.

    State holds the ring's seqs only, in chunks; a chunk goes as a whole once no newer ring can need it.
    """

    CHUNK = 4096

    def __init__(self, limit: int, forget: str | None):
        super().__init__(forget)
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", StructType([StructField("k", LongType())]), StructType([StructField("seqs", BinaryType())]), self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        held = {k: np.frombuffer(v[0], np.int64) for (k,), v in self.chunks.iterator()}
        seqs = batch["seq"].to_numpy(np.int64)
        for k in np.unique(seqs // self.CHUNK):
            new = seqs[seqs // self.CHUNK == k]
            held[int(k)] = np.sort(np.concatenate([held.get(int(k), new[:0]), new]))
        count, start = 0, None
        for k in sorted(held, reverse=True):
            if count >= self.limit:
                if self.chunks.containsKey((k,)):
                    self.chunks.removeKey((k,))
                continue
            start = int(held[k][max(len(held[k]) - (self.limit - count), 0)])
            count += len(held[k])
            self.chunks.updateValue((k,), (held[k].tobytes(),))
        batch = batch[batch["seq"] >= start]
        yield batch.assign(ring_start=start)


def ring_stream(rows: DataFrame, keys: list[str], limit: int, forget: str | None = None) -> DataFrame:
    """A stream of rows(keys, seq, ...) -> the rows that are among their key's newest `limit` when they come, with ring_start
    (append mode). What has a seq of at least its key's largest ring_start is the key's ring; the rest may be dropped."""
    out = StructType([*rows.schema.fields, StructField("ring_start", LongType())])
    return rows.groupBy(*keys).transformWithStateInPandas(Ring(limit, forget), out, "append", _mode(forget))


def trace_stream(frames: DataFrame, limit: int = TRACE_LIMIT, forget: str | None = None) -> DataFrame:
    """The ring of each run's last frames, as views.newest() of the batch."""
    return ring_stream(frames, ["run_id"], limit, forget)


def history_stream(samples: DataFrame, limit: int = HISTORY_LIMIT, forget: str | None = None) -> DataFrame:
    """The ring of each series' last samples, as series.history() of the batch."""
    return ring_stream(samples, SERIES, limit, forget)


def in_ring(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What a ring_stream() has left of its rows by now."""
    starts = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max("ring_start").alias("_start"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(starts, same).where(F.col("seq") >= F.col("_start")).select(*(c for c in rows.columns if c != "ring_start"))


def replay_stream(spark: SparkSession, folder: str, max_bytes: int | None = None, progress: str | None = None) -> DataFrame:
    """ASC files of a folder as a stream of frames; run_id is the file, seq the line's place in it, in bytes.

    Files may be of any size and may grow: they are read by ranges of bytes, at most `max_bytes` of them in a batch, as
    lines_stream() says.
    """
    return parse_lines(lines_stream(spark, folder, max_bytes, progress)).where("valid").drop("valid", "value")


def record(frames: DataFrame, folder: str, checkpoint: str):
    """Write a stream of frames as ASC lines as they come; returns the writer, to be started with a trigger.

    Each batch is a folder, and each run in it another one with the run's lines in arrival order, so that asc.scan_recorded()
    gives the runs again. A batch that is repeated after a failure takes the place of what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.select("run_id", "seq", render_line().alias("value")).repartition("run_id").sortWithinPartitions("run_id", "seq")
        lines.select("run_id", "value").write.mode("overwrite").partitionBy("run_id").text(f"{folder}/batch={number}")

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
