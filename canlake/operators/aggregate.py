"""Per-message aggregates, cycle times and shares."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canlake.schema import KEY, NEW, OLD, TRACE_LIMIT

#: Arrival order is cut into buckets of this many, so that a busy message's rows are dealt over many tasks.
BUCKET = 1 << 17


#: Of a message's last frame.
LAST = {"dir": "dir", "dlc": "dlc", "data": "data", "last_t_us": "t_us"}


def _counted() -> list:
    """count, extended of the first frame, and what LAST says of the last one. Each is an aggregate of its own, so that a
    query which needs numbers only is a hash aggregation."""
    return [F.count("*").alias("count"), F.min_by("extended", "seq").alias("extended"), *(F.max_by(c, "seq").alias(k) for k, c in LAST.items())]


def message_agg(frames: DataFrame) -> DataFrame:
    """One row per (run, channel, id): count, extended of its first frame; dir, dlc, data and t_us of its last.

    Partially aggregated before its one shuffle, so frequent messages do no harm.
    """
    return frames.groupBy(*KEY).agg(*_counted())


def _deltas(frames: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """frames with bucket, n (place within the key, from 1), dt (NULL on a key's first frame, else not below 0).

    Deltas and places are taken inside (key, bucket); the previous bucket's last time and the rows before come from a
    small table with one row per key and bucket, which is partially aggregated.
    """
    f = frames.withColumn("bucket", F.expr(f"seq div {bucket}"))
    heads = f.groupBy(*KEY, "bucket").agg(F.max_by("t_us", "seq").alias("end_t"), F.count("*").alias("rows"))
    w = W.partitionBy(*KEY).orderBy("bucket")
    heads = heads.select(*KEY, "bucket", F.lag("end_t").over(w).alias("before_t"), (F.sum("rows").over(w) - F.col("rows")).alias("before_n"))
    inside = W.partitionBy(*KEY, "bucket").orderBy("seq")
    f = f.withColumn("lag_t", F.lag("t_us").over(inside)).withColumn("k", F.row_number().over(inside)).join(heads, [*KEY, "bucket"])
    prev = F.coalesce("lag_t", "before_t")
    dt = F.when(prev.isNotNull(), F.greatest(F.col("t_us") - prev, F.lit(0)))
    return f.withColumn("dt", dt).withColumn("n", F.col("before_n") + F.col("k")).drop("lag_t", "k", "before_t", "before_n")


def _bucket_sums(frames: DataFrame, bucket: int = BUCKET, frames_too: bool = False) -> DataFrame:
    """Per key and bucket: low, high, m (deltas) and s: the smoothed value's share that comes from the bucket, at its end;
    with frames_too also count, extended of the first frame and LAST of the last.

    The smoothed value is linear in the deltas: the first has weight 0.9^r, the others 0.1 * 0.9^r, with r deltas after it.
    The frames are read and shuffled once: only a bucket's first delta, and whether it or the next is the key's first,
    depend on earlier buckets, so both are added when each bucket is one row.
    """
    inside = W.partitionBy(*KEY, "bucket")
    lag = F.lag("t_us").over(inside.orderBy("seq"))
    f = frames.withColumn("bucket", F.expr(f"seq div {bucket}"))
    f = f.withColumn("d", F.when(lag.isNotNull(), F.greatest(F.col("t_us") - lag, F.lit(0)))).withColumn("k", F.row_number().over(inside.orderBy("seq"))).withColumn("rows", F.count("*").over(inside))
    weight = lambda r: F.pow(F.lit(OLD), r)
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    own = F.count("*").alias("rows"), at(1, "t_us").alias("start_t"), at(F.col("rows"), "t_us").alias("end_t"), at(2, "d").alias("second"), F.sum(F.when(F.col("k") > 2, weight(F.col("rows") - F.col("k")) * NEW * F.col("d"))).alias("rest")
    sums = f.groupBy(*KEY, "bucket").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("d").alias("m"), *own, *(_counted() if frames_too else []))
    w = W.partitionBy(*KEY).orderBy("bucket")
    sums = sums.withColumn("before_t", F.lag("end_t").over(w)).withColumn("before_n", F.sum("rows").over(w) - F.col("rows"))
    sums = sums.withColumn("dt", F.when(F.col("before_t").isNotNull(), F.greatest(F.col("start_t") - F.col("before_t"), F.lit(0))))
    part = lambda c, k: F.coalesce(weight(F.col("rows") - k) * F.when(F.col("before_n") + k == 2, 1.0).otherwise(NEW) * F.col(c), F.lit(0.0))
    s = part("dt", 1) + part("second", 2) + F.coalesce("rest", F.lit(0.0))
    made = F.least("low", "dt").alias("low"), F.greatest("high", "dt").alias("high"), (F.col("m") + F.col("dt").isNotNull().cast("long")).alias("m"), s.alias("s")
    return sums.select(*KEY, "bucket", *made, *(["count", "extended", *LAST] if frames_too else []))


def _cycles(sums: DataFrame, *more) -> DataFrame:
    after = F.sum("m").over(W.partitionBy(*KEY).orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1))
    sums = sums.withColumn("share", F.col("s") * F.pow(F.lit(OLD), F.coalesce(after, F.lit(0))))
    ms = lambda c: F.coalesce(c, F.lit(0)) / 1000.0
    cycles = ms(F.min("low")).alias("cycle_min_ms"), F.round(ms(F.sum("share")), 6).alias("cycle_avg_ms"), ms(F.max("high")).alias("cycle_max_ms")
    return sums.groupBy(*KEY).agg(*cycles, *more)


def cycle_stats(frames: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """run_id, channel, id, cycle_min_ms, cycle_avg_ms (smoothed), cycle_max_ms; 0 for messages with one frame."""
    return _cycles(_bucket_sums(frames, bucket))


def summary(frames: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """message_agg and cycle_stats of each message in one pass."""
    more = F.sum("count").alias("count"), F.min_by("extended", "bucket").alias("extended"), *(F.max_by(k, "bucket").alias(k) for k in LAST)
    out = _cycles(_bucket_sums(frames, bucket, frames_too=True), *more)
    return out.select(*KEY, "count", "extended", *LAST, "cycle_min_ms", "cycle_avg_ms", "cycle_max_ms")


def fold_state(frames: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """What a stream's message fold holds after these frames: count, extended of the first; dir, dlc, data, t_us of the last;
    smoothed, least and largest delta in microseconds (NULL for messages with one frame). A stream goes on from it."""
    sums = _bucket_sums(frames, bucket, frames_too=True)
    after = F.sum("m").over(W.partitionBy(*KEY).orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1))
    share = F.col("s") * F.pow(F.lit(OLD), F.coalesce(after, F.lit(0)))
    ends = [F.max_by(k, "bucket").alias(k) for k in LAST]
    out = sums.withColumn("share", share).groupBy(*KEY).agg(F.sum("count").alias("count"), F.when(F.sum("m") > 0, F.sum("share")).alias("ewma_us"), F.min("low").alias("min_us"), F.max("high").alias("max_us"), F.min_by("extended", "bucket").alias("extended"), *ends)
    return out.select(*KEY, "count", "last_t_us", "ewma_us", "min_us", "max_us", "extended", "dir", "dlc", "data")


def cycle_delta(frames: DataFrame, bucket: int = BUCKET) -> DataFrame:
    return _deltas(frames, bucket).select(*KEY, "seq", "t_us", F.col("n").alias("count"), "dt")


def cycle_running(frames: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The state after each frame: count, smoothed, least and largest delta so far (NULL before the second frame).

    Buckets of a key start from what earlier buckets leave, so they are folded independently of each other.
    """
    deltas = _deltas(frames, bucket)
    w = W.partitionBy(*KEY).orderBy("bucket")
    # After 400 deltas a bucket's share is below 1e-18 of the value.
    before = F.collect_list(F.struct("m", "s")).over(w.rowsBetween(-400, -1))
    carried = F.aggregate(before, F.lit(0.0), lambda acc, b: acc * F.pow(F.lit(OLD), b["m"]) + b["s"])
    so_far = w.rowsBetween(W.unboundedPreceding, -1)
    start = _bucket_sums(frames, bucket).select(*KEY, "bucket", carried.alias("ewma0"), F.sum("m").over(so_far).alias("m0"), F.min("low").over(so_far).alias("low0"), F.max("high").over(so_far).alias("high0"))
    rows = deltas.join(start, [*KEY, "bucket"]).select(*KEY, "bucket", "seq", "n", "dt", "ewma0", F.coalesce("m0", F.lit(0)).alias("m0"), "low0", "high0")

    none = 1 << 62

    def fold(batches):
        key, state = None, None
        for batch in batches:
            keys = batch.select(["run_id", "channel", "id", "bucket"])
            cut = np.zeros(max(batch.num_rows - 1, 0), bool)
            for c in keys.columns:
                cut |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, max(len(c) - 1, 0))), True).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(cut) + 1).tolist(), batch.num_rows]
            dts = pc.fill_null(batch.column("dt"), -1).to_numpy(zero_copy_only=False)
            value, low, high = np.full(len(dts), np.nan), np.full(len(dts), none), np.full(len(dts), -1)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                this = tuple(c[a].as_py() for c in keys.columns)
                if this != key:
                    first = {c: batch.column(c)[a].as_py() for c in ("ewma0", "m0", "low0", "high0")}
                    key, state = this, (first["ewma0"] if first["m0"] > 0 else None, none if first["low0"] is None else first["low0"], -1 if first["high0"] is None else first["high0"])
                v, lo, hi = state
                d = dts[a:b]
                low[a:b] = np.minimum(np.minimum.accumulate(np.where(d < 0, none, d)), lo)
                high[a:b] = np.maximum(np.maximum.accumulate(d), hi)
                value[a:b] = smoothed(d, v)
                last = value[b - 1]
                state = (None if np.isnan(last) else float(last), int(low[b - 1]), int(high[b - 1]))
            cols = [batch.column(c) for c in (*KEY, "seq", "n")]
            cols += [pa.array(value, pa.float64(), mask=np.isnan(value)), pa.array(low, pa.int64(), mask=low == none), pa.array(high, pa.int64(), mask=high < 0)]
            yield pa.RecordBatch.from_arrays(cols, names=[*KEY, "seq", "count", "ewma_us", "min_us", "max_us"])

    dealt = rows.repartition(*KEY, "bucket").sortWithinPartitions(*KEY, "bucket", "seq")
    return dealt.mapInArrow(fold, "run_id string, channel int, id long, seq long, count long, ewma_us double, min_us long, max_us long")


def smoothed(deltas: np.ndarray, value: float | None, step: int = 256) -> np.ndarray:
    """The smoothed value after each delta (negative: none yet), from the value before; NaN before the first delta.

    In runs of `step` deltas it is a running sum: what a delta adds fades by OLD with each later one.
    """
    out, at = np.full(len(deltas), np.nan), 0
    if value is None:
        some = np.flatnonzero(deltas >= 0)
        if not len(some):
            return out
        at = int(some[0])
        value = float(deltas[at])
        out[at] = value
        at += 1
    fade = OLD ** np.arange(1, step + 1)
    for start in range(at, len(deltas), step):
        d = deltas[start : start + step]
        f = fade[: len(d)]
        out[start : start + step] = f * (value + np.cumsum(NEW * d / f))
        value = out[start + len(d) - 1]
    return out


def statistics(frames: DataFrame, messages: DataFrame) -> DataFrame:
    """Per message: name, count, share of the frames in percent, extended, dlc and cycle times. Runs have totals of their own."""
    agg = summary(frames)
    total = F.sum("count").over(W.partitionBy("run_id"))
    share = F.when(total > 0, F.round(F.col("count") / total * 100, 6)).otherwise(0.0)
    names = broadcast_if_small(messages.select("channel", "id", "name"))
    return agg.withColumn("share", share).join(names, ["channel", "id"], "left").select(*KEY, "name", "count", "share", "extended", "dlc", "cycle_min_ms", "cycle_avg_ms", "cycle_max_ms")


#: Catalogues are broadcast up to this many rows.
BROADCAST_ROWS = 100_000


def broadcast_if_small(catalogue: DataFrame) -> DataFrame:
    """A catalogue with a broadcast hint if its rows allow it; Spark shuffles larger ones. Rows are counted unless the plan
    itself bounds them, as that of a table made from rows does; nothing is remembered from one call to the next."""
    bound = catalogue._jdf.queryExecution().optimizedPlan().maxRows()
    if bound.isDefined() and bound.get() <= BROADCAST_ROWS or catalogue.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return F.broadcast(catalogue)
    return catalogue


def bus_share(frames: DataFrame) -> DataFrame:
    """Count per bus and its share of all frames of the run in percent."""
    c = frames.groupBy("run_id", "channel").agg(F.count("*").alias("count"))
    return c.withColumn("share", F.round(F.col("count") / F.sum("count").over(W.partitionBy("run_id")) * 100, 6))


def run_summary(frames: DataFrame, signals: DataFrame, limit: int = TRACE_LIMIT) -> DataFrame:
    """Frames, frames in the trace and signals that were seen, per run."""
    n = frames.groupBy("run_id").agg(F.count("*").alias("frames"))
    seen = frames.select(*KEY).distinct().join(broadcast_if_small(signals.select("channel", "id", "signal")), ["channel", "id"])
    s = seen.groupBy("run_id").agg(F.countDistinct("channel", "id", "signal").alias("signals"))
    return n.join(s, "run_id", "left").select("run_id", "frames", F.least("frames", F.lit(limit)).alias("trace"), F.coalesce("signals", F.lit(0)).alias("signals"))


def selection_counts(signals: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected and all signals per message and, with a NULL id, per bus."""
    picked = selection.select("channel", "id", "signal").distinct().withColumn("picked", F.lit(1))
    rows = signals.select("channel", "id", "signal").join(picked, ["channel", "id", "signal"], "left")
    return rows.rollup("channel", "id").agg(F.count("picked").alias("selected"), F.count("*").alias("total")).where("channel is not null")
