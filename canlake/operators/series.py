"""Signals over time: decoding, sampling, histories, viewports and as-of lookups."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from canlake.functions.codec import extract_raw, gauge, to_physical, with_words
from canlake.operators.aggregate import BUCKET, broadcast_if_small, message_agg
from canlake.schema import HISTORY_LIMIT, KEY, SAMPLE_GAP_US

SERIES = [*KEY, "signal"]


def decode(frames: DataFrame, signals: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """One row per frame and signal of its message, with value and unit. With a selection only its signals are decoded:
    the catalogue is cut down before it meets the frames."""
    if selection is not None:
        signals = signals.join(selection.select("channel", "id", "signal").distinct(), ["channel", "id", "signal"], "left_semi")
    rows = with_words(frames).join(broadcast_if_small(signals), ["channel", "id"])
    return rows.withColumn("raw", extract_raw()).withColumn("value", to_physical()).select(*frames.columns, "ord", "signal", "raw", "value", "unit", "min", "max")


def thin(frames: DataFrame, gap_us: int = SAMPLE_GAP_US, bucket: int = BUCKET, keys: list[str] = KEY, mark: str | None = None) -> DataFrame:
    """The frames of each message that are at least gap_us after the last one kept, in arrival order; with `mark` all
    frames, and a column of that name that says which are kept.

    Which frames are kept depends on their times only, so all signals of a message share them: thin first, decode after.
    Buckets of arrival order are thinned independently of each other, each from the time last kept before it. That time comes
    from jumps(): what a bucket makes of any time that may be the last one kept, one row per bucket.
    """
    names, at = frames.columns, [*keys, "_bucket"]
    dealt = frames.withColumn("_bucket", F.expr(f"seq div {bucket}")).repartition(*at)
    order = W.partitionBy(*keys).orderBy("_bucket")
    most = dealt.groupBy(*at).agg(F.max("t_us").alias("_most"))
    most = most.select(*at, F.max("_most").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.lead("_bucket").over(order).isNotNull().alias("_more"))
    # What a message's last bucket does to the time last kept is of no use, so a message of one bucket isn't looked at here.
    ordered = dealt.join(most.where("_more"), at).select(*at, "seq", "t_us", "_before").sortWithinPartitions(*at, "seq")
    none = F.lit(None).cast("array<long>")
    last = most.where("not _more and _before is not null").select(*at, none.alias("bounds"), none.alias("ends"))
    start = kept_before(jumps(ordered, gap_us, keys).unionByName(last), gap_us, keys)
    ready = dealt.join(start, at, "left").select(*names, "_bucket", "_kept").sortWithinPartitions(*at, "seq")

    def work(batches):
        for batch, parts in _stretches(batches, at):
            t, starts, keep = batch.column("t_us").to_numpy(), batch.column("_kept"), np.zeros(batch.num_rows, bool)
            for a, b, new, _ in parts:
                if new:
                    kept = starts[a].as_py()
                if kept is None:
                    kept, keep[a], a = int(t[a]), True, a + 1
                while (a := first_from(t, a, b, kept + gap_us)) < b:
                    kept, keep[a], a = int(t[a]), True, a + 1
            out = batch.select(names)
            yield out.append_column(mark, pa.array(keep)) if mark else out.filter(pa.array(keep, pa.bool_()))

    return ready.mapInArrow(work, StructType([*frames.schema.fields, StructField(mark, BooleanType())]) if mark else frames.schema)


def _stretches(batches, names: list[str]):
    """Each batch of rows in order of these columns, with its stretches of equal ones: start, end, whether they begin there,
    and what they are."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in names]
        cut = np.zeros(batch.num_rows - 1, bool)
        for c in keys:
            a, b = c.slice(1), c.slice(0, len(c) - 1)
            cut |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        edges, parts = [0, *(np.flatnonzero(cut) + 1).tolist(), batch.num_rows], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            this = tuple(c[a].as_py() for c in keys)
            parts.append((a, b, this != last, this))
            last = this
        yield batch, parts


def following(t: np.ndarray, gap_us: int) -> np.ndarray:
    """For each place the first later one whose time is at least gap_us above its own, or the end."""
    n, want = len(t), t + gap_us
    if (t[1:] >= t[:-1]).all():
        return np.maximum(np.searchsorted(t, want), np.arange(1, n + 1))
    most = [t]  # the largest time of 2^k places from each one on
    while 2 << (len(most) - 1) <= n:
        half = 1 << (len(most) - 1)
        most.append(np.maximum(most[-1][:-half], most[-1][half:]))
    at = np.arange(1, n + 1)
    for k in reversed(range(len(most))):
        inside = at + (1 << k) <= n
        skip = inside & (most[k][np.where(inside, at, 0)] < want)
        at += skip << k
    return at


def jump_map(t: np.ndarray, before: int | None, gap_us: int) -> tuple[list, list]:
    """(bounds, ends) of a bucket's times: what the time last kept before it leads to, as jumps() says.

    The time last kept is never a whole gap behind the largest time so far: a frame that late after it would have been kept.
    So a bucket's first kept frame is one that exceeds all before it, up to the first one a whole gap after `before`.
    """
    if before is None:
        starts = [0]
    else:
        best = np.maximum(np.maximum.accumulate(t), before)
        rises = np.flatnonzero(best > np.concatenate([[before], best[:-1]]))
        starts = rises[: np.searchsorted(best[rises], before + gap_us) + 1].tolist()
    after, end = following(t, gap_us).tolist(), {}
    for start in starts:
        way, i = [], start
        while i not in end and after[i] < len(t):
            way.append(i)
            i = after[i]
        last = end.get(i, i)
        end.update(dict.fromkeys([*way, i], last))
    return t[starts].tolist(), t[[end[s] for s in starts]].tolist()


def jumps(ordered: DataFrame, gap_us: int, keys: list[str] = KEY) -> DataFrame:
    """Rows in order of (keys, _bucket, seq) with _before, the largest time before their bucket -> keys, _bucket, bounds, ends: a
    time last kept leads to the end of the first bound that is at least a gap above it, and stays where there is none."""
    at = [*keys, "_bucket"]
    out = StructType([*(ordered.schema[c] for c in at), *(StructField(c, ArrayType(LongType())) for c in ("bounds", "ends"))])
    kind = to_arrow_schema(out)

    def work(batches):
        held = key = most = None
        made = []
        for batch, parts in _stretches(batches, at):
            t, before = batch.column("t_us").to_numpy(), batch.column("_before")
            for a, b, new, this in parts:
                if new:
                    if held is not None:
                        made.append((*key, *jump_map(np.concatenate(held), most, gap_us)))
                    key, held, most = this, [], before[a].as_py()
                held.append(t[a:b])
            if len(made) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), kind, strict=True)], schema=kind)
                made = []
        if held is not None:
            made.append((*key, *jump_map(np.concatenate(held), most, gap_us)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), kind, strict=True)], schema=kind)

    return ordered.mapInArrow(work, out)


def kept_before(moves: DataFrame, gap_us: int, keys: list[str] = KEY) -> DataFrame:
    """jumps() -> keys, _bucket, _kept: the time last kept before each bucket (NULL before the first). A message's buckets go
    by in order, and one number is remembered."""
    at = [*keys, "_bucket"]

    def work(batches):
        last = kept = None
        for batch in batches:
            out = []
            for *key, bounds, ends in zip(*(batch.column(c).to_pylist() for c in (*keys, "bounds", "ends")), strict=True):
                if key != last:
                    last, kept = key, None
                out.append(kept)
                if bounds is not None:
                    place = 0 if kept is None else bisect_left(bounds, kept + gap_us)
                    kept = ends[place] if place < len(ends) else kept
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in at), pa.array(out, pa.int64())], names=[*at, "_kept"])

    return moves.repartition(*keys).sortWithinPartitions(*at).mapInArrow(work, StructType([*(moves.schema[c] for c in at), StructField("_kept", LongType())]))


def first_from(t: np.ndarray, start: int, end: int, least: int) -> int:
    """The first place from start on with t >= least, or end; looked for in stretches that double."""
    size = 16
    while start < end:
        stop = min(end, start + size)
        hit = t[start:stop] >= least
        i = int(hit.argmax())
        if hit[i]:
            return start + i
        start, size = stop, size * 2
    return end


def samples(frames: DataFrame, signals: DataFrame, selection: DataFrame | None = None, gap_us: int = SAMPLE_GAP_US) -> DataFrame:
    """run_id, channel, id, signal, seq, t_us, value of the kept samples. Frames without signals aren't thinned at all."""
    wanted = signals if selection is None else signals.join(selection.select("channel", "id", "signal").distinct(), ["channel", "id", "signal"], "left_semi")
    keys = wanted.select("channel", "id").distinct()
    few = frames.select(*KEY, "seq", "t_us", "data").join(broadcast_if_small(keys), ["channel", "id"], "left_semi").select(*KEY, "seq", "t_us", "data")
    return decode(thin(few, gap_us), wanted).select(*SERIES, "seq", "t_us", "value")


def subscribed_samples(frames: DataFrame, signals: DataFrame, subscriptions: DataFrame, gap_us: int = SAMPLE_GAP_US, bucket: int = BUCKET) -> DataFrame:
    """subscriptions(subscription, channel, id, signal, from_us, to_us) -> subscription, run_id, channel, id, signal, seq, t_us, value:
    the samples that each got of frames from from_us on and before to_us (NULL: no end), thinned from its own first frame.

    Subscriptions of a message that begin and end together share their frames; frames meet the others' spans by message.
    """
    span, wanted = [*KEY, "from_us", "to_us"], subscriptions.withColumn("to_us", F.coalesce("to_us", F.lit((1 << 63) - 1)))
    spans = wanted.select("channel", "id", "from_us", "to_us").join(signals.select("channel", "id").distinct(), ["channel", "id"], "left_semi").distinct()
    inside = (F.col("t_us") >= F.col("from_us")) & (F.col("t_us") < F.col("to_us"))
    few = frames.select(*KEY, "seq", "t_us", "data").join(broadcast_if_small(spans), ["channel", "id"]).where(inside).select(*span, "seq", "t_us", "data")
    kept = decode(thin(few, gap_us, bucket, span), signals)
    return kept.join(broadcast_if_small(wanted), ["channel", "id", "signal", "from_us", "to_us"]).select("subscription", *KEY, "signal", "seq", "t_us", "value")


def history(kept: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The newest `limit` samples of each series."""
    n = F.row_number().over(W.partitionBy(*SERIES).orderBy(F.desc("seq")))
    return kept.withColumn("n", n).where(F.col("n") <= limit).drop("n")


def minmax(kept: DataFrame) -> DataFrame:
    """Least and largest value over all kept samples of each series, those beyond the history's limit included."""
    return kept.groupBy(*SERIES).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def latest(frames: DataFrame, signals: DataFrame) -> DataFrame:
    """The last value of each signal with unit and gauge: only each message's last frame is decoded."""
    last = message_agg(frames).select(*KEY, F.col("last_t_us").alias("t_us"), "data")
    rows = decode(last, signals)
    return rows.select(*SERIES, "ord", "t_us", "value", "unit", gauge(F.col("value"), F.col("min"), F.col("max")).alias("gauge"))


def viewport(kept: DataFrame, t_min: int, shared: bool = True) -> DataFrame:
    """lo and hi of samples from t_min on, over all series of a run or for each: 0 and 1 where none is in sight, and
    lo + 1 as hi where they are less than 1e-9 apart. All kept samples count, those beyond the history's limit too."""
    keys = ["run_id"] if shared else SERIES
    shown = F.when(F.col("t_us") >= t_min, F.col("value"))
    r = kept.groupBy(*keys).agg(F.coalesce(F.min(shown), F.lit(0.0)).alias("lo"), F.coalesce(F.max(shown), F.lit(1.0)).alias("hi"))
    return r.withColumn("hi", F.when(F.col("hi") - F.col("lo") < 1e-9, F.col("lo") + 1).otherwise(F.col("hi")))


def viewport_points(kept: DataFrame, t_min: int, span_us: int, shared: bool = True) -> DataFrame:
    """x and y of samples from t_min on as shares of the time span and of the range, clamped to 0 to 1; series with
    fewer than two points are left out."""
    keys = ["run_id"] if shared else SERIES
    rows = kept.where(F.col("t_us") >= t_min).join(viewport(kept, t_min, shared), keys)
    points = rows.groupBy(*SERIES).agg(F.count("*").alias("points")).where("points >= 2")
    clamp = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    x, y = (F.col("t_us") - t_min) / float(span_us), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return rows.join(points, SERIES).select(*SERIES, "seq", clamp(x).alias("x"), clamp(y).alias("y"))


def as_of(kept: DataFrame, probes: DataFrame, bucket_us: int = 60_000_000) -> DataFrame:
    """probes(run_id, channel, id, signal, t_us) -> with value: that of the last sample at or before t_us (of equal times the
    last in arrival order), NULL before the first and for negative times.

    Series and probes are laid into time buckets; inside one, probes take the last sample before them. A probe with none
    takes its bucket's carry: the last value of the nearest earlier bucket, from one row per series and bucket.
    """
    b = F.expr(f"floor(t_us / {bucket_us})")
    s = kept.select(*SERIES, "t_us", F.struct("value").alias("v"), F.col("seq"), F.lit(0).alias("probe"))
    p = probes.select(*SERIES, "t_us", F.lit(None).cast("struct<value:double>").alias("v"), F.lit(None).cast("long").alias("seq"), F.lit(1).alias("probe"))
    rows = s.unionByName(p).withColumn("b", b)
    inside = W.partitionBy(*SERIES, "b").orderBy("t_us", "probe", "seq").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("here", F.last("v", ignorenulls=True).over(inside))
    ends = rows.groupBy(*SERIES, "b").agg(F.max_by("v", F.when(F.col("probe") == 0, F.struct("t_us", "seq"))).alias("end"))
    carry = ends.select(*SERIES, "b", F.last("end", ignorenulls=True).over(W.partitionBy(*SERIES).orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    found = rows.where("probe = 1").join(carry, [*SERIES, "b"])
    return found.select(*SERIES, "t_us", F.when(F.col("t_us") >= 0, F.coalesce("here", "carry")["value"]).alias("value"))


def extent(kept: DataFrame, now_us: int) -> DataFrame:
    """The oldest retained sample of a run and how long ago that is."""
    return history(kept).groupBy("run_id").agg(F.min("t_us").alias("oldest_us")).withColumn("span_us", F.greatest(F.lit(now_us) - F.col("oldest_us"), F.lit(0)))
