"""Saved views as predicates: scope, direction, catalogue membership and text."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canlake.operators.aggregate import BUCKET, broadcast_if_small
from canlake.schema import TRACE_LIMIT, VIEW_LIMIT

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_upper(c) -> Column:
    return F.translate(c, LOWER, UPPER)


@dataclass(frozen=True)
class View:
    """scope: None for all, a bus number, or the (channel, id) pairs picked by hand (none picked: nothing passes)."""

    scope: None | int | tuple[tuple[int, int], ...] = None
    direction: str | None = None
    known_only: bool = False
    text: str = ""


def with_names(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """rows with name, NULL where the catalogue doesn't know the id on that bus. The catalogue's keys are unique."""
    return rows.join(broadcast_if_small(messages.select("channel", "id", "name")), ["channel", "id"], "left")


def in_scope(rows: DataFrame, scope) -> DataFrame:
    if scope is None:
        return rows
    if isinstance(scope, int):
        return rows.where(F.col("channel") == scope)
    keys = rows.sparkSession.createDataFrame(list(scope), "channel int, id long")
    return rows.join(broadcast_if_small(keys), ["channel", "id"], "left_semi")


def _scoped(view: View):
    if isinstance(view.scope, int):
        return F.col("channel") == view.scope
    return F.lit(True) if view.scope is None else F.concat_ws(":", "channel", "id").isin([f"{c}:{i}" for c, i in view.scope])


def trace_passes(view: View):
    """Whether a frame with name passes a trace view. Text is matched ignoring ASCII case against the unpadded hex id and the
    name; an unknown name matches nothing."""
    keep = _scoped(view)
    if view.direction:
        keep = keep & (F.col("dir") == view.direction)
    if view.known_only:
        keep = keep & F.col("name").isNotNull()
    q = view.text.strip().translate(str.maketrans(LOWER, UPPER))
    return keep & (F.hex("id").contains(q) | F.coalesce(ascii_upper("name").contains(q), F.lit(False))) if q else keep


def trace(frames: DataFrame, messages: DataFrame, view: View) -> DataFrame:
    """Frames that pass a trace view, with name."""
    return with_names(frames, messages).where(trace_passes(view))


def passes(view: View):
    """Whether an aggregated row with name (`-` where unknown) passes a messages view; text is looked for in lower case."""
    keep = _scoped(view)
    if view.known_only:
        keep = keep & (F.col("name") != "-")
    q = view.text.strip().lower()
    return keep & (F.lower("name").contains(q) | F.lower(F.hex("id")).contains(q)) if q else keep


def message_rows(aggregated: DataFrame, messages: DataFrame, view: View) -> DataFrame:
    """Aggregated rows that pass a messages view. Unknown names are `-` before the text is looked for."""
    return with_names(aggregated, messages).withColumn("name", F.coalesce("name", F.lit("-"))).where(passes(view))


def newest(frames: DataFrame, n: int, bucket: int = BUCKET) -> DataFrame:
    """The last n frames of each run in arrival order. Counts per bucket say from which bucket on a run's frames are needed,
    so that only those (n and a bucket's more at most) are ranked."""
    b = F.expr(f"seq div {bucket}")
    counts = frames.groupBy("run_id", b.alias("b")).agg(F.count("*").alias("k"))
    later = F.sum("k").over(W.partitionBy("run_id").orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1))
    needed = counts.withColumn("later", F.coalesce(later, F.lit(0))).where(F.col("later") < n).groupBy("run_id").agg(F.min("b").alias("_from"))
    nth = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("seq")))
    return frames.join(needed, "run_id").where(b >= F.col("_from")).withColumn("_nth", nth).where(F.col("_nth") <= n).select(frames.columns)


def trace_view(frames: DataFrame, messages: DataFrame, view: View, ring: int = TRACE_LIMIT, shown: int = VIEW_LIMIT) -> DataFrame:
    """What a trace view shows of each run: of the run's last `ring` frames the newest `shown` that pass the view."""
    return newest(trace(newest(frames, ring), messages, view), shown)


def view_counts(aggregated: DataFrame, messages: DataFrame, views: dict[str, View]) -> DataFrame:
    """view, messages, frames: for each messages view the number of its rows and of their frames, 0 where nothing passes. Names
    are looked up once, and all views are counted by one aggregate."""
    rows = with_names(aggregated.select("channel", "id", "count"), messages).withColumn("name", F.coalesce("name", F.lit("-")))
    shown = [F.coalesce(F.when(passes(v), F.lit(1)), F.lit(0)) for v in views.values()]
    sums = [F.struct(F.coalesce(F.sum(p), F.lit(0)).alias("messages"), F.coalesce(F.sum(p * F.col("count")), F.lit(0)).alias("frames")).alias(f"v{k}") for k, p in enumerate(shown)]
    if not sums:
        return rows.sparkSession.createDataFrame([], "view string, messages long, frames long")
    named = F.array(*(F.struct(F.lit(name).alias("view"), F.col(f"v{k}.messages").alias("messages"), F.col(f"v{k}.frames").alias("frames")) for k, name in enumerate(views)))
    return rows.agg(*sums).select(F.inline(named))


def find_messages(messages: DataFrame, signals: DataFrame, text: str, in_signals: bool = True) -> DataFrame:
    """Messages whose hex id or name contains the text, or, unless left out, one of whose signals does."""
    q = text.strip().translate(str.maketrans(LOWER, UPPER))
    hit = F.hex("id").contains(q) | ascii_upper("name").contains(q)
    if in_signals:
        s = signals.groupBy("channel", "id").agg(F.max(ascii_upper("signal").contains(q)).alias("signal_hit"))
        messages = messages.join(s, ["channel", "id"], "left")
        return messages.where(hit | F.coalesce("signal_hit", F.lit(False))).drop("signal_hit")
    return messages.where(hit)


def find_signals(messages: DataFrame, signals: DataFrame, text: str) -> DataFrame:
    """All signals of messages whose name contains the text, and those of others that do themselves."""
    q = text.strip().translate(str.maketrans(LOWER, UPPER))
    rows = signals.join(messages.select("channel", "id", "name"), ["channel", "id"])
    return rows.where(ascii_upper("name").contains(q) | ascii_upper("signal").contains(q))


def drop_bus(rows: DataFrame, channel: int) -> DataFrame:
    """Rows of the other buses, renumbered to close the gap."""
    c = F.col("channel")
    return rows.where(c != channel).withColumn("channel", F.when(c > channel, c - 1).otherwise(c))


def scope_after_drop(scope, channel: int):
    """A view's scope once a bus is gone: a bus scope of that bus shows all; pairs of it go; higher numbers move down."""
    if isinstance(scope, int):
        return None if scope == channel else scope - (scope > channel)
    if scope is None:
        return None
    return tuple((c - (c > channel), i) for c, i in scope if c != channel)


def drop_bus_everywhere(tables: dict[str, DataFrame], views: dict[str, View], channel: int) -> tuple[dict[str, DataFrame], dict[str, View]]:
    """All tables and views once a bus is gone, later buses renumbered. tables: `buses` and any others with a channel (frames,
    messages, signals, nodes, selections). The last bus stays: its removal is a ValueError."""
    if tables["buses"].where(F.col("channel") != channel).limit(1).count() == 0:
        raise ValueError("the last bus can't be removed")
    return {k: drop_bus(t, channel) for k, t in tables.items()}, {k: replace(v, scope=scope_after_drop(v.scope, channel)) for k, v in views.items()}
