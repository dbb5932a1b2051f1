"""Frames derived from the driver's tables, the demo catalogue, and named views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake import schema
from canlake.operators.views import View

BUS_ROWS = [(0, "CAN1", "demo0.dbc"), (1, "CAN2", "demo1.dbc"), (2, None, "missing.dbc")]
MESSAGE_ROWS = [
    (0, 272, False, "DriveState", 8, "DriveUnit"),
    (0, 528, False, "BodyState", 8, "BodyUnit"),
    (0, 816, False, "StopInfo", 3, "BodyUnit"),
    (0, 416944369, True, "DiagReply", 8, ""),
    (1, 272, False, "CabinState", 8, "CabinUnit"),
    (1, 200, False, "WheelState", 8, "WheelUnit"),
    (1, 201, False, "WheelShort", 3, "WheelUnit"),
]
FIELDS = [
    ("Level", 0, 16, False, False, 0.01, 0.0, 0.0, 655.35, "u", ["Panel"]),
    ("Unit", 16, 8, False, False, 1.0, -40.0, -40.0, 215.0, "degC", []),
    ("Counter", 31, 16, True, False, 1.0, 0.0, 0.0, 0.0, "", ["Panel"]),
    ("Trim", 40, 8, False, True, 0.5, 0.0, -64.0, 63.5, "%", ["Panel", "Logger"]),
    ("Phase", 48, 3, False, False, 1.0, 0.0, 0.0, 7.0, "", []),
    ("Slot", 51, 5, False, False, 1.0, 0.0, 0.0, 0.0, "", []),
]
NODE_ROWS = [(0, ["DriveUnit", "BodyUnit", "Panel", "Logger"]), (1, ["CabinUnit", "WheelUnit", "Panel", "Logger"])]
SIGNAL_ROWS = [(c, i, k, *f) for c, i, _, _, dlc, _ in MESSAGE_ROWS for k, f in enumerate(FIELDS if dlc == 8 else FIELDS[:2])]
#: (view, ord, channel, id, signal, visible)
SELECTION_ROWS = [
    ("curves", 1, 0, 272, "Level", True),
    ("curves", 2, 0, 272, "Trim", True),
    ("curves", 3, 1, 200, "Counter", False),
    ("panel", 1, 0, 272, "Level", True),
    ("panel", 2, 1, 201, "Unit", True),
    ("panel", 3, 1, 99, "Ghost", True),
]

VIEWS = {
    "all": View(),
    "bus1": View(scope=1),
    "manual": View(scope=((0, 816), (1, 200))),
    "empty": View(scope=()),
    "text": View(direction="Rx", known_only=True, text="state"),
    "hex": View(text="7a"),
    "dash": View(text="-"),
}


def buses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUS_ROWS, schema.BUSES)


def messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MESSAGE_ROWS, schema.MESSAGES)


def signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNAL_ROWS, schema.SIGNALS)


def nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, k, n) for c, names in NODE_ROWS for k, n in enumerate(names)], schema.NODES)


def selection(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SELECTION_ROWS, schema.SELECTION)


def dbc_text(channel: int) -> str:
    """The demo catalogue of one bus as DBC text."""
    out = ['VERSION ""', "", "BU_: " + " ".join(dict(NODE_ROWS)[channel]), ""]
    for c, i, ext, name, dlc, sender in MESSAGE_ROWS:
        if c == channel:
            out.append(f"BO_ {i + (1 << 31) * ext} {name}: {dlc} {sender or schema.NO_NODE}")
            for s, start, size, big, signed, factor, offset, lo, hi, unit, to in FIELDS if dlc == 8 else FIELDS[:2]:
                out.append(f' SG_ {s} : {start}|{size}@{0 if big else 1}{"-" if signed else "+"} ({factor},{offset}) [{lo}|{hi}] "{unit}" {",".join(to) or schema.NO_NODE}')
            out.append("")
    return "\n".join(out)


def frames_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame for each row of events, with closed-form payloads in integer arithmetic."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    ch = F.col("user_id") % 2
    kind = F.col("event_type")
    by_bus = lambda a, b: F.when(ch == 0, a).otherwise(b)
    id_ = F.when(kind == "click", 272).when(kind == "view", by_bus(528, 200)).when(kind == "purchase", by_bus(816, 201)).when(kind == "signup", 1952).otherwise(by_bus(416944369, 416944370))
    dlc = F.when(kind == "purchase", 3).otherwise(8)
    w0 = F.round(F.col("value") * 100).cast("long") % 65536  # the low 16 bits: the field has no more
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    ev, us = F.col("event_id"), F.col("user_id")
    parts = [w0 % 256, F.expr("(cast(round(value * 100) as bigint) % 65536) div 256"), us % 256, F.expr("(event_id % 65536) div 256"), ev % 256, (us * 7 + ev) % 256, ev % 8 + 8 * (us % 32)]
    h = F.concat(*(byte(p) for p in parts), F.lit("00"))
    data = F.unhex(F.rpad(F.substring(h, F.lit(1), dlc * 2), 16, "0"))
    t_us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 100000")
    return e.select(
        F.lit("r0").alias("run_id"), ev.alias("seq"), t_us.alias("t_us"), ch.cast("int").alias("channel"), id_.cast("long").alias("id"), (kind == "error").alias("extended"),
        dlc.alias("dlc"), data.alias("data"), F.when(us % 5 == 0, "Tx").otherwise("Rx").alias("dir"),
    )


#: Frames of a run in frames_in_runs.
RUN_FRAMES = 400


def frames_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames in runs of RUN_FRAMES each; a run's times go on from the one before."""
    return frames_from_events(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run"), F.expr(f"seq div {RUN_FRAMES}").cast("string")))
