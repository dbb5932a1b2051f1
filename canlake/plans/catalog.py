"""Registered queries over the driver's tables and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.functions import codec
from canlake.operators import aggregate, encode, export, rates, series, topology, views
from canlake.plans import fixtures as fx
from canlake.plans.sql import SQL
from canlake.schema import KEY, TRACE_LIMIT
from canlake.sources import asc, catalogue
from canlake.sources.shared import shared_folder

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return fx.frames_from_events(spark, d)


def _hexed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("data", F.hex("data")).drop("run_id")


def _picked(spark: SparkSession, view: str = "curves") -> DataFrame:
    return fx.selection(spark).where(F.col("view") == view)


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return series.samples(_frames(spark, d), fx.signals(spark))


# Logs


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Each frame's ASC line; every seventh line is broken in one of six ways."""
    f = asc.render(_frames(spark, d), "line")
    broken = [
        F.regexp_replace("line", r"^\S+", "1d"), F.regexp_replace("line", r"(Rx|Tx)", "RX"), F.regexp_replace("line", r"^(\S+\s+\d+\s+)\S+", "$11G"),
        F.regexp_replace("line", r"\S+$", "ZZ"), F.lit("   "), F.regexp_replace("line", r"^(\S+)\s+\d+", "$1 bus"),
    ]
    bad = F.lit(None).cast("string")
    for k, b in enumerate(broken):
        bad = F.when(F.col("seq") % 42 == 7 * k, b).otherwise(bad)
    return f.select("seq", F.coalesce(bad, "line").alias("value"))


@query
def asc_scan(spark, d):
    return asc.parse_lines(_lines(spark, d)).where("valid").select("seq", "t_us", "channel", "id", "extended", "dlc", F.hex("data").alias("data"), "dir")


@query
def asc_rejects(spark, d):
    return asc.parse_lines(_lines(spark, d)).where("not valid").select("seq", "value")


@query
def asc_render(spark, d):
    return asc.render(_frames(spark, d), "line").select("seq", "line")


@query
def replay_until(spark, d):
    return export.replay_until(_frames(spark, d), 10_000_000).select("seq", "t_us", "channel", "id")


@query
def trace_export(spark, d):
    return export.trace_rows(_frames(spark, d), fx.messages(spark), fx.VIEWS["text"])


@query
def stats_export(spark, d):
    return export.stats_rows(_frames(spark, d), fx.messages(spark), fx.buses(spark))


@query
def messages_export(spark, d):
    return export.messages_rows(_frames(spark, d), fx.messages(spark), fx.buses(spark))


@query
def history_export(spark, d):
    rows = export.history_rows(_frames(spark, d), fx.signals(spark), _picked(spark), fx.buses(spark))
    return rows.withColumn("value", F.round("value", 6))


@query
def latest_export(spark, d):
    rows = export.latest_rows(_frames(spark, d), fx.signals(spark), _picked(spark, "panel"), fx.buses(spark))
    return rows.withColumn("value", F.round("value", 6))


# Catalogues


def _catalogue_lines(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue per bus as text lines, from the table part: a message for each part with two signals."""
    p = spark.read.parquet(f"{d}/part.parquet")
    ident = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    head = F.format_string("BO_ %d %s: 8 %s", F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey") + (1 << 31)).otherwise(F.col("p_partkey")), ident("p_name"), F.when(F.col("p_size") % 10 == 0, "Vector__XXX").otherwise(ident("p_brand")))
    size = F.format_string(' SG_ Size : 0|%d@1+ (0.5,-1) [0|%d] "cm" Panel,%s', F.col("p_size") % 16 + 1, F.col("p_size"), ident("p_brand"))
    kind = F.format_string(' SG_ %s : 23|%d@0- (2,0) [0|0] "" Vector__XXX', ident("p_type"), F.col("p_size") % 8 + 2)
    rows = F.array(head, size, kind, F.lit("CM_ a line of no interest"))
    return p.select(F.concat(F.lit("bus"), (F.col("p_partkey") % 2).cast("string"), F.lit(".dbc")).alias("path"), "p_partkey", F.posexplode(rows).alias("k", "value")).select("path", (F.col("p_partkey") * 4 + F.col("k")).alias("line"), "value")


def _part_catalogue(spark, d):
    messages, signals, _ = catalogue.parse(_catalogue_lines(spark, d))
    bus = F.substring("path", 4, 1).cast("int").alias("channel")
    return messages.select(bus, "id", "extended", "name", "dlc", "transmitter"), signals.select(bus, *signals.columns[1:])


@query
def catalogue_scan(spark, d):
    messages, signals, _ = catalogue.parse(_catalogue_lines(spark, d))
    rows = signals.join(messages, ["path", "id"])
    return rows.select("path", "id", "extended", "name", "transmitter", "ord", "signal", "start_bit", "size", "big_endian", "signed", "factor", "offset", F.array_join("receivers", ",").alias("receivers"))


def _wrapped_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same catalogue with signals and node lists over two lines, and comments whose strings hold lines like statements."""
    rows = _catalogue_lines(spark, d).withColumn("line", F.col("line") * 8)
    p = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("bus"), (F.col("p_partkey") % 2).cast("string"), F.lit(".dbc")).alias("path"), (F.col("p_partkey") * 32 + 25).alias("line"), "p_brand", "p_type")
    ident = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    more = F.array(F.lit('CM_ BO_ 7 "first line,'), F.lit("BO_ 77 Ghost: 8 A"), F.lit("BU_: Nobody"), F.lit(' end";'), F.concat(F.lit("BU_: "), ident("p_brand")), F.concat(F.lit("    "), ident("p_type")))
    comments = p.select("path", "line", F.posexplode(more).alias("k", "value")).select("path", (F.col("line") + F.col("k")).alias("line"), "value")
    parts = F.when(F.col("value").rlike("^ SG_"), F.array(F.regexp_replace("value", ' "(cm)?" .*', ""), F.regexp_replace("value", '^.*( "(cm)?" .*)$', "  $1"))).otherwise(F.array("value"))
    return rows.select("path", "line", F.posexplode(parts).alias("k", "value")).select("path", (F.col("line") + F.col("k")).alias("line"), "value").unionByName(comments)


@query
def catalogue_wrapped(spark, d):
    messages, signals, _ = catalogue.parse(_wrapped_lines(spark, d))
    rows = messages.join(signals, ["path", "id"], "left")
    return rows.select("path", "id", "extended", "name", "transmitter", "ord", "signal", "start_bit", "size", "big_endian", "signed", "factor", "offset", F.array_join("receivers", ",").alias("receivers"))


@query
def catalogue_nodes(spark, d):
    return catalogue.parse(_wrapped_lines(spark, d))[2].groupBy("path", "node").agg(F.count("*").alias("n"))


@query
def bus_report(spark, d):
    """How loading went: two catalogues, some of whose messages are broken, and one each that is missing, empty and no text."""
    broken = spark.read.parquet(f"{d}/part.parquet").where("p_size % 9 = 0").select(F.concat(F.lit("bus"), (F.col("p_partkey") % 2).cast("string"), F.lit(".dbc")).alias("path"), (F.col("p_partkey") * 4 + 3).alias("line"), F.lit("BO_ oops").alias("value"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    files = _catalogue_lines(spark, d).unionByName(broken).groupBy("path").agg(F.encode(text, "utf-8").alias("content"))
    more = spark.createDataFrame([("empty.dbc", b""), ("image.dbc", b"\xff\xfeBO_")], "path string, content binary")
    buses = spark.createDataFrame([(0, "A", "bus0.dbc"), (1, "B", " bus1.dbc"), (2, "C", "none.dbc"), (3, "D", "empty.dbc"), (4, "E", "image.dbc"), (5, "F", None)], "channel int, bus_name string, dbc_path string")
    found = files.unionByName(more).withColumn("bytes", F.octet_length("content").cast("long"))
    return catalogue.report(buses, found).select("channel", "bus_name", "status", "messages", "signals", "rejects")


@query
def bus_catalogue(spark, d):
    buses = spark.createDataFrame([(0, "A", "bus0.dbc"), (1, "B", "bus1.dbc"), (2, "C", "none.dbc")], "channel int, bus_name string, dbc_path string")
    bound = catalogue.bind(buses, catalogue.parse(_catalogue_lines(spark, d))[0])
    return bound.groupBy("channel", "bus_name").agg(F.count("id").alias("messages"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids"))


@query
def catalogue_search(spark, d):
    """Found by id, by name, and by the names of signals alone."""
    return views.find_messages(*_part_catalogue(spark, d), "ed").select("channel", "id", "name")


@query
def select_matching(spark, d):
    return views.find_messages(*_part_catalogue(spark, d), "ed", in_signals=False).select("channel", "id")


@query
def signal_search(spark, d):
    return views.find_signals(*_part_catalogue(spark, d), "ed").select("channel", "id", "name", "signal")


@query
def signal_ranges(spark, d):
    low, high = codec.value_range()
    return _part_catalogue(spark, d)[1].select("channel", "id", "signal", low.alias("low"), high.alias("high"))


@query
def node_rx(spark, d):
    messages, signals = _part_catalogue(spark, d)
    nodes = messages.select("channel", F.col("transmitter").alias("node")).where("node <> ''").distinct()
    return topology.node_rx(nodes, messages, signals)


@query
def selection_counts(spark, d):
    _, signals = _part_catalogue(spark, d)
    picked = signals.where("size % 3 = 0")
    return aggregate.selection_counts(signals, picked).select("channel", F.coalesce("id", F.lit(-1)).alias("id"), "selected", "total")


def _selections(spark, d):
    _, signals = _part_catalogue(spark, d)
    return signals.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("view"), "channel", "id", "signal", "size").where("(view = 'a' and size % 3 = 0) or (view = 'b' and size % 2 = 0)")


@query
def active_signals(spark, d):
    return topology.active_signals(_selections(spark, d))


@query
def selection_update(spark, d):
    s = _selections(spark, d)
    return topology.selection_update(s.where("view = 'a'").select("channel", "id"), s.where("view = 'b'"), s.where("size > 9"))


# Codec


@query
def extract_raw(spark, d):
    rows = series.decode(_frames(spark, d), fx.signals(spark))
    return rows.select("seq", "signal", "raw")


@query
def to_physical(spark, d):
    """Per signal: how many values, their sum and ends, after the field and its scaling."""
    rows = series.decode(_frames(spark, d), fx.signals(spark))
    return rows.groupBy("channel", "id", "signal").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


def _writes(spark, d):
    return series.decode(_frames(spark, d), fx.signals(spark)).select(F.col("seq").alias("frame"), "channel", "id", "ord", "signal", F.col("value").alias("phys"))


@query
def from_physical(spark, d):
    """Values scaled by 3 so that some leave their field's range, as raw bits again."""
    rows = _writes(spark, d).join(fx.signals(spark).drop("ord"), ["channel", "id", "signal"]).withColumn("phys", F.col("phys") * 3)
    return codec.with_raw(rows).select("frame", "signal", "raw")


@query
def pack_raw(spark, d):
    """Each frame's fields packed one by one into empty payloads."""
    rows = _writes(spark, d).join(fx.signals(spark).drop("ord"), ["channel", "id", "signal"])
    return codec.with_bits(codec.with_raw(rows)).select("frame", "signal", F.hex(codec.word_to_data(F.col("bits"))).alias("data"))


@query
def encode_batch(spark, d):
    return encode.encode_batch(_writes(spark, d), fx.signals(spark), fx.messages(spark)).withColumn("data", F.hex("data"))


@query
def encode_unknown(spark, d):
    """Every third frame has an id that the catalogue doesn't know."""
    writes = _writes(spark, d).withColumn("id", F.when(F.col("frame") % 3 == 0, F.col("id") + 1000).otherwise(F.col("id")))
    return encode.encode_batch(writes, fx.signals(spark), fx.messages(spark)).withColumn("data", F.hex("data"))


# Filters and joins


@query
def scope_bus(spark, d):
    return _hexed(views.in_scope(_frames(spark, d), 1))


@query
def scope_manual(spark, d):
    return _hexed(views.in_scope(_frames(spark, d), ((0, 816), (1, 200))))


@query
def trace_filter(spark, d):
    return views.trace(_frames(spark, d), fx.messages(spark), fx.VIEWS["text"]).select("seq", "channel", "id", "name", "dir")


@query
def messages_filter(spark, d):
    agg = aggregate.message_agg(_frames(spark, d))
    return views.message_rows(agg, fx.messages(spark), fx.VIEWS["dash"]).select("channel", "id", "name", "count")


@query
def drop_bus(spark, d):
    return views.drop_bus(_frames(spark, d), 0).select("seq", "channel", "id")


@query
def bus_removed(spark, d):
    """Rows per bus of every table once the first bus is gone."""
    tables = {"frames": _frames(spark, d), "buses": fx.buses(spark), "messages": fx.messages(spark), "signals": fx.signals(spark), "nodes": fx.nodes(spark), "selections": fx.selection(spark)}
    left, _ = views.drop_bus_everywhere(tables, fx.VIEWS, 0)
    counts = [t.groupBy("channel").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "channel", "n") for name, t in left.items()]
    return reduce(DataFrame.unionByName, counts)


@query
def trace_named(spark, d):
    rows = views.with_names(_frames(spark, d), fx.messages(spark))
    return rows.select("seq", codec.render_id(F.col("id"), F.col("extended")).alias("id_text"), F.coalesce("name", F.lit("-")).alias("name"), codec.render_data(F.col("data"), F.col("dlc")).alias("data"))


@query
def decode_signals(spark, d):
    return series.decode(_frames(spark, d), fx.signals(spark)).select("seq", "channel", "id", "signal", F.round("value", 6).alias("value"), "unit")


@query
def decode_subscribed(spark, d):
    return series.decode(_frames(spark, d), fx.signals(spark), _picked(spark)).select("seq", "channel", "id", "signal", F.round("value", 6).alias("value"))


@query
def unknown_ids(spark, d):
    return topology.unknown_ids(aggregate.message_agg(_frames(spark, d)), fx.messages(spark)).select("channel", "id", "count")


@query
def node_tx(spark, d):
    return topology.node_tx(fx.nodes(spark), fx.messages(spark), aggregate.message_agg(_frames(spark, d)))


@query
def node_activity(spark, d):
    return topology.node_activity(fx.nodes(spark), fx.messages(spark), aggregate.message_agg(_frames(spark, d)))


@query
def node_summary(spark, d):
    return topology.node_summary(fx.nodes(spark), fx.messages(spark), fx.signals(spark), aggregate.message_agg(_frames(spark, d)))


# Aggregates


@query
def message_agg(spark, d):
    return _hexed(aggregate.message_agg(_frames(spark, d)))


@query
def cycle_stats(spark, d):
    return aggregate.cycle_stats(_frames(spark, d)).drop("run_id")


@query
def bus_share(spark, d):
    return aggregate.bus_share(_frames(spark, d)).drop("run_id")


@query
def statistics(spark, d):
    rows = aggregate.statistics(_frames(spark, d), fx.messages(spark)).drop("run_id")
    return rows.withColumn("name", F.coalesce("name", F.lit("-"))).orderBy("channel", "id")


@query
def messages_decoded(spark, d):
    last = aggregate.message_agg(_frames(spark, d))
    return series.decode(last, fx.signals(spark)).select("channel", "id", "ord", "signal", F.round("value", 6).alias("value"), "unit")


@query
def run_summary(spark, d):
    return aggregate.run_summary(_frames(spark, d), fx.signals(spark)).drop("run_id")


@query
def cycle_delta(spark, d):
    return aggregate.cycle_delta(_frames(spark, d)).select("seq", "channel", "id", "count", F.coalesce("dt", F.lit(-1)).alias("dt"))


@query
def cycle_running(spark, d):
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return aggregate.cycle_running(_frames(spark, d)).select("seq", "count", F.round(F.coalesce("ewma_us", F.lit(-1.0)), 3).alias("ewma_us"), none("min_us"), none("max_us"))


@query
def frame_rate(spark, d):
    return rates.frame_rate(_frames(spark, d)).drop("run_id")


@query
def bus_load(spark, d):
    return rates.bus_load(_frames(spark, d)).drop("run_id")


@query
def view_counts(spark, d):
    """What each messages view says it shows."""
    return views.view_counts(aggregate.message_agg(_frames(spark, d)), fx.messages(spark), fx.VIEWS)


# Several runs: the frames in runs of RUN_FRAMES, in logs of their own


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return fx.frames_in_runs(spark, d)


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """The runs written as ASC logs, and scanned again; run_id is the folder's run."""
    folder = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    asc.write_runs(_runs(spark, d), folder, header=True)
    return asc.scan(spark, folder).withColumn("run_id", F.regexp_extract("run_id", "run_id=([^/]+)", 1))


@query
def scan_statistics(spark, d):
    rows = aggregate.statistics(_logs(spark, d), fx.messages(spark))
    return rows.withColumn("name", F.coalesce("name", F.lit("-"))).drop("extended")


@query
def scan_message_agg(spark, d):
    return aggregate.message_agg(_logs(spark, d)).withColumn("data", F.hex("data"))


@query
def frame_rate_wild(spark, d):
    """Logs with times that are none, and one frame of the first run a thousand million seconds late."""
    late = F.when(F.col("seq") == 399, F.col("t_us") + 1_000_000_000_000_000).otherwise(F.col("t_us"))
    lines = asc.render(_runs(spark, d).withColumn("t_us", late), "line")
    lines = lines.select("run_id", "seq", F.when(F.col("seq") % 97 == 0, F.regexp_replace("line", r"^\S+", "1e30")).otherwise(F.col("line")).alias("value"))
    return rates.frame_rate(asc.parse_lines(lines).where("valid"), quiet=50)


@query
def scan_cycle_delta(spark, d):
    return aggregate.cycle_delta(_logs(spark, d)).select("run_id", "channel", "id", "count", "t_us", F.coalesce("dt", F.lit(-1)).alias("dt"))


@query
def trace_view_runs(spark, d):
    """The newest 40 of bus 1 among each run's last 150 frames."""
    rows = views.trace_view(_runs(spark, d), fx.messages(spark), fx.VIEWS["bus1"], ring=150, shown=40)
    return rows.select("run_id", "seq", "channel", "id", F.coalesce("name", F.lit("-")).alias("name"))


@query
def run_summary_runs(spark, d):
    return aggregate.run_summary(_runs(spark, d), fx.signals(spark), limit=150)


@query
def bus_load_runs(spark, d):
    """By run and bus, in windows of 50 ms."""
    return rates.bus_load(_runs(spark, d), 50_000, by_channel=True)


# Newest rows


@query
def trace_newest(spark, d):
    return _hexed(views.trace_view(_frames(spark, d), fx.messages(spark), fx.VIEWS["bus1"]).drop("name"))


@query
def trace_ring(spark, d):
    return views.newest(_frames(spark, d), TRACE_LIMIT).select("seq", "t_us", "channel", "id")


# Series


@query
def signal_samples(spark, d):
    return _kept(spark, d).select("channel", "id", "signal", "seq", "t_us", F.round("value", 6).alias("value"))


@query
def history_ring(spark, d):
    return series.history(_kept(spark, d)).select("channel", "id", "signal", "seq", "t_us", F.round("value", 6).alias("value"))


@query
def history_full(spark, d):
    """All frames of eight bytes as one message without a gap: more samples than a history holds."""
    f = _frames(spark, d).where("dlc = 8").withColumn("channel", F.lit(0)).withColumn("id", F.lit(272).cast("long"))
    return series.history(series.samples(f, fx.signals(spark), gap_us=0)).select("signal", "seq", "t_us", F.round("value", 6).alias("value"))


@query
def samples_hot(spark, d):
    """Thinning where one message has nine tenths of all frames, in small buckets."""
    own = F.col("seq") % 10 == 0
    f = _frames(spark, d).select("run_id", "seq", "t_us", F.when(own, F.col("channel")).otherwise(0).alias("channel"), F.when(own, F.col("id")).otherwise(272).alias("id"))
    return series.thin(f, bucket=512).select("seq", "t_us", "channel", "id")


@query
def subscribed_samples(spark, d):
    """Subscriptions that begin and end in the middle of a run."""
    rows = [("a", 0, 272, "Level", 5_000_000, 15_000_000), ("b", 0, 272, "Trim", 5_000_000, 15_000_000), ("c", 0, 272, "Level", 7_013_000, None), ("d", 1, 200, "Counter", 0, 20_000_000), ("e", 1, 99, "Ghost", 0, None)]
    wanted = spark.createDataFrame(rows, "subscription string, channel int, id long, signal string, from_us long, to_us long")
    return series.subscribed_samples(_frames(spark, d), fx.signals(spark), wanted).select("subscription", "channel", "id", "signal", "seq", "t_us", F.round("value", 6).alias("value"))


@query
def signal_minmax(spark, d):
    return series.minmax(_kept(spark, d)).select("channel", "id", "signal", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query
def latest_values(spark, d):
    return series.latest(_frames(spark, d), fx.signals(spark)).select("channel", "id", "signal", "t_us", F.round("value", 6).alias("value"), "unit", F.round("gauge", 6).alias("gauge"))


@query
def viewport(spark, d):
    return series.viewport(_kept(spark, d), 10_000_000, shared=False).select("channel", "id", "signal", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query
def viewport_overlay(spark, d):
    """One range over all series of a run; half of the runs show nothing yet."""
    kept = series.samples(_runs(spark, d), fx.signals(spark))
    rows = series.viewport(kept, 1_000_000)
    return rows.select("run_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query
def viewport_points(spark, d):
    rows = series.viewport_points(_kept(spark, d), 10_000_000, 10_000_000, shared=False)
    return rows.select("channel", "id", "signal", "seq", F.round("x", 7).alias("x"), F.round("y", 6).alias("y"))


@query
def cursor_values(spark, d):
    """Each series at -1, 0 and every second up to 30 s."""
    kept = _kept(spark, d)
    times = F.concat(F.array(F.lit(-1).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: k.cast("long") * 1_000_000))
    # A message that has a frame has a sample of each of its signals.
    probes = _frames(spark, d).select(*KEY).distinct().join(fx.signals(spark).select("channel", "id", "signal"), ["channel", "id"]).withColumn("t_us", F.explode(times))
    rows = series.as_of(kept, probes, bucket_us=4_000_000)
    return rows.select("channel", "id", "signal", "t_us", F.coalesce(codec.format_value(F.round("value", 6)), F.lit("-")).alias("text"))


@query
def history_extent(spark, d):
    return series.extent(_kept(spark, d), 30_000_000).drop("run_id")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in SQL.items() if k in QUERIES}
