import glob
import random

from pyspark.sql import functions as F

from canlake import schema
from canlake.operators import aggregate, encode, rates, series, topology, views
from canlake.operators.views import View
from canlake.plans import fixtures as fx
from canlake.sources import asc, catalogue


def frames(spark, rows):
    """rows: (seq, t_us, channel, id[, extended, dlc, data, dir])"""
    full = [("r", *r, *(False, 8, bytes(8), "Rx")[len(r) - 4 :]) for r in rows]
    return spark.createDataFrame(full, schema.FRAMES)


def fold(rows):
    """Plain fold per key in arrival order."""
    out, state = {}, {}
    for seq, t, ch, i in sorted(rows):
        k = (ch, i)
        n, last, e, lo, hi = state.get(k, (0, None, None, None, None))
        if n:
            dt = max(t - last, 0)
            e = dt if e is None else 0.9 * e + 0.1 * dt
            lo, hi = dt if lo is None else min(lo, dt), dt if hi is None else max(hi, dt)
        state[k] = (n + 1, t, e, lo, hi)
        out[seq] = state[k]
    return state, out


def random_rows(n=700):
    rnd = random.Random(4)
    return [(s, max(0, s * 1000 + rnd.randrange(-4000, 4000)), rnd.randrange(2), rnd.choice([1, 1, 1, 2, 3])) for s in range(n)] + [(n, 5, 1, 99)]


def test_cycles_equal_the_fold_for_any_bucket(spark):
    rows = random_rows()
    state, running = fold(rows)
    for bucket in (7, 64, 1 << 17):
        got = {(r["channel"], r["id"]): r for r in aggregate.cycle_stats(frames(spark, rows), bucket).collect()}
        assert set(got) == set(state)
        for k, (_, _, e, lo, hi) in state.items():
            assert abs(got[k]["cycle_avg_ms"] - (e or 0) / 1000) < 1e-5 and got[k]["cycle_min_ms"] == (lo or 0) / 1000 and got[k]["cycle_max_ms"] == (hi or 0) / 1000
    for r in aggregate.cycle_running(frames(spark, rows), 50).collect():
        n, _, e, lo, hi = running[r["seq"]]
        assert (r["count"], r["min_us"], r["max_us"]) == (n, lo, hi) and (e is None) == (r["ewma_us"] is None) and abs((e or 0) - (r["ewma_us"] or 0)) < 1e-6


def test_message_agg_takes_first_extended_and_last_rest(spark):
    f = frames(spark, [(1, 10, 0, 5, True, 8, b"\1" * 8, "Rx"), (2, 30, 0, 5, False, 3, b"\2" * 8, "Tx"), (3, 20, 0, 5, False, 2, b"\3" * 8, "Rx"), (4, 1, 1, 5)])
    r = {x["channel"]: x for x in aggregate.message_agg(f).collect()}
    assert (r[0]["count"], r[0]["extended"], r[0]["dlc"], r[0]["last_t_us"], bytes(r[0]["data"])) == (3, True, 2, 20, b"\3" * 8) and r[1]["count"] == 1


def test_thinning_is_greedy(spark):
    rows = random_rows()
    want, last = set(), {}
    for s, t, ch, i in sorted(rows):
        if (ch, i) not in last or t >= last[ch, i] + 5000:
            last[ch, i] = t
            want.add(s)
    assert {r["seq"] for r in series.thin(frames(spark, rows), 5000).collect()} == want


def test_trace_truth_table(spark):
    f = frames(spark, [(1, 1, 0, 816, False, 3, bytes(8), "Rx"), (2, 2, 0, 528, False, 8, bytes(8), "Tx"), (3, 3, 1, 200, False, 8, bytes(8), "Rx"), (4, 4, 0, 0x7A0, False, 8, bytes(8), "Rx")])
    m = fx.messages(spark)
    table = [
        (View(), {1, 2, 3, 4}), (View(scope=1), {3}), (View(scope=()), set()), (View(scope=((0, 816),)), {1}), (View(direction="Tx"), {2}), (View(known_only=True), {1, 2, 3}),
        (View(text="state"), {2, 3}), (View(text=" 7a "), {4}), (View(text="-"), set()), (View(direction="Rx", known_only=True, text="STOP"), {1}),
    ]
    for view, want in table:
        assert {r["seq"] for r in views.trace(f, m, view).collect()} == want, view
    agg = aggregate.message_agg(f)
    assert {r["id"] for r in views.message_rows(agg, m, View(text="-")).collect()} == {0x7A0}


def test_bus_removal(spark):
    f = frames(spark, [(1, 1, 0, 1), (2, 1, 1, 1), (3, 1, 2, 1)])
    assert {(r["seq"], r["channel"]) for r in views.drop_bus(f, 1).collect()} == {(1, 0), (3, 1)}
    assert views.scope_after_drop(1, 1) is None and views.scope_after_drop(2, 1) == 1 and views.scope_after_drop(((1, 5), (2, 6)), 1) == ((1, 6),)


def test_asc_round_trip_and_rejects(spark, sf, tmp_path):
    f = fx.frames_from_events(spark, sf)
    asc.write(f.coalesce(1), str(tmp_path / "log"))
    assert glob.glob(str(tmp_path / "log" / "part-*"))
    back = asc.scan(spark, str(tmp_path / "log"))
    cols = ["t_us", "channel", "id", "extended", "dlc", F.hex("data").alias("data"), "dir"]
    assert sorted(back.select(cols).collect()) == sorted(f.select(cols).collect())
    lines = [
        "date Mon Jan 1 10:00:00 AM 2024", "", "0.1 1 7 Rx", "1d 1 7 Rx 1 00", "0.1 x 7 Rx 1 00", "0.1 1 1G Rx 1 00", "0.1 1 7 RX 1 00", "0.1 1 7 Rx 1 ZZ", "0.000000 Start of measurement",
        "0.5 0 1fX tx 8 ff", "0.25 257 7 Rx 2 01 02 03 04 05 06 07 08 09", "  1 2 10 Rx 0",
    ]
    got = asc.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["valid"] for r in got] == [False] * 9 + [True] * 3
    assert [(r["t_us"], r["channel"], r["id"], r["extended"], r["dlc"], bytes(r["data"]).hex(), r["dir"]) for r in got[9:]] == [
        (500000, 0, 31, True, 8, "ff" + "00" * 7, "Tx"), (250000, 0, 7, False, 2, "0102030405060708", "Rx"), (1000000, 1, 16, False, 0, "00" * 8, "Rx")
    ]


def test_catalogue_text_gives_the_demo_rows(spark):
    texts = spark.createDataFrame([(f"demo{c}.dbc", fx.dbc_text(c) + "\nBO_ 5 Old: 1 A\n SG_ X : 0|1@1+ (1,0) [0|1] \"\" B\nBO_ 5 New: 2 A\n") for c in (0, 1)], "path string, value string")
    m, s, n = catalogue.parse(catalogue.lines_of(texts))
    bound = catalogue.bind(fx.buses(spark), m).where("id <> 5")
    assert sorted(bound.select("channel", "id", "extended", "name", "dlc", "transmitter").where("id is not null").collect()) == sorted(fx.messages(spark).collect())
    assert [r["name"] for r in m.where("id = 5").collect()] == ["New", "New"] and s.where("id = 5").count() == 0
    got = catalogue.bind(fx.buses(spark), s).where("id is not null").select(fx.signals(spark).columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, fx.signals(spark).collect()))
    assert n.count() == 8 and catalogue.bind(fx.buses(spark), m).where("channel = 2 and id is null").count() == 1


def test_encode_decode_identity_and_overlap(spark, sf):
    f = fx.frames_from_events(spark, sf)
    s, m = fx.signals(spark), fx.messages(spark)
    writes = series.decode(f, s).select(F.col("seq").alias("frame"), "channel", "id", "ord", "signal", F.col("value").alias("phys"))
    got = {r["frame"]: bytes(r["data"]) for r in encode.encode_batch(writes, s, m).collect()}
    want = {r["seq"]: bytes(r["data"]) for r in f.join(m.select("channel", "id"), ["channel", "id"]).collect()}
    assert got == want
    two = spark.createDataFrame([(1, 0, 272, 2, "Level", 1.0), (1, 0, 272, 1, "Level", 2.0), (1, 0, 272, 3, "Nope", 2.0)], "frame int, channel int, id long, ord int, signal string, phys double")
    assert bytes(encode.encode_batch(two, s, m).first()["data"])[:2] == bytes([100, 0]) and encode.rejected(two, s).count() == 1


def test_as_of(spark):
    kept = spark.createDataFrame([("r", 0, 1, "s", k, t, v) for k, (t, v) in enumerate([(5, 1.0), (5, 2.0), (30, 3.0)])], "run_id string, channel int, id long, signal string, seq long, t_us long, value double")
    probes = spark.createDataFrame([("r", 0, 1, "s", t) for t in (-1, 0, 5, 29, 30, 99)], "run_id string, channel int, id long, signal string, t_us long")
    for bucket in (4, 1000):
        assert {r["t_us"]: r["value"] for r in series.as_of(kept, probes, bucket).collect()} == {-1: None, 0: None, 5: 2.0, 29: 2.0, 30: 3.0, 99: 3.0}


def test_history_keeps_the_newest_samples(spark):
    kept = spark.createDataFrame([("r", 0, i, "s", k, k, float(k)) for i in (1, 2) for k in range(5 + i)], "run_id string, channel int, id long, signal string, seq long, t_us long, value double")
    assert sorted((r["id"], r["seq"]) for r in series.history(kept, 3).collect()) == [(1, 3), (1, 4), (1, 5), (2, 4), (2, 5), (2, 6)]


def test_rates_fill_gaps_and_start_late(spark):
    f = frames(spark, [(1, 1_200_000, 0, 1), (2, 1_300_000, 1, 1), (3, 3_100_000, 0, 1)])
    assert [(r["w"], r["frames"], r["rate"]) for r in rates.frame_rate(f, from_zero=True).orderBy("w").collect()] == [(0, 0, 0.0), (1, 2, 2.0), (2, 0, 1.8), (3, 1, 1.72)]
    assert [r["bits"] for r in rates.bus_load(f, from_zero=True).orderBy("w").collect()] == [0, 222, 0, 111]
    assert [(r["w"], r["rate"]) for r in rates.frame_rate(f).orderBy("w").collect()] == [(1, 2.0), (2, 1.8), (3, 1.72)]


def test_rates_of_times_since_the_epoch_and_long_gaps(spark):
    start = 1_700_000_000_000_000
    f = frames(spark, [(1, start, 0, 1), (2, start + 5_000_000, 1, 1), (3, start + 3_000_000_000, 0, 1)])
    got = rates.bus_load(f).orderBy("w").collect()
    value, want = None, []
    for w in range(3001):
        v = (111 if w in (0, 5, 3000) else 0) / 500_000 * 100
        value = v if value is None else 0.9 * value + 0.1 * v
        want.append((1_700_000_000 + w, round(value, 6)))
    assert [(r["w"], round(r["load"], 6)) for r in got] == want


def test_scanned_logs_feed_every_cycle_operator(spark, tmp_path):
    rows = random_rows(300)
    f = frames(spark, rows)
    asc.write_runs(f, str(tmp_path / "logs"), header=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")  # several blocks of a file
    try:
        back = asc.scan(spark, str(tmp_path / "logs"))
        assert back.rdd.getNumPartitions() > 3
        assert [(r["t_us"], r["channel"], r["id"]) for r in back.orderBy("seq").collect()] == [r[1:4] for r in sorted(rows)]
        for op in (aggregate.cycle_stats, aggregate.summary):
            assert sorted(map(tuple, op(back).drop("run_id").collect())) == sorted(map(tuple, op(f).drop("run_id").collect()))
        assert aggregate.cycle_running(back, 50).count() == aggregate.cycle_delta(back, 50).count() == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rings_and_views_are_per_run(spark):
    rows = [("a", s, s, s % 2, 816 if s % 2 == 0 else 7, False, 8, bytes(8), "Rx") for s in range(30)] + [("b", 100 + s, s, s % 2, 200, False, 8, bytes(8), "Rx") for s in range(9)]
    f = spark.createDataFrame(rows, schema.FRAMES)
    for bucket in (4, 1 << 17):
        got = views.newest(f, 10, bucket).groupBy("run_id").agg(F.min("seq").alias("lo"), F.count("*").alias("n")).orderBy("run_id").collect()
        assert [tuple(r) for r in got] == [("a", 20, 10), ("b", 100, 9)]
    shown = views.trace_view(f, fx.messages(spark), View(scope=1), ring=10, shown=3).collect()
    assert sorted(r["seq"] for r in shown) == [25, 27, 29, 103, 105, 107]
    counts = views.view_counts(aggregate.message_agg(f), fx.messages(spark), fx.VIEWS)
    assert {r["view"]: (r["messages"], r["frames"]) for r in counts.collect()}["empty"] == (0, 0) and counts.count() == len(fx.VIEWS)


def test_viewport_defaults_and_flat_ranges(spark):
    kept = spark.createDataFrame([("r", 0, 1, s, k, t, v) for k, (s, t, v) in enumerate([("a", 5, 2.0), ("b", 50, 3.0), ("b", 60, 3.0 + 1e-10), ("c", 50, 1.0), ("c", 60, 4.0)])], "run_id string, channel int, id long, signal string, seq long, t_us long, value double")
    got = {r["signal"]: (r["lo"], r["hi"]) for r in series.viewport(kept, 10, shared=False).collect()}
    assert got == {"a": (0.0, 1.0), "b": (3.0, 4.0), "c": (1.0, 4.0)}
    assert [tuple(r) for r in series.viewport(kept, 10).collect()] == [("r", 1.0, 4.0)] and [tuple(r) for r in series.viewport(kept, 99).collect()] == [("r", 0.0, 1.0)]


def test_encoding_of_overlapping_fields_and_bases(spark):
    s = spark.createDataFrame([(0, 1, k, n, a, z, big, False, 1.0, 0.0, 0.0, 0.0, "", []) for k, (n, a, z, big) in enumerate([("A", 0, 8, False), ("B", 4, 8, False), ("C", 23, 12, True)])], schema.SIGNALS)
    m = spark.createDataFrame([(0, 1, False, "M", 8, "")], schema.MESSAGES)
    w = spark.createDataFrame([(1, 0, 1, 1, "A", 255.0), (1, 0, 1, 2, "B", 0.0), (2, 0, 1, 2, "A", 255.0), (2, 0, 1, 1, "B", 0.0), (3, 0, 1, 1, "C", 2748.0)], "frame int, channel int, id long, ord int, signal string, phys double")
    base = spark.createDataFrame([(1, b"\xff" * 8), (3, b"\xff" * 8)], "frame int, data binary")
    assert {r["frame"]: bytes(r["data"]).hex() for r in encode.encode_batch(w, s, m).collect()} == {1: "0f00" + "00" * 6, 2: "ff00" + "00" * 6, 3: "0000abc0" + "00" * 4}
    assert {r["frame"]: bytes(r["data"]).hex() for r in encode.encode_batch(w, s, m, base).collect()} == {1: "0ff0" + "ff" * 6, 2: "ff00" + "00" * 6, 3: "ffffabcf" + "ff" * 4}


def test_sets(spark):
    k = lambda *x: spark.createDataFrame(list(x), "channel int, id long")
    assert sorted(map(tuple, topology.selection_update(k((0, 1), (0, 2)), k((0, 2), (0, 3)), k((0, 1))).collect())) == [(0, 2), (0, 3)]


def test_runs_are_kept_apart(spark):
    rows = [("a", 1, 10, 0, 5), ("a", 2, 30, 0, 5), ("b", 3, 35, 0, 5)]
    f = spark.createDataFrame([(*r, False, 8, bytes(8), "Rx") for r in rows], schema.FRAMES)
    got = {r["run_id"]: (r["count"], r["share"], r["cycle_avg_ms"]) for r in aggregate.statistics(f, fx.messages(spark)).collect()}
    assert got == {"a": (2, 100.0, 0.02), "b": (1, 100.0, 0.0)}
    assert {r["run_id"] for r in series.thin(f, 50).collect()} == {"a", "b"} and rates.frame_rate(f).count() == 2


def test_strict_scan_and_csv(spark, tmp_path):
    from canlake.operators import export

    lines = spark.createDataFrame([("0.1 1 7 Rx d 8 01",), ("0.1 1 7 Rx 8 01",)], "value string")
    assert asc.parse_lines(lines).where("valid").count() == 2 and asc.parse_lines(lines, strict=True).where("valid").count() == 1
    f = frames(spark, [(1, 1, 0, 816, False, 3, bytes([1, 2, 3, 0, 0, 0, 0, 0]), "Rx"), (2, 5, 3, 7)])
    export.write_csv(export.messages_rows(f, fx.messages(spark), fx.buses(spark)), str(tmp_path / "csv"))
    got = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("bus").collect()
    assert [tuple(r) for r in got] == [("CAN1", "816", "StopInfo", "Rx", "1", "0.0", "3", "01 02 03"), ("CAN4", "7", "-", "Rx", "1", "0.0", "8", "00 00 00 00 00 00 00 00")]


def test_empty_frames(spark):
    f = frames(spark, [(1, 1, 0, 1)]).limit(0)
    m, s = fx.messages(spark), fx.signals(spark)
    for out in (aggregate.statistics(f, m), aggregate.cycle_running(f), series.samples(f, s), series.latest(f, s), rates.bus_load(f), views.trace(f, m, View(text="a"))):
        assert out.count() == 0
    assert {r["active"] for r in topology.node_activity(fx.nodes(spark), m, aggregate.message_agg(f)).collect()} == {False}
