"""The frame store, exports that report, load reports, wild times, and workers that can't import the package."""

import os
import random
import subprocess
import sys

from pyspark.sql import functions as F

from canlake import schema
from canlake.operators import aggregate, export, rates, series, views
from canlake.operators.views import View
from canlake.plans import fixtures as fx
from canlake.sources import asc, catalogue, store


def frames(spark, rows):
    return spark.createDataFrame([("r", *r, *(False, 8, bytes(8), "Rx")[len(r) - 4 :]) for r in rows], schema.FRAMES)


def greedy(rows, gap):
    kept, last = set(), {}
    for seq, t, *key in sorted(rows):
        if tuple(key) not in last or t >= last[tuple(key)] + gap:
            last[tuple(key)] = t
            kept.add(seq)
    return kept


def test_thinning_in_any_buckets_equals_the_fold(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        spread, n = rnd.choice([(0, 900), (3000, 900), (40_000, 700), (500, 1200)])
        rows = [(s, max(0, s * rnd.choice([100, 900]) + rnd.randrange(-spread - 1, spread + 1)), 0, rnd.choice([1, 1, 1, 1, 2])) for s in range(n)]
        rows += [(n + k, 0 if k % 2 else 10**9 + k, 0, 1) for k in range(9)]
        f = frames(spark, rows)
        for bucket, gap in ((1, 5000), (7, 5000), (64, 20_000), (500, 0)):
            assert {r["seq"] for r in series.thin(f, gap, bucket).collect()} == greedy(rows, gap), (seed, bucket, gap)
    marked = series.thin(f, 5000, 64, mark="kept").collect()
    assert len(marked) == len(rows) and {r["seq"] for r in marked if r["kept"]} == greedy(rows, 5000)


def test_jump_maps_of_unordered_times():
    import numpy as np

    rnd = random.Random(9)
    for _ in range(200):
        t = np.array([rnd.randrange(60) for _ in range(rnd.randrange(1, 40))])
        gap, before = rnd.randrange(0, 20), rnd.randrange(60)
        after = series.following(t, gap).tolist()
        assert after == [next((j for j in range(i + 1, len(t)) if t[j] >= t[i] + gap), len(t)) for i in range(len(t))]
        bounds, ends = series.jump_map(t, before, gap)
        for last in range(before - gap + 1, before + 1):
            want = last
            for x in t.tolist():
                want = x if x >= want + gap else want
            at = next((k for k, b in enumerate(bounds) if b >= last + gap), None)
            assert (last if at is None else ends[at]) == want or gap == 0


def test_store_is_pruned_and_needs_no_shuffle(spark, sf):
    f = fx.frames_from_events(spark, sf).unionByName(fx.frames_from_events(spark, sf).withColumn("run_id", F.lit("r1")).withColumn("t_us", F.col("t_us") + 7_000_000))
    spark.sql("drop table if exists stored_frames")
    store.write(f, "stored_frames", slot_us=5_000_000, buckets=4)
    try:
        back = store.frames(spark, "stored_frames")
        cols = [*schema.KEY, "seq", "t_us", "extended", "dlc", F.hex("data"), "dir"]
        assert sorted(back.select(cols).collect()) == sorted(f.select(cols).collect())
        agg = aggregate.message_agg(back)
        plan = agg._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and sorted(agg.collect()) == sorted(aggregate.message_agg(f).collect())
        some = store.frames(spark, "stored_frames", "r1", 12_000_000, 16_000_000, slot_us=5_000_000)
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and plan.count("slot") > 2 and len(some.inputFiles()) < len(back.inputFiles()) / 4
        read = {r["f"] for r in some.select(F.input_file_name().alias("f")).distinct().collect()}
        assert read and all("run_id=r1" in x and x.split("slot=")[1][0] in "23" for x in read)
        want = series.samples(f, fx.signals(spark)).where("run_id = 'r1' and t_us between 12000000 and 16000000")
        assert sorted(store.samples(some, fx.signals(spark)).collect()) == sorted(want.collect())
        seen = series.viewport(store.samples(some, fx.signals(spark)), 12_000_000, shared=False)
        assert sorted(seen.collect()) == sorted(series.viewport(want, 12_000_000, shared=False).collect())
    finally:
        spark.sql("drop table stored_frames")


def test_exports_say_what_they_did(spark, tmp_path):
    m = fx.messages(spark)
    f = frames(spark, [(k, k * 1000, k % 2, 816 if k % 2 == 0 else 7, False, 3, bytes(8), "Rx") for k in range(50)])
    path = str(tmp_path / "trace.asc")
    done = export.export_trace(f, m, View(text="stop"), path, limit=20)
    assert (done.rows, done.of, done.status) == (10, 20, f"exported 10 of 20 frames to {path}")
    with open(path) as x:
        lines = x.read().splitlines()
    assert lines[:4] == asc.HEADER and [float(x.split()[0]) for x in lines[4:]] == [k / 1000 for k in range(30, 50, 2)]
    none = export.export_trace(f, m, View(text="nothing"), str(tmp_path / "none.asc"))
    assert none.status == "export: no frames pass the trace filter" and not os.path.exists(tmp_path / "none.asc")
    assert export.export_trace(f.limit(0), m, View(), str(tmp_path / "none.asc")).status == "export: trace is empty"
    csv = str(tmp_path / "stats.csv")
    assert export.export_csv(export.stats_rows(f, m, fx.buses(spark)), csv).rows == 2
    with open(csv) as x:
        assert x.read().splitlines()[0] == "bus,id,name,count,cycle_min_ms,cycle_avg_ms,cycle_max_ms,dlc"
    assert {x for x in os.listdir(tmp_path) if not x.startswith(".")} == {"trace.asc", "stats.csv"}


def test_load_report_of_files(spark, tmp_path):
    (tmp_path / "good.dbc").write_text(fx.dbc_text(0))
    (tmp_path / "empty.dbc").write_text("")
    (tmp_path / "bytes.dbc").write_bytes(b"BO_ 1 A: 8 B\n\xff\xfe")
    (tmp_path / "half.dbc").write_text('BO_ 1 A: 8 B\n SG_ S : x|8@1+ (1,0) [0|0] "" C\nBO_ x\n')
    at = lambda n: f"file:{tmp_path}/{n}.dbc"
    buses = spark.createDataFrame([(k, None, at(n)) for k, n in enumerate(["good", "empty", "bytes", "half", "gone"])] + [(5, None, "  ")], schema.BUSES)
    got = {r["channel"]: (r["status"], r["messages"], r["signals"], r["rejects"]) for r in catalogue.report(buses, catalogue.files(spark, str(tmp_path))).collect()}
    assert got == {0: ("loaded", 4, 20, 0), 1: ("no messages", 0, 0, 0), 2: ("not text", 0, 0, 0), 3: ("loaded", 1, 0, 2), 4: ("missing", 0, 0, 0), 5: ("no path", 0, 0, 0)}


def test_statements_over_lines_in_small_buckets(spark, monkeypatch):
    text = 'VERSION "a\nBO_ 1 X: 8 A\n"\nBU_: A B\n  C\n\tD ;\nBO_ 512 Real: 8 A\n SG_ S1 : 0|8@1+\n  (1,0) [0|1] "u"\n  B,C\nCM_ "say\nBO_ 512 Ghost: 8 A\nSG_ x\n"; \n SG_ S2 : 8|8@1- (1,0) [0|1] "" Vector__XXX\nBU_SG_REL_ x\n'
    want = None
    for size in (1, 2, 5, 1 << 13):
        monkeypatch.setattr(catalogue, "LINES", size)
        m, s, n = catalogue.parse(catalogue.lines_of(spark.createDataFrame([("p", text)], "path string, value string")))
        got = ([(r["id"], r["name"]) for r in m.collect()], sorted((r["signal"], r["start_bit"], tuple(r["receivers"])) for r in s.collect()), [r["node"] for r in n.orderBy("ord").collect()])
        want = want or got
        assert got == want == ([(512, "Real")], [("S1", 0, ("B", "C")), ("S2", 8, ())], ["A", "B", "C", "D"])


def test_wild_times_harm_no_other_run(spark):
    lines = spark.createDataFrame([("a", 1, "1e30 1 100 Rx 0"), ("a", 2, "0.5 1 100 Rx 0"), ("a", 3, "9e10 1 100 Rx 0"), ("b", 4, "2.5 1 100 Rx 0")], "run_id string, seq long, value string")
    got = asc.parse_lines(lines)
    assert [r["seq"] for r in got.where("not valid").collect()] == [1]
    rate = rates.frame_rate(got.where("valid"), quiet=5000).groupBy("run_id").agg(F.count("*").alias("n"), F.max_by("rate", "w").alias("last")).collect()
    assert {r["run_id"]: (r["n"], r["last"]) for r in rate} == {"a": (5002, 1.0), "b": (1, 1.0)}


def test_small_is_counted_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(aggregate, "BROADCAST_ROWS", 100)
    path = str(tmp_path / "t")
    hinted = lambda df: "hint" in aggregate.broadcast_if_small(df)._jdf.queryExecution().logical().toString().lower()
    spark.range(10).write.parquet(path)
    assert hinted(spark.read.parquet(path))
    spark.range(300).write.mode("overwrite").parquet(path)
    assert not hinted(spark.read.parquet(path)) and hinted(spark.createDataFrame([(1,)], "a int"))


def test_last_bus_stays(spark):
    import pytest

    one = {"buses": spark.createDataFrame([(0, "A", "x")], schema.BUSES)}
    with pytest.raises(ValueError, match="last bus"):
        views.drop_bus_everywhere(one, {}, 0)


SHIP = """
import os, sys, tempfile
sys.path.insert(0, {repo!r})
os.chdir(tempfile.mkdtemp())
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.local.dir", {tmp!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from canlake.plans import catalog
import canlake.streaming.folds as folds
from canlake import schema
for name in ("cycle_running", "signal_samples", "cursor_values", "viewport"):
    assert catalog.queries()[name](spark, {sf!r}).count() > 0
f = catalog.queries and catalog._frames(spark, {sf!r})
f.write.parquet({tmp!r} + "/in")
s = spark.readStream.schema(schema.FRAMES).parquet({tmp!r} + "/in")
spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
for k, (df, mode) in enumerate([(folds.message_fold(s), "update"), (folds.smoothed_rates(s), "append")]):
    q = df.writeStream.format("memory").queryName("q%d" % k).outputMode(mode).option("checkpointLocation", {tmp!r} + "/c%d" % k).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert spark.table("q%d" % k).count() > 0
print("shipped")
"""


def test_workers_need_no_package(sf, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SHIP.format(repo=repo, sf=sf, tmp=str(tmp_path))], capture_output=True, text=True, timeout=600, cwd="/", env=env)
    assert "shipped" in done.stdout, done.stderr[-3000:]
