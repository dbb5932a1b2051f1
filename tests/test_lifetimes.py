"""Streams of several runs, their lifetimes, rings, growing files; what they give equals the batch."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from canlake import schema
from canlake.operators import aggregate, rates, series, views
from canlake.plans import fixtures as fx
from canlake.sources import asc
from canlake.streaming import folds, source


def frame(run, seq, t, channel=0, id_=272):
    return (run, seq, t, channel, id_, False, 8, bytes([seq % 256] * 8), "Rx")


def stream_of(spark, folder, batches):
    """One file per batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema.FRAMES).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return spark.readStream.schema(schema.FRAMES).option("maxFilesPerTrigger", 1).parquet(folder)


def start(df, name, mode, tmp_path, **trigger):
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(**(trigger or {"availableNow": True})).start()


def run(df, name, mode, tmp_path):
    start(df, name, mode, tmp_path).awaitTermination(240)


def three_runs():
    """Three runs that all begin at 0, with lengths of 100, 300 and 200 windows, one after another, the last two mixed."""
    rnd = random.Random(3)
    rows = {r: [frame(r, 0, k * 100_000 + rnd.randrange(50_000)) for k in range(10 * n)] for r, n in (("a", 100), ("b", 300), ("c", 200))}
    rows["c"][700:] = [r[:2] + (r[2] + 40_000_000,) + r[3:] for r in rows["c"][700:]]
    order = [*rows["a"], *rows["b"][:500]]
    rest = [rows["b"][500:], rows["c"]]
    while any(rest):
        some = rest[rnd.randrange(2)]
        order.append(some.pop(0) if some else max(rest, key=len).pop(0))
    return [(r[0], k, *r[2:]) for k, r in enumerate(order)]


def test_rates_of_several_runs_lose_nothing(spark, tmp_path):
    rows = three_runs()
    size = len(rows) // 5 + 1
    stream = stream_of(spark, str(tmp_path / "in"), [rows[k : k + size] for k in range(0, len(rows), size)])
    q = start(folds.smoothed_rates(stream, late="3 seconds", idle="4 seconds"), "runs", "append", tmp_path, processingTime="500 milliseconds")
    f = spark.createDataFrame(rows, schema.FRAMES)
    want = {(r["run_id"], r["w"]): r for r in rates.frame_rate(f).join(rates.bus_load(f), ["run_id", "w"]).collect()}
    try:
        for _ in range(120):
            time.sleep(1)
            if spark.table("runs").count() >= len(want):
                break
        time.sleep(3)
        got = {(r["run_id"], r["w"]): r for r in spark.table("runs").collect()}
    finally:
        q.stop()
    assert set(got) == set(want) and spark.table("runs").count() == len(want)
    for k, r in want.items():
        g = got[k]
        assert g["late"] is None and (g["frames"], g["bits"]) == (r["frames"], r["bits"]) and abs(g["rate"] - r["rate"]) < 2e-6 and abs(g["load"] - r["load"]) < 2e-6


def test_late_frames_are_counted(spark, tmp_path):
    batches = [[frame("a", k, k * 1_000_000) for k in range(20)], [frame("a", 20, 2_500_000), frame("a", 21, 2_600_000), frame("a", 22, 18_500_000), frame("b", 23, 0)]]
    run(folds.smoothed_rates(stream_of(spark, str(tmp_path / "in"), batches), late="4 seconds"), "lates", "append", tmp_path)
    rows = spark.table("lates").collect()
    assert [(r["run_id"], r["w"], r["late"]) for r in rows if r["late"] is not None] == [("a", 2, 2)]
    assert sorted(r["w"] for r in rows if r["late"] is None) == list(range(15))


def test_state_goes_with_its_run(spark, tmp_path):
    folder = str(tmp_path / "in")
    stream = stream_of(spark, folder, [[frame(r, k, k * 1000, id_=i) for r in "ab" for i in range(20) for k in (1, 2)]])
    q = start(folds.message_fold(stream, forget="2 seconds"), "forgets", "update", tmp_path, processingTime="500 milliseconds")
    sizes = []
    try:
        for k in range(40):
            time.sleep(1)
            if k in (3, 8, 12, 16):
                spark.createDataFrame([frame("c", 100 + k, 0)], schema.FRAMES).coalesce(1).write.mode("append").parquet(folder)
            sizes += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
            if k > 8 and sizes and sizes[-1] <= 2 < max(sizes):
                break
    finally:
        q.stop()
    assert max(sizes) >= 40 and sizes[-1] <= 2


def test_batch_then_stream_equals_one_batch(spark, tmp_path):
    rnd = random.Random(5)
    rows = [frame("r", k, max(0, k * 20_000 + rnd.randrange(-90_000, 90_000)), 0, rnd.choice([272, 528, 816])) for k in range(600)] + [frame("r", 600, 1, 1, 200)]
    whole, before = spark.createDataFrame(rows, schema.FRAMES), spark.createDataFrame(rows[:350], schema.FRAMES)
    stream = stream_of(spark, str(tmp_path / "in"), [rows[350:480], rows[480:]])
    run(folds.message_fold(stream, aggregate.fold_state(before)), "goes_on", "update", tmp_path)
    got = spark.sql("select channel, id, max_by(struct(count, extended, dir, dlc, data, last_t_us, cycle_min_ms, cycle_avg_ms, cycle_max_ms), count) s from goes_on group by channel, id").select("channel", "id", "s.*")
    want = aggregate.summary(whole).select(got.columns)
    near = lambda df: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert near(got) == near(want)
    kept = series.thin(before).groupBy(*schema.KEY).agg(F.max_by("t_us", "seq").alias("t"))
    run(folds.sample_stream(stream, fx.signals(spark), initial=kept), "samples_on", "append", tmp_path)
    assert sorted(spark.table("samples_on").collect()) == sorted(series.samples(whole, fx.signals(spark)).where("seq >= 350").collect())


def test_rings_of_a_stream_equal_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folds.Ring, "CHUNK", 64)
    rows = [frame("ab"[k % 3 == 0], k, k * 1000, 0, 272) for k in range(1500)]
    random.Random(1).shuffle(rows)
    stream = stream_of(spark, str(tmp_path / "in"), [rows[k : k + 400] for k in range(0, 1500, 400)])
    run(folds.trace_stream(stream, 300), "ring", "append", tmp_path)
    f = spark.createDataFrame(rows, schema.FRAMES)
    got = folds.in_ring(spark.table("ring"), ["run_id"])
    assert sorted(r["seq"] for r in got.collect()) == sorted(r["seq"] for r in views.newest(f, 300).collect())
    kept = [("r", 0, 272, s, k, k, float(k)) for k in range(900) for s in ("x", "y")]
    kind = "run_id string, channel int, id long, signal string, seq long, t_us long, value double"
    folder = str(tmp_path / "samples")
    for k in range(0, 1800, 600):
        spark.createDataFrame(kept[k : k + 600], kind).coalesce(1).write.mode("append").parquet(folder)
    run(folds.history_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder), 250), "samples_ring", "append", tmp_path)
    got = folds.in_ring(spark.table("samples_ring"), series.SERIES)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, series.history(spark.createDataFrame(kept, kind), 250).collect()))


@pytest.mark.parametrize("options", [{}, {"partBytes": 37}])
def test_growing_files_are_read_once(spark, tmp_path, options):
    folder, lines = tmp_path / "logs", [f"{k}.5 1 {k % 9} Rx 1 0{k % 9}" + " " * (k % 13) for k in range(400)]
    os.makedirs(folder)
    texts = {"a.asc": lines[:250], "b.asc": lines[250:]}

    def append(name, data):
        with open(folder / name, "ab") as f:
            f.write(data)

    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def go():
        rows = source.lines_stream(spark, str(folder), 900, checkpoint + "/planned.json", settledSeconds=3600, **options)
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        q.processAllAvailable()
        batches = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        q.stop()
        return batches

    append("a.asc", "\n".join(texts["a.asc"][:100]).encode()[:-3])
    append("b.asc", ("\r\n".join(texts["b.asc"]) + "\r\n").encode())
    assert len(go()) > 3  # several batches of at most 900 bytes
    whole = ("\n".join(texts["a.asc"]) + "\n").encode()
    append("a.asc", whole[len("\n".join(texts["a.asc"][:100]).encode()) - 3 :])
    go()
    got = sorted((os.path.basename(r["run_id"]), r["seq"], r["value"]) for r in spark.read.parquet(out).collect())
    want = []
    for name, end in (("a.asc", 1), ("b.asc", 2)):
        at = 0
        for line in texts[name]:
            want.append((name, at, line))
            at += len(line) + end
    assert got == sorted(want)


def test_recorded_runs_come_back(spark, tmp_path):
    rows = [frame(r, k, k * 1000 + j, j % 2, 272 + j) for k in range(60) for j, r in enumerate(["001", "a/b c", "z"])]
    rows = [(r[0], k, *r[2:]) for k, r in enumerate(rows)]
    stream = stream_of(spark, str(tmp_path / "in"), [rows[:70], rows[70:120], rows[120:]])
    folds.record(stream, str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    back = asc.scan_recorded(spark, str(tmp_path / "log"))
    by = lambda df: [tuple(r) for r in df.orderBy("run_id", "seq").select("run_id", "t_us", "channel", "id", F.hex("data")).collect()]
    assert by(back) == by(spark.createDataFrame(rows, schema.FRAMES))
