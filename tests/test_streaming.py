from canlake import schema
from canlake.operators import aggregate, rates, series
from canlake.plans import fixtures as fx
from canlake.sources import asc
from canlake.streaming import folds


def parts(spark, sf, folder, n=3):
    """The frames as n Parquet files in arrival order."""
    f = fx.frames_from_events(spark, sf).persist()
    size = -(-f.count() // n)
    for k in range(n):
        f.where(f"seq >= {k * size} and seq < {(k + 1) * size}").coalesce(1).write.mode("append").parquet(folder)
    return f, spark.readStream.schema(schema.FRAMES).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)


def test_message_fold_equals_batch(spark, sf, tmp_path):
    f, stream = parts(spark, sf, str(tmp_path / "in"))
    run(folds.message_fold(stream), "fold", "update", tmp_path)
    got = spark.sql("select channel, id, max_by(struct(count, extended, dir, dlc, last_t_us, cycle_min_ms, cycle_avg_ms, cycle_max_ms), count) s from fold group by channel, id").select("channel", "id", "s.*")
    want = aggregate.message_agg(f).join(aggregate.cycle_stats(f), schema.KEY).select(got.columns)
    near = lambda df: sorted(tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert near(got) == near(want)


def test_samples_equal_batch(spark, sf, tmp_path):
    f, stream = parts(spark, sf, str(tmp_path / "in"))
    run(folds.sample_stream(stream, fx.signals(spark)), "samples", "append", tmp_path)
    want = series.samples(f, fx.signals(spark))
    assert sorted(spark.table("samples").collect()) == sorted(want.collect())


def test_smoothed_rates_equal_batch(spark, sf, tmp_path):
    f, stream = parts(spark, sf, str(tmp_path / "in"), 6)
    run(folds.smoothed_rates(stream, 1_000_000, "1 seconds"), "smooth", "append", tmp_path)
    got = {r["w"]: (r["frames"], r["bits"], r["rate"], r["load"]) for r in spark.table("smooth").collect()}
    want = rates.frame_rate(f).join(rates.bus_load(f), ["run_id", "w"]).orderBy("w").collect()
    assert sorted(got) == [r["w"] for r in want][: len(got)] and len(got) >= 15
    for r in want[: len(got)]:
        g = got[r["w"]]
        assert g[:2] == (r["frames"], r["bits"]) and abs(g[2] - r["rate"]) < 2e-6 and abs(g[3] - r["load"]) < 2e-6


def test_rates_and_recording(spark, sf, tmp_path):
    f, stream = parts(spark, sf, str(tmp_path / "in"))
    run(folds.rate_stream(stream), "rates", "append", tmp_path)
    assert 0 < spark.sql("select sum(frames) from rates").first()[0] <= f.count()
    whole = {r["w"]: (r["frames"], r["bits"]) for r in rates.windows(f).collect()}
    assert all((r["frames"], r["bits"]) == whole[r["w"]] for r in spark.sql("select unix_micros(window.start) div 1000000 w, frames, bits from rates").collect())
    folds.record(stream, str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    assert asc.scan(spark, str(tmp_path / "log")).count() == f.count()
    replayed = folds.replay_stream(spark, str(tmp_path / "log"))
    run(replayed.select("t_us", "channel", "id"), "replayed", "append", tmp_path)
    assert spark.table("replayed").count() == f.count()
