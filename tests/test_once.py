"""What is costly is done once for a row, however plans are merged."""

from pyspark.sql import functions as F

from canlake.operators import rates
from canlake.plans import catalog
from canlake.plans import fixtures as fx
from canlake.sources import asc


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_cut_and_judged_once(spark):
    lines = spark.createDataFrame([(1, "0.5  1  110  Rx  2  5A 0"), (2, "junk")], "seq long, value string")
    frames = asc.parse_lines(lines).where("valid")
    assert plan(frames).count("split(") == 1
    assert frames.select("seq", "t_us", "channel", "id", "dlc", F.hex("data"), "dir").collect() == [(1, 500000, 0, 272, 2, "5A00000000000000", "Rx")]


def test_scanned_logs_are_cut_once_for_each_read(spark, sf):
    for name, reads in (("scan_cycle_delta", 2), ("scan_statistics", 2), ("scan_message_agg", 1)):
        assert plan(catalog.QUERIES[name](spark, sf)).count("split(") <= reads, name


def test_rates_read_frames_four_times_at_most(spark, sf):
    assert plan(rates.frame_rate(fx.frames_from_events(spark, sf))).count("Relation [") <= 4
    assert plan(catalog.frame_rate_wild(spark, sf)).count("split(") <= 4
