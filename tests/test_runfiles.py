"""Logs of many runs: what each file costs besides its lines."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from canlake import schema
from canlake.plans import catalog
from canlake.sources import asc
from canlake.sources.shared import shared_folder


def told(df):
    return sorted(df.select("t_us", "channel", "id", "extended", "dlc", F.hex("data").alias("data"), "dir").collect())


def runs(spark, names):
    rows = [(n, 2 * k + s, s, 0, 816, False, 8, bytes([s + 1] * 8), "Rx") for k, n in enumerate(names) for s in range(2)]
    return spark.createDataFrame(rows, schema.FRAMES)


def test_short_logs_are_written_listed_and_read_by_few_tasks(spark, tmp_path):
    f, path = runs(spark, [f"r{k}" for k in range(700)]), str(tmp_path / "logs")
    asc.write_runs(f, path, header=True)
    assert len(glob.glob(f"{path}/run_id=*/part-*")) == 700
    assert not glob.glob(f"{path}/run_id=*/.*.crc") and not os.path.exists(f"{path}/_temporary")  # Spark's writer starts processes for them
    sc = spark.sparkContext
    sc.setJobGroup("listing", "")
    back = asc.scan(spark, path)
    sc.setJobGroup("others", "")
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("listing")]
    tasks = [sc.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert tasks and max(tasks) <= asc.LISTERS * sc.defaultParallelism and spark.conf.get(asc.LISTING) == "10000"
    assert back.rdd.getNumPartitions() <= asc.LISTERS * sc.defaultParallelism < 700 // 32
    assert told(back) == told(f)
    assert back.groupBy("run_id").agg(F.countDistinct("seq").alias("n")).where("n = 2").count() == 700
    with pytest.raises(Exception, match="logs"):
        asc.write_runs(f, path)


def test_folders_are_named_as_partitions_are(spark, tmp_path):
    f = runs(spark, ["a b", "x=1/2", "é%", "[q]", "{z}^", None, ""])
    asc.write_runs(f, str(tmp_path / "logs"))
    f.select("run_id", "dir").write.partitionBy("run_id").text(str(tmp_path / "plain"))
    names = [sorted(os.path.basename(x) for x in glob.glob(f"{tmp_path}/{d}/run_id=*")) for d in ("logs", "plain")]
    assert names[0] == names[1] and len(names[0]) == 6
    assert asc.scan(spark, str(tmp_path / "logs")).count() == 14


def test_other_file_systems_take_sparks_writer(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.runs.link./in", f"file://{tmp_path}")
    f = runs(spark, ["a", "b"])
    asc.write_runs(f, "viewfs://runs/in/logs", header=True)
    assert told(asc.scan(spark, "viewfs://runs/in/logs")) == told(f)


def test_odd_bytes_are_judged_as_before(spark):
    odd = [("5A", True, "5A"), ("a 00F 0000ff", True, "0A0FFF"), ("5A\u0085 1", True, "5A01"), ("100", False, None), ("ZZ", False, None), ("5A\u0085\u0085", False, None), ("", True, "")]
    lines = spark.createDataFrame([(k, f"0.5 1 7 tx 8 {b}") for k, (b, *_) in enumerate(odd)], "seq long, value string")
    got = [(r["valid"], r["data"]) for r in asc.parse_lines(lines).orderBy("seq").select("valid", F.hex("data").alias("data")).collect()]
    assert got == [(ok, data.ljust(16, "0") if ok else None) for _, ok, data in odd]
    assert "forall" not in asc.parse_lines(lines)._jdf.queryExecution().optimizedPlan().toString()


#: Queries on scanned logs.
SCANS = ["scan_cycle_delta", "scan_statistics", "scan_message_agg"]


@pytest.mark.parametrize("name", SCANS)
def test_scan_queries_take_the_short_way(spark, sf, name):
    def logs():
        return set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/logs-*"))

    before = logs()
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    (made,) = logs() - before
    assert len(glob.glob(f"{made}/run_id=*/part-*")) == 3 and not glob.glob(f"{made}/run_id=*/.*.crc")
    assert "Repartition" in plan and "forall" not in plan


def test_statistics_read_the_logs_once(spark, sf):
    plan = catalog.QUERIES["scan_statistics"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan text") == 1


def test_usual_lines_are_told_by_one_pattern(spark):
    made = asc.render(runs(spark, ["a", "b"])).select("value")
    lines = made.unionByName(spark.createDataFrame([("9999999999.999999  256  1FFFFFFFx  Tx  0",), ("0.000000 1 7 Rx 8 00 11 22 33 44 55 66 77",)], "value string"))
    assert lines.where(F.col("value").rlike(asc.USUAL)).count() == 6 == asc.parse_lines(lines, strict=True).where("valid").count()
    odd = ["99999999999.999999  1  7  Rx  0", "0.5  1  7  Rx  0", "0.000000  1  7  Rx  9", "0.000000  1  7  Rx  d", "0.000000  1  7  Rx  1  5", "0.000000\t1  7  Rx  0", "0.000000  1  7  Rx  0\n"]
    odd = spark.createDataFrame([(k, v) for k, v in enumerate(odd)], "k int, value string")
    assert not odd.where(F.col("value").rlike(asc.USUAL)).count()
    assert [r["valid"] for r in asc.parse_lines(odd).orderBy("k").collect()] == [False] + [True] * 6
    plan = asc.parse_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(value" not in plan and plan.count(asc.USUAL) == 1
