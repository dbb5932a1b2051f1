"""ASC logs: whole directories in, rows out, and back to text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.sources import runfiles

#: Times from here on, in seconds, are no times (three thousand years).
LAST_S = 1e11
#: Lines that are valid in any case: time below LAST_S, bus, id, direction, dlc up to 8 and that many bytes at most, apart by blanks.
USUAL = r"^[0-9]{1,10}\.[0-9]{6} +[0-9]{1,3} +[0-9A-F]{1,8}x? +(?:Tx|Rx) +[0-8](?: +[0-9A-F]{2}){0,8}\z"


def parse_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """lines(value, ...) -> the same columns with valid and the frame's columns (NULL where valid is false).

    A frame has at least five tokens: time in seconds, bus (from 1), hexadecimal id with an `x` if extended, Tx or Rx,
    hexadecimal dlc, then up to eight hexadecimal bytes; more tokens are ignored. The bus is counted from 0 and wraps
    at 256. Lines with times from LAST_S on are invalid; with strict, those that have `d` or `r` in the dlc's place too.
    """
    tokens = F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0))
    t = F.col("_t")
    tok = lambda i: F.try_element_at(t, F.lit(i + 1))
    number = r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    byte = "0*[0-9A-Fa-f]{1,2}[\\x85\\u2028\\u2029]?"  # a byte's `$` lets such a line end pass
    hexid = F.regexp_replace(tok(2), "[xX]$", "")
    bytes_ = F.slice(t, 6, 8)
    joined = F.array_join(bytes_, " ")  # no token has a blank; a pattern over all bytes is compiled, a lambda is not
    good = (
        (F.size(t) >= 5)
        & tok(0).rlike(number)
        & (tok(0).try_cast("double") < LAST_S)
        & tok(1).rlike(r"^\d{1,10}$")
        & (F.try_to_number(tok(1), F.lit("9999999999")) <= 4294967295)
        & hexid.rlike("^0*[0-9A-Fa-f]{1,8}$")
        & tok(3).isin("Tx", "tx", "Rx", "rx")
        & tok(4).rlike("^0*[0-9A-Fa-f]{1,2}$")
        & joined.rlike(rf"^(?:{byte}(?: {byte})*)?\z")
    )
    if strict:
        good = good & ~tok(4).isin("d", "D", "r", "R")
    # Lines as render_line() makes them are told by one pattern; the others are judged token by token.
    usual = F.col("value").rlike(USUAL)
    kind = F.when(usual, F.lit(2)).when(good, F.lit(1)).otherwise(F.lit(0))
    # A generated row stays as it is when filters and columns above are merged: a line is cut, and judged, once.
    cut = lines.select("*", F.explode(F.array(tokens)).alias("_t"))
    out = cut.select("*", F.explode(F.array(kind)).alias("_kind")).withColumn("valid", F.col("_kind") > 0)
    hexed = lambda c: F.conv(c, 16, 10).cast("bigint")
    us = F.greatest(F.round(tok(0).cast("double") * 1e6), F.lit(0.0))
    two = lambda b: F.when(F.length(b) == 2, b).otherwise(F.lpad(F.regexp_replace(b, "^0+(?=..)", ""), 2, "0"))
    plain = joined.rlike(r"^[0-9A-Fa-f]{2}(?: [0-9A-Fa-f]{2})*\z")
    digits = F.when(F.col("_kind") == 2, F.array_join(bytes_, "")).when(plain, F.replace(joined, F.lit(" "))).otherwise(F.array_join(F.transform(bytes_, two), ""))
    data = F.unhex(F.rpad(digits, 16, "0"))
    made = {
        "t_us": us.cast("bigint"),
        "channel": (F.greatest(tok(1).cast("bigint") - 1, F.lit(0)) % 256).cast("int"),
        "id": hexed(hexid),
        "extended": tok(2).rlike("[xX]$"),
        "dlc": hexed(tok(4)).cast("int"),
        "data": data,
        "dir": F.when(tok(3).isin("Tx", "tx"), "Tx").otherwise("Rx"),
    }
    return out.select(*lines.columns, "valid", *(F.when(F.col("valid"), c).alias(k) for k, c in made.items()))


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """run_id (the file), seq (arrival order within it, a long), value, by one narrow expression on the scan itself.

    A row's number in its partition is less than the bytes that the partition reads, and those are at most what lies
    between the starts of two blocks of a file; so twice the block's start and the row's number go up from line to line
    and from block to block, whichever tasks read them. Numbers have gaps between blocks.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    read = listed(spark, paths)
    lines = read.select(F.col("_metadata.file_path").alias("run_id"), (F.col("_metadata.file_block_start") * 2 + row).alias("seq"), "value")
    return in_fewer_tasks(lines, read)


#: Tasks for each core that list folders; Spark's own number is a task for each folder, up to 10,000, whose start costs more than its list.
LISTERS, LISTING = 4, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Bytes of short files that a task reads at least; Spark counts 4 MB for opening a file, which makes a task of 32 of them.
TASK_BYTES = 16 << 20


def listed(spark: SparkSession, paths) -> DataFrame:
    """Text files of any number of folders, which are listed here, by a few tasks for each core."""
    was = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(was), LISTERS * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.text(paths)
    finally:
        spark.conf.set(LISTING, was)


def in_fewer_tasks(lines: DataFrame, read: DataFrame) -> DataFrame:
    """lines, made from the files of `read`, by fewer tasks if the files are short, so that shuffles don't grow with their number."""
    size = int(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return lines.coalesce(max(-(-size // TASK_BYTES), LISTERS * lines.sparkSession.sparkContext.defaultParallelism))


def scan(spark: SparkSession, paths, strict: bool = False) -> DataFrame:
    return parse_lines(read_lines(spark, paths), strict).where("valid").drop("valid", "value")


def scan_recorded(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """Frames of what folds.record() wrote: run_id as it was, seq in the order of batches and of lines in them.

    A batch's lines of a run are one file, so a line's place is its batch and its place in the file, which has 42 bits.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.schema("value string, batch long, run_id string").text(folder)
    seq = F.shiftleft("batch", 42) + F.col("_metadata.file_block_start") * 2 + row
    return parse_lines(lines.select("run_id", seq.alias("seq"), "value"), strict).where("valid").drop("valid", "value")


def render(frames: DataFrame, value: str = "value") -> DataFrame:
    """frames with their ASC line: time with six decimals, bus from 1, id, direction, dlc and at most eight bytes."""
    return frames.withColumn(value, render_line())


def render_line() -> Column:
    h = F.hex(F.substring("data", F.lit(1), F.least("dlc", F.lit(8))))
    time = F.concat(F.expr("t_us div 1000000").cast("string"), F.lit("."), F.lpad((F.col("t_us") % 1000000).cast("string"), 6, "0"))
    return F.concat_ws(
        "  ", time, (F.col("channel") + 1).cast("string"), F.concat(F.hex("id"), F.when(F.col("extended"), "x").otherwise("")), "dir", F.hex("dlc"), F.regexp_replace(h, "(..)(?!$)", "$1 ")
    )


def write(frames: DataFrame, path: str) -> None:
    """Text files of ASC lines of one run, in arrival order within each file; write_runs() keeps several apart. Files have no
    header, which the scan doesn't need."""
    frames.select("seq", render_line().alias("value")).sortWithinPartitions("seq").select("value").write.text(path)


#: What stands before the frames of a single file that other tools are to read; the scan skips it.
HEADER = ["date Thu Jan 1 00:00:00 AM 1970", "base hex  timestamps absolute", "internal events logged", "// version 7.0.0"]


def write_runs(frames: DataFrame, path: str, header: bool = False) -> None:
    """One file of ASC lines in arrival order for each run, in a folder run_id=..., with a header if asked for.

    In the local file system Spark's writer starts two processes for each file, to set its mode and its checksum's, which
    takes longer than the lines of a short run; there files are written by the tasks themselves.
    """
    local = runfiles.local_path(frames, path)
    if local:
        lines = frames.select("run_id", "seq", render_line().alias("value")).repartition("run_id").sortWithinPartitions("run_id", "seq")
        return runfiles.write(lines, local, HEADER if header else [])
    lines = frames.select("run_id", F.struct(F.lit(1).alias("part"), "seq").alias("at"), render_line().alias("value"))
    if header:
        head = F.posexplode(F.array(*(F.lit(x) for x in HEADER))).alias("seq", "value")
        heads = frames.select("run_id").distinct().select("run_id", head).select("run_id", F.struct(F.lit(0).alias("part"), F.col("seq").cast("long").alias("seq")).alias("at"), "value")
        lines = heads.unionByName(lines)
    lines.repartition("run_id").sortWithinPartitions("run_id", "at").select("run_id", "value").write.partitionBy("run_id").text(path)
