"""Catalogues: DBC text to tables, bound to buses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canlake.schema import NO_NODE

#: Lines of a file are looked at in buckets of this many, each in one task.
LINES = 1 << 13
NUMBER = r"[-+0-9.eE]+"
SIGNAL = rf"^\s*SG_\s+(\w+)\s*(?:[mM]\w*\s*)?:\s*(\d+)\|(\d+)@([01])([+-])\s*\(({NUMBER}),({NUMBER})\)\s*\[({NUMBER})\|({NUMBER})\]\s*\"([^\"]*)\"\s*(.*?)\s*;?\s*$"
MESSAGE = r"^\s*BO_\s+(\d+)\s+(\w+)\s*:\s*(\d+)\s+(\w+)"
# The words that statements of the format begin with.
KEYWORDS = (
    "VERSION NS_ NS_DESC_ CM_ BA_DEF_ BA_ VAL_ CAT_DEF_ CAT_ FILTER BA_DEF_DEF_ EV_DATA_ ENVVAR_DATA_ SGTYPE_ SGTYPE_VAL_ BA_DEF_SGTYPE_ BA_SGTYPE_ SIG_TYPE_REF_ VAL_TABLE_ "
    "SIG_GROUP_ SIG_VALTYPE_ SIGTYPE_VALTYPE_ BO_TX_BU_ BA_DEF_REL_ BA_REL_ BA_DEF_DEF_REL_ BU_SG_REL_ BU_EV_REL_ BU_BO_REL_ SG_MUL_VAL_ BS_ BU_ BO_ SG_ EV_"
).split()


def lines_of(texts: DataFrame) -> DataFrame:
    """texts(path, value) -> path, line, value with one row per line of each text."""
    return texts.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def read(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def files(spark: SparkSession, folder: str, pattern: str = "*.dbc") -> DataFrame:
    """path, bytes, content of the catalogue files in a folder, for report(); their text is not looked at yet."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    # A scan leaves files without bytes out; the list of files has them.
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", x),) for x in found.inputFiles()], "path string")
    return listed.join(found, "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("bytes"), F.coalesce("content", F.lit(b"")).alias("content"))


def texts_of(found: DataFrame) -> DataFrame:
    """files -> path, value of those that are valid UTF-8."""
    value = F.col("content").cast("string")
    return found.select("path", value.alias("value")).where(F.is_valid_utf8("value"))


def statements(lines: DataFrame, words: tuple[str, ...] = ("BU_", "BO_", "SG_")) -> DataFrame:
    """lines(path, line, value) -> path, line, word, value: the statements that begin with one of the words, their lines joined.

    A statement begins on a line that begins with a keyword and not inside a string, and goes on to the next one. Whether
    a line begins inside a string is the parity of the quotes before it: counted per bucket of lines, carried from bucket to
    bucket, and counted on inside. The line that a statement began on is carried in the same way.
    """
    bucket, order = F.expr(f"line div {LINES}"), W.partitionBy("path").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("path", "bucket").orderBy("line")
    rows = lines.select("path", "line", "value", bucket.alias("bucket"), (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    quotes = rows.groupBy("path", "bucket").agg(F.sum("quotes").alias("all")).select("path", "bucket", F.coalesce(F.sum("all").over(order), F.lit(0)).alias("carried"))
    before = F.coalesce(F.sum("quotes").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    word = F.regexp_extract("value", rf"^\s*({'|'.join(KEYWORDS)})\b", 1)
    rows = rows.withColumn("before", before).join(quotes, ["path", "bucket"]).withColumn("word", F.when((F.col("before") + F.col("carried")) % 2 == 0, F.nullif(word, F.lit(""))))
    rows = rows.withColumn("begins", F.when(F.col("word").isNotNull(), F.struct("line", "word")))
    heads = rows.groupBy("path", "bucket").agg(F.max("begins").alias("last"))
    heads = heads.select("path", "bucket", F.last("last", ignorenulls=True).over(order).alias("carried_begin"))
    here = F.last("begins", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    of = rows.drop("word", "carried").withColumn("here", here).join(heads, ["path", "bucket"]).withColumn("of", F.coalesce("here", "carried_begin")).where(F.col("of.word").isin(*words))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), " ")
    return of.groupBy("path", "of").agg(joined.alias("value")).select("path", "of.line", "of.word", "value")


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lines(path, line, value) -> messages, signals, nodes, each with path.

    Strings and lists may go over lines; what a string holds is no statement. Of several definitions of an id the last one
    holds. Bit 31 of a number marks an extended id. The placeholder node is no receiver and no transmitter. Multiplexing,
    value tables and value types are not read.
    """
    rows = statements(lines)
    value = F.col("value")
    names = F.filter(F.split(F.regexp_replace("value", r"^\s*BU_\s*:\s*", ""), r"[\s;]+"), lambda n: n != "")
    nodes = rows.where((F.col("word") == "BU_") & value.rlike(r"^\s*BU_\s*:")).select("path", F.posexplode(names).alias("ord", "node"))
    m = rows.where((F.col("word") == "BO_") & value.rlike(MESSAGE)).select(
        "path",
        "line",
        F.regexp_extract("value", MESSAGE, 1).cast("long").alias("number"),
        F.regexp_extract("value", MESSAGE, 2).alias("name"),
        F.regexp_extract("value", MESSAGE, 3).cast("int").alias("dlc"),
        F.coalesce(F.nullif(F.regexp_extract("value", MESSAGE, 4), F.lit(NO_NODE)), F.lit("")).alias("transmitter"),
    )
    m = m.withColumn("extended", F.col("number") >= 1 << 31).withColumn("id", F.when(F.col("extended"), F.col("number").bitwiseAND(F.lit(0x1FFFFFFF))).otherwise(F.col("number")))
    last = m.groupBy("path", "id").agg(F.max_by(F.struct("line", "extended", "name", "dlc", "transmitter"), "line").alias("m")).select("path", "id", "m.*")
    # A signal belongs to the last message opened before it: within a bucket of lines, or else before the bucket.
    opened, bucket = F.when(F.col("word") == "BO_", F.col("line")), F.expr(f"line div {LINES}")
    heads = rows.groupBy("path", bucket.alias("bucket")).agg(F.max(opened).alias("last"))
    heads = heads.select("path", "bucket", F.last("last", ignorenulls=True).over(W.partitionBy("path").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    here = F.last(opened, ignorenulls=True).over(W.partitionBy("path", "bucket").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    x = lambda i: F.regexp_extract("value", SIGNAL, i)
    s = (
        rows.withColumn("bucket", bucket)
        .withColumn("here", here)
        .where((F.col("word") == "SG_") & value.rlike(SIGNAL))
        .join(heads, ["path", "bucket"])
        .withColumn("of", F.coalesce("here", "carried"))
        .select(
            "path", F.col("of"), F.col("line").alias("sg"), x(1).alias("signal"), x(2).cast("int").alias("start_bit"), x(3).cast("int").alias("size"), (x(4) == "0").alias("big_endian"),
            (x(5) == "-").alias("signed"), x(6).cast("double").alias("factor"), x(7).cast("double").alias("offset"), x(8).cast("double").alias("min"), x(9).cast("double").alias("max"), x(10).alias("unit"),
            F.filter(F.split(x(11), r"[,\s]+"), lambda n: (n != "") & (n != NO_NODE)).alias("receivers"),
        )
    )
    s = s.join(last.select("path", "id", F.col("line").alias("of")), ["path", "of"]).withColumn("ord", F.row_number().over(W.partitionBy("path", "id").orderBy("sg")) - 1)
    signals = s.select("path", "id", "ord", "signal", "start_bit", "size", "big_endian", "signed", "factor", "offset", "min", "max", "unit", "receivers")
    return last.select("path", "id", "extended", "name", "dlc", "transmitter"), signals, nodes


def bind(buses: DataFrame, table: DataFrame) -> DataFrame:
    """buses(channel, bus_name, dbc_path) with the rows of a catalogue table; a missing file leaves NULLs."""
    return buses.join(table, buses["dbc_path"] == table["path"], "left").drop("path")


def report(buses: DataFrame, found: DataFrame) -> DataFrame:
    """channel, bus_name, dbc_path, bytes, status, messages, signals, rejects: how loading each bus's catalogue went.

    status is `no path`, `missing`, `not text` (no UTF-8), `no messages` or `loaded`; rejects counts messages and signals that are
    begun but can't be read. found: files().
    """
    lines = lines_of(texts_of(found))
    messages, signals, _ = parse(lines)
    bad = statements(lines, ("BO_", "SG_")).where(F.when(F.col("word") == "BO_", ~F.col("value").rlike(MESSAGE)).otherwise(~F.col("value").rlike(SIGNAL)))
    counts = [t.groupBy("path").agg(F.count("*").alias(n)) for n, t in (("messages", messages), ("signals", signals), ("rejects", bad))]
    known = found.select("path", "bytes", F.is_valid_utf8(F.col("content").cast("string")).alias("text"))
    for c in counts:
        known = known.join(c, "path", "left")
    path = F.trim(F.coalesce("dbc_path", F.lit("")))
    rows = buses.join(known, path == known["path"], "left")
    status = F.when(path == "", "no path").when(F.col("path").isNull(), "missing").when(~F.col("text"), "not text").when(F.col("messages").isNull(), "no messages").otherwise("loaded")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("channel", "bus_name", "dbc_path", zero("bytes"), status.alias("status"), zero("messages"), zero("signals"), zero("rejects"))
