"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

#: The weights that sources get in code-point order, NULL last.
WEIGHTS = (3, 1, 2)
#: The fractional part of the golden ratio in units of 2^-32.
GOLDEN = 2654435769
#: Slots are counted in chunks of this many, and a source's documents in this many hash ranges.
CHUNK = 1 << 14
RANGES = 4096
#: The schedule's line is cut into this many cells, by which slots and sources meet.
CELLS = 4096
#: The table of sources is broadcast up to this many rows.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, n, target: share x the total size dealt by weight.

    A target stops at repeat x its source's size; the excess is dealt again by weight among the others until none is
    above. In closed form: sources are filled up in the order of repeat x size / weight; the first level that the next
    source still holds is the level of all the rest. One row per source, so this table is small. Sources of size 0
    have target 0. `n` numbers the sources from 0 in code-point order, NULL last.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod("n", F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("n", F.row_number().over(order) - 1).withColumn("w", w).withColumn("most", F.lit(repeat) * F.col("source_size"))
    s = s.withColumn("full_at", F.col("most") / F.col("w"))
    fill = W.orderBy("full_at", "n")
    s = (
        s.withColumn("budget", F.lit(share) * F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("filled", F.coalesce(F.sum("most").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("filled")) / F.col("rest"))
    )
    fits = F.when(F.col("level") <= F.col("full_at"), F.col("level"))
    s = s.withColumn("at", F.first(fits, ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return s.select("source", "source_size", "n", F.least("most", F.coalesce(F.col("at") * F.col("w"), "most")).alias("target")).orderBy("n")


def planned(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, repeat: float = 2.0, max_block: int = 4096) -> DataFrame:
    """targets() with block, need, c0, c1: a source's words come in blocks of `block` words, so that it needs `need` slots,
    64 or more where it has as many words; the schedule's line of all needed slots gives it the stretch from c0 to c1.

    Blocks are a source's own, so that a small source doesn't cut up the large ones. One row per source.
    """
    t = targets(sizes, weights, share, repeat).withColumn("block", F.greatest(F.lit(1), F.least(F.lit(max_block), F.floor(F.col("target") / 64))).cast("long"))
    # Whole passes over the source, each with a short last block, and blocks for the rest.
    passes, blocks = "(floor(target) div nullif(source_size, 0))", "((source_size + block - 1) div block)"
    rest = f"((floor(target) - {passes} * source_size + block - 1) div block)"
    t = t.withColumn("need", F.expr(f"coalesce(cast({passes} * {blocks} + {rest} as bigint), 0L)"))
    return t.withColumn("c1", F.sum("need").over(W.orderBy("n"))).withColumn("c0", F.col("c1") - F.col("need"))


def point(i: Column) -> Column:
    """frac(i x golden ratio) in units of 2^-32, in exact integer arithmetic: by halves, since the product has over 63 bits."""
    low, high = i.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(i, 16).bitwiseAND(F.lit(0xFFFF))
    return (low * F.lit(GOLDEN) + (high * F.lit(GOLDEN)).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def schedule(goals: DataFrame, slots: int, small: bool = True) -> DataFrame:
    """goals(n, need, c0, c1) -> (n, rank): the source of each of `slots` (the sum of need) slots, ranked within it.

    Slot i belongs to the source in whose stretch its point falls: points and stretches meet by equality of cells of the
    line, and then exactly. Ranks come from counts per chunk of slots, so that no source's slots meet in one task. What a
    source lacks of its need (the sequence is within a few slots of each share) comes after all others. With small, the
    table of sources is broadcast.
    """
    spark = goals.sparkSession
    hint = F.broadcast if small else lambda df: df
    cell = lambda c: F.floor(F.col(c) / slots * CELLS)
    cells = goals.where("need > 0").select("n", "c0", "c1", F.explode(F.sequence(cell("c0"), cell("c1"))).alias("cell"))
    s = spark.range(slots).select("id", F.expr(f"id div {CHUNK}").alias("chunk"), (point(F.col("id")) / F.lit(float(1 << 32))).alias("x"))
    s = s.withColumn("cell", F.floor(F.col("x") * CELLS)).join(hint(cells), "cell").where((F.col("x") * slots >= F.col("c0")) & (F.col("x") * slots < F.col("c1"))).select("id", "chunk", "n")
    sums = s.groupBy("n", "chunk").count()
    before = sums.select("n", "chunk", (F.sum("count").over(W.partitionBy("n").orderBy("chunk")) - F.col("count")).alias("before"))
    inside = s.withColumn("r", F.row_number().over(W.partitionBy("chunk", "n").orderBy("id")) - 1)
    ranked = inside.join(before, ["n", "chunk"]).select("n", (F.col("before") + F.col("r")).alias("rank"))
    got = goals.select("n", "need").join(sums.groupBy("n").agg(F.sum("count").alias("got")), "n", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    lacking = got.where("got < need").select("n", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
    return ranked.unionByName(lacking)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, repeat: float = 2.0, max_block: int = 4096) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for each row of docs(doc_id, text, source).

    size counts the text's words (runs of characters other than space and U+0009 to U+000D; NULL: 0). A source's
    documents are laid out in the order of a hash of id and text (ties: id, then a hash of the text; equal rows in any
    order, which gives them the same total) and cut into blocks of equally many words. Slots of the schedule,
    ranked within their source, take the source's blocks in turn, so that a source's words are all taken once before
    any is taken again; the slot that reaches the target takes only what is missing. `taken` counts the words that the
    slots take from the document, repeats counted: at most `repeat` x size. Sources that hold nothing get nothing.
    Empty table: no rows. NULL sources form one source of their own; NULL ids are ordinary ids; other columns are ignored.
    """
    doc_id, text = F.col("doc_id"), F.col("text")
    th = F.xxhash64(text)
    rows = cut(docs.select("doc_id", "source", n_words(text).alias("size"), F.xxhash64(doc_id, th).alias("h"), th.alias("th")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = cut(planned(sizes, weights, share, repeat, max_block))  # one row per source
    n_sources, slots = goals.agg(F.count("*"), F.coalesce(F.sum("need"), F.lit(0))).first()
    hint = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda df: df
    columns = ["n", "source_size", "target", "block"]
    keyed = rows.join(hint(goals.select(F.col("source").alias("s"), *columns)), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    if not slots:
        return keyed.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "source")

    # A pass over a source is its line of words; a block is [b * block, (b + 1) * block) of that line, the last one shorter.
    per_pass = F.expr("(source_size + block - 1) div block")
    takes = (
        schedule(goals, slots, n_sources <= BROADCAST_SOURCES)
        .join(hint(goals.select(*columns)), "n")
        .withColumn("b", F.col("rank") % per_pass)
        .withColumn("done", F.floor(F.col("rank") / per_pass) * F.col("source_size") + F.col("b") * F.col("block"))
        .withColumn("len", F.least("block", F.col("source_size") - F.col("b") * F.col("block"), F.floor("target") - F.col("done")))
        .where("len > 0")
        .groupBy("n", "b")
        .agg(F.count("*").alias("k"), F.min("len").alias("min_len"), F.max("len").alias("max_len"))
    )

    keyed = keyed.withColumn("range", F.shiftrightunsigned(F.col("h"), 64 - RANGES.bit_length() + 1))
    line = W.partitionBy("n", "range").orderBy("h", "doc_id", "th")
    starts = (
        keyed.groupBy("n", "range")
        .agg(F.sum("size").alias("s"))
        .withColumn("before", F.sum("s").over(W.partitionBy("n").orderBy("range")) - F.col("s"))
        .select("n", "range", "before")
    )
    placed = (
        keyed.withColumn("inside", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .join(starts, ["n", "range"])
        .withColumn("start", F.col("before") + F.col("inside"))
    )
    blocks = F.sequence(F.expr("start div block"), F.expr("(start + size - 1) div block"))
    pieces = placed.withColumn("b", F.explode(F.when(F.col("size") > 0, blocks).otherwise(F.array(F.expr("-1L")))))
    lo = F.greatest(F.col("start") - F.col("b") * F.col("block"), F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("b") * F.col("block"), F.col("block"))
    # All takes of a block but the one that reaches the target have the same length.
    full = F.greatest(F.lit(0), F.least(hi, F.col("max_len")) - lo)
    short = F.greatest(F.lit(0), F.least(hi, F.col("min_len")) - lo)
    got = F.when(F.col("k").isNull(), 0).when(F.col("min_len") == F.col("max_len"), full * F.col("k")).otherwise(full * (F.col("k") - 1) + short)
    summed = (
        pieces.join(takes, ["n", "b"], "left")
        .groupBy("n", "h", "doc_id", "th", "start", "size", "source", "source_size", "target")
        .agg(F.sum(got).cast("long").alias("taken"), F.count("*").alias("pieces"))
    )
    copies = F.when(F.col("size") > 0, F.lit(1)).otherwise(F.col("pieces")).cast("int")  # equal rows without words share their place
    return summed.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of `documents`. NULL texts have size 0 and are not taken; NULL
    sources are one source, the last; NULL and repeated ids are rows like others; an empty table gives no rows."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
