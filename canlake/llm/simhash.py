"""SimHash fingerprints and search by permuted block tables. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut
from .units import in_blocks

#: Fingerprints at most this many bits apart are near; leading blocks are searched in units of about this many fingerprints.
RADIUS, UNIT = 3, 1024
#: A fingerprint has two words of 64 bits. Each sum holds the votes of bits i and i + 32 in its two halves.
BITS = 128
LANES = 0x0000000100000001
#: Votes of at most this many terms are summed in such halves, which can't overflow: 2^20 weights of 144 are under 2^28.
PART = 1 << 20
TERM = r"[^\p{L}\p{N}]+"
#: A term's weight is the square of its length, up to this length: long words tell texts apart better than short ones.
LONGEST = 12


def term_rows(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., part, term: the lower-cased runs of letters and digits, or the text itself after a space where it has none,
    in parts of PART terms."""
    blank = ~F.col("text").rlike(r"[\p{L}\p{N}]")
    words = F.when(blank, F.array(F.concat(F.lit(" "), "text"))).otherwise(F.split(F.lower("text"), TERM))
    return texts.select(*keys, F.posexplode(words).alias("at", "term")).where("term <> ''").select(*keys, F.expr(f"at div {PART}").alias("part"), "term")


def vote_sums(term: Column) -> list[Column]:
    """Aggregates over a part's term rows: the total weight, then 64 sums with the weighted votes for the bits of both words."""
    n = F.least(F.length(term), F.lit(LONGEST))
    w = F.greatest(n * n, F.lit(1)).cast("long")
    sums = [F.sum(w).alias("w")]
    for k, h in enumerate((F.xxhash64(term), F.xxhash64(term, F.lit(1)))):
        sums += [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) * w).alias(f"v{k}_{i}") for i in range(32)]
    return sums


def half_sums() -> list[Column]:
    """Aggregates over a text's parts: the total weight, and each bit's votes on their own."""
    sums = [F.sum("w").alias("w")]
    for k in range(2):
        for i in range(32):
            v = F.col(f"v{k}_{i}")
            sums += [F.sum(v.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"b{k}_{i}"), F.sum(F.shiftrightunsigned(v, 32)).alias(f"b{k}_{i + 32}")]
    return sums


def signed_bits(k: int) -> Column:
    """Word k of the fingerprint: a bit is set where over half of the weight votes for it."""
    word = F.lit(0).cast("long")
    for at in range(64):
        word = word.bitwiseOR(F.when(2 * F.col(f"b{k}_{at}") > F.col("w"), F.lit((1 << at) - (1 << 64) * (at == 63))).otherwise(F.lit(0)).cast("long"))
    return word


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts(keys..., text) -> keys..., f0, f1: weighted term hashes vote on each bit. Rows with equal keys share a fingerprint.

    NULL texts are empty ones; an empty text has a fingerprint of its own; texts may have any length. Keys that the input
    is already dealt out by need no further shuffle.
    """
    rows = term_rows(texts.withColumn("text", F.coalesce("text", F.lit(""))), keys)
    sums = rows.groupBy(*keys, "part").agg(*vote_sums(F.col("term"))).groupBy(*keys).agg(*half_sums())
    return sums.select(*keys, signed_bits(0).alias("f0"), signed_bits(1).alias("f1"))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def _rotated(f0: Column, f1: Column, start: int, width: int) -> Column:
    """`width` (up to 64) bits of the 128 from `start` on: the leading block of the table permuted to start there."""
    def bits(word: Column, lo: int, n: int) -> Column:
        mask = (1 << n) - 1 if n < 64 else -1
        return F.shiftrightunsigned(word, lo).bitwiseAND(F.lit(mask))

    if start >= 64:
        return bits(f1, start - 64, width)
    first = min(width, 64 - start)
    low = bits(f0, start, first)
    return low if first == width else low.bitwiseOR(F.call_function("shiftleft", bits(f1, 0, width - first), F.lit(first)))


def within_radius(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints(f0, f1) -> (a0, a1, b0, b1, distance): all pairs of different fingerprints at most `radius` bits apart.

    The bits are cut into radius + 1 blocks; two fingerprints within the radius agree in at least one. Each table is
    the fingerprints permuted so that one block leads; equal leading blocks are candidates, verified by their whole
    distance in the join, and a pair is taken from its first agreeing table only. Leading blocks of very many
    fingerprints are dealt into units of bounded size. Equal fingerprints are one row, so copies make no pairs;
    membership comes from joining rows to their fingerprint. NULL fingerprints are left out. radius is 1 to 31.
    """
    if not 1 <= radius <= 31:
        raise ValueError("radius is from 1 to 31")
    n = radius + 1
    edges = [BITS * i // n for i in range(n + 1)]
    lead = lambda f0, f1, i: _rotated(f0, f1, edges[i], min(64, edges[i + 1] - edges[i]))
    one = prints.where("f0 is not null and f1 is not null").select("f0", "f1").distinct()
    tables = F.array(*(F.struct(F.lit(i).alias("t"), lead(F.col("f0"), F.col("f1"), i).alias("lead")) for i in range(n)))
    rows = one.select("f0", "f1", F.explode(tables).alias("g")).withColumn("member", F.xxhash64("f0", "f1"))
    units = in_blocks(rows, "g", "member", UNIT).select("u", "g.t", "side", "same", "f0", "f1")
    left = units.where("side = 0").select("u", "t", "same", F.col("f0").alias("a0"), F.col("f1").alias("a1"))
    right = units.where("side = 1 or same").select("u", F.col("f0").alias("b0"), F.col("f1").alias("b1"))
    a, b = (F.col("a0"), F.col("a1")), (F.col("b0"), F.col("b1"))
    once = ~F.col("same") | (F.col("a0") < F.col("b0")) | ((F.col("a0") == F.col("b0")) & (F.col("a1") < F.col("b1")))
    for i in range(n - 1):
        once = once & ((F.col("t") <= i) | (lead(*a, i) != lead(*b, i)))
    left, right = left.alias("l"), right.alias("r")
    pairs = left.join(right, (F.col("l.u") == F.col("r.u")) & (distance(a, b) <= radius) & once)
    return pairs.select("a0", "a1", "b0", "b1", distance(a, b).alias("distance"))


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints(f0, f1), a row for each text -> f0, f1, near: how many other rows have a fingerprint at most `radius` bits away."""
    sizes = prints.where("f0 is not null and f1 is not null").groupBy("f0", "f1").agg(F.count("*").alias("rows"))
    pairs = within_radius(sizes, radius)
    ends = F.explode(F.array(F.struct(F.col("a0").alias("f0"), F.col("a1").alias("f1"), F.col("b0").alias("o0"), F.col("b1").alias("o1")), F.struct(F.col("b0").alias("f0"), F.col("b1").alias("f1"), F.col("a0").alias("o0"), F.col("a1").alias("o1"))))
    others = pairs.select(ends.alias("e")).select("e.*").join(sizes.select(F.col("f0").alias("o0"), F.col("f1").alias("o1"), "rows"), ["o0", "o1"]).groupBy("f0", "f1").agg(F.sum("rows").alias("others"))
    return sizes.join(others, ["f0", "f1"], "left").select("f0", "f1", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("near"))


def _with_next(docs: DataFrame) -> DataFrame:
    """bucket, rn, extra, doc_id, text, next_text: rows in descending doc_id (NULL last, ties by a hash of the text).

    Ids are cut into ranges by quantiles; an id that several quantiles fall on has a range of its own, and such an id's
    rows and those without an id are cut into 64 by the hash of their text. Each range gets the first row of the next lower
    range as an extra row, so one shuffle puts every row beside its successor; the lowest one gets the very first row of all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    n = min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("c")).first()["c"] or []
    heavy = sorted({a for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a == b})
    cuts = sorted(set(cuts) | {x - 1 for x in heavy})
    range_ = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c < F.col("doc_id"))))
    alone = F.col("doc_id").isNull() | F.array_contains(F.lit(heavy).cast("array<long>"), F.col("doc_id"))
    bucket = range_ * 64 + F.when(alone, 31 - F.shiftright("th", 58)).otherwise(0).cast("int")
    rows = rows.withColumn("bucket", bucket)
    first = F.min(F.struct((-F.col("doc_id").cast("decimal(20,0)")).alias("d"), "th", "doc_id"))
    tops = sorted((r["bucket"], r["t"]["doc_id"], r["t"]["th"]) for r in rows.groupBy("bucket").agg(first.alias("t")).collect())
    if not tops:
        return rows.select("bucket", F.lit(0).alias("rn"), F.lit(0).alias("extra"), "doc_id", "text", F.col("text").alias("next_text"))
    goes = [(tops[i][1], tops[i][2], tops[(i + 1) % len(tops)][0]) for i in range(len(tops))]
    to = F.broadcast(spark.createDataFrame(goes, "t_id long, t_th long, t_bucket int"))  # 64 rows for each of 4,097 ranges at most
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra"))
    there = F.struct(F.col("t_bucket").alias("bucket"), F.lit(1).alias("extra"))
    copies = F.when(F.col("t_bucket").isNull(), F.array(here)).otherwise(F.array(here, there))
    dealt = rows.join(to, rows["doc_id"].eqNullSafe(F.col("t_id")) & (F.col("th") == F.col("t_th")), "left").withColumn("e", F.explode(copies))
    order = W.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), "th")
    return (
        dealt.select("e.bucket", "e.extra", "doc_id", "th", "text")
        .withColumn("rn", F.row_number().over(order))
        .withColumn("next_text", F.lead("text").over(order))
        .select("bucket", "rn", "extra", "doc_id", "text", "next_text")
    )


def edited_prints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_rows for docs(doc_id, text).

    The edited text is the text with its last floor(n / 3) code points replaced by the first as many (or all) of the
    next document in descending doc_id; after the last comes the first. NULL texts are empty; NULL ids come last; rows
    with equal ids are ordered by a hash of their text, equal rows in any order. A table of one row follows itself.
    Likeness is the share of equal bits; near_rows counts the other rows with a fingerprint at most RADIUS bits away.
    Texts of any length count whole; an empty table gives no rows. Other columns are ignored.
    """
    rows = _with_next(docs)
    third = F.expr("char_length(text) div 3").cast("int")
    n = F.char_length("text").cast("long")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    both = rows.withColumn("n_chars", n).withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["bucket", "rn", "extra", "doc_id", "n_chars", "edited_sha256"]
    sides = both.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("s")).select(*keys, "s.side", "s.text")
    prints = fingerprints(sides, [*keys, "side"])
    pick = lambda side, f: F.max(F.when(F.col("side") == side, F.col(f)))
    wide = prints.groupBy(*keys).agg(pick(0, "f0").alias("f0"), pick(0, "f1").alias("f1"), pick(1, "f0").alias("e0"), pick(1, "f1").alias("e1"))
    order = W.partitionBy("bucket").orderBy("rn")
    wide = cut(wide.withColumn("n0", F.lead("f0").over(order)).withColumn("n1", F.lead("f1").over(order)).where("extra = 0"))
    wide = wide.join(near_counts(wide), ["f0", "f1"], "left")
    mine = (F.col("f0"), F.col("f1"))
    like = lambda a, b: 1 - distance(mine, (F.col(a), F.col(b))) / F.lit(float(BITS))
    text = lambda a, b: F.concat(F.lpad(F.lower(F.hex(b)), 16, "0"), F.lpad(F.lower(F.hex(a)), 16, "0"))
    return wide.select(
        "doc_id", "n_chars", "edited_sha256", text("f0", "f1").alias("fingerprint"), text("e0", "e1").alias("edited_fingerprint"), like("e0", "e1").alias("near_edited"), like("n0", "n1").alias("near_next"), F.col("near").alias("near_rows")
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_rows for each row of
    `documents`. NULL texts are empty, NULL ids come last, equal ids are ordered by their text; an empty table gives no rows."""
    return edited_prints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
