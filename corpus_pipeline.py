"""A training-data pipeline: five of the subpackage's operators, one after the other, over the table documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import mixing, ngramjoin, spiece, suffix, toxicity
from canlake.llm.common import row_key, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores under 0.5; the model is fitted on the tables documents and labels. NULL and empty
    texts count as empty and score like one; repeated rows and NULL or repeated ids are judged each; an empty table stays
    empty; only the columns of documents come through."""
    return toxicity.keep_clean(docs.select(COLUMNS), toxicity.fit_tables(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that 5-word shingles with a Jaccard similarity of 0.8 or more hang together, the one with
    the smallest id (NULL ids last, ties by a hash of the text); of repeated rows one. Documents without words (NULL, empty,
    blank) are groups of their own id and text. Rows that share an id but not their text are documents like others. Very
    long texts count whole; an empty table stays empty; only the columns of documents come through."""
    keyed = docs.select(*COLUMNS, row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    groups = ngramjoin.similar(docs.select(F.col("doc_id").alias("key"), "text"))
    group = F.struct("root", F.when(F.col("root").isNull(), F.col("row")).alias("own"))
    first = groups.groupBy(group.alias("group")).agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "row")).alias("first"))
    stay = first.select(F.col("first.row").alias("_key"))
    return keyed.join(stay, "_key", "left_semi").dropDuplicates(["_key"]).select(COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that stand elsewhere too; documents with nothing left go. NULL, empty
    and short texts stay as they are; repeated rows, NULL and equal ids included, are copies of each other and go where
    they are long enough; very long texts count whole; an empty table stays empty; only the columns of documents come
    through."""
    left = suffix.remove_repeats(docs.select(COLUMNS), COLUMNS).where("n_removed = 0 or n_removed < n_bytes")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("kept_text").cast("long"))
    return left.select("doc_id", text.alias("text"), "lang", "source", n_chars.cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded: 0, 1 or 2 rows. Documents without words (NULL, empty) have
    no part in it; NULL sources are one source; rows with equal id and text are taken alike; an empty table stays empty;
    only the columns of documents come through."""
    keyed = docs.select(*COLUMNS, row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    mixed = mixing.mix(keyed.select(F.col("_key").alias("doc_id"), "text", "source"))
    times = mixed.where("taken > 0").groupBy(F.col("doc_id").alias("_key")).agg(F.round(F.max("taken") / F.max("size")).cast("int").alias("_times"))
    return keyed.join(times.where("_times > 0"), "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, round_trip of each document of the mix. NULL and empty texts have no tokens; every
    row, repeated ones too, gets its row; an empty table gives none."""
    return spiece.encode(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_array", drop_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Compression lengths, MinHash and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written as Parquet in the shared folder and read again by the next.

    A stage's files go when the next one's are written; the last ones, which the result reads, go with remove()."""
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder by the file system that it is in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
