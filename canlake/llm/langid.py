"""Language identification: known words first, then progressively shorter character n-grams of unseen words."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import crc_mod, worker_store

#: The model is fitted on about this many labelled documents of each language at most, picked by a hash of the row, and on
#: the most frequent languages, so many at most.
FIT_DOCS, MOST_LANGS = 1_500, 1_000
#: A language keeps its most frequent words and n-grams, so many of each at most; rarer than MIN_COUNT ones are left out.
KEEP_WORDS, KEEP_GRAMS, MIN_COUNT = 15_000, 15_000, 3
#: Longest n-gram of an unseen word, with marks for its start and end.
LONGEST = 4
#: Words are counted in pieces of this many letters.
PIECE = 100
LETTERS = r"[^\p{L}]+"
#: A worker remembers the scores of so many words at most, in a table of so many bytes.
CACHED_WORDS, CACHED_BYTES = 200_000, 64 << 20


class Model:
    """Log frequencies by language: words, and n-grams of length 1 to LONGEST."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray]):
        self.langs, self.words, self.grams = langs, words, grams

    def score(self, word: str) -> np.ndarray:
        """Log likelihoods by language, 0 at most: the word's own, else the mean of its longest known n-grams', else 0."""
        if (s := self.words.get(word)) is not None:
            return s
        w = f"^{word}$"
        for n in range(min(LONGEST, len(w)), 0, -1):
            found = [s for i in range(len(w) - n + 1) if (s := self.grams.get(w[i : i + n])) is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs))


def _tables(counts: list, langs: list[str]) -> dict[str, np.ndarray]:
    """(lang, key, n) -> each key's log shares by language, with add-half smoothing, less the best one."""
    at = {x: i for i, x in enumerate(langs)}
    raw: dict[str, np.ndarray] = {}
    totals = np.ones(len(langs))
    for r in counts:
        raw.setdefault(r["key"], np.full(len(langs), 0.5))[at[r["lang"]]] += r["n"]
        totals[at[r["lang"]]] += r["n"]
    logs = {k: np.log(v / (totals + 0.5 * len(raw))) for k, v in raw.items()}
    return {k: v - v.max() for k, v in logs.items()}


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """labelled(doc_id, text, lang) -> Model, from rows with both text and lang; other columns are ignored.

    A bounded sample for each of the MOST_LANGS most frequent languages: documents whose row's hash falls under
    fit_docs / rows of the language, so that rare languages are learned from all they have. Words and n-grams are counted
    in Spark; only the most frequent ones of each language come to the driver. NULL and repeated ids are ordinary rows.
    Without labelled rows the model has no languages.
    """
    spark = labelled.sparkSession
    known = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    rows = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    langs, top = sorted(r["lang"] for r in rows), 1 << 30
    if not langs:
        return Model([], {}, {})
    shares = F.broadcast(spark.createDataFrame([(r["lang"], min(top, int(top * fit_docs / r["n"]) + 1)) for r in rows], "lang string, share long"))
    sample = known.join(shares, "lang").where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(top)) < F.col("share"))
    words = (
        sample.select("lang", F.explode(F.split(F.lower("text"), LETTERS)).alias("key"))
        .where("key <> ''")
        .groupBy("lang", "key")
        .agg(F.count("*").alias("n"))
        .persist()
    )
    # Long words are looked at in pieces that overlap by what an n-gram needs, so that each of its places counts once.
    marked = F.concat(F.lit("^"), F.col("key"), F.lit("$"))
    starts = F.sequence(F.lit(0), F.expr(f"(char_length(key) + 1) div {PIECE}"))
    pieces = words.select("lang", "n", F.explode(F.transform(starts, lambda i: F.substring(marked, i * PIECE + 1, F.lit(PIECE + LONGEST - 1)))).alias("piece"))
    size = F.char_length("piece")
    last = lambda k: F.least(F.lit(PIECE), size - (k - 1))

    def of(k: int):
        """The piece's n-grams of k characters. (transform() would take a lambda's second argument for an element's place.)"""
        return F.when(size >= k, F.transform(F.sequence(F.lit(1), last(k)), lambda i: F.substring("piece", i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*(of(k) for k in range(1, LONGEST + 1))))
    grams = pieces.select("lang", "n", F.explode(grams).alias("key")).groupBy("lang", "key").agg(F.sum("n").alias("n"))

    def most(df: DataFrame, keep: int) -> list:
        """The most frequent ones, as many as fit whole: with one that no longer fits go all that are as frequent."""
        df = df.where(F.col("n") >= MIN_COUNT)
        sizes = df.groupBy("lang", "n").agg(F.count("*").alias("k"))
        reached = F.sum("k").over(W.partitionBy("lang").orderBy(F.desc("n")))
        least = sizes.withColumn("reached", reached).where(F.col("reached") <= keep).groupBy("lang").agg(F.min("n").alias("least"))
        got = df.join(F.broadcast(least), "lang").where("n >= least").select("lang", "key", "n").collect()  # a row of least for each language
        # Where already the most frequent ones are too many, the first of them are taken, so that no language is lost.
        for r in sizes.select("lang").distinct().join(least, "lang", "left_anti").collect():
            got += df.where(F.col("lang") == r["lang"]).orderBy(F.desc("n"), "key").limit(keep).select("lang", "key", "n").collect()
        return got

    w, g = most(words, KEEP_WORDS), most(grams, KEEP_GRAMS)
    words.unpersist()
    return Model(langs, _tables(w, langs), _tables(g, langs))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs(doc_id, text), by the whole text and nothing else.

    The language with the highest sum of word scores wins (ties: the first in code-point order); `score` is its share
    of the likelihood per word: softmax of the mean word scores times the square root of the number of words, 20 at
    most. NULL texts and texts without a letter are `und` with score 0, as is everything under an empty model. Very long
    texts are read word by word to their end; repeated rows each get their row; other columns, of any name, are ignored.
    """
    # Plain lists and dicts: a broadcast class would have to be importable on the workers.
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams))

    def work(batches):
        worker_store("langid")
        m = Model(*shared.value)
        split = re.compile(r"[^\W\d_]+").findall
        at: dict[str, int] = {}
        kept = max(1024, min(CACHED_WORDS, CACHED_BYTES // (8 * max(len(m.langs), 1))))
        table = np.zeros((kept, len(m.langs)))
        for batch in batches:
            preds, scores = [], []
            for text in batch.column(1):
                words = split((text.as_py() or "").lower())
                if not m.langs or not any(c.isalpha() for w in words for c in w):
                    preds.append("und")
                    scores.append(0.0)
                    continue
                total = np.zeros(len(m.langs))
                for start in range(0, len(words), kept // 2):
                    part = words[start : start + kept // 2]
                    if len(at) + len(part) > kept:
                        at.clear()
                    for w in part:
                        if w not in at:
                            table[len(at)] = m.score(w)
                            at[w] = len(at)
                    total += table[[at[w] for w in part]].sum(axis=0)
                best = int(total.argmax())
                e = np.exp((total - total[best]) / len(words) * min(20.0, math.sqrt(len(words))))
                preds.append(m.langs[best])
                scores.append(float(1 / e.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `documents`, by its whole text. The model is fitted on a bounded
    sample of the rows whose crc32 of the id modulo 4 is not 2; a NULL id has no remainder and is neither learned from nor
    held out. NULL, empty and letterless texts are `und`; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return predict(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
