"""Toxicity by compression distance: two zstandard dictionaries, compared on windows with calibrated weights."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, worker_store

#: The classifier is fitted on at most about this many labelled documents of each label, picked by a hash of their id.
FIT_TOXIC, FIT_ORDINARY = 1_500, 3_000
#: Of the sample come at most so many telling n-grams, ordinary words and toxic stretches, the strongest and most frequent ones.
MOST_GRAMS, MOST_WORDS, MOST_STRETCHES = 5_000, 3_000, 600
#: Both dictionaries share this many bytes of frequent ordinary words; the toxic one has up to TOXIC_BYTES more.
SHARED_BYTES, TOXIC_BYTES = 8192, 2048
#: Windows of so many bytes overlap by OVERLAP; those that the toxic dictionary shortens by SUSPECT bytes are looked at in runs of WORDS words.
WINDOW, OVERLAP, SUSPECT, WORDS = 64, 8, 2, 3
FAST, THOROUGH = 9, 19
#: Lengths of the n-grams, the space before a word included, that are looked for in toxic words.
GRAMS = (4, 5, 6, 7)
N_FEATURES = 7
#: A task hands on its counts of n-grams when it holds more than this many.
COUNTED = 50_000


def _grams(word: str):
    word = " " + word
    return (word[i : i + n] for n in GRAMS for i in range(len(word) - n + 1))


class Compressors:
    """Lengths of windows under the two dictionaries, at a fast and at a thorough level."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        self.pad = ordinary[:24]
        self.pairs = {}
        for level in (FAST, THOROUGH):
            pair = []
            for content in (ordinary, toxic + ordinary):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                pair.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
            self.pairs[level] = pair

    def gain(self, window: bytes, level: int) -> int:
        """Bytes that the toxic dictionary saves over the ordinary one. A fixed start lets even short windows compress."""
        a, b = self.pairs[level]
        return len(a(self.pad + window)) - len(b(self.pad + window))

    def features(self, text: str) -> list[float]:
        """Over all windows of the text: the largest gain and the share of suspect ones; over the runs of words of
        suspect windows, each run once: the largest gain that both levels agree on, and how many runs gain 2 or 4."""
        data = b" " + b" ".join(text.lower().encode("utf-8", "replace").split())
        step = WINDOW - OVERLAP
        most = suspect = windows = 0
        runs: dict[bytes, int] = {}
        for i in range(0, max(1, len(data) - OVERLAP), step):
            gain = self.gain(data[i : i + WINDOW], FAST)
            windows += 1
            most = max(most, gain)
            if gain >= SUSPECT:
                suspect += 1
                start = max(data.rfind(b" ", 0, i + 1), i - 24, 0)
                end = data.find(b" ", i + WINDOW)
                words = data[start : min(end if end >= 0 else len(data), i + WINDOW + 24)].split()
                for k in range(0, len(words), WORDS):
                    run = b" " + b" ".join(words[k : k + WORDS])
                    if run not in runs:
                        runs[run] = min(self.gain(run, FAST), self.gain(run, THOROUGH))
        two, four = sum(b >= 2 for b in runs.values()), sum(b >= 4 for b in runs.values())
        return [min(most, 12), min(max(runs.values(), default=0), 12), math.log1p(two), math.log1p(four), min(1, 10 * two / windows), min(1, 10 * four / windows), min(1, 3 * suspect / windows)]


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(features)), features]) @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the constant comes first and isn't shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    b, shrink = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge * w.sum() / 100] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + shrink, x.T @ (w * (y - p)) - shrink @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _featured(rows: DataFrame, shared, keep: list[str]) -> DataFrame:
    """keep..., f: the features of each row's text."""

    def work(batches):
        worker_store("toxicity")
        c = Compressors(*shared.value)
        for batch in batches:
            f = [c.features(t.as_py() or "") for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(f, pa.list_(pa.float64()))], names=[*keep, "f"])

    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keep)
    return rows.select(*keep, "text").mapInArrow(work, f"{schema}, f array<double>")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic) with the rows to learn from -> Model.

    Rows with a NULL id, text or label are left out; a document with several labels is toxic if one says so. From a
    bounded sample (FIT_TOXIC, FIT_ORDINARY) come: how many toxic and ordinary documents have each character n-gram
    (counted in Spark); from those much more usual in toxic documents, the stretches of toxic words they cover and two
    characters more, which make the toxic dictionary; the most frequent ordinary words, which both dictionaries share; and the weights of the
    windows' compression gains, by logistic regression with each label weighted back to its share. Without any toxic
    or any ordinary document the score is constant.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    most = {0: FIT_ORDINARY, 1: FIT_TOXIC}
    top = 1 << 20
    share = {k: min(top, int(top * most[k] / v) + 1) if v else top for k, v in (n | {k: n.get(k, 0) for k in most}).items() if k in most}
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(top)) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).where("toxic in (0, 1)")
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").persist()  # bounded: some thousand ids

    def counts(batches):
        worker_store("toxicity")
        found = [Counter(), Counter()]

        def flush():
            keys = list(found[0].keys() | found[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[0][k] for k in keys], pa.int64()), pa.array([found[1][k] for k in keys], pa.int64())], names=["g", "o", "t"])
            for f in found:
                f.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                found[toxic.as_py()].update({g for w in set(text.as_py().lower().split()) for g in _grams(w)})
                if len(found[0]) + len(found[1]) > COUNTED:
                    yield flush()
        yield flush()

    try:
        size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n_o, n_t = size.get(0, 0), size.get(1, 0)
        if not n_o or not n_t:
            return Model(b" ", b"", np.array([30.0 if n_t else -30.0] + [0.0] * N_FEATURES))
        sums = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(counts, "g string, o long, t long").groupBy("g").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
        rate_t, rate_o = F.col("t") / n_t, (F.col("o") + 0.5) / n_o
        z = F.log(rate_t / rate_o) / F.sqrt(1 / F.col("t") + 1 / (F.col("o") + 0.5))
        telling = {r["g"] for r in sums.where((F.col("t") >= 4) & (((rate_t > 20 * rate_o) & (z > 3.0)) | (F.col("g").rlike("^ .{4}") & (rate_t > 4 * rate_o) & (z > 4)))).orderBy(F.desc(z), "g").limit(MOST_GRAMS).collect()}
        words = sample.select("toxic", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).where("w <> ''").groupBy("toxic", "w").agg(F.count("*").alias("n"))
        usual = words.where("toxic = 0").orderBy(F.desc("n"), "w").limit(MOST_WORDS).collect()
        ordinary = b" ".join(r["w"].encode() for r in usual)[:SHARED_BYTES] or b" "

        def stretches(batches):
            for batch in batches:
                out = Counter()
                for w, k in zip(batch.column(0), batch.column(1), strict=True):
                    w = " " + w.as_py()
                    covered = [False] * len(w)
                    for n in GRAMS:
                        for i in range(len(w) - n + 1):
                            if w[i : i + n] in telling:
                                covered[i : i + n] = [True] * n
                    covered = [x or any(covered[max(0, i - 2) : i]) for i, x in enumerate(covered)]
                    out.update({s: k.as_py() for s in "".join(c if x else "\0" for c, x in zip(w, covered, strict=True)).split("\0") if s})
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["s", "n"])

        spans = words.where("toxic = 1").select("w", "n").mapInArrow(stretches, "s string, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(MOST_STRETCHES).collect()
        toxic = b"".join(r["s"].encode() for r in reversed(spans))[-TOXIC_BYTES:]
        if not toxic:  # nothing tells them apart: toxic text as it is
            rest = words.where("toxic = 1").orderBy(F.desc("n"), "w").limit(MOST_STRETCHES).collect()
            toxic = b" ".join(r["w"].encode() for r in reversed(rest))[-TOXIC_BYTES:]
        shared = sample.sparkSession.sparkContext.broadcast((ordinary, toxic))
        rows = _featured(sample.select("toxic", "doc_id", "text"), shared, ["doc_id", "toxic"]).orderBy("doc_id").select("toxic", "f").collect()
    finally:
        sample.unpersist()
    x, y = np.array([r["f"] for r in rows]), np.array([float(r["toxic"]) for r in rows])
    w = np.where(y == 1, n.get(1, n_t) / n_t, n.get(0, n_o) / n_o)
    return Model(ordinary, toxic, _logistic(x, y, w / w.mean()))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs(doc_id, text), by all windows of the whole text, however long; a NULL text is an
    empty one. Repeated rows and NULL ids each get their row, equal texts the same score; an empty table gives no rows;
    other columns, of any name, are ignored."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model.ordinary, model.toxic))
    weights = model.weights

    def work(batches):
        worker_store("toxicity")
        c, m = Compressors(*shared.value), Model(b"", b"", weights)
        for batch in batches:
            f = np.array([c.features(t.as_py() or "") for t in batch.column(1)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(f), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with their own columns, whose text scores under the threshold; NULL texts count as empty."""
    sc = docs.sparkSession.sparkContext
    shared, weights, at = sc.broadcast((model.ordinary, model.toxic)), model.weights, docs.columns.index("text")

    def work(batches):
        worker_store("toxicity")
        c, m = Compressors(*shared.value), Model(b"", b"", weights)
        for batch in batches:
            f = np.array([c.features(t.as_py() or "") for t in batch.column(at)]).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(m.score(f) < threshold))

    return docs.mapInArrow(work, docs.schema)


def fit_tables(spark: SparkSession, sf_dir: str) -> Model:
    """Fitted on the tables documents and labels, without the rows whose crc32 of the id modulo 5 is 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return fit(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `documents`, by its whole text. The model is fitted on a bounded
    sample of the labelled rows whose crc32 of the id modulo 5 is not 0; a NULL id has no remainder and is not held out.
    NULL and empty texts score like an empty one; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return scores(docs, fit_tables(spark, sf_dir)).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
