"""N-gram Jaccard join with Bayesian pruning of candidates by MinHash, and exact verification."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, row_key, worker_store
from .components import components, stars
from .units import by_unit, in_blocks, in_linked_blocks

#: Shingles of N words; sets as similar as THRESHOLD are linked.
N, THRESHOLD = 5, 0.8
#: HASHES MinHash values in bands of ROWS: two sets at the threshold share no band with a probability of 2e-6.
HASHES, ROWS = 100, 4
#: Values are compared STEP at a time; a pair goes when its similarity reaches the threshold with a probability under TOLERANCE.
STEP, TOLERANCE = 20, 1e-6
#: Groups of candidates are compared in blocks of about this many sets, and of so many bytes of shingles.
BLOCK, BLOCK_BYTES = 512, 1 << 24

_rng = np.random.default_rng(8)
_A = _rng.integers(1, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64)


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words (split at white space, lower-cased); a shorter text with words
    is one shingle; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(" ".join(words))], np.uint64)
    w = np.fromiter((xxhash.xxh64_intdigest(x) for x in words), np.uint64, len(words))
    h = w[: len(w) - n + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, n):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h)


def minhash(s: np.ndarray) -> np.ndarray:
    """HASHES 32-bit MinHash values of a set that isn't empty."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        part = s[i : i + 2048]
        np.minimum(out, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _bands(sig: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(sig[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, HASHES, ROWS)]


def _fewest_matches(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values among `compared` with which a pair stays: with fewer, the posterior probability that its
    similarity is the threshold or more, under a uniform prior, is less than the tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000

    def reach(m: int) -> float:
        logs = m * np.log(grid) + (compared - m) * np.log1p(-grid)
        p = np.exp(logs - logs.max())
        return float(p[grid >= threshold].sum() / p.sum())

    return next((m for m in range(compared + 1) if reach(m) >= tolerance), compared)


#: By the number of values compared so far; a plain dict, so that tasks carry it along.
FEWEST = {compared: _fewest_matches(compared) for compared in range(STEP, HASHES + 1, STEP)}


def surviving_pairs(sigs: np.ndarray, others: np.ndarray, same: bool) -> np.ndarray:
    """Index pairs (i, j) of sets that pass every step of the incremental comparison; i < j if both blocks are the same."""
    left = np.argwhere(np.triu(np.ones((len(sigs), len(others)), bool), 1)) if same else np.argwhere(np.ones((len(sigs), len(others)), bool))
    matches = np.zeros(len(left), np.int32)
    for at in range(0, HASHES, STEP):
        if not len(left):
            break
        for part in range(0, len(left), 1 << 17):
            p = left[part : part + (1 << 17)]
            matches[part : part + (1 << 17)] += (sigs[p[:, 0], at : at + STEP] == others[p[:, 1], at : at + STEP]).sum(axis=1, dtype=np.int32)
        stay = matches >= FEWEST[at + STEP]
        left, matches = left[stay], matches[stay]
    return left


def linked(sets: list[np.ndarray], others: list[np.ndarray], pairs: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs have an exact Jaccard similarity of the threshold or more."""
    out = np.zeros(len(pairs), bool)
    if not len(pairs):
        return out
    # Sets of a group share most shingles: number them once and intersect with marks.
    order = np.argsort(pairs[:, 0], kind="stable")
    universe = np.unique(np.concatenate([*(sets[i] for i in np.unique(pairs[:, 0])), *(others[j] for j in np.unique(pairs[:, 1]))]))
    numbered = {j: np.searchsorted(universe, others[j]) for j in np.unique(pairs[:, 1]).tolist()}
    marks, current = np.zeros(len(universe), bool), -1
    for k in order.tolist():
        i, j = pairs[k].tolist()
        if i != current:
            marks[:] = False
            marks[np.searchsorted(universe, sets[i])] = True
            current = i
        a, b = len(sets[i]), len(others[j])
        if min(a, b) < threshold * max(a, b) - 1e-9:
            continue
        both = int(np.count_nonzero(marks[numbered[j]]))
        out[k] = both >= threshold * (a + b - both) - 1e-9
    return out


def _class(s: np.ndarray) -> int:
    """The class of a shingle set."""
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def _classes(docs: DataFrame) -> DataFrame:
    """docs(key, row, text) -> key, row, cls, bands: the class of equal shingle sets (NULL without words) and the set's bands."""

    def work(batches):
        worker_store("shingles")
        for batch in batches:
            cls, bands = [], []
            for text in batch.column(2):
                s = shingles(text.as_py() or "")
                cls.append(_class(s) if len(s) else None)
                bands.append(_bands(minhash(s)) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["key", "row", "cls", "bands"])

    return docs.mapInArrow(work, "key long, row long, cls long, bands array<long>")


def _signed(members: DataFrame) -> DataFrame:
    """members(cls, ..., text) -> ..., sig, shingles of the rows whose text is of the class: MinHash values and, packed, the shingle set itself."""
    names = [c for c in members.columns if c != "text"]
    kinds = dict(members.dtypes)

    def work(batches):
        worker_store("shingles")
        for batch in batches:
            sets = [shingles(t.as_py() or "") for t in batch.column(len(names))]
            own = [i for i, cls in enumerate(batch.column(names.index("cls")).to_pylist()) if len(sets[i]) and _class(sets[i]) == cls]
            batch, sets = batch.take(pa.array(own, pa.int64())), [sets[i] for i in own]
            cols = [pa.array([minhash(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *cols], names=[*names, "sig", "shingles"])

    return members.select(*names, "text").mapInArrow(work, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sig binary, shingles binary")


def similar(docs: DataFrame) -> DataFrame:
    """docs(key, text), keys NULL or repeated with other texts included -> key, row, cls, root, class_id, component_id, n_links.

    row is the row_key of key and text, root the smallest class of the row's component. Texts with equal sets of shingles form a class; class_id is the class's smallest key (NULL where all its keys are). n_links counts the other rows
    whose set has a Jaccard similarity of at least 0.8 with the row's. component_id is the smallest key that links
    lead to. Rows without words (NULL, empty or blank texts) have no links, no class and no root. Very long texts count whole;
    an empty table gives no rows; columns other than key and text are ignored.
    """
    docs = docs.select("key", row_key(F.col("key"), F.col("text")).alias("row"), "text")
    rows = cut(_classes(docs))
    worded = rows.where("cls is not null")
    classes = worded.groupBy("cls").agg(F.min("key").alias("class_id"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = cut(classes)
    bands = classes.select("cls", F.explode("bands").alias("band"))

    # Bands with the same members are one group of candidates.
    groups = bands.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("who")).where("n > 1")
    groups = groups.groupBy("n", "who").agg(F.min("band").alias("band")).select("band")
    members = cut(bands.join(groups, "band").select("band", "cls"))
    chosen = members.select("cls").distinct().join(classes.select("cls", "row", "copies"), "cls")
    # One text of each class that has a candidate, with its MinHash values and its shingles.
    text = docs.join(chosen, "row").select("cls", "copies", "text")
    signed = cut(_signed(text).dropDuplicates(["cls"]))

    def candidates(a, b):
        """The classes of a unit, and the pairs of them that the pruning leaves."""
        both, n = a if b is None else pa.concat_tables([a, b]), len(a)
        sigs = np.array([np.frombuffer(s.as_buffer(), np.uint32) for s in both.column("sig")]).reshape(-1, HASHES)
        pairs = surviving_pairs(sigs, sigs, True) if b is None else surviving_pairs(sigs[:n], sigs[n:], False) + [0, n]
        return both.column("cls").to_pylist(), pairs

    def prune(a, b):
        cls, pairs = candidates(a, b)
        got = stars(len(cls), pairs.tolist())
        return [cls[i] for i, _ in got], [cls[r] for _, r in got]

    ab = pa.schema([pa.field("a", pa.int64()), pa.field("b", pa.int64())])
    near = by_unit(in_blocks(members.join(signed.select("cls", "sig"), "cls"), "band", "cls", BLOCK), ["cls", "sig"], ab, prune)
    # What passes hangs together in clusters; links can only be inside one. A cluster of one block gets each set once; in a
    # larger one a set goes only to the blocks that hold a candidate of it.
    clusters = components(near)

    def verify(a, b):
        cls, pairs = candidates(a, b)
        both = a if b is None else pa.concat_tables([a, b])
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in both.column("shingles")]
        pairs = pairs[linked(sets, sets, pairs)]
        copies, links = both.column("copies").to_numpy(), np.zeros(len(cls), np.int64)
        np.add.at(links, pairs[:, 0], copies[pairs[:, 1]])
        np.add.at(links, pairs[:, 1], copies[pairs[:, 0]])
        root = dict(stars(len(cls), pairs.tolist()))
        some = np.flatnonzero(links).tolist()
        return [cls[i] for i in some], [cls[root.get(i, i)] for i in some], links[some].tolist()

    abn = pa.schema([*ab, pa.field("links", pa.int64())])
    inside = clusters.select(F.col("node").alias("cls"), F.col("root").alias("cluster")).join(signed.select("cls", F.octet_length("shingles").alias("bytes")), "cls")
    units = in_linked_blocks(inside, "cluster", "cls", members, "band", BLOCK, F.col("bytes"), BLOCK_BYTES)
    found = cut(by_unit(units.join(signed, "cls"), ["cls", "copies", "sig", "shingles"], abn, verify))
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    joined = components(found.select("a", "b"))

    known = classes.select("cls", "class_id", "copies").join(counts, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    first = known.groupBy("root").agg(F.min("class_id").alias("component_id"))
    known = known.join(first, "root").select("cls", "root", "class_id", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(known, "cls", "left")
    return out.select("key", "row", "cls", "root", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("component_id", "key").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, component_id, kept for each row of `documents`, by the whole text. Texts without words
    (NULL, empty, blank) have no links; rows with NULL or repeated ids are rows like others; ties of component go to the
    smallest id; an empty table gives no rows; columns other than doc_id and text are ignored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    got = similar(docs).select(F.col("key").alias("doc_id"), "class_id", "n_links", "component_id")
    return got.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
