"""Nearest neighbours by largest inner product: p-stable hashing in several tables, perturbed buckets in order of success."""

from __future__ import annotations

import heapq
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from canlake.operators.aggregate import broadcast_if_small

from .common import cut

#: Tables, width of a cell, vectors that a bucket is to hold on average, cells of about equal weight that a hash value has.
TABLES, WIDTH, POINTS, CELLS = 4, 1.0, 1024, 4.2
#: Buckets of a table that a query visits at most; one that needs more is compared with all vectors.
PROBES = 2048
#: Vectors and queries of a unit of work; larger buckets are dealt into such blocks.
BLOCK, QUERIES = 4096, 16_384
#: Bounded samples: vectors (and their bytes) that bounds of a query's scores come from, and queries of the audit.
SAMPLE, SAMPLE_BYTES, AUDIT = 16_384, 8 << 20, 64
#: Shares of neighbours that visited buckets are estimated to hold, tried in this order until the audit finds GOAL of them.
TARGETS, GOAL = (0.9, 0.95, 0.99, 0.999, 0.99999), 0.97
SALTS = 64
#: Exact inner products that are taken at a time.
PAIRS = 1 << 16


def classes(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> a (struct of two hashes), v, vec_id: vectors that take part, exact repeats of a row once."""
    kind = vectors.schema["embedding"].dataType
    kind = kind if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType | DoubleType) else ArrayType(DoubleType())
    v = F.col("embedding").cast(kind)
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))
    return good.distinct().withColumn("a", F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(7), "v").alias("y")))


def matrix(lists: pa.ListArray, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def log_norms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their largest component, and the logarithms of the rows' norms; no square over- or underflows."""
    top = np.abs(x).max(axis=1, keepdims=True)
    y = x / top
    return y, (np.log(top) + 0.5 * np.log((y * y).sum(axis=1, keepdims=True)))[:, 0]


@lru_cache(maxsize=4)
def family(d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions with normal components for d dimensions and the one that is added, and shifts, of TABLES * k hash functions."""
    rnd = np.random.default_rng(1_000_003 * d + k)
    return rnd.normal(size=(d + 1, TABLES * k)), rnd.uniform(0, WIDTH, TABLES * k)


def bucket(cells: np.ndarray) -> np.ndarray:
    """64-bit numbers of buckets, from their cells (last axis)."""
    h = np.zeros(cells.shape[:-1], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(cells.shape[-1]):
            h = (h ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def vector_buckets(x: np.ndarray, k: int, longest: float) -> np.ndarray:
    """A bucket in each table. Vectors are divided by the longest one's norm and lifted to the unit sphere by one more
    component, so that a larger inner product with a query is a smaller distance from it."""
    y, logs = log_norms(x)
    u = y * np.exp(logs - longest - 0.5 * np.log((y * y).sum(axis=1)))[:, None]
    lifted = np.hstack([u, np.sqrt(np.maximum(1 - (u * u).sum(axis=1, keepdims=True), 0))])
    directions, shifts = family(x.shape[1], k)
    return bucket(np.floor((lifted @ directions + shifts) / WIDTH).reshape(len(x), TABLES, k))


def query_places(x: np.ndarray, k: int) -> np.ndarray:
    """Where queries, scaled to the unit sphere, fall on each table's lines, in cells."""
    y = log_norms(x)[0]
    u = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
    directions, shifts = family(x.shape[1], k)
    return ((u @ directions[:-1] + shifts) / WIDTH).reshape(len(x), TABLES, k)


def probes(place: np.ndarray, distance: float, share: float) -> np.ndarray | None:
    """Cells of a table's buckets in order of the estimated chance to hold a neighbour at that distance, until the chances sum
    up to `share`; None if PROBES are not enough. A neighbour is off by a normal amount on each line."""
    ways = []
    for p in place:
        home = math.floor(p)
        reach = math.ceil(5 * distance / WIDTH) + 1
        edges = [math.erf((home + e - p) * WIDTH / (distance * math.sqrt(2))) / 2 for e in range(-reach, reach + 2)]
        chances = sorted(((b - a, home + e) for a, b, e in zip(edges, edges[1:], range(-reach, reach + 1), strict=False) if b > a), reverse=True)
        ways.append(chances)
    found, total = [], 0.0
    heap = [(-math.prod(w[0][0] for w in ways), (0,) * len(ways), 0)]
    while heap and total < share:
        if len(found) == PROBES:
            return None
        chance, at, first = heapq.heappop(heap)
        total -= chance
        found.append([w[i][1] for w, i in zip(ways, at, strict=True)])
        for j in range(first, len(ways)):  # each set of steps is reached in one way only
            if at[j] + 1 < len(ways[j]):
                w, i = ways[j], at[j]
                heapq.heappush(heap, (chance / w[i][0] * w[i + 1][0], (*at[:j], i + 1, *at[j + 1 :]), j))
    return np.array(found)


def visited(place: np.ndarray, distance: float, target: float) -> list[np.ndarray] | None:
    """The buckets that a query visits in each table, so that a neighbour is missed by all tables with a chance of 1 - target."""
    each = 1 - (1 - target) ** (1 / TABLES)
    cells = [probes(p, distance, each) for p in place]
    return None if any(c is None for c in cells) else [bucket(c) for c in cells]


class Sample:
    """Vectors that ride along with every task: bounds of a query's scores."""

    def __init__(self, table: pa.Table, n: int, longest: float, k: int):
        self.n, self.longest, self.k, self.by_dim = n, longest, k, {}
        self.share = table.num_rows / max(n, 1)
        v = table.column("v").combine_chunks()
        sizes = v.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            self.by_dim[int(d)] = matrix(v.filter(pa.array(sizes == d)), int(d))

    def bounds(self, x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query a score that its `top` best vectors reach at least (-inf if unknown), and about how far its
        `top`-th neighbour is (2 if unknown)."""
        s = self.by_dim.get(x.shape[1], np.zeros((0, x.shape[1])))
        least, far = np.full(len(x), -np.inf), np.full(len(x), 2.0)
        if not len(s):
            return least, far
        scores = -np.sort(-(x @ s.T), axis=1)
        if len(s) >= top:
            at = scores[:, top - 1]
            least = at - np.abs(at) * 1e-9 - 1e-300
        nth = min(max(math.ceil(top * self.share), 1), len(s)) - 1
        with np.errstate(over="ignore", invalid="ignore"):
            cosine = scores[:, nth] * np.exp(-log_norms(x)[1] - self.longest)
        return least, np.sqrt(np.maximum(2 - 2 * np.clip(np.nan_to_num(cosine), -1, 1), 1e-4))


def best(scores: np.ndarray, q: np.ndarray, p: np.ndarray, first: np.ndarray, least: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, exact score) of each query's `top` vectors among p with scores of `least` or more; ties by first."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if scores.shape[1] > top:
        nth = -np.partition(-scores, top - 1, axis=1)[:, top - 1]
        least = np.maximum(least, nth - np.abs(nth) * 1e-9 - 1e-300)
    near = scores >= least[:, None]
    if len(q) > 1 and np.count_nonzero(near) > PAIRS:  # many ties: fewer queries at a time
        half = len(q) // 2
        a, b = (best(scores[s], q[s], p, first, least[s], top) for s in (slice(half), slice(half, None)))
        return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])
    i, j = np.nonzero(near)
    exact = (q[i] * p[j]).sum(axis=1)
    exact[np.isnan(exact)] = -np.inf
    order = np.lexsort((first[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    starts = np.searchsorted(i, np.arange(len(q)))
    keep = np.arange(len(i)) - starts[i] < top
    return i[keep], j[keep], exact[keep]


FOUND = pa.schema([("q", pa.struct([("x", pa.int64()), ("y", pa.int64())])), ("score", pa.float64()), ("a", pa.struct([("x", pa.int64()), ("y", pa.int64())])), ("ids", pa.list_(pa.int64()))])


def compare(points: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """points(t, d, b, a, ids, v) and queries(t, d, b, a, least, v) -> q, score, a, ids: each query's best vectors of each of
    its buckets (t, d, b).

    A bucket of more than BLOCK vectors or QUERIES queries is dealt into blocks, and units of work are pairs of blocks, so
    that no bucket's rows meet in one task; only large buckets are looked up, by bucket and salt.
    """
    key = ["t", "d", "b"]
    sizes = lambda rows, size, name: rows.groupBy(*key).agg(F.ceil(F.count("*") / size).cast("int").alias(name)).where(F.col(name) > 1)
    large = sizes(points, BLOCK, "blocks").join(sizes(queries, QUERIES, "parts"), key, "full").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    one = F.lit(1)

    def dealt(rows: DataFrame, own: str, other: str, side: int) -> DataFrame:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("a", F.lit(9)), F.lit(SALTS)).cast("int")).join(large, [*key, "salt"], "left")
        rows = rows.withColumn(own, F.pmod(F.xxhash64("a", F.lit(5)), F.coalesce(own, one)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)))
        return rows.withColumn("side", F.lit(side)).drop("salt")

    both = dealt(points, "blocks", "parts", 0).unionByName(dealt(queries, "parts", "blocks", 1), allowMissingColumns=True)
    unit = [*key, "blocks", "parts"]
    ready = both.repartition(*unit).sortWithinPartitions(*unit, "side").select(F.xxhash64(*unit).alias("unit"), "d", "side", "a", "ids", "least", "v")

    def work(batches):
        unit = x = names = None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            u, side = batch.column("unit").to_numpy(), batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero((u[1:] != u[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(u)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(start, end - start)
                if u[start] != unit:
                    unit, held, x = u[start], [], None
                if side[start] == 0:
                    held.append(part)
                    continue
                if not held and x is None:
                    continue
                d = part.column("d")[0].as_py()
                if x is None:
                    names = pa.Table.from_batches(held).select(["a", "ids"]).combine_chunks()
                    x, held = np.vstack([matrix(h.column("v"), d) for h in held]), []
                    first = np.array([i[0] for i in names.column("ids").to_pylist()])
                q, least = matrix(part.column("v"), d), part.column("least").to_numpy()
                for k in range(0, len(q), 256):
                    i, j, score = best(q[k : k + 256] @ x.T, q[k : k + 256], x, first, least[k : k + 256], top)
                    if len(i):
                        columns = [part.column("a").take(pa.array(i + k)), pa.array(score), *(names.column(c).take(pa.array(j)).combine_chunks() for c in ("a", "ids"))]
                        yield pa.RecordBatch.from_arrays(columns, schema=FOUND)

    return ready.mapInArrow(work, from_arrow_schema(FOUND))


def _best_classes(found: DataFrame, top: int) -> DataFrame:
    """The `top` best classes of each query, each once, from all its tables and buckets."""
    nth = F.dense_rank().over(W.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0], "a"))
    return found.withColumn("nth", nth).where(F.col("nth") <= top).groupBy("q", "nth").agg(F.first("score").alias("score"), F.first("a").alias("a"), F.first("ids").alias("ids")).drop("nth")


def search(vectors: DataFrame, every: int = 20, top: int = 20, report: dict | None = None) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` its `top`
    other rows with the largest inner products in double precision, all if there are fewer; ties go to the smaller vec_id.

    Vectors that are NULL, zero or hold NULL or non-finite components take no part, nor do rows without a vec_id; vectors are
    compared with those of their length only. Exact repeats of a row count once; rows that share an id but not the vector are
    rows of their own. An empty table gives no rows; other columns are ignored.

    Equal vectors are one class, hashed once: they have equal scores, so only their `top` + 1 smallest ids can be answers.
    Queries visit buckets until they are likely to hold the neighbours; how likely is set by an audit of AUDIT queries
    against all vectors, so that GOAL of their true neighbours lie in visited buckets. Queries that need over PROBES buckets of
    a table, or find fewer rows than there are, are compared with all vectors, in blocks. `report` takes the audit's figures.
    """
    more, report = top + 1, {} if report is None else report
    rows = cut(classes(vectors))
    ranked = rows.withColumn("nth", F.row_number().over(W.partitionBy("a").orderBy("vec_id"))).where(F.col("nth") <= more)
    kinds = cut(ranked.groupBy("a", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("d", F.size("v")))
    asked = rows.where(F.col("vec_id") % every == 0)
    asks = asked.select("a", "v").distinct().withColumn("d", F.size("v"))

    def norms(batches):
        for batch in batches:
            d, v = batch.column("d").to_numpy(), batch.column("v")
            logs = [log_norms(matrix(v.filter(pa.array(d == k)), int(k)))[1].max() for k in np.unique(d)]
            yield pa.RecordBatch.from_pydict({"logs": pa.array(logs, pa.float64())})

    n = kinds.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = kinds.select("d", "v").mapInArrow(norms, "logs double").agg(F.max("logs")).first()[0]
    widest = kinds.agg(F.max("d")).first()[0]
    k = max(1, round(math.log(max(n / POINTS, 1)) / math.log(CELLS)))
    by_hash = F.xxhash64("a", F.lit(11))
    sample = Sample(kinds.orderBy(by_hash).limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * widest)))).select("v").toArrow(), n, longest, k)
    target = _audited(kinds, asks.orderBy(by_hash).limit(AUDIT).toArrow(), sample, top, report)
    shared = vectors.sparkSession.sparkContext.broadcast(sample)
    sent = "a struct<x: long, y: long>, d int, v " + kinds.schema["v"].dataType.simpleString()

    def laid(batches):
        for batch in batches:
            d, out = batch.column("d").to_numpy(), np.zeros((batch.num_rows, TABLES), np.int64)
            for size in np.unique(d):
                out[d == size] = vector_buckets(matrix(batch.column("v").filter(pa.array(d == size)), int(size)), k, longest)
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * TABLES, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, buckets], names=[*batch.schema.names, "buckets"])

    def aimed(batches):
        for batch in batches:
            d, v = batch.column("d").to_numpy(), batch.column("v")
            least, ways = np.zeros(len(d)), [None] * len(d)
            for size in np.unique(d):
                at = np.flatnonzero(d == size)
                for some in np.array_split(at, -(-len(at) // 256)):
                    x = matrix(v.take(pa.array(some)), int(size))
                    least[some], far = shared.value.bounds(x, more)
                    for i, place, distance in zip(some, query_places(x, k), far, strict=True):
                        got = visited(place, distance, target) if target else None
                        ways[i] = got and [{"t": t, "b": b} for t, bs in enumerate(got) for b in bs.tolist()]
            kind = pa.list_(pa.struct([("t", pa.int32()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least), pa.array(ways, kind)], names=[*batch.schema.names, "least", "ways"])

    index = kinds.select("a", "d", "v", "ids").mapInArrow(laid, sent + ", ids array<long>, buckets array<long>")
    points = index.select("a", "d", "v", "ids", F.posexplode("buckets").alias("t", "b"))
    aims = cut(asks.select("a", "d", "v").mapInArrow(aimed, sent + ", least double, ways array<struct<t: int, b: long>>"))
    queries = aims.select("a", "d", "v", "least", F.explode("ways").alias("w")).select("a", "d", "v", "least", "w.t", "w.b")
    found = cut(_best_classes(compare(points, queries, more), more))

    # What found less than there is: queries without ways, and those whose buckets held too few.
    held = found.groupBy("q").agg(F.sum(F.size("ids")).alias("held"))
    there = kinds.groupBy("d").agg(F.sum(F.size("ids")).alias("there"))
    short = aims.join(held, aims["a"] == held["q"], "left").join(broadcast_if_small(there), "d").where(F.coalesce("held", F.lit(0)) < F.least("there", F.lit(more)))
    short = cut(short.select("a", "d", "v", "least", F.lit(0).alias("t"), F.lit(0).cast("long").alias("b")))
    report["compared with all"] = short.count()
    if report["compared with all"]:
        everything = kinds.select("a", "d", "v", "ids", F.lit(0).alias("t"), F.lit(0).cast("long").alias("b")).join(broadcast_if_small(short.select("d").distinct()), "d", "left_semi")
        found = found.join(short.select(F.col("a").alias("q")), "q", "left_anti").unionByName(_best_classes(compare(everything, short, more), more))

    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("a").alias("q")).join(found, "q").withColumn("vec_id", F.explode("ids"))
    answers = answers.where((F.col("a") != F.col("q")) | (F.col("vec_id") != F.col("query_id")))
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _audited(kinds: DataFrame, asks: pa.Table, sample: Sample, top: int, report: dict) -> float | None:
    """The first of TARGETS with which the buckets that the audit's queries visit hold GOAL of their true neighbours, which a
    comparison with all vectors gives; None if none does."""
    dims = asks.column("d").to_numpy()
    by_dim = {int(d): np.flatnonzero(dims == d) for d in np.unique(dims)}
    v = asks.column("v").combine_chunks()
    questions = {d: matrix(v.take(pa.array(at)), d) for d, at in by_dim.items()}

    def work(batches):
        for batch in batches:
            d = batch.column("d").to_numpy()
            for size in np.unique(d):
                if int(size) not in questions:
                    continue
                part = batch.filter(pa.array(d == size))
                x, q = matrix(part.column("v"), int(size)), questions[int(size)]
                i, j, score = best(q @ x.T, q, x, np.arange(len(x)), np.full(len(q), -np.inf), top + 1)
                yield pa.RecordBatch.from_arrays([pa.array(by_dim[int(size)][i].astype(np.int32)), pa.array(score), part.column("v").take(pa.array(j))], names=["q", "score", "v"])

    kind = kinds.schema["v"].dataType.simpleString()
    true = kinds.select("d", "v").mapInArrow(work, f"q int, score double, v {kind}")
    true = true.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))).where(F.col("nth") <= top + 1).select("q", "v").toArrow()
    whose, near = true.column("q").to_numpy(), true.column("v").combine_chunks()
    buckets, places, far = {}, {}, {}
    for d, at in by_dim.items():
        mine = np.flatnonzero(np.isin(whose, at))
        own = {int(i): q for i, q in zip(at, questions[d], strict=True)}
        for i, x, b in zip(whose[mine], matrix(near.take(pa.array(mine)), d), vector_buckets(matrix(near.take(pa.array(mine)), d), sample.k, sample.longest), strict=True):
            if not np.array_equal(x, own[int(i)]):
                buckets.setdefault(int(i), []).append(b)
        places |= dict(zip(at.tolist(), query_places(questions[d], sample.k), strict=True))
        far |= dict(zip(at.tolist(), sample.bounds(questions[d], top + 1)[1], strict=True))
    report["audited"] = sum(map(len, buckets.values()))
    for target in TARGETS:
        hits = 0
        for i, some in buckets.items():
            ways = visited(places[i], far[i], target)
            hits += len(some) if ways is None else sum(any(b[t] in set(w.tolist()) for t, w in enumerate(ways)) for b in some)
        report["target"], report["recall"] = target, hits / max(report["audited"], 1)
        if report["recall"] >= GOAL or not report["audited"]:
            return target
    report["target"] = None
    return None


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search() of the whole table `embeddings`, with queries divisible by 20; what it says of odd vectors and ties holds."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
