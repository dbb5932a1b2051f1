"""Near-duplicate embeddings: navigable small-world graphs per shard, searched with beams that widen until audits pass."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .units import by_unit, in_blocks

#: A label's vectors are dealt into shards of about this many rows and components; a shard has one graph, built once.
SHARD, SHARD_SIZE = 65_536, 4_194_304
#: Links of a node in the upper layers and in the lowest one; the beam while building, and the first one while searching.
LINKS, LINKS_0, BUILD_BEAM, BEAM = 12, 24, 48, 48
#: A search is audited on so many probes and so many of its queries, and repeated with twice the beam below this recall.
AUDITED, RECALL = 64, 0.99
THRESHOLD = 0.98
#: Queries that are searched at a time, and numbers in a product of all nodes with some.
BATCH, PRODUCT = 256, 1 << 22


def _best(ids: np.ndarray, sims: np.ndarray, keep: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    if ids.shape[1] > keep:
        top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
        return tuple(np.take_along_axis(x, top, 1) for x in (ids, sims, *more))
    return (ids, sims, *more)


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of up to `beam` nodes near each query (-1: none): follows the links of the best nodes so far
    that aren't followed yet, for all queries of a batch at once, until each beam has none.

    seen: flags by query and node, all False before and after, so that its cost is that of the nodes that were looked at.
    """
    n, rows = len(vectors), np.arange(len(queries))
    ids = entries
    sims = np.where(ids < 0, -np.inf, np.einsum("bd,bkd->bk", queries, vectors[ids])).astype(np.float32)
    marked = [(np.repeat(rows, ids.shape[1]), np.where(ids < 0, n, ids).ravel())]
    seen[marked[0]] = True
    seen[rows, n] = True  # stands for no node
    done = ids < 0
    while True:
        open_ = np.where(done, -np.inf, sims)
        k = min(4, open_.shape[1])
        top = np.argpartition(-open_, k - 1, axis=1)[:, :k]
        live = np.take_along_axis(open_, top, 1) > -np.inf
        on = live.any(axis=1)
        if not on.any():
            break
        at = rows[on]
        follow = np.where(live[on], np.take_along_axis(ids[on], top[on], 1), -1)
        done[at[:, None], top[on]] = True
        near = links[follow].reshape(len(at), -1)  # the last row of links holds no node
        near = np.where(near < 0, n, near)
        near[seen[at[:, None], near]] = n
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        some = near < n
        width = int(some.sum(axis=1).max(initial=0))
        if not width:
            continue
        i, j = np.nonzero(some)
        put = (np.cumsum(some, axis=1) - 1)[i, j]
        node = near[i, j]
        seen[at[i], node] = True
        marked.append((at[i], node))
        pad, pad_s = np.full((len(ids), width), -1, np.int32), np.full((len(ids), width), -np.inf, np.float32)
        pad[at[i], put] = node
        pad_s[at[i], put] = np.einsum("kd,kd->k", queries[at[i]], vectors[node])
        ids, sims, done = _best(np.concatenate([ids, pad], 1), np.concatenate([sims, pad_s], 1), beam, np.concatenate([done, pad < 0], 1))
    for m in marked:
        seen[m] = False
    seen[rows, n] = False
    return ids, sims


class Graph:
    """A hierarchical navigable small world over unit vectors whose order says nothing about them.

    The first n / LINKS^k vectors are in layer k as well. Built in batches that double the graph at most.
    """

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.seen = np.zeros((BATCH, len(vectors) + 1), bool)
        if layers is not None:
            self.layers = layers
            return
        self.layers = [np.full((m + 1, w), -1, np.int32) for m, w in self.shape(len(vectors))]
        sims = [np.full(x.shape, -np.inf, np.float32) for x in self.layers]
        done = 1
        while done < len(vectors):
            new = np.arange(done, min(len(vectors), done + min(BATCH, done)))
            self._insert(new, sims)
            done = int(new[-1]) + 1

    @staticmethod
    def shape(n: int) -> list[tuple[int, int]]:
        """The number of nodes and the width of each layer of a graph of n nodes."""
        out = [(n, LINKS_0)]
        while out[-1][0] // LINKS:
            out.append((out[-1][0] // LINKS, LINKS))
        return out

    def _entries(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """Good nodes to start from in layer down_to: narrow searches from the top layer down."""
        at = np.zeros((len(queries), 1), np.int32)
        for layer in self.layers[:down_to:-1]:
            at, sims = beam_search(self.vectors[: len(layer) - 1], layer, queries, at, 8, self.seen)
            at = np.take_along_axis(at, np.argsort(-sims, axis=1)[:, :4], 1)
        return at

    def _insert(self, new: np.ndarray, link_sims: list[np.ndarray]) -> None:
        for k in range(len(self.layers) - 1, -1, -1):
            links, known = self.layers[k], link_sims[k]
            n, width = len(links) - 1, links.shape[1]
            some = new[new < n]
            if not len(some):
                continue
            v = self.vectors[some]
            ids, sims = beam_search(self.vectors[:n], links, v, self._entries(v, k), BUILD_BEAM, self.seen)
            among = v @ v.T
            np.fill_diagonal(among, -np.inf)
            ids, sims = np.concatenate([ids, np.repeat(some[None, :].astype(np.int32), len(some), 0)], 1), np.concatenate([sims, among], 1)
            ids, sims = _best(ids, sims, width)
            links[some, : ids.shape[1]] = np.where(sims > -np.inf, ids, -1)
            known[some, : ids.shape[1]] = sims
            # Links back: each node keeps its nearest ones, and a quarter of its older ones so that ways out of dense groups stay.
            src, dst, s = np.repeat(some, ids.shape[1]).astype(np.int32), ids.ravel(), sims.ravel()
            ok = s > -np.inf
            src, dst, s = src[ok], dst[ok], s[ok]
            by = np.lexsort((-s, dst))
            src, dst, s = src[by], dst[by], s[by]
            nodes, first = np.unique(dst, return_index=True)
            nth = np.arange(len(dst)) - np.repeat(first, np.diff([*first, len(dst)]))
            src, dst, s, nth = (x[nth < width] for x in (src, dst, s, nth))
            row = np.searchsorted(nodes, dst)
            fresh, fresh_s = np.full((len(nodes), width), -1, np.int32), np.full((len(nodes), width), -np.inf, np.float32)
            fresh[row, nth], fresh_s[row, nth] = src, s
            fresh_s[(fresh[:, :, None] == links[nodes][:, None, :]).any(axis=2)] = -np.inf  # links that are there already
            cand, cand_s = np.concatenate([links[nodes], fresh], 1), np.concatenate([known[nodes], fresh_s], 1)
            order = np.argsort(-cand_s, axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(2 * width)[None, :], 1)
            full = (cand_s > -np.inf).sum(axis=1, keepdims=True) > width
            keep = width - width // 4
            # Where there are too many, those after the nearest `keep` come in the order of their age.
            rank = np.where(full & (rank >= keep), keep + np.arange(2 * width)[None, :] + 2 * width * (cand_s == -np.inf), rank)
            top = np.argsort(rank, axis=1, kind="stable")[:, :width]
            cand, cand_s = np.take_along_axis(cand, top, 1), np.take_along_axis(cand_s, top, 1)
            links[nodes], known[nodes] = np.where(cand_s > -np.inf, cand, -1), cand_s

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of up to `beam` nodes for each of at most BATCH queries."""
        return beam_search(self.vectors, self.layers[0], queries, self._entries(queries, 0), beam, self.seen)


def probes(unit: np.ndarray, threshold: float = THRESHOLD, n: int = AUDITED) -> np.ndarray:
    """Vectors that are just within the threshold of evenly spread nodes, each turned in a direction of its own: queries
    with a true link at least, as hard to find as any."""
    v = unit[np.unique(np.linspace(0, len(unit) - 1, min(n, len(unit))).astype(int))]
    r = np.random.default_rng(len(unit)).normal(size=v.shape)
    r -= np.einsum("kd,kd->k", r, v)[:, None] * v
    size = np.linalg.norm(r, axis=1, keepdims=True)
    c = threshold + 1e-6
    turned = c * v + np.sqrt(1 - c * c) * r / np.where(size > 1e-9, size, 1)
    out = np.where(size > 1e-9, turned, v)  # one component: nowhere to turn
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _within(unit: np.ndarray, queries: np.ndarray, at: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, nodes) within the threshold, of the queries at `at`, by comparing all nodes in products of bounded size."""
    step = max(1, min(BATCH, PRODUCT // len(unit)))
    for start in range(0, len(at), step):
        some = at[start : start + step]
        i, j = np.nonzero(queries[some] @ unit.T >= threshold)
        yield some[i], j


def _searched(graph: Graph, unit: np.ndarray, queries: np.ndarray, threshold: float, beam: int, audit: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, nodes) within the threshold, a batch of queries at a time, that the graph leads to. A query whose whole
    beam is within the threshold may have more links: it is searched again with a wider one. Those that are near so many
    that the beam would hold a quarter of the nodes are compared with all, and counted in audit["exact"]."""
    q32, slack = np.ascontiguousarray(queries, np.float32), threshold - 1e-4  # single precision finds, double precision decides
    for start in range(0, len(queries), BATCH):
        todo, width = np.arange(start, min(start + BATCH, len(queries))), beam
        while len(todo):
            ids, sims = graph.search(q32[todo], width)
            full = (sims.min(axis=1) >= slack) & (ids.shape[1] >= width) & (width < len(unit))
            i, j = np.nonzero((sims >= slack) & ~full[:, None])
            q, node = todo[i], ids[i, j]
            for at in range(0, len(q), 1 << 16):
                part = slice(at, at + (1 << 16))
                good = np.einsum("kd,kd->k", queries[q[part]], unit[node[part]]) >= threshold
                yield q[part][good], node[part][good]
            todo, width = todo[full], width * 4
            if len(todo) and width * 4 >= len(unit):
                audit["exact"] += len(todo)
                yield from _within(unit, queries, todo, threshold)
                break


def _keys(pairs, n: int) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(q.astype(np.int64) * n + node for q, node in pairs)])


def find_links(unit: np.ndarray, queries: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM, graph: Graph | None = None) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], dict]:
    """((queries, nodes) with a similarity of the threshold or more, a bounded part at a time; the audit) of unit vectors
    in double precision. A vector's link with itself is among them.

    First the audit: what comparing all nodes finds for some probes just within the threshold of a node, and for an
    evenly spread sample of the queries (links with oneself left out), is looked for in the graph. Below RECALL it is
    repeated with twice the beam; once the beam would hold a quarter of the nodes, all queries are compared with all
    nodes. audit: true, hits, real (true links of the sampled queries), beam, exact (queries compared with all nodes,
    complete when the pairs are read).
    """
    graph, n = graph or Graph(unit), len(unit)
    sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
    asked, tries = np.ascontiguousarray(queries[sample]), probes(unit, threshold)
    real = _keys(_within(unit, asked, np.arange(len(asked)), threshold), n)
    own = np.arange(len(sample)) * n + sample if queries is unit else np.empty(0, np.int64)
    real = real[~np.isin(real, own)]
    planted = _keys(_within(unit, tries, np.arange(len(tries)), threshold), n)
    audit = {"true": len(real) + len(planted), "real": len(real), "exact": 0}
    while True:
        tally = {"exact": 0}
        found = _keys(_searched(graph, unit, asked, threshold, beam, tally), n), _keys(_searched(graph, unit, tries, threshold, beam, tally), n)
        audit |= {"hits": int(np.isin(real, found[0]).sum() + np.isin(planted, found[1]).sum()), "beam": beam}
        if audit["hits"] >= RECALL * audit["true"]:
            return _searched(graph, unit, queries, threshold, beam, audit), audit
        beam *= 2
        if beam * 4 >= n:
            audit |= {"hits": audit["true"], "beam": beam, "exact": len(queries)}
            return _within(unit, queries, np.arange(len(queries)), threshold), audit


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts the ends of the links under one root, in place; roots are the smallest of their members and point to themselves."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (deeper := root[root] != root).any():
            root[deeper] = root[root[deeper]]


def _matrix(rows: pa.Table, column: str) -> np.ndarray:
    """The unit vectors of a column of lists of equal lengths."""
    lists = rows.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _packed(graph: Graph) -> list[bytes]:
    """Each node's links: its row of each layer that it is in."""
    return [b"".join(x[i].tobytes() for x in graph.layers if i < len(x) - 1) for i in range(len(graph.vectors))]


def _unpacked(packed: list[bytes]) -> list[np.ndarray]:
    layers, at = [], 0
    for n, width in Graph.shape(len(packed)):
        rows = np.frombuffer(b"".join(x[at : at + 4 * width] for x in packed[:n]), np.int32).reshape(n, width)
        layers.append(np.concatenate([rows, np.full((1, width), -1, np.int32)]))
        at += 4 * width
    return layers


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, graph: type = Graph, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding, label).

    Rows are compared within equal labels that aren't NULL, by cosine in double precision; vectors that are NULL, empty
    or zero or hold NULL or non-finite components, and vectors of other lengths, link with nothing. Equal vectors are
    one node with a count, so copies cost nothing. n_links counts the other rows that a row is linked with directly;
    component_id is the smallest vec_id reachable, the row's own included; kept says that it is the row's own. NULL
    vec_ids are never smallest; a row that reaches none has a NULL component and isn't kept. An empty table gives none.

    Each shard's graph is built once, written, and searched by every shard of its label. Each search is audited
    (find_links); `report`, where given, gets the sums of the audits: true, hits, real, exact and queries.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), "label", (sound & F.col("label").isNotNull()).alias("sound"))
    nodes = rows.where("sound").groupBy("label", "x").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = nodes.withColumn("node", F.xxhash64("label", "x")).withColumn("g", F.struct("label", F.size("x").alias("size")))
    members = nodes.select("g", "node", "copies", "x")

    def build(a, b):
        made = graph(_matrix(a, "x"))
        return a.column("node").to_pylist(), _packed(made)

    def units(rows: DataFrame) -> DataFrame:
        return in_blocks(rows, "g", "node", SHARD, F.size("x"), SHARD_SIZE)

    built = by_unit(units(members).where("same"), ["node", "x"], pa.schema([pa.field("node", pa.int64()), pa.field("links", pa.binary())]), build)
    linked = cut(members.join(built, "node"))

    def search(a, b):
        if not len(a) or (b is not None and not len(b)):
            return [[]] * len(schema)
        unit = _matrix(a, "x")
        queries = unit if b is None else _matrix(b, "x")
        pairs, audit = find_links(unit, queries, threshold, graph=graph(unit, _unpacked(a.column("links").to_pylist())))
        both = a if b is None else pa.concat_tables([a, b])
        copies, node = both.column("copies").to_numpy(), both.column("node").to_numpy()
        root, links = np.arange(len(both)), np.zeros(len(both), np.int64)
        for q, at in pairs:
            # In a shard each link is met from both ends, and counts from the later one.
            q, at = (q[at < q], at[at < q]) if b is None else (q + len(a), at)
            links += np.bincount(q, copies[at], len(both)).astype(np.int64) + np.bincount(at, copies[q], len(both)).astype(np.int64)
            joined(root, q, at)
        some = np.flatnonzero(links)
        own = [*node[some].tolist(), None], [*node[root[some]].tolist(), None], [*links[some].tolist(), None]
        none = [None] * len(some)
        return [*own, *([*none, v] for v in (audit["true"], audit["hits"], audit["real"], audit["exact"], len(queries)))]

    audits = ["true", "hits", "real", "exact", "queries"]
    schema = pa.schema([pa.field(c, pa.int64()) for c in ("a", "b", "links", *audits)])
    asked = units(linked).withColumn("links", F.when(F.col("side") == 0, F.col("links")))
    found = cut(by_unit(asked, ["node", "copies", "x", "links"], schema, search))
    sums = found.where("a is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in audits)).first().asDict()
    logging.getLogger(__name__).info("audits of embedding searches: %s", sums)
    if report is not None:
        report |= sums
    found = found.where("a is not null").select("a", "b", "links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    reached = components(found.select("a", "b"))
    known = nodes.select("node", "copies", "first").join(counts, "node", "left").join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(smallest, "root").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.withColumn("node", F.when(F.col("sound"), F.xxhash64("label", "x"))).select("vec_id", "node").join(known, "node", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of `embeddings`: links of a cosine of 0.98 or more within equal
    labels. NULL or unsound vectors and NULL labels link with nothing, equal vectors link with each other, an empty table
    gives no rows, other columns are ignored."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
