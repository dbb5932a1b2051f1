"""Repeated byte strings: common-prefix intervals of an enhanced suffix array, built over contexts of shared anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, row_key, worker_store

#: Strings of LENGTH bytes are looked for. In each, the n-gram of GRAM bytes with the smallest hash is its anchor.
LENGTH, GRAM = 200, 40
#: Texts are scanned in stretches of this many bytes, short ones BLOCK bytes at a time; suffix arrays hold about ARRAY bytes of contexts.
STRETCH, BLOCK, ARRAY = 1 << 22, 1 << 17, 1 << 20
#: Contexts of an anchor with more different ones than this are cut into parts of PART strings that meet by what all of
#: those have in common; parts that are still too many are cut into single strings.
HOT, PART = 2_000, 20

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(1 << 60, 1 << 62, 8)]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM (= 32 + 8) bytes."""
    h, size, kept = _TABLE[data], 1, None
    for k in range(5):
        h = h[:-size] * _ODD[k] + h[size:]
        size *= 2
        if size == 8:
            kept = h
    h = h[: len(data) - GRAM + 1] * _ODD[6] + kept[32 : 32 + len(data) - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= _ODD[7]
    return h ^ (h >> np.uint64(32))


def _sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _blocks(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """[(text, start, bytes)]: texts that have strings of LENGTH bytes, in stretches, with BLOCK bytes of short ones together."""
    held, size = [], 0
    for k, data in enumerate(texts):
        for start in range(0, len(data) - LENGTH + 1, STRETCH):
            part = data[start : start + STRETCH + LENGTH - 1]
            if held and size + len(part) > BLOCK:
                yield held
                held, size = [], 0
            held.append((k, start, part))
            size += len(part)
    if held:
        yield held


def anchors(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """part, hash, position, first, last: the n-grams that are the smallest of some string of LENGTH bytes (of equal ones the
    first), with the places where those strings start. Every part has LENGTH bytes at least.

    The choice depends on a string's bytes only, so equal strings have their anchor at the same place. Each string of
    a part belongs to exactly one row.
    """
    sizes = np.array([len(x) for x in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    final = begin + sizes - LENGTH  # later strings go over a part's end
    width = LENGTH - GRAM + 1
    h = _gram_hashes(np.frombuffer(b"".join(parts), np.uint8))
    low = _sliding(np.minimum, h, width)
    # An anchor's strings end where another value is the smallest, and where it is their first n-gram itself.
    new = np.empty(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1])
    new[begin] = True
    first = np.flatnonzero(new)
    part = np.searchsorted(begin, first, "right") - 1
    inside = first <= final[part]
    first, part = first[inside], part[inside]
    last = np.minimum(np.append(first[1:], len(low)) - 1, final[part])
    strings = np.lib.stride_tricks.sliding_window_view(h, width)
    place = first.copy()
    for at in range(0, len(first), 1024):
        place[at : at + 1024] += strings[first[at : at + 1024]].argmin(axis=1)
    return part, low[first].view(np.int64), *(x - begin[part] for x in (place, first, last))


def _anchor_rows(texts: list[bytes]) -> Iterator[tuple[list[np.ndarray], list[tuple[int, list]]]]:
    """([text, hash, context hash, position, lead, tail, times], [(text, [(start, end)])]) for each block: each different context
    of a text once, and the stretches covered by contexts that stand several times in it.

    A context is the bytes of an anchor's strings, `lead` before its position and `tail` from there on. Contexts that recur
    in a later stretch of a long text have a row there too.
    """
    digest = xxhash.xxh64_intdigest
    for block in _blocks(texts):
        parts = [x for _, _, x in block]
        part, h, p, s, e = anchors(parts)
        lead, tail, end = p - s, e + LENGTH - p, e + LENGTH
        c = np.array([digest(parts[k][a:b], x) for k, a, b, x in zip(part.tolist(), s.tolist(), end.tolist(), lead.tolist(), strict=True)], np.uint64)
        c = (c ^ np.uint64(1 << 63)).view(np.int64)
        text, start = (np.array([x[i] for x in block], np.int64)[part] for i in (0, 1))
        times, kept = np.ones(len(c), np.int64), np.ones(len(c), bool)
        order = np.argsort(c)
        same = np.flatnonzero(c[order][1:] == c[order][:-1])
        seen: dict[tuple[int, int], int] = {}
        again: dict[int, list] = {}
        for i in np.union1d(order[same], order[same + 1]).tolist():  # few: what isn't alone in the block
            k = seen.setdefault((int(text[i]), int(c[i])), i)
            if k != i:
                times[k] += 1
                kept[i] = False
                spans = again.setdefault(int(text[i]), [])
                spans.extend((int(start[x] + s[x]), int(start[x] + end[x])) for x in ((k, i) if times[k] == 2 else (i,)))
        yield [x[kept] for x in (text, h, c, start + p, lead, tail, times)], [(k, _merge(x)) for k, x in again.items()]


def _scan(docs: DataFrame) -> DataFrame:
    """docs(rid, text) -> rid, h, c, pos, lead, tail, n, end: contexts of anchors; rows with a NULL h are covered stretches [pos, end)."""

    def work(batches):
        worker_store("suffix")
        names = ["rid", "h", "c", "pos", "lead", "tail", "n", "end"]

        def rows(rids, texts):
            for (text, *cols), again in _anchor_rows(texts):
                none = pa.nulls(len(text), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rids[text]), *(pa.array(x) for x in cols), none], names=names)
                spans = [(rids[k], a, b) for k, merged in again for a, b in merged]
                if spans:
                    rid, a, b = (pa.array([x[i] for x in spans], pa.int64()) for i in range(3))
                    none = pa.nulls(len(spans), pa.int64())
                    yield pa.RecordBatch.from_arrays([rid, none, none, a, none, none, none, b], names=names)

        for batch in batches:
            rids, held, size, at = batch.column(0).to_numpy(), [], 0, 0
            for text in batch.column(1).cast(pa.binary()):
                held.append(text.as_py() or b"")
                size += len(held[-1])
                if size >= BLOCK * 4:
                    yield from rows(rids[at:], held)
                    at, held, size = at + len(held), [], 0
            yield from rows(rids[at:], held)

    return docs.mapInArrow(work, "rid long, h long, c long, pos long, lead long, tail long, n long, end long")


def maximal_repeats(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(size, [(text, start), ...]): the maximal repeats of at least `length` bytes with all their occurrences.

    An enhanced suffix array over all texts: ranks of 8 to 128 bytes by doubling, suffixes whose first `length` bytes
    recur sorted by ranks, their common prefixes with the next suffix by the same ranks. A scan with a stack visits
    the tree of common-prefix intervals; an interval is output where its suffixes have different bytes before them (or
    start a text), since otherwise a longer repeat holds it. length is 128 to 256.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    # Each text ends in eight bytes of its own, so that no common prefix goes past its end unnoticed.
    joined = b"".join(t + (i + (1 << 63)).to_bytes(8, "big") for i, t in enumerate(texts)) + bytes(3 * 128 + 8)
    buf = np.frombuffer(joined, np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 8)[:-1]]).astype(np.int64)
    total = int(sizes.sum() + 8 * len(texts))
    own = np.repeat(np.arange(len(texts)), sizes + 8)
    left = (begin + sizes)[own] - np.arange(total)  # bytes up to the end of the text
    key = np.zeros(len(buf) - 7, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | buf[i : len(buf) - 7 + i]
    ranks = {}
    rank, size = np.unique(key, return_inverse=True)[1].astype(np.int64), 8
    del key
    ranks[8] = rank.astype(np.int32)
    while size < 128:
        pair = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        rank, size = np.unique(pair, return_inverse=True)[1].astype(np.int64), size * 2
        ranks[size] = rank.astype(np.int32).astype(np.int32)
    starts = np.flatnonzero(left >= length)
    if not len(starts):
        return
    top = int(rank.max()) + 1
    window = np.unique(rank[starts] * top + rank[starts + length - 128], return_inverse=True)[1]
    starts = starts[np.bincount(window)[window] > 1]
    if not len(starts):
        return
    starts = starts[np.lexsort((rank[starts + 256], rank[starts + 128], rank[starts]))]
    a, b = starts[:-1], starts[1:]
    lcp = np.zeros(len(a), np.int64)
    on = np.ones(len(a), bool)
    while on.any():  # longest steps first, for as long as they fit
        at = np.flatnonzero(on)
        same = ranks[128][a[at] + lcp[at]] == ranks[128][b[at] + lcp[at]]
        lcp[at[same]] += 128
        on[at[~same]] = False
    for step in (64, 32, 16, 8):
        same = ranks[step][a + lcp] == ranks[step][b + lcp]
        lcp[same] += step
    for _ in range(7):
        same = (buf[a + lcp] == buf[b + lcp]) & (lcp < np.minimum(left[a], left[b]))
        lcp[same] += 1
    lcp = np.minimum(lcp, np.minimum(left[a], left[b])).tolist()
    text, begins = own[starts], begin[own[starts]]
    before = np.where(starts > begins, buf[starts - 1].astype(np.int64), -1 - starts).tolist()
    where = list(zip(text.tolist(), (starts - begins).tolist(), strict=True))
    stack: list[list] = []  # common prefix, first suffix, the byte before all suffixes so far or None where they differ
    for i in range(len(lcp) + 1):
        here = lcp[i] if i < len(lcp) else 0
        first, byte = i, before[i]
        while stack and stack[-1][0] > here:
            size, first, mixed = stack.pop()
            byte = byte if byte is not None and byte == mixed else None
            if byte is None:
                yield size, where[first : i + 1]
            if stack and stack[-1][0] >= here:
                stack[-1][2] = byte if stack[-1][2] == byte else None
        if here >= length:
            if stack and stack[-1][0] == here:
                stack[-1][2] = byte if stack[-1][2] == byte else None
            else:
                stack.append([here, first, byte])


def _covered(texts: list[bytes]) -> list[list[list[int]]]:
    """For each text the stretches covered by its maximal repeats."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for size, where in maximal_repeats(texts):
        for text, start in where:
            spans[text].append((start, start + size))
    return [_merge(s) for s in spans]


def _merge(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs(rid, text), wanted(rid, items of (pos, lead, tail, h, c, hot)) -> h, c, h2, c2, lead, context.

    Contexts of hot anchors come cut into parts of PART strings each, keyed by the bytes that these share (h2) and by
    themselves (c2); the others whole, with both NULL.
    """
    names, kinds = ["h", "c", "h2", "c2", "lead", "context"], [pa.int64()] * 5 + [pa.binary()]

    def work(batches):
        worker_store("suffix")
        for batch in batches:
            rows, size = [[] for _ in names], 0

            def flush(rows=rows):
                out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)
                for x in rows:
                    x.clear()
                return out

            for text, items in zip(batch.column(0), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8")
                for x in items.as_py():
                    h, c, lead, context = x["h"], x["c"], x["lead"], data[x["pos"] - x["lead"] : x["pos"] + x["tail"]]
                    for row in _parts(h, c, lead, context, PART) if x["hot"] else [(h, c, None, None, lead, context)]:
                        for col, v in zip(rows, row, strict=True):
                            col.append(v)
                        size += len(row[-1])
                    if size > 1 << 23:
                        yield flush()
                        size = 0
            yield flush()

    return docs.join(wanted, "rid").select("text", "items").mapInArrow(work, "h long, c long, h2 long, c2 long, lead long, context binary")


def _parts(h: int, c: int, lead: int, context: bytes, part: int) -> Iterator[tuple]:
    """(h, c, h2, c2, lead, context): a context cut into parts of `part` strings."""
    first, last = -lead, len(context) - LENGTH - lead  # places of the strings, relative to the anchor
    for low in range(first // part * part, last + 1, part):
        a, b = max(low, first), min(low + part - 1, last)
        strings = context[a + lead : b + lead + LENGTH]
        # All strings that may start at this part's places hold these bytes, so equal strings meet.
        shared = context[low + part - 1 + lead : low + LENGTH + lead]
        h2 = xxhash.xxh64_intdigest(shared, (h + low) & 0xFFFFFFFF) - (1 << 63)
        yield h, c, h2, xxhash.xxh64_intdigest(strings, (a - low) & 0xFFFFFFFF) - (1 << 63), -a, strings


def _single(contexts: DataFrame) -> DataFrame:
    """contexts(h, c, lead, context) -> h, c, h2, c2, lead, context: cut into parts of one string."""
    names, kinds = ["h", "c", "h2", "c2", "lead", "context"], [pa.int64()] * 5 + [pa.binary()]

    def work(batches):
        worker_store("suffix")
        for batch in batches:
            rows = [x for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True) for x in _parts(*r, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return contexts.select("h", "c", "lead", "context").mapInArrow(work, "h long, c long, h2 long, c2 long, lead long, context binary")


def _array_spans(contexts: DataFrame) -> DataFrame:
    """h, c, lo, hi: covered stretches of contexts, relative to the anchor. Contexts of an anchor meet in one suffix array."""

    def work(batches):
        worker_store("suffix")
        held: list[tuple] = []
        size = 0

        def solve():
            rows = [[] for _ in range(4)]
            for (h, c, lead, _), spans in zip(held, _covered([x[3] for x in held]), strict=True):
                for a, b in spans:
                    for col, v in zip(rows, (h, c, a - lead, b - lead), strict=True):
                        col.append(v)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["h", "c", "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= ARRAY and row[0] != held[-1][0]:
                    yield solve()
                    size = 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve()

    rows = contexts.select("h", "c", "lead", "context").repartition("h").sortWithinPartitions("h", "c")
    return rows.mapInArrow(work, "h long, c long, lo long, hi long")


def _hot_spans(parts: DataFrame, hot: int, part: int = PART) -> DataFrame:
    """h, c, lo, hi as _array_spans gives them, for parts of contexts of anchors with very many different ones, which never meet in one task.

    Strings at the same places share the bytes between the last one's start and the first one's end: parts of contexts
    meet by those. Equal parts are one row with a count. Parts that meet in bounded numbers go through suffix arrays,
    the others are cut into parts of one string, which meet only if they are equal.
    """
    size = (F.length("context") if part > 1 else F.lit(LENGTH)).cast("long")
    distinct = parts.groupBy("h2", "c2").agg(F.count("*").alias("n"), F.first("lead").alias("lead"), F.first("context").alias("context"))
    spans = distinct.where("n > 1").select(F.col("h2").alias("h"), F.col("c2").alias("c"), (-F.col("lead")).alias("lo"), (size - F.col("lead")).alias("hi"))
    if part > 1:
        sizes = distinct.groupBy("h2").agg(F.count("*").alias("k")).where("k > 1")
        met = distinct.join(sizes, "h2").select(F.col("h2").alias("h"), F.col("c2").alias("c"), "lead", "context", "k")
        spans = spans.unionByName(_array_spans(met.where(F.col("k") <= hot))).unionByName(_hot_spans(_single(met.where(F.col("k") > hot)), hot, 1))
    spans = spans.groupBy("h", "c").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # at most PART + 1 for a part
    back = parts.select("h", "c", "h2", "c2").join(spans.select(F.col("h").alias("h2"), F.col("c").alias("c2"), "spans"), ["h2", "c2"])
    return back.select("h", "c", F.explode("spans").alias("s")).select("h", "c", "s.lo", "s.hi")


def repeated_spans(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """docs(text, ...) with a column rid -> (covered, docs): rid, spans of (lo, hi) for texts with repeated strings."""
    docs = docs.select("rid", "text")
    scanned = _scan(docs)
    by_anchor = scanned.where("h is not null").groupBy("h").agg(F.sum("n").alias("times"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    repeated = by_anchor.where("times > 1").select("h", (F.col("c0") != F.col("c1")).alias("contested"))
    # One row for each place whose anchor recurs; stretches that recur within their text come along.
    found = cut(scanned.join(repeated, "h", "left").where("h is null or contested is not null"))
    spread = (F.col("pos") - F.col("lead")).alias("lo"), (F.col("pos") + F.col("tail")).alias("hi")
    plain = found.where("h is null").select("rid", F.col("pos").alias("lo"), F.col("end").alias("hi"))
    plain = plain.unionByName(found.where("h is not null and not contested").select("rid", *spread))

    contested = found.where("contested")
    contexts = contested.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("lead").alias("lead"), F.min("tail").alias("tail"), F.min(F.struct("rid", "pos")).alias("at"))
    many = contexts.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("h", F.lit(True).alias("hot"))
    contexts = contexts.join(many, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = contexts.groupBy(F.col("at.rid").alias("rid")).agg(F.collect_list(F.struct(F.col("at.pos").alias("pos"), "lead", "tail", "h", "c", "hot")).alias("items"))
    fetched = _contexts(docs, wanted)
    # A context that stands more than once is covered whole, and still counts for the others.
    whole = contexts.where("n > 1").select("h", "c", (-F.col("lead")).alias("lo"), F.col("tail").alias("hi"))
    spans = cut(whole.unionByName(_array_spans(fetched.where("h2 is null"))).unionByName(_hot_spans(fetched.where("h2 is not null"), hot)))
    partial = contested.join(spans, ["h", "c"]).select("rid", F.greatest(F.col("pos") + F.col("lo"), F.lit(0)).alias("lo"), (F.col("pos") + F.col("hi")).alias("hi"))
    return plain.unionByName(partial).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # one text's own places


def remove_repeats(docs: DataFrame, columns: list[str] | None = None, texts: bool = True) -> DataFrame:
    """Each row of docs with columns (all of them unless given), n_bytes, n_removed, n_spans, kept_sha256 and, if asked for,
    kept_text: the remaining bytes as text, without pieces of characters that were cut.

    Every byte covered by a string of 200 bytes that starts anywhere else as well, in the same text or another, is
    removed; overlaps count, and all strings are judged on the input. NULL texts are empty, texts under 200 bytes lose
    nothing. Rows with equal texts are copies of each other, with equal ids too. Columns may have any names but those added.
    """
    columns = columns or docs.columns
    names = [f"_{i}" for i in range(len(columns))]
    keyed = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(columns, names, strict=True)), F.coalesce("text", F.lit("")).alias("text"), row_key(F.col("doc_id"), F.col("text")).alias("rid"))
    covered = repeated_spans(keyed)
    schema = keyed.join(covered, "rid", "left").select(*names, "text", "spans")

    def work(batches):
        worker_store("suffix")
        for batch in batches:
            out = [[] for _ in added]
            for text, spans in zip(batch.column(len(names)), batch.column(len(names) + 1), strict=True):
                data = text.as_py().encode("utf-8")
                merged = _merge([(x["lo"], min(x["hi"], len(data))) for x in spans.as_py() or []])
                parts, at = [], 0
                for a, b in merged:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]])
                for col, v in zip(out, (len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts else None), strict=False):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *(pa.array(x, k) for x, k in zip(out, kinds, strict=False))], names=[*names, *added])

    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * texts
    kinds = dict(schema.dtypes)
    made = schema.mapInArrow(work, ", ".join(f"{x} {kinds[x]}" for x in names) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts)
    return made.select(*(F.col(x).alias(c) for x, c in zip(names, columns, strict=True)), *added)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of `documents`, by the whole text. NULL texts are empty,
    texts under 200 bytes lose nothing, repeated rows (NULL and equal ids too) are copies of each other and lose all that
    is long enough; an empty table gives no rows; columns other than doc_id and text are ignored."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"], texts=False)
