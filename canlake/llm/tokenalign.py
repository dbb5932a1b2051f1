"""Cross-tokenizer alignment: groups of tokens between the byte offsets where two tokenizers both end, links and their counts."""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import uuid
import zlib
from array import array
from collections import Counter
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from canlake.sources.shared import shared_folder

from .common import cut, tokenizer_path, worker_store
from .spiece import BYTE, MARK, NORMAL, PROBES, UNUSED, USER_DEFINED, parse_model

#: So many parts of words are kept by a worker before the older half goes, and so many characters in them.
CACHED, CACHED_CHARS = 400_000, 12_000_000
#: A batch for the encoders holds at most so many characters beyond its first text; longer texts go by in slices of this size.
BATCH_CHARS = 500_000
#: Pairs of ids that ride along by broadcast, the most frequent first; the others meet their links by a shuffle.
BROADCAST_PAIRS = 250_000
#: Characters that some tables count as white space and others don't.
ODD = "᠎​⁠﻿"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class Aligner:
    """Aligns the tokens of a byte-level BPE (A) and of a sentence-piece model (B) on texts.

    A text is cut into units at places that tokens of neither tokenizer cross: A's own pre-tokens end there, and no piece of
    B has the characters on both sides next to each other. Units repeat, so each is encoded and aligned once and kept. A
    single pre-token of A is encoded by the merge ranks that the vocabulary's order is.
    """

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        # The same model without the space that it puts before a text: of a repeated field the last value holds.
        self.b_inside = sentencepiece.SentencePieceProcessor(model_proto=b + b"\x1a\x02\x18\x00")
        alphabet, vocabulary, spec, model = byte_alphabet(), self.a.get_vocab(with_added_tokens=False), json.loads(a)["model"], parse_model(b)
        self.a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocabulary.items()}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model["pieces"]]
        self.a_text, self.b_text = {i: str(i) for i in self.a_bytes}, [str(i) for i in range(len(self.b_bytes))]
        self.joined = set()
        for p, _, kind in model["pieces"]:
            if kind in (NORMAL, USER_DEFINED, UNUSED):
                p = p.replace(MARK, " ")
                self.joined.update(zip(p, p[1:], strict=False))
        plain = model["escape"] and model["prefix"] and not model["suffix"] and not model["strip"] and not model["charsmap"]
        level = self.a.pre_tokenizer
        self.cuttable = plain and type(level).__name__ == "ByteLevel" and level.use_regex and not level.add_prefix_space and self.a.normalizer is None
        self.cuttable = self.cuttable and not any(y in " \n\t" and not x.isspace() for x, y in self.joined)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec.get("merges", [])]
        ranked = spec["type"] == "BPE" and all(vocabulary.get(m) == k for k, m in enumerate(merged, len(alphabet)))
        self.ranks = tiktoken.Encoding("ranks", pat_str="(?s:.+)", mergeable_ranks={v: i for i, v in self.a_bytes.items()}, special_tokens={}) if ranked else None
        self.words = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+").findall
        self.odd = re.compile(rf"[^\S \n\t]|[{ODD}]").search
        self.edge = re.compile(rf"(?<=[^\s{ODD}])(?=[ \n\t])")
        self.letters = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ſ]+").fullmatch
        self.parts, self.older_parts, self.units, self.older_units, self.several, self.chars, self.shared = {}, {}, {}, {}, set(), 0, {}

    def slices(self, text: str):
        """Words of the text with the white space before them, in slices of bounded size that end between two words."""
        text, start = " " + text, 0
        while start < len(text):
            end = len(text)
            if self.cuttable and end - start > BATCH_CHARS and (at := self.edge.search(text, start + BATCH_CHARS)):
                end = at.start()
            part = text if end - start == len(text) else text[start:end]
            yield [part] if not self.cuttable else [x for x in self.edge.split(part) if x] if self.odd(part) else self.words(part)
            start = end

    def split(self, word: str) -> tuple[str, ...]:
        """The word's units: A's pre-tokens, those joined that a piece of B may cross."""
        if self.cuttable and self.letters(word):
            return (word,)
        if self.cuttable:
            spans = [s for _, s in self.a.pre_tokenizer.pre_tokenize_str(word)]
            units = [spans[0]]
            for start, end in spans[1:]:
                if (word[start - 1], word[start]) in self.joined:
                    units[-1] = (units[-1][0], end)
                else:
                    units.append((start, end))
            alone = lambda s, e: [(s + x, s + y) for _, (x, y) in self.a.pre_tokenizer.pre_tokenize_str(word[s:e])]
            joined = [] if len(units) == len(spans) else [u for u in units if u not in spans]
            if all(alone(s, e) == [x for x in spans if s <= x[0] < e] for s, e in joined):
                self.several.update(word[s:e] for s, e in joined)
                return tuple([word[s:e] for s, e in units])
        self.several.add(word)  # what follows would change how a unit is cut
        return (word,)

    def encoded(self, units: list[str]) -> list[tuple[list[int], list[int]]]:
        a = {}
        slow = [u for u in units if u in self.several or not self.ranks]
        if slow:
            a = {u: e.ids for u, e in zip(slow, self.a.encode_batch_fast(slow, add_special_tokens=False), strict=True)}
        b = self.b_inside.encode(units, num_threads=1) if self.cuttable else self.b.encode([u[1:] for u in units], num_threads=1)
        return [(a[u] if u in a else self.ranks.encode_ordinary(u), ids) for u, ids in zip(units, b, strict=True)]

    def aligned(self, text: str, a: list[int], b: list[int]) -> tuple | None:
        """(tokens of A, of B, groups, links), the groups written out, linked pairs and how often each is linked (a pair may
        stand several times), or None where the tokens of either don't give the text again. Numbers are packed as 64-bit
        ones; a pair is its id of A times 2^32 plus that of B."""
        own, of_a, of_b = text.encode(), [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(of_a) != own or b"".join(of_b) != own:
            return None
        ends_a = dict(zip(accumulate(map(len, of_a)), range(1, len(a) + 1), strict=True))
        ends_b = dict(zip(accumulate(map(len, of_b)), range(1, len(b) + 1), strict=True))
        common, pairs, times, written, links, i, j = sorted(ends_a.keys() & ends_b.keys()), [], [], [], 0, 0, 0
        for end in common:
            x, y = ends_a[end], ends_b[end]
            if x - i == 1 == y - j:
                pairs.append(a[i] << 32 | b[j])
                written.append(f"{self.a_text[a[i]]}|{self.b_text[b[j]]}")
                links += 1
            else:
                some, others = a[i:x], b[j:y]
                written.append(",".join([self.a_text[k] for k in some]) + "|" + ",".join([self.b_text[k] for k in others]))
                links += len(some) * len(others)
                if len(some) * len(others) <= 64:
                    pairs += [k << 32 | m for k in some for m in others]
                else:  # ids of a long group repeat: each pair of different ones once
                    many = Counter(others).items()
                    times += [1] * (len(pairs) - len(times))
                    for k, n in Counter(some).items():
                        pairs += [k << 32 | m for m, _ in many]
                        times += [n * c for _, c in many]
            i, j = x, y
        times += [1] * (len(pairs) - len(times))
        counts = (len(a), len(b), len(common), links)
        return self.packed(counts), ";".join(written), array("q", pairs).tobytes(), self.packed(tuple(times)) if len(times) < 16 else array("q", times).tobytes()

    def packed(self, numbers: tuple) -> bytes:
        """64-bit numbers; few different ones are asked for, so they are shared."""
        if numbers not in self.shared:
            if len(self.shared) > CACHED:
                self.shared.clear()
            self.shared[numbers] = array("q", numbers).tobytes()
        return self.shared[numbers]

    def prepare(self, words: set[str]) -> None:
        """Sees to it that the words' units and their alignments are kept."""
        if len(self.units) > CACHED or len(self.parts) > CACHED or self.chars > CACHED_CHARS:
            self.older_parts, self.older_units, self.parts, self.units, self.several, self.chars = self.parts, self.units, {}, {}, set(), 0
        new = set()
        for w in words.difference(self.parts):
            self.parts[w] = units = self.older_parts.get(w) or self.split(w)
            self.chars += len(w)
            for u in units:
                if u not in self.units:
                    if u in self.older_units:
                        self.units[u] = self.older_units[u]
                    else:
                        new.add(u)
                    self.chars += len(u)
        new = list(new)
        for u, (a, b) in zip(new, self.encoded(new), strict=True):
            self.units[u] = self.aligned(u, a, b)

    def align(self, text: str | None) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        """(tokens of A, of B, groups, links), SHA-256 of the groups, linked pairs, and how often each is linked in the text."""
        if not text:
            return NOTHING
        total, sha, found, first = np.zeros(4, np.int64), hashlib.sha256(), [], True
        for words in self.slices(text):
            self.prepare(set(words))
            units, known = list(chain.from_iterable(map(self.parts.__getitem__, words))), self.units
            kinds = Counter(units)
            of = [known[u] for u in kinds]
            if None in of:
                return self.whole(text)
            n = np.fromiter(kinds.values(), np.int64, len(kinds))
            counts, _, pairs, times = zip(*of, strict=True)
            total += n @ np.frombuffer(b"".join(counts), np.int64).reshape(-1, 4)
            found.append((np.frombuffer(b"".join(pairs), np.int64), np.frombuffer(b"".join(times), np.int64) * np.repeat(n, [len(x) // 8 for x in pairs])))
            sha.update(((b"" if first else b";") + ";".join([known[u][1] for u in units]).encode()))
            first = False
        return total, sha.hexdigest(), *merged([x for x, _ in found], [x for _, x in found])

    def whole(self, text: str) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        """align() without units: the whole text is encoded at once, by the two libraries."""
        got = self.aligned(" " + text, self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text))
        if got is None:
            return NOTHING
        counts, written, pairs, times = got
        return np.frombuffer(counts, np.int64), hashlib.sha256(written.encode()).hexdigest(), *merged([np.frombuffer(pairs, np.int64)], [np.frombuffer(times, np.int64)])

    def verify(self, texts: list[str]) -> None:
        """Raise unless units give what the libraries give for whole texts."""
        for text in texts:
            if text and not all(map(np.array_equal, self.align(text), self.whole(text))):
                raise ValueError(f"the alignment of {text[:80]!r} differs from that of the whole text")


NOTHING = (np.zeros(4, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def merged(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, in order, with its times summed."""
    pairs, times = np.concatenate(pairs), np.concatenate(times)
    order = np.argsort(pairs)
    pairs = pairs[order]
    starts = np.flatnonzero(np.concatenate([pairs[:1] == pairs[:1], pairs[1:] != pairs[:-1]]))
    return pairs[starts], np.add.reduceat(times[order], starts) if len(starts) else times


def _aligner(a: str, b: bytes) -> Aligner:
    """The worker's aligner, built once in each process."""
    os.environ.setdefault("RAYON_NUM_THREADS", "1")  # read when the library starts; tasks run side by side already
    store, key = worker_store("alignment"), hashlib.sha256(a.encode() + b).hexdigest()
    if store.get("key") != key:
        store["aligner"], store["key"] = Aligner(a, b), key
    return store["aligner"]


ALIGNED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())]
    + [("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)


def alignments(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, column: str = "text", audit_every: int = 256) -> DataFrame:
    """docs(doc_id, text) -> row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times for each row, by its whole text.

    `pairs` has the linked pairs of ids, each once, and `times` how often each is linked. Texts that are NULL or empty, or that
    the tokens of either tokenizer don't give again, have no tokens: zeros, '' and empty lists. The vocabulary files are read on
    the driver and sent along; they are small and fixed. In each task about one text in `audit_every` is encoded whole by the
    libraries themselves as well, and a difference fails the task.
    """
    with open(a_file or tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        a = f.read()
    with open(b_file or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        b = f.read()
    Aligner(a, b).verify(PROBES)
    shared = docs.sparkSession.sparkContext.broadcast((a, b))

    def rows_of(t: Aligner, texts: pa.Array, start: int):
        """Alignments of the texts from a place on until they hold BATCH_CHARS characters."""
        size = 0
        while start < len(texts) and size < BATCH_CHARS:
            text = texts[start].as_py()
            yield t.align(text)
            if text and zlib.crc32(text[:200].encode()) % audit_every == 0:
                t.verify([text])
            size, start = size + len(text or ""), start + 1

    def work(batches):
        t, n = _aligner(*shared.value), TaskContext.get().partitionId() << 33
        collecting = gc.isenabled()
        gc.disable()  # what is kept has no cycles, and going through it again and again takes longer than the work
        try:
            for batch in batches:
                start = 0
                while start < batch.num_rows:
                    counts, shas, pairs, times = zip(*rows_of(t, batch.column(1), start), strict=True)
                    k = len(shas)
                    offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (pairs, times)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + k)), batch.column(0).slice(start, k), *(pa.array(c) for c in np.stack(counts, axis=1)), pa.array(shas, pa.string()), *lists], schema=ALIGNED)
                    n, start = n + k, start + k
        finally:
            if collecting:
                gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text")).mapInArrow(work, from_arrow_schema(ALIGNED))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (how many rows hold it linked), best (whether no pair of its id of A is held by more)."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", 32)))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return cut(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def counted(aligned: DataFrame, counts: DataFrame, bound: int = BROADCAST_PAIRS) -> DataFrame:
    """row, n_best, count_sum: each row's links that are best, and its links' counts summed.

    The most frequent pairs, `bound` at most, are broadcast, so that no pair which stands in many rows is shuffled; the rest
    meet their links by a join.
    """
    sizes = sorted(((int(r["size"]), r["pairs"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("pairs")).collect()), reverse=True)
    fit, least = 0, 1 << 62
    for size, pairs in sizes:
        if (fit := fit + pairs) > bound:
            break
        least = 1 << size
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    if fit <= bound:
        met = links.join(F.broadcast(counts), "pair")
    else:
        met = links.join(F.broadcast(counts.where(F.col("n") >= least)), "pair", "left")
        rest = met.where("n is null").select("row", "pair", "times").join(counts.where(F.col("n") < least), "pair")
        met = met.where("n is not null").unionByName(rest)
    return met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, column: str = "text", bound: int = BROADCAST_PAIRS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row for each row.

    NULL and empty texts, and those that tokens don't give again, have zeros and ''. Repeated rows and NULL ids each get
    their row, and each counts as a document; an empty table gives no rows; other columns are ignored. Alignments are written
    once to the shared folder, since pairs have to be counted over all documents before links can be judged.
    """
    folder = f"{shared_folder(docs.sparkSession)}/aligned-{uuid.uuid4().hex}"
    alignments(docs, a_file, b_file, column).write.option("compression", "zstd").parquet(folder)
    aligned = docs.sparkSession.read.parquet(folder)
    sums = counted(aligned, pair_counts(aligned), bound)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """align() of every row of `documents`; what it says of NULLs, repeated rows, long texts and empty tables holds."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
