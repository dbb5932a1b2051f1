"""SentencePiece models on the tokenizers library: parse the protobuf, rebuild every stage, encode and decode in batches."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, tokenizer_path, worker_store

#: The marker that stands for a space, and the numbers of the format's piece types and model types.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: The encoder's threads in a task: tasks run side by side already, and each thread keeps memory of its own.
THREADS = 2
#: A batch given to the encoder holds at most so many characters, however many rows Spark hands over at a time.
BATCH_CHARS = 500_000
#: So many words with their ids are kept by a worker, about 30 MB, and so many new ones go through the library at a time.
CACHED_WORDS, NEW_WORDS = 120_000, 8_192


def _fields(buf: bytes):
    """(field number, value) of a protobuf message: ints for varints, bytes for the rest."""
    i, n = 0, len(buf)

    def varint(i):
        v = shift = 0
        while True:
            b = buf[i]
            v |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return v, i

    while i < n:
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            v, i = buf[i : i + size], i + size
        else:
            size = 8 if kind == 1 else 4
            v, i = buf[i : i + size], i + size
        yield tag >> 3, v


def parse_model(blob: bytes) -> dict:
    """The pieces (text, score, type) and the specs of a serialized model that encoding depends on."""
    m = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "charsmap": b"", "prefix": True, "strip": True, "escape": True, "suffix": False}
    for field, v in _fields(blob):
        if field == 1:
            p = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(v))
            m["pieces"].append((p[1].decode("utf-8"), struct.unpack("<f", p[2])[0], p[3]))
        elif field == 2:
            t = dict(_fields(v))
            m["type"], m["byte_fallback"], m["suffix"] = t.get(3, UNIGRAM), bool(t.get(35, 0)), bool(t.get(24, 0))
        elif field == 3:
            t = dict(_fields(v))
            m["charsmap"], m["prefix"], m["strip"], m["escape"] = t.get(2, b""), bool(t.get(3, 1)), bool(t.get(4, 1)), bool(t.get(5, 1))
    return m


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The pairs that make up each piece from two others, best score first; pairs of one piece by the places of their halves."""
    place = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for p, score, kind in pieces:
        if kind == NORMAL and len(p) > 1:
            for cut in range(1, len(p)):
                a, b = place.get(p[:cut]), place.get(p[cut:])
                if a is not None and b is not None:
                    found.append((-score, a, b, p[:cut], p[cut:]))
    found.sort(key=lambda x: x[:3])
    return [(a, b) for *_, a, b in found]


def words_are_closed(m: dict) -> bool:
    """Whether no piece has the space marker after another character, so that tokens never cross from one word to the next."""
    return m["escape"] and not m["suffix"] and not any(MARK in p.lstrip(MARK) for p, _, kind in m["pieces"] if kind in (NORMAL, USER_DEFINED))


class Codec:
    """encode_batch and decode_batch with the ids of the model's own library."""

    def __init__(self, blob: bytes):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        m = self.model = parse_model(blob)
        pieces = m["pieces"]
        unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), None)
        if m["type"] == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unk, byte_fallback=m["byte_fallback"])
        elif m["type"] == BPE:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, _merges(pieces), unk_token=None if unk is None else pieces[unk][0], fuse_unk=True, byte_fallback=m["byte_fallback"])
        else:
            raise ValueError(f"model type {m['type']} is neither unigram nor BPE")
        t = Tokenizer(model)
        steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
        if m["strip"]:
            steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normalizer = normalizers.Sequence(steps)
        t.normalizer = normalizers.Sequence([])
        self.closed = words_are_closed(m)
        # Runs of markers start a word.
        self.split, self.known, self.lossy = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall, {}, set()
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        t.encode_special_tokens = True
        self.tokenizer = t
        self.control = {i for i, p in enumerate(pieces) if p[2] == CONTROL}

    def normalize(self, text: str) -> str:
        """The text as the model sees it: normalised, with the leading marker and with markers for spaces."""
        if self.model["charsmap"] or self.model["strip"]:
            text = self.normalizer.normalize_str(text)
        if not text:
            return ""
        if self.model["prefix"]:
            text = text + " " if self.model["suffix"] else " " + text
        return text.replace(" ", MARK) if self.model["escape"] else text

    def encode_packed(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Each text's ids as little-endian 32-bit numbers, and whether its parts decode to themselves.

        Where tokens never cross words, each new word goes through the library once, in one multithreaded batch per
        call, and is kept; the memory of words is emptied when it holds CACHED_WORDS.
        """
        normal = [self.normalize(t) for t in texts]
        parts = [self.split(t) if self.closed else [t] for t in normal]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
            self.lossy.clear()
        known = self.known
        new = list(set().union(*parts).difference(known))
        for start in range(0, len(new), NEW_WORDS):
            some = new[start : start + NEW_WORDS]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            known.update((w, array("i", x).tobytes()) for w, x in zip(some, ids, strict=True))
            back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            self.lossy.update(w for w, b in zip(some, back, strict=True) if b != w.replace(MARK, " "))
        packed = [b"".join([known[w] for w in words]) for words in parts]
        exact = [not self.lossy or self.lossy.isdisjoint(words) for words in parts]
        if not self.closed:
            known.clear()
            self.lossy.clear()
        return packed, exact

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [list(memoryview(x).cast("i")) for x in self.encode_packed(texts)[0]]

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        texts = self.tokenizer.decode_batch([[i for i in x if i not in self.control] for x in ids], skip_special_tokens=False)
        if self.model["prefix"]:
            texts = [x[:-1] if self.model["suffix"] and x.endswith(" ") else x[1:] if x.startswith(" ") else x for x in texts]
        return texts

    def denormalized(self, text: str) -> str:
        """What decoding gives back for a text that is encoded: its normalised form without marker and added space."""
        normal = self.normalize(text)
        plain = normal.replace(MARK, " ")
        return (plain[:-1] if self.model["suffix"] else plain[1:]) if self.model["prefix"] and plain else plain


def _codec(blob: bytes) -> Codec:
    """The worker's codec, built once in each process."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read when the library starts
    store, key = worker_store("sentencepiece"), hashlib.sha256(blob).hexdigest()
    if store.get("key") != key:
        store["codec"], store["key"] = Codec(blob), key
    return store["codec"]


def verify_parity(blob: bytes, texts: list[str]) -> None:
    """Raise unless the model's own library gives the same ids and the same decoded texts."""
    import sentencepiece

    own, codec = sentencepiece.SentencePieceProcessor(model_proto=blob), Codec(blob)
    want, got = own.encode(texts, num_threads=1), codec.encode_batch(texts)
    for text, a, b in zip(texts, want, got, strict=True):
        if a != b:
            raise ValueError(f"ids differ for {text[:80]!r}")
    for text, a, b in zip(texts, own.decode(want, num_threads=1), codec.decode_batch(got), strict=True):
        if a != b:
            raise ValueError(f"decoded texts differ for {text[:80]!r}")


#: What the parity check encodes on the driver before any task starts: spaces, bytes outside the vocabulary, several scripts.
PROBES = [
    "", " ", "  two  spaces  ", "plain words, with marks.", "line\nbreaks\tand\ttabs", "éàüß ñ", "日本語 русский",
    "\U0001f600 emoji \U0001f469‍\U0001f680", "<s> </s> <unk> <0x41>", f"a{MARK}b {MARK}{MARK}c", "x" * 300, "\u0000nul", "aaa   bbb", "trailing ", "1234567890 3.14",
]


def encode(docs: DataFrame, model_file: str | None = None, column: str = "text", ids: bool = True, digests: bool = True, audit_every: int = 64) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, round_trip for each row of docs(doc_id, text).

    NULL and empty texts have no tokens. `ids_sha256` hashes the ids as little-endian 32-bit numbers. `round_trip`
    says whether decoding the ids gives back the normalised text. In each task about one text in `audit_every` is
    encoded by the model's own library as well, and a difference fails the task. The model file is read once on the
    driver and sent along; it is a fixed small file. Repeated rows are encoded each; other columns are ignored.
    """
    with open(model_file or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        blob = f.read()
    verify_parity(blob, PROBES)
    shared = docs.sparkSession.sparkContext.broadcast(blob)
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64())]
    fields += [pa.field("ids", pa.list_(pa.int32()))] if ids else []
    fields += [pa.field("ids_sha256", pa.string())] if digests else []
    schema = pa.schema([*fields, pa.field("round_trip", pa.bool_())])

    def work(batches):
        import zlib

        import sentencepiece

        codec, own = _codec(shared.value), sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            release()
            doc_ids, texts = batch.column(0), batch.column(1)
            start = 0
            while start < len(texts):
                part, size, end = [], 0, start
                while end < len(texts) and (not part or size < BATCH_CHARS):
                    part.append(texts[end].as_py() or "")
                    size += len(part[-1])
                    end += 1
                packed, exact = codec.encode_packed(part)
                for text, x, ok in zip(part, packed, exact, strict=True):
                    if zlib.crc32(text[:200].encode("utf-8", "replace")) % audit_every == 0:
                        want = own.encode(text)
                        if array("i", want).tobytes() != x or (codec.decode_batch([want])[0] == codec.denormalized(text)) != ok:
                            raise ValueError(f"ids or decoded text differ for {text[:80]!r}")
                out = {"doc_id": doc_ids.slice(start, end - start), "n_tokens": [len(x) // 4 for x in packed], "round_trip": exact}
                if ids:
                    out["ids"] = [memoryview(x).cast("i").tolist() for x in packed]
                if digests:
                    out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in packed]
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)
                start = end

    from pyspark.sql.pandas.types import from_arrow_schema

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text")).mapInArrow(work, from_arrow_schema(schema))


def decode(tokens: DataFrame, model_file: str | None = None) -> DataFrame:
    """tokens(doc_id, ids) -> doc_id, text. NULL ids give an empty text; repeated rows are decoded each."""
    with open(model_file or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())

    def work(batches):
        codec = _codec(shared.value)
        for batch in batches:
            texts = codec.decode_batch([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(work, "doc_id long, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, round_trip for each row of `documents`, by its whole text. NULL and empty texts have no
    tokens; repeated rows and NULL ids each get their row; an empty table gives no rows; other columns are ignored."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
