"""Conversation structure repair: the cheapest edits that give each conversation alternating turns, by block tables."""

from __future__ import annotations

import hashlib
from collections import deque
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: What counts as white space, and what ends a sentence.
BLANKS, ENDS = " \t\n\v\f\r", ".!?"
#: Costs of the edits; a truncated row that stays adds TRUNCATED.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States of `(s?(ua)+)?`: at the start, after s, after u, after ua; what is missing costs inserts at the end.
END = (0, 2 * INSERT, INSERT, 0)
#: The state after an inserted or rerolled turn (assistant after u, else user), and after a kept s, u or a (-1: not allowed).
FORCED = (2, 2, 3, 2)
KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
#: Symbols: twice the initial (s, u, a, other), and one more if truncated; DROP is a row that has to go.
DROP, SYMBOLS = 8, 9
#: Symbols of a block, and symbols that are folded as one piece of a conversation.
BLOCK, PIECE = 4, 4096
#: Faults of a row, the first that holds.
SOUND, CUT_OFF, BLANK, DUPLICATE = 0, 1, 2, 3
NEVER = 1 << 40


def step(after: tuple, symbol: int) -> tuple:
    """Least costs from each state before a row, given those after it; turns may be inserted before the row."""
    if symbol == DROP:
        return tuple(c + DELETE for c in after)
    initial, cut_off = divmod(symbol, 2)
    stay, keep = TRUNCATED * cut_off, KEPT[initial]
    cost = [min(DELETE + after[q], stay + REROLE + after[FORCED[q]], stay + after[keep[q]] if keep[q] >= 0 else NEVER) for q in range(4)]
    for _ in range(3):
        cost = [min(cost[q], INSERT + cost[FORCED[q]]) for q in range(4)]
    return tuple(min(c, NEVER) for c in cost)


def normal(vector) -> tuple[tuple, int]:
    """The vector with its least entry taken off, and that entry."""
    low = min(vector)
    return tuple(NEVER if c >= NEVER else c - low for c in vector), low


class Tables:
    """Transitions of normalised cost vectors over every block of `block` symbols: next vector and what the least entry grows by.

    Entries of a vector differ by a bounded amount, so that the vectors reached from the end, and from any one state, are few.
    """

    def __init__(self, block: int):
        units = [tuple(0 if q == r else NEVER for q in range(4)) for r in range(4)]
        self.vectors, self.place, self.block = [], {}, block
        for v in [END, *units]:
            self._add(v)
        steps = []
        for v in self.vectors:  # grows while it is gone through
            steps.append([(self._add(n), low) for n, low in (normal(step(v, x)) for x in range(SYMBOLS))])
        self.units = [self.place[v] for v in units]
        one = np.array(steps)
        self.next1, self.low1 = one[:, :, 0], one[:, :, 1]
        self.next, self.low = np.arange(len(one))[:, None], np.zeros((len(one), 1), int)
        for _ in range(block):  # a symbol more on the left of each block
            n, low = self.next, self.low
            self.next = np.stack([self.next1[n, x] for x in range(SYMBOLS)], axis=1).reshape(len(one), -1)
            self.low = np.stack([low + self.low1[n, x] for x in range(SYMBOLS)], axis=1).reshape(len(one), -1)
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1)
        self.rows, self.lows = self.next.tolist(), self.low.tolist()
        self.choices: dict = {}

    def _add(self, v: tuple) -> int:
        if v not in self.place:
            self.place[v] = len(self.vectors)
            self.vectors.append(v)
        return self.place[v]

    def codes(self, symbols: np.ndarray) -> list[int]:
        """The numbers of the blocks, which are laid from the right end."""
        first = len(symbols) % self.block
        return (symbols[first:].reshape(-1, self.block).astype(int) @ self.weights).tolist()

    def back(self, symbols: np.ndarray, vector: int) -> tuple[list[int], int]:
        """Vectors at the edges of the blocks from right to left, the last one before all symbols; and the sum taken off."""
        edges, total = [vector], 0
        for code in reversed(self.codes(symbols)):
            total += self.lows[vector][code]
            vector = self.rows[vector][code]
            edges.append(vector)
        for x in reversed(symbols[: len(symbols) % self.block].tolist()):
            total += int(self.low1[vector, x])
            vector = int(self.next1[vector, x])
        edges.append(vector)
        return edges, total

    def costs(self, symbols: np.ndarray) -> list[int]:
        """Least costs from each state before the symbols (4 by 4, the state after them last)."""
        out = np.full((4, 4), NEVER, dtype=object)
        for r, unit in enumerate(self.units):
            edges, total = self.back(symbols, unit)
            for q, c in enumerate(self.vectors[edges[-1]]):
                out[q][r] = min(c + total, NEVER)
        return [int(c) for c in out.ravel()]

    def trace(self, symbols: np.ndarray, after: tuple, state: int) -> tuple[list[str], int]:
        """The cheapest edits of each symbol, least in ASCII order, given the costs after them; and the state after them.

        Block by block from the left: a block's inner vectors are expanded backward from its right edge, and each edit is
        the least one that keeps to the least cost.
        """
        edges = self.back(symbols, self.place[normal(after)[0]])[0][::-1]
        first, ops = len(symbols) % self.block, []
        for k, start in enumerate(range(first - self.block, len(symbols), self.block)):
            part = symbols[max(start, 0) : start + self.block].tolist()
            inner = [edges[k + 1]]
            for x in reversed(part[1:]):
                inner.append(int(self.next1[inner[-1], x]))
            for x, vector in zip(part, reversed(inner), strict=False):
                op, state = self.choice(vector, x, state)
                ops.append(op)
        return ops, state

    def choice(self, vector: int, symbol: int, state: int) -> tuple[str, int]:
        key = (vector, symbol, state)
        if key not in self.choices:
            after, done = self.vectors[vector], ""
            before = step(after, symbol)
            initial, cut_off = divmod(symbol, 2)
            stay, keep = TRUNCATED * cut_off, KEPT[initial] if symbol != DROP else KEPT[3]
            while True:
                if DELETE + after[state] == before[state]:
                    done += "D"
                    break
                if INSERT + before[FORCED[state]] == before[state]:
                    done, state = done + "I", FORCED[state]
                    continue
                kept = keep[state] >= 0 and stay + after[keep[state]] == before[state]
                done, state = done + ("K" if kept else "R"), keep[state] if kept else FORCED[state]
                break
            self.choices[key] = (done, state)
        return self.choices[key]


@cache
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv, conv_id, turn, role, text, copies: each row after its damage.

    NULL role and text are one space; `conv` names the conversation, that of NULL ids included. By crc32(`conv_id:turn`) % 20:
    0 no copy is left, 1 the text is empty, 2 it loses its sentence ends, 3 there are two copies, 4 the role is user.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        name("conv_id").alias("conv"), "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _order(ascending: bool = True) -> list[Column]:
    at = F.col("turn")
    return [F.col("conv"), at.asc_nulls_first() if ascending else at.desc_nulls_last(), *(F.col(c) if ascending else F.desc(c) for c in ("role", "digest"))]


def _tuples(batches, names: list[str]):
    """The rows of all batches, one by one."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _symbols(codes: bytes) -> np.ndarray:
    code = np.frombuffer(codes, np.uint8)
    return np.where(code % 4 >= BLANK, DROP, code // 4 * 2 + code % 4)


PIECES = pa.schema(
    [("conv", pa.string()), ("id", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("k", pa.int64()), ("rows", pa.binary())]
    + [("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("costs", pa.list_(pa.int64()))]
)


class _Piece:
    """Rows of a conversation that follow each other, as codes (4 * initial + fault)."""

    def __init__(self, place: tuple):
        self.place, self.codes, self.turns, self.low, self.high = place, bytearray(), 0, None, None

    def add(self, turn: int | None, codes: list[int]) -> None:
        self.codes += bytes(codes)
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn

    def row(self, k: int) -> tuple:
        return (*self.place, k, bytes(self.codes), self.turns, self.low, self.high, tables().costs(_symbols(self.codes)))


def pieces(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """rows(conv, conv_id, turn, role, digest, initial, fault, copies) -> pieces of at most `size` rows of a conversation.

    Rows are sorted over all partitions by range, so a conversation of any length is cut where partitions end, and after
    `size` rows within one. A piece has its first row's place, its rows' codes, how many turns differ, the first and last of
    them, and the least costs from each state to each. Copies after the first are duplicates; rows without copies only say
    that their conversation exists.
    """

    def work(batches):
        held, made, k = None, [], 0
        for *place, initial, fault, copies in _tuples(batches, [*PIECES.names[:5], "initial", "fault", "copies"]):
            again = BLANK if fault == BLANK else DUPLICATE
            if held is not None and held.place[0] != place[0]:
                made.append(held.row(k := k + 1))
                held = None
            held = held or _Piece(place)
            while copies:
                if len(held.codes) == size:
                    made.append(held.row(k := k + 1))
                    held = _Piece(place)
                n = min(copies, size - len(held.codes))
                held.add(place[2], [4 * initial + x for x in [fault, *[again] * (n - 1)]])
                fault, copies = again, copies - n
            if len(made) >= 512:
                yield _batch(made, PIECES)
                made = []
        if held is not None:
            made.append(held.row(k + 1))
        if made:
            yield _batch(made, PIECES)

    named = rows.withColumn("id", F.col("conv_id").cast("string"))
    dealt = named.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    return dealt.select(*PIECES.names[:5], "initial", "fault", "copies").mapInArrow(work, from_arrow_schema(PIECES))


def suffixes(cut: DataFrame) -> DataFrame:
    """pieces with `after` (the least costs from each state after the piece to the conversation's end) and `cost` (from the
    start through the piece to the end). Pieces of a conversation go by from the last one; four numbers are remembered."""
    schema = pa.schema([*PIECES, pa.field("after", pa.list_(pa.int64())), pa.field("cost", pa.int64())])

    def work(batches):
        current, vector = None, END
        for batch in batches:
            after, cost = [], []
            for conv, costs in zip(batch.column("conv").to_pylist(), batch.column("costs").to_pylist(), strict=True):
                if conv != current:
                    current, vector = conv, END
                after.append(list(vector))
                vector = tuple(min(costs[4 * q + r] + vector[r] for r in range(4)) for q in range(4))
                cost.append(vector[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(after, pa.list_(pa.int64())), pa.array(cost, pa.int64())], schema=schema)

    return cut.repartition("conv").sortWithinPartitions(*_order(False), F.desc("k")).mapInArrow(work, from_arrow_schema(schema))


OUT = pa.schema(
    [("conv_id", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
)


class _Conversation:
    """What is known of a conversation while its pieces and texts go by in order."""

    def __init__(self, id_: str | None):
        self.id, self.cost, self.faults, self.illegal = id_, None, np.zeros(4, np.int64), 0
        self.last_initial, self.turns, self.low, self.high = None, 0, None, None
        self.traced = self.state = 0
        self.ops, self.audit, self.sha, self.lines = deque(), [], hashlib.sha256(), 0

    def piece(self, t: Tables, rows: bytes, turns: int, low: int | None, high: int | None, after: list[int], cost: int) -> None:
        self.cost = cost if self.cost is None else self.cost
        code = np.frombuffer(rows, np.uint8)
        self.faults += np.bincount(code % 4, minlength=4)
        initials = [*([] if self.last_initial is None else [self.last_initial]), *(code // 4).tolist()]
        self.illegal += sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(initials, initials[1:], strict=False))
        self.last_initial = initials[-1] if initials else None
        if turns:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high
        ops, self.traced = t.trace(_symbols(rows), tuple(after), self.traced)
        self.ops.extend(ops)

    def _line(self, line: str) -> None:
        self.sha.update(("\n" + line if self.lines else line).encode())
        self.lines += 1

    def _forced(self, text: str) -> None:
        self._line(("assistant:" if self.state == 2 else "user:") + text)
        self.state = FORCED[self.state]

    def text(self, role: str, text: str | None, copies: int) -> None:
        for op in [self.ops.popleft() for _ in range(copies)]:
            self.audit.append(op)
            for edit in op:
                if edit == "I":
                    self._forced("")
                elif edit == "R":
                    self._forced(text or "")
                elif edit == "K":
                    self._line(f"{role}:{text or ''}")
                    self.state = KEPT["sua".index(role[0])][self.state]

    def done(self) -> tuple:
        while END[self.state]:
            self.audit.append("I")
            self._forced("")
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.id, gaps, *map(int, (self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT_OFF])), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def repair(conversations: DataFrame, size: int = PIECE) -> DataFrame:
    """conversations(conv_id, turn, role, text), damaged, then repaired: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256, one row per conversation.

    Rows are taken by turn, NULL first; rows of one turn by role and then by the text's MD5. NULL role and text are one
    space, and NULL ids are one conversation. Repeated rows are duplicates. A conversation without rows after the damage has
    zeros, an empty audit and the hash of an empty string; an empty table gives no rows; other columns are ignored.

    Faults are found, and costs folded, on narrow rows in pieces, however long a conversation is. Texts are shuffled once, for
    the hash, which has to read a conversation's text in order; they go by with their pieces, one at a time.
    """
    d = damaged(conversations)
    digest, trimmed = F.md5("text").alias("digest"), F.rtrim(F.col("text"), F.lit(BLANKS))
    ends = F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(*ENDS), SOUND).otherwise(CUT_OFF)
    place = ["conv", "conv_id", "turn", "role", "digest"]
    rows = d.select(*place[:-1], digest, ends.alias("ends"), "copies").groupBy(*place, "ends").agg(F.sum("copies").alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = rows.where("copies > 0").groupBy("conv", "role", "digest").agg(F.min(at)["turn"].alias("first"))
    again = (F.col("copies") > 0) & ~F.col("turn").eqNullSafe(F.col("first"))
    fault = F.when(F.col("ends") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("ends"))
    initial = F.coalesce(*(F.when(F.left("role", F.lit(1)) == x, k) for k, x in enumerate("sua")), F.lit(3))
    known = rows.join(first, ["conv", "role", "digest"], "left").select(*place, initial.alias("initial"), fault.alias("fault"), "copies")
    cut = suffixes(pieces(known, size))
    texts = d.where("copies > 0").select("conv", F.col("conv_id").cast("string").alias("id"), "turn", "role", digest, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("k"), F.when(trimmed != "", F.col("text")).alias("text"), "copies")
    both = cut.drop("costs").withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)

    def work(batches):
        t, current, held, out = tables(), None, None, []
        for conv, id_, kind, role, text, copies, *piece in _tuples(batches, ["conv", "id", "kind", "role", "text", "copies", "rows", "turns", "low", "high", "after", "cost"]):
            if conv != current:
                if held:
                    out.append(held.done())
                current, held = conv, _Conversation(id_)
            if kind:
                held.text(role, text, copies)
            else:
                held.piece(t, *piece)
            if len(out) >= 1024:
                yield _batch(out, OUT)
                out = []
        if held:
            out.append(held.done())
        if out:
            yield _batch(out, OUT)

    ordered = both.repartition("conv").sortWithinPartitions(*_order(), "kind", "k")
    done = ordered.mapInArrow(work, from_arrow_schema(OUT))
    return done.withColumn("conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repair() of the whole table `conversations`; what it says of NULLs, ties, repeated rows and empty tables holds."""
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
