"""Conversation repair, token alignment and nearest neighbours against plain versions."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from canlake.llm import common, convrepair, lshsearch, tokenalign


def plain_repair(rows):
    """rows(conv_id, turn, role, text) of one conversation -> the result's columns, by search over all edit scripts."""
    blanks = " \t\n\v\f\r"
    done = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            row = (turn, "user" if k == 4 else role, "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text)
            done += [row] * (2 if k == 3 else 1)
    done.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in done:
        solid = text.rstrip(blanks)
        faults.append("blank" if not solid else "dup" if (role, text) in seen else "cut" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    # Each way: state -> (cost, audit, lines), with ties by the audit; a state's prefixes are never extended by free edits.
    move = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}

    def insert(ways):
        for _ in range(2):
            for q, (c, ops, lines) in list(ways.items()):
                for x in "ua":
                    if (q, x) in move:
                        new = (c + 5, ops + "I", [*lines, names[x] + ":"])
                        r = move[q, x]
                        ways[r] = min(ways.get(r, new), new)
        return ways

    ways = insert({0: (0, "", [])})
    for (_, role, text), fault in zip(done, faults, strict=True):
        new = {}

        def put(q, way):
            new[q] = min(new.get(q, way), way)

        for q, (c, ops, lines) in ways.items():
            put(q, (c + 2, ops + "D", lines))
            if fault in ("", "cut"):
                stay = 5 if fault else 0
                if (q, role[:1]) in move:
                    put(move[q, role[:1]], (c + stay, ops + "K", [*lines, f"{role}:{text}"]))
                for x in "ua":
                    if (q, x) in move:
                        put(move[q, x], (c + stay + 1, ops + "R", [*lines, f"{names[x]}:{text}"]))
        ways = insert(new)
    cost, audit, lines = min(ways[q] for q in (0, 3) if q in ways)
    turns = {r[0] for r in done if r[0] is not None}
    initials = [r[1][:1] for r in done]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, faults.count("blank"), faults.count("dup"), faults.count("cut"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    rnd = random.Random(7)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.choice([0, 1, 2, 5, 9, 40]) + 1):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "student"])
            text = rnd.choice(["Yes.", "No", "Why?", " ", "", None, "a.b!\n ", f"line {turn}.", f"open {turn}", "été. \t", "x" * 50_000])
            rows.append((conv, rnd.choice([turn, turn, turn, turn * 3, None]), role, text, "extra"))
    rows += [rows[5]] * 3 + [(99, t, "user", "Same.", None) for t in range(300)] + [(100, None, "user", "Hello.", None)] * 30
    return rows + [(101, t, ("user", "assistant")[t % 2], f"turn {t}." if t % 7 else f"turn {t}", None) for t in range(500)]


@pytest.mark.parametrize("size", [3, 64, 4096])
def test_conversations_are_repaired_as_by_search(spark, size):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in convrepair.repair(df, size).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[:4])
    assert set(got) == set(by)
    for conv, some in by.items():
        assert got[conv] == plain_repair(some), conv


def test_conversations_without_rows(spark, sf):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert convrepair.repair(empty).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = convrepair.repair(spark.createDataFrame([(gone, 0, "user", "a.")], empty.schema)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    whole = convrepair.op12_conversation_repair(spark, sf).collect()
    by = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        by.setdefault(r["conv_id"], []).append(tuple(r))
    assert {r["conv_id"]: tuple(r)[1:] for r in whole} == {c: plain_repair(rows) for c, rows in by.items()}


def test_block_tables_equal_single_steps():
    t, rnd = convrepair.tables(), random.Random(2)
    assert len(t.vectors) < 500
    for n in (0, 1, 3, 4, 5, 21):
        symbols = [rnd.randrange(convrepair.SYMBOLS) for _ in range(n)]
        vector = convrepair.END
        for x in reversed(symbols):
            vector = convrepair.step(vector, x)
        edges, total = t.back(convrepair.np.array(symbols, int), t.place[convrepair.END])
        assert tuple(c + total for c in t.vectors[edges[-1]]) == vector


def plain_alignment(texts):
    """Rows of the result without doc_id, straight from the two libraries and byte offsets."""
    from collections import Counter, defaultdict

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path("piece_bpe_32k.model"))
    to_byte = {c: i for c, i in tokenalign.byte_alphabet().items()}
    rows, held = [], Counter()
    for text in texts:
        groups, links = [], Counter()
        if text:
            whole = (" " + text).encode()
            ta = [(i, bytes(to_byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            tb = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
            if b"".join(x for _, x in ta) == whole == b"".join(x for _, x in tb):
                group_of = []
                ends = [set(itertools.accumulate(len(x) for _, x in t)) for t in (ta, tb)]
                both = sorted(ends[0] & ends[1])
                for t in (ta, tb):
                    at, g, out = 0, 0, defaultdict(list)
                    for i, x in t:
                        out[g].append(i)
                        at += len(x)
                        g += at == both[g]
                    group_of.append(out)
                groups = [(group_of[0][g], group_of[1][g]) for g in range(len(both))]
                links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(links.keys())
        rows.append((groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for groups, links in rows:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


ODD_TEXTS = [
    None, "", " ", "  \n\n \t", "a", "don't can'tell 's  they'll", "x\r\ny\r\n\r\n  z \r", "tab\t\ttab \n line\n\n\nnext ", "été 你好世界 \U0001f600\U0001f469‍\U0001f680 ال", "mark ▁ inside",
    "<|endoftext|> and <s></s><unk><0x41>", "nul \u0000 byte\u0001\x1c \x85 nbsp  　wide", "();\r\n}\r\r\nY ,\r x", "m² x½ ⅠⅡ 3²", "é combining ö ᠎ ​ x​ y", "https://a.b/c?d=e&f=1#g __init__ == != {'k': [1,2]}", "word" * 5000, "aaa bbb " * 400,
]


@pytest.mark.parametrize("bound", [tokenalign.BROADCAST_PAIRS, 300])
def test_tokens_are_aligned_as_by_the_libraries(spark, sf, monkeypatch, bound):
    monkeypatch.setattr(tokenalign, "BATCH_CHARS", 5_000)  # long texts in slices
    real = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    texts = [*ODD_TEXTS, *real, real[3]]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string, n int").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in tokenalign.align(df, bound=bound).collect()}
    for k, want in enumerate(plain_alignment(texts)):
        assert got[k] == want, texts[k] and texts[k][:80]


def test_alignment_of_empty_tables_and_registered_query(spark, sf):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenalign.align(empty).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "one two"), (None, "one two")], empty.schema)
    assert sorted(r["n_a"] for r in tokenalign.align(nulls).collect()) == [0, 2, 2]
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([r["doc_id"] for r in docs], plain_alignment([r["text"] for r in docs]), strict=True))
    assert {r["doc_id"]: tuple(r)[1:] for r in tokenalign.op11_token_alignment(spark, sf).collect()} == want


def test_texts_are_cut_into_units():
    with open(common.tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f, open(common.tokenizer_path("piece_bpe_32k.model"), "rb") as g:
        t = tokenalign.Aligner(f.read(), g.read())
    assert t.cuttable and t.split(" end).") == (" end", ").") and t.split(" ;\r\nx") == (" ;\r", "\n", "x")
    t.verify([x for x in ODD_TEXTS if x])
    assert all(x[0].tolist() == [0] * 4 and x[1] == "" and not len(x[2]) for x in (t.align("mark ▁ inside"), t.align(""), t.align(None)))


def plain_search(rows, every=20, top=20):
    """(query, vector) -> ranked (vec_id, score) lists, by comparing all."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i % every == 0:
            near = [(-float((np.array(v) * np.array(w)).sum()), j) for j, w in good if len(w) == len(v) and (j, w) != (i, v)]
            out[i, v] = [(j, -s) for s, j in sorted(near)[:top]]
    return out


def vectors_of(n, d, seed, groups):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(groups, d))
    x = centers[rnd.integers(groups, size=n)] + rnd.normal(size=(n, d)) * 0.7
    return (x * rnd.uniform(0.5, 2, size=(n, 1))).astype(np.float32).astype(float)


@pytest.mark.parametrize(("groups", "points"), [(40, 64), (1, 16)])
def test_neighbours_against_all_vectors(spark, monkeypatch, groups, points):
    for name, value in {"POINTS": points, "SAMPLE": 200, "BLOCK": 128, "QUERIES": 16, "PAIRS": 500}.items():
        monkeypatch.setattr(lshsearch, name, value)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors_of(3000, 12, groups, groups))]
    rows += [(5000 + k, rows[7][1]) for k in range(300)] + [(rows[20][0], rows[3][1]), rows[40], rows[40]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    report = {}
    got = {}
    for r in lshsearch.search(df, report=report).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for (i, _), near in plain_search(rows).items():
        want.setdefault(i, []).append(near)
    assert set(got) == set(want) and report["audited"] > 500 and report["recall"] >= 0.97
    hits = total = 0
    for i, lists in want.items():
        if len(lists) > 1:
            continue
        mine = sorted(got[i])
        assert [r for r, *_ in mine] == list(range(1, len(lists[0]) + 1)) and all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in itertools.pairwise(mine))
        hits += len({(j, s) for _, j, s in mine} & set(lists[0]))
        total += len(lists[0])
    print(report, hits / total)
    assert hits >= 0.93 * total


def test_neighbours_of_odd_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (20, [-1.0, 0.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (3, [None, 1.0]), (120, []), (None, [1.0, 1.0]), (140, [1.0, 1.0, 1.0]), (0, [1.0, 2.0]), (4, [1e300, 1.0]), (160, [1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in lshsearch.search(df).collect())
    assert got == sorted((i, k, j, s) for (i, _), near in plain_search(rows).items() for k, (j, s) in enumerate(near, 1)) and got
    assert lshsearch.search(df.limit(0)).count() == 0 and lshsearch.search(df.where("vec_id = 1")).count() == 0


def test_neighbours_without_buckets_are_found_among_all(spark, monkeypatch):
    monkeypatch.setattr(lshsearch, "PROBES", 1)
    monkeypatch.setattr(lshsearch, "POINTS", 16)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors_of(400, 6, 3, 1))]
    report = {}
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in lshsearch.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), report=report).collect())
    assert got == sorted((i, k, j, s) for (i, _), near in plain_search(rows).items() for k, (j, s) in enumerate(near, 1)) and report["compared with all"] == 20


def test_recall_of_the_registered_search(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = plain_matrix(rows)
    got = {}
    for r in lshsearch.op13_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[i] & near) for i, near in want.items())
    print(hits / (20 * len(want)))
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)


def plain_matrix(rows, every=20, top=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        s = x @ x[k]
        s[k] = -np.inf
        out[int(ids[k])] = set(ids[np.argsort(-s)[:top]].tolist())
    return out
