import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from canlake.llm import langid, mixing, ngramjoin, simhash, spiece, suffix, toxicity, units

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, size string, key string, bucket string"
WORDS = "alpha beta gamma delta omega sigma kappa theta lambda epsilon zeta iota".split()


def text_of(rnd, n, words=WORDS):
    return " ".join(rnd.choice(words) + rnd.choice("abcdefgh") for _ in range(n))


def nasty(spark, more=()):
    """NULLs in every column, empty, blank and long texts, repeated rows, ties, odd characters, clashing extra columns."""
    rnd = random.Random(5)
    long_, base = text_of(rnd, 40_000), text_of(rnd, 120)
    texts = [None, "", "   \n", "!!! ---", "été", base, base, base.replace("alpha", "Alpha", 1), base + " tail", long_, "\U0001f600 zero\u0000byte", "a" * 900, text_of(rnd, 4), text_of(rnd, 5), *more]
    rows = [(k, t, ["en", None, "fr"][k % 3], ["s1", None, "s2"][k % 3], len(t or ""), "x", "y", None, "z") for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def covered(texts, n=200):
    from collections import Counter

    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                m[i : i + n] = b"\1" * n
        out.append(bytes(m))
    return out


def digest(t, m):
    return len(t), sum(m), sum(1 for k in range(len(m)) if m[k] and not (k and m[k - 1])), hashlib.sha256(bytes(a for a, x in zip(t, m, strict=True) if not x)).hexdigest()


def repeats(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefgh é") for _ in range(600)) for _ in range(3)]
    out = []
    for _ in range(25):
        b, i = rnd.choice(base), rnd.randrange(250)
        x = list(b[i : i + rnd.randrange(150, 480)])
        for _ in range(rnd.randrange(3)):
            x[rnd.randrange(len(x))] = "Z"
        out.append("".join(rnd.choice("xyz") for _ in range(rnd.randrange(60))) + "".join(x))
    return [*out, "q" * 700, "ab" * 99, "0123456789" * 25, out[0]]


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_suffix_array_equals_brute_force(spark, hot):
    docs = nasty(spark, repeats(spark))
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    want = sorted((-1 if i is None else i, *digest(t, m)) for (i, t), m in zip(rows, covered([t for _, t in rows]), strict=True))
    keyed = suffix.remove_repeats
    old = suffix.HOT
    try:
        suffix.repeated_spans.__defaults__ = (hot,)
        got = keyed(docs, ["doc_id"]).collect()
    finally:
        suffix.repeated_spans.__defaults__ = (old,)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_short_texts_are_scanned_together(monkeypatch):
    rnd = random.Random(4)
    texts = [text_of(rnd, rnd.randrange(1, 90)).encode() for _ in range(300)]
    texts += [b"", b"q" * 199, b"q" * 200, b"q" * 700, b"ab" * 300, b"xyz" * 80 + texts[0] * 3, text_of(rnd, 500).encode()]
    calls, hashes = [], suffix._gram_hashes
    monkeypatch.setattr(suffix, "_gram_hashes", lambda data: calls.append(len(data)) or hashes(data))
    monkeypatch.setattr(suffix, "STRETCH", 1 << 11)
    got, again = [], {}
    for cols, spans in suffix._anchor_rows(texts):
        got += zip(*(x.tolist() for x in cols), strict=True)
        for k, merged in spans:
            again[k] = again.get(k, 0) + sum(b - a for a, b in merged)
    assert len(calls) <= sum(map(len, texts)) // suffix.BLOCK + 1  # numpy's calls cost more than the work on one short text
    for k, t in enumerate(texts):
        want, grams = {}, hashes(suffix.np.frombuffer(t, suffix.np.uint8)).view(suffix.np.uint64).tolist() if len(t) >= 200 else []
        for i in range(len(t) - 199):
            window = grams[i : i + 161]
            want.setdefault((i >> 11, i + window.index(min(window))), []).append(i)
        places = {(p - lead, p, p + tail) for text, _, _, p, lead, tail, _ in got if text == k}
        assert places <= {(x[0], p, x[-1] + 200) for (_, p), x in want.items()}
        assert sum(r[-1] for r in got if r[0] == k) == len(want)
    assert again[303] == 700 and 304 in again and all(k >= 303 for k in again)


def test_maximal_repeats_have_all_occurrences():
    rnd = random.Random(1)
    shared = bytes(rnd.randrange(97, 105) for _ in range(300))
    texts = [b"A" + shared, b"B" + shared + b"x", shared[:250] + b"y"]
    found = {(size, tuple(sorted(where))) for size, where in suffix.maximal_repeats(texts)}
    assert found == {(300, ((0, 1), (1, 1))), (250, ((0, 1), (1, 1), (2, 0)))}


def test_ngram_join_equals_brute_force(spark):
    rnd = random.Random(9)
    groups = [text_of(rnd, n) for n in (60, 200, 30)]
    near = []
    for g in groups:
        for _ in range(14):
            w = g.split()
            for _ in range(rnd.randrange(1, 6)):
                w[rnd.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    docs = nasty(spark, near).where("doc_id is not null").select("doc_id", "text").distinct()
    rows = docs.collect()
    sets = {r["doc_id"]: set(ngramjoin.shingles(r["text"] or "").tolist()) for r in rows}
    ids, links, parent = sorted(sets), dict.fromkeys(sets, 0), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    for block in (512, 4):
        old, ngramjoin.BLOCK = ngramjoin.BLOCK, block
        got = {r["key"]: r for r in ngramjoin.similar(docs.withColumnRenamed("doc_id", "key")).collect()}
        ngramjoin.BLOCK = old
        assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (links[i], find(i)) for i in ids}
    assert sum(links.values()) >= 40
    twice = ngramjoin.similar(nasty(spark).select(F.col("doc_id").alias("key"), "text", *(F.lit("x").alias(c) for c in ("row", "cls", "band", "bands", "root", "sig")))).collect()
    assert len(twice) == nasty(spark).count()
    assert ngramjoin.similar(empty(spark).select(F.col("doc_id").alias("key"), "text")).count() == 0


def test_ngram_join_of_null_and_repeated_ids_equals_brute_force(spark):
    rnd = random.Random(21)
    rows = []
    for g in [text_of(rnd, n) for n in (80, 60, 120, 90)]:
        for k in range(6):
            w = g.split()
            w[5 * k + 2] = "changed"
            # Some classes have NULL ids only; ids 1 to 3 stand on rows of all four groups.
            rows.append((None if k % 2 else k // 2 + 1, " ".join(w)))
    rows += rows[:2]
    docs = spark.createDataFrame(rows, "key long, text string")
    sets = [set(ngramjoin.shingles(t).tolist()) for _, t in rows]
    near = [[len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets] for a in sets]
    want = sorted((str(i), sum(n) - 1) for (i, _), n in zip(rows, near, strict=True))
    assert sum(n for _, n in want) >= 60
    for shuffled in (docs, docs.repartition(3, "text")):
        assert sorted((str(r["key"]), r["n_links"]) for r in ngramjoin.similar(shuffled).collect()) == want


def test_a_loose_cluster_goes_to_blocks_with_candidates_only(spark, monkeypatch):
    rnd = random.Random(31)
    words = text_of(rnd, 60 * 4 + 120).split()
    texts = [" ".join(words[4 * k : 4 * k + 100]) for k in range(60)]  # a chain: each is like the next ones only
    sets = [set(ngramjoin.shingles(t).tolist()) for t in texts]
    want = {i: sum(len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets) - 1 for i, a in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    sent = {}

    def counted(units, *rest):
        sent[len(sent)] = units
        return units_by(units, *rest)

    units_by = ngramjoin.by_unit
    monkeypatch.setattr(ngramjoin, "by_unit", counted)
    monkeypatch.setattr(ngramjoin, "BLOCK", 2)
    got = ngramjoin.similar(docs).collect()
    assert {r["key"]: r["n_links"] for r in got} == want and {r["component_id"] for r in got} == {0}
    bands = [set(ngramjoin._bands(ngramjoin.minhash(ngramjoin.shingles(t)))) for t in texts]
    candidates = sum(bool(bands[i] & bands[j]) for i in range(60) for j in range(i))
    assert sent[1].count() <= 60 + 2 * candidates < 60 * 30  # all pairs of its 30 blocks would take 60 x 30 rows


def test_linked_blocks_equal_brute_force(spark):
    rnd = random.Random(32)
    rows = [(k % 2 if k < 80 else 2 + k // 3, k, rnd.randrange(5)) for k in range(110)]
    near = [(band, rnd.randrange(120)) for band in range(40) for _ in range(rnd.randrange(2, 6))] + [(99, k) for k in range(0, 80, 2)]
    groups, bands = spark.createDataFrame(rows, "g long, m long, w int"), spark.createDataFrame(near, "band long, m long").distinct()
    deal = {(r["m"], r["u"][1], r["u"][2]) for r in units.in_blocks(groups, "g", "m", 8).collect()}
    of = {m: next(x for k, x, y in deal if k == m and x == y) for _, m, _ in rows}
    group = {m: g for g, m, _ in rows}
    want = {(m, group[m], b, b) for m, b in of.items()}
    for band, m in set(near):
        for other, n in set(near):
            if band == other and m in of and n in of and group[m] == group[n]:
                want.add((m, group[m], *sorted((of[m], of[n]))))
    got = units.in_linked_blocks(groups, "g", "m", bands, "band", 8).collect()
    assert {(r["m"], *r["u"]) for r in got} == want and len(got) == len(want)
    assert all(r["same"] == (r["u"][1] == r["u"][2]) and of[r["m"]] == r["u"][1 + r["side"]] for r in got)
    assert units.in_linked_blocks(groups.limit(0), "g", "m", bands.limit(0), "band", 8).count() == 0


def test_mixing_meets_targets_and_reruns_agree(spark):
    rnd = random.Random(2)
    rows = [(k, text_of(rnd, rnd.randrange(0, 90)) if k % 11 else None, rnd.choice(["a", "a", "a", "b", "c", None, "é"]), "x") for k in range(400)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).collect()
    assert len(got) == 420 and sorted(got) == sorted(mixing.mix(docs.repartition(7)).collect())
    total, by = 0, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0], s[1], total = s[0] + r["size"], s[1] + r["taken"], total + r["size"]
    order = sorted(by, key=lambda x: (x is None, (x or "").encode()))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, free, want = 1.5 * total, set(by), {}
    while free:  # plain water filling
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * level > 2 * by[s][0]}
        if not full:
            want |= {s: weights[s] * level for s in free}
            break
        want |= {s: 2 * by[s][0] for s in full}
        left, free = left - sum(2 * by[s][0] for s in full), free - full
    for s, (size, taken, target, source_size) in by.items():
        assert size == source_size and abs(target - want[s]) < 1e-6 and abs(taken - target) <= 1
    assert mixing.mix(empty(spark)).count() == 0
    none = mixing.mix(nasty(spark).where("text is null or text = ''")).collect()
    assert none and all(r["taken"] == 0 and r["target"] == 0 for r in none)
    assert mixing.mix(nasty(spark)).count() == nasty(spark).count()


def test_schedule_beyond_32_bits_and_small_sources(spark):
    ids = [0, 1, 65_535, 65_536, (1 << 32) - 1, 1 << 32, 3_470_000_000, 5_000_000_001, (1 << 40) + 12_345]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", mixing.point(F.col("i")).alias("p")).collect()
    assert {r["i"]: r["p"] for r in got} == {i: i * mixing.GOLDEN % (1 << 32) for i in ids}

    large = [("a", 4_000_000), ("b", 9_000_000), (None, 2_500_000)]
    slots = lambda rows: mixing.planned(spark.createDataFrame(rows, "source string, source_size long")).agg(F.sum("need")).first()[0]
    assert 0 < slots([*large, ("tiny", 3)]) - slots(large) < 64
    goals = mixing.planned(spark.createDataFrame([*large, ("tiny", 3), ("z", 0)], "source string, source_size long"))
    n = goals.agg(F.sum("need")).first()[0]
    for small in (True, False):
        ranks = mixing.schedule(goals, n, small).groupBy("n").agg(F.count("*").alias("k"), F.countDistinct("rank").alias("d"), F.max("rank").alias("top"))
        by = {r["n"]: r for r in ranks.collect()}
        assert all(by[r["n"]]["k"] >= r["need"] and by[r["n"]]["k"] == by[r["n"]]["d"] == by[r["n"]]["top"] + 1 for r in goals.where("need > 0").collect())


def test_simhash_edits_and_neighbours(spark):
    docs = nasty(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(docs.select("doc_id", F.coalesce("text", F.lit(""))).collect(), reverse=True)
    got = {r["doc_id"]: r for r in simhash.edited_prints(docs).collect()}
    prints = {}
    for (i, t), (j, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        near = 1 - bin(int(r["fingerprint"], 16) ^ int(got[j]["fingerprint"], 16)).count("1") / 128
        assert abs(r["near_next"] - near) < 1e-9
        assert abs(r["near_edited"] - (1 - bin(int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).count("1") / 128)) < 1e-9
        prints.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert len(simhash.edited_prints(nasty(spark)).collect()) == nasty(spark).count()
    assert simhash.edited_prints(empty(spark)).count() == 0
    assert simhash.edited_prints(nasty(spark).limit(1)).first()["near_next"] == 1.0


def test_next_documents_of_null_and_heavy_ids(spark):
    rnd = random.Random(30)
    rows = [(rnd.choice([None, None, 7, 7, 7, *range(40)]), text_of(rnd, rnd.randrange(1, 9))) for _ in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["th"]))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        k = len(r["text"]) // 3
        want.append((str(r["doc_id"]), hashlib.sha256((r["text"][: len(r["text"]) - k] + nxt["text"][:k]).encode()).hexdigest()))
    got = simhash.edited_prints(docs.repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == sorted(want)


def test_near_rows_equal_brute_force_and_long_texts_dont_overflow(spark, monkeypatch):
    docs = nasty(spark)
    prints = {}
    rows = simhash.edited_prints(docs).collect()
    monkeypatch.setattr(simhash, "PART", 7)
    monkeypatch.setattr(simhash, "UNIT", 2)
    again = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in simhash.edited_prints(docs).collect()}
    for r in rows:
        x = int(r["fingerprint"], 16)
        assert r["near_rows"] == sum(bin(x ^ int(o["fingerprint"], 16)).count("1") <= simhash.RADIUS for o in rows) - 1
        prints[r["fingerprint"]] = prints.get(r["fingerprint"], 0) + 1
        if r["doc_id"] is not None and prints[r["fingerprint"]] == 1:
            assert again[r["doc_id"], r["n_chars"], r["edited_sha256"]]["fingerprint"] == r["fingerprint"]
    assert max(prints.values()) >= 4 and sum(r["near_rows"] for r in again.values()) > 0


def test_permuted_tables_find_all_pairs(spark):
    rnd = random.Random(6)
    rows = []
    for _ in range(12):
        base = rnd.getrandbits(128)
        for _ in range(8):
            x = base
            for _ in range(rnd.randrange(5)):
                x ^= 1 << rnd.randrange(128)
            rows.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    both = lambda x: (signed(x & (1 << 64) - 1), signed(x >> 64))
    df = spark.createDataFrame([both(x) for x in rows] + [(None, None), both(rows[0])], "f0 long, f1 long")
    for radius in (1, 3, 6):
        got = sorted(tuple(sorted([(r["a0"], r["a1"]), (r["b0"], r["b1"])])) for r in simhash.within_radius(df, radius).collect())
        assert got == sorted(tuple(sorted([both(a), both(b)])) for a in set(rows) for b in set(rows) if a < b and bin(a ^ b).count("1") <= radius)


def labelled(spark, n=260):
    rnd = random.Random(8)
    syllables = {"en": "th he an er on in ou".split(), "fr": "eau le ai oi que an é".split(), "de": "sch ei ung ch er au ö".split()}
    rows = []
    for k in range(n):
        lang = list(syllables)[k % 3]
        words = ["".join(rnd.choice(syllables[lang]) for _ in range(rnd.randrange(1, 5))) for _ in range(40)]
        toxic = int(rnd.random() < 0.3)
        if toxic:
            for _ in range(3):
                words[rnd.randrange(40)] = rnd.choice(["grubbish", "vilestuff"])
        rows.append((k, " ".join(words), lang, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_language_id_held_out(spark):
    docs = labelled(spark)
    train = docs.where("doc_id % 4 <> 2")
    got = {r["doc_id"]: r for r in langid.predict(docs.drop("lang"), langid.fit(train)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in truth if i % 4 == 2]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = {r["doc_id"]: r for r in langid.predict(nasty(spark), langid.fit(train)).where("doc_id is not null").collect()}
    assert [odd[k]["lang_pred"] for k in (0, 1, 2, 3)] == ["und"] * 4 and odd[9]["lang_pred"] in ("en", "fr", "de")
    assert langid.predict(docs.limit(3).withColumn("lang_pred", F.lit("x")).unionByName(docs.limit(3).withColumn("lang_pred", F.lit("y"))), langid.fit(train)).count() == 6
    rare = docs.where("doc_id < 200").withColumn("lang", F.when(F.col("doc_id") == 5, "rare").otherwise(F.col("lang")))
    assert "rare" in langid.fit(rare, fit_docs=20).langs
    whole = langid.fit(docs.limit(20).withColumn("text", F.lit("ab" * 400)))
    assert {k: v.shape for k, v in langid.fit(docs.limit(20).withColumn("text", F.lit("ab " * 400))).grams.items() if len(k) == 1}.keys() == {k for k in whole.grams if len(k) == 1}
    nothing = langid.fit(empty(spark))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"} and langid.predict(empty(spark), nothing).count() == 0


def plain_languages(rows, texts):
    """(words, grams, predictions) by counting and adding in plain Python, over all rows(text, lang)."""
    import math
    from collections import Counter

    import regex

    langs = sorted({x for _, x in rows})
    words, grams = Counter(), Counter()
    for text, lang in rows:
        for w in regex.findall(r"\p{L}+", text.lower()):
            words[lang, w] += 1
            marked = f"^{w}$"
            for n in range(1, langid.LONGEST + 1):
                for i in range(len(marked) - n + 1):
                    grams[lang, marked[i : i + n]] += 1

    def table(counts):
        counts = {k: n for k, n in counts.items() if n >= langid.MIN_COUNT}
        keys = {k for _, k in counts}
        totals = {x: 1 + sum(n for (lang, _), n in counts.items() if lang == x) + 0.5 * len(keys) for x in langs}
        logs = {k: [math.log((counts.get((x, k), 0) + 0.5) / totals[x]) for x in langs] for k in keys}
        return {k: [v - max(row) for v in row] for k, row in logs.items()}

    w_table, g_table = table(words), table(grams)

    def score(word):
        if word in w_table:
            return w_table[word]
        marked = f"^{word}$"
        for n in range(min(langid.LONGEST, len(marked)), 0, -1):
            some = [g_table[marked[i : i + n]] for i in range(len(marked) - n + 1) if marked[i : i + n] in g_table]
            if some:
                return [sum(c) / len(some) for c in zip(*some, strict=True)]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        found = regex.findall(r"\p{L}+", text.lower())
        sums = [sum(c) for c in zip(*map(score, found), strict=True)]
        best = max(range(len(langs)), key=lambda k: (sums[k], -k))
        scale = min(20.0, math.sqrt(len(found))) / len(found)
        out.append((langs[best], 1 / sum(math.exp((v - sums[best]) * scale) for v in sums)))
    return w_table, g_table, out


def test_language_scores_equal_plain_counting(spark):
    docs = labelled(spark, 120)
    rows = [(r["text"], r["lang"]) for r in docs.orderBy("doc_id").collect()]
    unseen = ["heothing anerou", "zzz eaule schxx", "q", "thhe " * 50]
    words, grams, want = plain_languages(rows, [t for t, _ in rows] + unseen)
    model = langid.fit(docs)
    for mine, plain in ((model.words, words), (model.grams, grams)):
        assert mine.keys() == plain.keys() and all(abs(a - b) < 1e-9 for k in plain for a, b in zip(mine[k], plain[k], strict=True))
    asked = spark.createDataFrame(list(enumerate([t for t, _ in rows] + unseen)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked, model).collect()}
    assert all(got[k][0] == p and abs(got[k][1] - s) < 1e-9 for k, (p, s) in enumerate(want))


def test_toxicity_held_out(spark):
    docs = labelled(spark)
    learn = zlib.crc32
    train = [r["doc_id"] for r in docs.collect() if learn(str(r["doc_id"]).encode()) % 5]
    labels = docs.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(F.col("doc_id").isin(train)))
    truth = {r["doc_id"]: r["toxic"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    held = [i for i in truth if i not in set(train)]
    assert sum((got[i] >= 0.5) == bool(truth[i]) for i in held) >= 0.9 * len(held)
    odd = toxicity.scores(nasty(spark), model).collect()
    assert len(odd) == nasty(spark).count() and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity.keep_clean(nasty(spark), model)
    assert kept.columns == nasty(spark).columns and kept.count() == sum(r["score"] < 0.5 for r in odd)
    constant = toxicity.fit(docs, empty(spark).select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert {r["score"] < 0.5 for r in toxicity.scores(docs, constant).collect()} == {True} and toxicity.scores(empty(spark), constant).count() == 0


def test_many_languages_and_equally_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(langid, "KEEP_WORDS", 5)
    monkeypatch.setattr(langid, "CACHED_BYTES", 1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k, " ".join(f"{letters[k % 26]}{letters[k // 26]}{x}" for x in "pqrstuvw") + " ", f"l{k:03d}") for k in range(120)]
    docs = spark.createDataFrame([(i, t * 3, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 120 and len(model.words) == 600
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}
    long_ = spark.createDataFrame([(1, " ".join(f"{letters[k % 26]}a{letters[k % 17]}{letters[k % 23]}" for k in range(6000)))], "doc_id long, text string")
    assert langid.predict(long_, model).count() == 1


def plain_toxicity(model, text):
    """The score of a text by a plain loop over windows, each compressed by fresh dictionaries."""
    import math

    import zstandard

    def size(content, data, level):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(model.ordinary[:24] + data))

    def gain(data, level):
        return size(model.ordinary, data, level) - size(model.toxic + model.ordinary, data, level)

    data = b"".join(b" " + w for w in text.lower().encode().split()) or b" "
    starts = [i for i in range(len(data)) if i % (toxicity.WINDOW - toxicity.OVERLAP) == 0 and (i == 0 or i < len(data) - toxicity.OVERLAP)]
    gains = {i: gain(data[i : i + toxicity.WINDOW], toxicity.FAST) for i in starts}
    runs = {}
    for i in (i for i in starts if gains[i] >= toxicity.SUSPECT):
        left = max(data[: i + 1].rfind(b" "), i - 24, 0)
        right = data.find(b" ", i + toxicity.WINDOW)
        words = data[left : min(len(data) if right < 0 else right, i + toxicity.WINDOW + 24)].split()
        for k in range(0, len(words), toxicity.WORDS):
            run = b"".join(b" " + w for w in words[k : k + toxicity.WORDS])
            runs[run] = min(gain(run, level) for level in (toxicity.FAST, toxicity.THOROUGH))
    n, two, four = len(starts), sum(g >= 2 for g in runs.values()), sum(g >= 4 for g in runs.values())
    features = [min(max([0, *gains.values()]), 12), min(max(runs.values(), default=0), 12), math.log1p(two), math.log1p(four), min(1, 10 * two / n), min(1, 10 * four / n), min(1, 3 * sum(g >= toxicity.SUSPECT for g in gains.values()) / n)]
    z = model.weights[0] + sum(w * f for w, f in zip(model.weights[1:], features, strict=True))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_scores_equal_a_plain_loop(spark):
    docs = labelled(spark, 160)
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()]
    texts += ["", "   ", "x" * 300, " ".join(texts[:20]), "grubbish", "VILESTUFF grubbish " * 9]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(asked, model).collect()}
    assert all(abs(got[k] - plain_toxicity(model, t)) < 1e-9 for k, t in enumerate(texts)) and len({round(x, 6) for x in got.values()}) > 5


def test_sentencepiece_parity_and_round_trip(spark):
    import sentencepiece

    from canlake.llm.common import tokenizer_path

    own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    docs = nasty(spark, [*spiece.PROBES, "é" * 5000])
    rows = spiece.encode(docs.where("doc_id is not null"), audit_every=1).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["ids"] == own.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert all(r["round_trip"] for r in rows if "▁" not in texts[r["doc_id"]])
    back = {r["doc_id"]: r["text"] for r in spiece.decode(spiece.encode(docs.where("doc_id is not null"))).collect()}
    assert all(back[r["doc_id"]] == own.decode(r["ids"]) for r in rows)
    assert spiece.encode(empty(spark)).count() == 0


def test_unigram_model_is_rebuilt():
    """A unigram model written by hand: its own library and the rebuilt one agree."""
    import struct

    def field(n, kind, v):
        head = bytes([n << 3 | kind]) if n < 16 else bytes([(n << 3 | kind) & 127 | 128, (n << 3 | kind) >> 7])
        if kind == 2:
            size, out = len(v), b""
            while size > 127:
                out, size = out + bytes([size & 127 | 128]), size >> 7
            return head + out + bytes([size]) + v
        return head + (v if isinstance(v, bytes) else bytes([v]))

    def piece(text, score, kind=1):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, kind))

    pieces = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3), piece("▁", -2.0), *(piece(c, -4.0) for c in "abcd"), piece("▁ab", -3.0), piece("cd", -3.5), piece("bc", -3.1)]
    blob = b"".join(pieces) + field(2, 2, field(3, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    spiece.verify_parity(blob, ["abcd", "ab cd", "dcba ab", "a", "abcbcd  cd"])
