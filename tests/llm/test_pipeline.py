import importlib

import corpus_pipeline
from canlake.llm import entries, mixing, ngramjoin
from tests.llm.test_text_operators import empty, nasty

COLUMNS = corpus_pipeline.COLUMNS


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = nasty(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "sentencepiece":
            assert out.columns == COLUMNS and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            assert stage(spark, empty(spark), sf).count() == 0
        out.count()


def test_near_copies_leave_one_of_each_group(spark, sf):
    docs = nasty(spark)
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf).collect()
    ids = [r["doc_id"] for r in kept]
    # 5 and 6 are the same, 7 and 8 nearly; blank, empty and NULL texts are no copies of each other.
    assert ids.count(5) == 1 and not {6, 7, 8} & set(ids) and {0, 1, 2, 3, 4, 9, 10, 11} <= set(ids)
    sets = [set(ngramjoin.shingles(r["text"] or "").tolist()) for r in kept]
    assert all(not a or not b or len(a & b) < 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])


def test_rows_that_share_an_id_are_documents_of_their_own(spark, sf):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " tail"), (1, a), (None, c), (None, c), (3, None), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, root string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])[:3]) for r in kept) == sorted([("1", "a0 "), ("1", "b0 "), ("None", "c0 "), ("3", "Non"), ("3", "")])


def test_filters_of_odd_rows(spark, sf):
    docs = nasty(spark)
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_repeats):
        kept = stage(spark, docs, sf).collect()
        texts = [r["text"] for r in kept]
        assert None in texts and "" in texts and "\u00e9t\u00e9" in texts and all(r["doc_id"] is None or 0 <= r["doc_id"] <= 13 for r in kept)
    # Repeated rows are judged each: all of them stay, or lose what they share.
    assert sum(r["doc_id"] == 5 for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()) == 3
    assert not [r for r in corpus_pipeline.drop_repeats(spark, docs, sf).collect() if r["doc_id"] in (5, 6)]


def test_mixing_stage_repeats_whole_documents(spark, sf):
    docs = nasty(spark).dropDuplicates(["doc_id"]).where("doc_id is not null")
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(docs).collect()}
    out = [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, sf).collect()]
    assert all(out.count(i) == (int(t / s + 0.5) if s else 0) for i, (t, s) in taken.items() if s > 5000 or not s) and max(out.count(i) for i in out) <= 2


def test_run_over_the_tables(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {n.split("_")[0] for n in entries.queries()} == {f"op{k}" for k in range(1, 14)} and set(entries.queries()) | {"pipeline"} <= names
