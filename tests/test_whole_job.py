"""Queries that must do the whole job: nothing left out of the rows, the lists or the answers."""

from pathlib import Path

import pytest

from sievewright.operators import retrieval as R
from sievewright.plans import dataset, relational, retrieval, storage, text


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_index_loses_no_neighbour(spark, data, sf):
    at = str(Path(data).parent / sf)
    found = {name: sorted(tuple(r) for r in retrieval.QUERIES[name](spark, at).select("query_id", "rank", "doc_id", "score").collect()) for name in ("dense_topk", "dense_index_topk")}
    assert found["dense_topk"] and found["dense_index_topk"] == found["dense_topk"]


def test_index_skips_lists_that_hold_nothing_better(spark):
    import numpy as np

    rows = [(i, [1.0, i / 1000]) for i in range(20)] + [(100 + i, [-1.0, i / 1000]) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    centroids = np.array([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]])
    index = R.index_vectors(df, "id", "v", centroids)
    assert R.list_radii(index, centroids).round(3).tolist() == [0.019, 0.019, -1.0]
    q = spark.createDataFrame([(1, [1.0, 0.5]), (2, [0.0, 1.0])], "q int, v array<float>")
    for k in (3, 30):
        want = sorted(tuple(r) for r in R.dense_topk(q, df, "q", "id", "v", k).select("query_id", "rank", "doc_id", "score").collect())
        assert sorted(tuple(r) for r in R.index_topk(index, q, "q", "v", centroids, k, 1).select("query_id", "rank", "doc_id", "score").collect()) == want


def test_hybrid_finds_what_bm25_does_not(spark, tmp_path):
    texts = ["fox " * 30 + "bog " * 30] * 60 + ["fox"] * 60 + ["bog " * 40] * 300
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "fox")], "item_id long, question string").write.parquet(str(tmp_path / "eval_items.parquet"))
    assert {r["doc_id"] for r in retrieval._bm25(spark, str(tmp_path)).collect()} == set(range(50))
    best = retrieval.QUERIES["hybrid_rrf_two_searches"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["doc_id"] for r in best] == [0, 60, 1]


def test_overlap_scores_every_document(spark):
    texts = [(i, ("red fox " if i % 3 else "Fox ") + "x" * i) for i in range(80)] + [(80, None), (81, "")]
    docs = spark.createDataFrame(texts, "id int, t string")
    asked = spark.createDataFrame([(1, "Red fox, red"), (2, "none")], "q int, s string")
    held = lambda t: len({"red", "fox"} & set(t.lower().split())) / max(len(t), 1)
    want = sorted(((1, i, round(held(t), 9)) for i, t in texts if t), key=lambda r: (-r[2], r[1]))[:50]
    found = R.overlap_scores(docs, "id", "t", asked, "q", "s", 50).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in found] == want


TEXTS = ["a" * 300, "é" * 150, "x" * 199 + "é", "x" * 198 + "日本", "x" * 197 + "🦊🦊", "Été — DAS\u00a0Größte, снег_1!", "", None]


def test_texts_of_all_scripts(spark, tmp_path):
    import re
    import unicodedata

    word = lambda ch: ch == "_" or unicodedata.category(ch)[0] in "LM" or unicodedata.category(ch) in ("Nd", "Pc")
    langs = ["en", "fr", "eng", "ja", None, "EN", "en-GB", "en"]
    spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(TEXTS, langs, strict=True))], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {n: {r[0]: r[1] for r in text.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("text_utf8_prefix", "text_phrase_norm")}
    texts = {i: t for i, t in enumerate(TEXTS) if t is not None}
    assert got["text_utf8_prefix"] == {i: t.encode()[:200].decode(errors="ignore") for i, t in texts.items()}
    assert got["text_phrase_norm"] == {i: re.sub(" +", " ", "".join(c if word(c) else " " for c in t.lower())).strip() for i, t in texts.items()}


def test_every_delivery_of_a_sample(spark, tmp_path):
    turns = [("user", "añ"), ("assistant", None), ("assistant", "xyz")]
    spark.createDataFrame([("s", 1, turns), ("s", 2, turns[:2]), ("t", 1, turns[2:])], "sample_id string, built_at int, messages array<struct<role string, content string>>").write.parquet(str(tmp_path / "sft_rows.parquet"))
    rows = lambda n: sorted(tuple(r) for r in dataset.QUERIES[n](spark, str(tmp_path)).collect())
    assert rows("chat_template") == [("s", 1, "<|user|>añ\n<|assistant|>\n<|assistant|>xyz"), ("s", 2, "<|user|>añ\n<|assistant|>"), ("t", 1, "<|assistant|>xyz")]
    assert rows("assistant_mask_ranges") == [("s", 1, 2, 2, 2), ("s", 1, 3, 2, 5), ("s", 2, 2, 2, 2), ("t", 1, 1, 0, 3)]


def test_scores_read_the_predictions(spark, tmp_path):
    def row(sample, source, contents, golds, calls=None):
        messages = [("user", "<answer>red</answer>", None)] + [("assistant", c, None) for c in contents]
        return (sample, 1, source, [*messages, ("assistant", None, [(("search", a),) for a in calls])] if calls else messages, (golds,))

    gold = ['<tool_call>{"name": "search", "arguments": {"query": "fox"}}</tool_call>']
    rows = [
        row("right", "dual_search", ["<answer>blue</answer>", "<answer>The Red.</answer>"], ["green", "red"]),
        row("wrong", "dual_search", ["<answer>red</answer>", "<answer>blue</answer>"], ["red"]),
        row("silent", "dual_search", ["red"], ["red"]),
        row("unknown", None, ["<answer>red</answer>"], []),
        row("same call", "tool_calls", [], gold, ['{"query": "fox"}']),
        row("other call", "tool_calls", [], gold, ['{"query": "bog"}']),
        row("no call", "tool_calls", ["<answer>fox</answer>"], gold),
        row("braces", "dual_search", ["<answer>x}{y</answer>"], ["x", "{x"]),
    ]
    schema = "sample_id string, built_at int, data_source string, messages array<struct<role string, content string, tool_calls array<struct<function struct<name string, arguments string>>>>>, extra_info struct<answers array<string>>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "sft_rows.parquet"))
    found = {r["sample_id"]: r["score"] for r in storage.QUERIES["protocol_scores"](spark, str(tmp_path)).collect()}
    assert found == {"right": 1.0, "wrong": 0.0, "silent": 0.0, "unknown": None, "same call": 1.0, "other call": 2 / 3, "no call": 0.0, "braces": 0.0}


def test_joins_and_repeats_over_whole_tables(spark, data):
    n = lambda t: spark.read.parquet(f"{data}/{t}.parquet")
    joined = relational.QUERIES["join_full_outer"](spark, data).collect()
    assert sum(r["customers"] or 0 for r in joined) == n("customer").count() and sum(r["suppliers"] or 0 for r in joined) == n("supplier").count()
    assert any(r["suppliers"] is None for r in joined)
    assert relational.QUERIES["batch_repeat"](spark, data).count() == 3 * n("orders").count()
    assert relational.QUERIES["batch_repeat_by_row"](spark, data).count() == n("part").selectExpr("sum(p_size)").first()[0]


def test_quota_counts_every_spelling(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("label_aliases", [("coarse_taxon", "aves", "Birds"), ("coarse_taxon", "birds", "Birds"), ("question_type", "auto", "automatic")], "field_name string, alias string, canonical string")
    put("sample_targets", [("Birds", "automatic", 0.01)], "coarse_taxon string, question_type string, target_share double")
    put("qa_candidates", [(1, "Birds", "auto", 3, "a"), (2, " AVES", "Auto ", 1, "b"), (3, "birds", "auto", 2, "c"), (4, None, "auto", 0, "d"), (5, "Fish", "auto", 0, "e")], "source_row_index long, coarse_taxon string, question_type string, train_rank long, tiebreak string")
    assert sorted(tuple(r) for r in relational.QUERIES["select_quota"](spark, str(tmp_path)).collect()) == [(2, "Birds", "automatic", 1), (3, "Birds", "automatic", 2)]
