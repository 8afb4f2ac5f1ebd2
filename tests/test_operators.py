import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.functions import arrays as A
from sievewright.functions import protocol as P
from sievewright.functions import text as T
from sievewright.functions.registry import Registry, load_function
from sievewright.operators import advantage as ADV
from sievewright.operators import balance as BAL
from sievewright.operators import batch as B
from sievewright.operators import joins as J
from sievewright.operators import metrics as M
from sievewright.operators import retrieval as R
from sievewright.operators import selection as S
from sievewright.operators.components import entity_links, propagate_labels
from sievewright.operators.correction import parse_thresholds
from sievewright.operators.ranks import distributed_row_number, hash_order, running_sum
from sievewright.session import cut_lineage
from sievewright.sources import readers, writers
from sievewright.streaming import windows as W


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_running_sum_in_buckets_equals_the_window(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, g string, v int").withColumn("o", hash_order("id", seed=3))
    one_task = {r["id"]: r["s"] for r in running_sum(df, ["g"], "o", ["id"], F.col("v"), "s", 1).collect()}
    bucketed = {r["id"]: r["s"] for r in running_sum(df, ["g"], "o", ["id"], F.col("v"), "s", 37).collect()}
    assert one_task == bucketed
    numbers = distributed_row_number(df, ["g"], "o", ["id"], "n", 11).groupBy("g").agg(F.max("n").alias("m"), F.count_distinct("n").alias("d"), F.count("*").alias("c")).collect()
    assert all(r["m"] == r["d"] == r["c"] for r in numbers)


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components_equal_union_find(spark, kind):
    rng = random.Random(5)
    pairs = {
        "chain": [(f"r{i}", f"e{j:03}") for i in range(60) for j in (i, i + 1)],
        "star": [(f"r{i}", e) for i in range(40) for e in ("hub", f"e{i:03}")],
        "random": [(f"r{rng.randint(0, 60)}", f"e{rng.randint(0, 90):03}") for _ in range(110)],
        "none": [(None, "e1"), ("r1", None), ("r2", "e2")],
    }[kind]
    df = spark.createDataFrame(pairs * 2, "r string, e string")
    found = {r["node"]: r["label"] for r in propagate_labels(entity_links(df, "r", "e")).collect()}
    whole = union_find([(f"0{e}", f"1{r}") for r, e in pairs if r and e])
    groups = {}
    for x, root in whole.items():
        if x[0] == "0":
            groups.setdefault(root, set()).add(x[1:])
    expected = {e: min(g) for g in groups.values() if len(g) > 1 for e in g}
    assert found == expected


def test_lineage_cuts_bound_the_size_estimate(spark):
    df = spark.range(20)
    for _ in range(4):  # three self-joins a step: the estimate's digits grow threefold, to over 100 here
        df = cut_lineage(df.join(df.select("id"), "id").join(df.select("id"), "id"))
        assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 63
    assert sorted(r["id"] for r in df.collect()) == list(range(20)) and df.schema == spark.range(20).schema


def test_components_of_many_rounds(spark):
    names = [f"e{i:03}" for i in range(600)]
    random.Random(2).shuffle(names)
    path = spark.createDataFrame([(i, e) for i in range(599) for e in names[i : i + 2]], "r int, e string")
    found = propagate_labels(entity_links(path, "r", "e"))
    assert sorted((r["node"], r["label"]) for r in found.collect()) == [(e, "e000") for e in sorted(names)]


@given(st.integers(0, 500), st.lists(st.integers(1, 50), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_apportionment(total, weights):
    got = S.largest_remainder(total, weights)
    assert sum(got) == total
    assert all(abs(g - total * w / sum(weights)) < 1 for g, w in zip(got, weights, strict=True))


def test_quota_matrix_and_fallbacks():
    for rows, columns in (([10, 7, 3], [9, 6, 5]), ([0, 4, 6], [1, 9, 0]), ([5], [2, 3]), ([], []), ([1, 1, 1, 9], [3, 3, 3, 3])):
        m = S.quota_matrix(rows, columns)
        assert [sum(r) for r in m] == rows and (not rows or [sum(c) for c in zip(*m, strict=True)] == columns)
    assert S.quota_matrix([4, 4], [5, 3]) == [[3, 1], [2, 2]]
    with pytest.raises(ValueError):
        S.quota_matrix([3], [2])
    assert S.balanced_totals(10, 4, 1) == [2, 3, 3, 2]
    assert S.fit_capacity([5, 5, 0], [3, 9, 9]) == [3, 5, 2]
    assert S.fallback_events([5, 5, 0], [3, 5, 2]) == [(0, 2, 2)]
    with pytest.raises(ValueError):
        S.fit_capacity([5], [4])


@given(st.lists(st.integers(0, 3000), min_size=8, max_size=40), st.integers(2, 5))
@settings(max_examples=60, deadline=None)
def test_partitions(lengths, parts):
    for cut in (BAL.greedy_partition, BAL.differencing_partition):
        assert sorted(i for p in cut(lengths, parts) for i in p) == list(range(len(lengths)))
    n = len(lengths) // parts * parts
    equal = BAL.differencing_partition(lengths[:n], parts, equal_size=True)
    assert {len(p) for p in equal} == {n // parts}
    groups = BAL.micro_batches(lengths, 4000)
    assert sorted(i for g in groups for i in g) == list(range(len(lengths)))


def test_balance_keeps_groups_together(spark):
    df = spark.createDataFrame([(0, i, 10 * (i % 7) + 1, f"g{i % 9}") for i in range(90)], "b int, i int, n int, g string")
    out = BAL.balance(df, "b", "i", "n", 3, together="g").join(df, ["b", "i"])
    assert out.count() == 90
    assert out.groupBy("g").agg(F.count_distinct("part").alias("k")).where("k > 1").count() == 0


def test_golden_values(spark):
    eos = [one(spark, A.eos_mask(F.array(*[F.lit(x) for x in xs]), F.lit(1))) for xs in ([20, 10, 34, 1, 0, 0, 0], [78, 0, 76, 2, 1, 0, 0])]
    assert eos == [[1, 1, 1, 1, 0, 0, 0], [1, 1, 1, 1, 1, 0, 0]]
    rows = [("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("accuracy", 0.8), ("accuracy", 0.9), ("accuracy", 0.7), ("max_reward", 5.0), ("max_reward", 8.0), ("min_error", 0.1), ("min_error", 0.05)]
    got = {r["m"]: round(r["reduced"], 6) for r in M.reduce_by_name(spark.createDataFrame(rows, "m string, v double"), "m", "v").collect()}
    assert got == {"loss": 2.0, "accuracy": 0.8, "max_reward": 8.0, "min_error": 0.05}
    votes = spark.createDataFrame([(1, "A", 0.9, 0), (1, "B", 0.8, 1), (1, "A", 0.7, 2)], "g int, p string, v double, i int")
    assert M.majority_value(votes, "g", "p", "v", "i").first()["majority"] == 0.9


def test_bootstrap_near_closed_form(spark):
    df = spark.createDataFrame([("u", float(v)) for v in range(8)], "g string, v double")
    sampled, exact = M.bootstrap(df, "g", "v", 3, draws=4000).first()["mean"], M.expected_best(df, "g", "v", 3).first()["expected"]
    assert abs(sampled - exact) < 0.12


def test_gae_equals_a_loop(spark):
    rng = random.Random(2)
    for _ in range(5):
        n = rng.randint(1, 9)
        r, v, m = [rng.random() for _ in range(n)], [rng.random() for _ in range(n)], [rng.randint(0, 1) for _ in range(n)]
        nxt, last, want = 0.0, 0.0, []
        for t in reversed(range(n)):
            if m[t]:
                last = r[t] + 0.9 * nxt - v[t] + 0.9 * 0.8 * last
                nxt = v[t]
            want.append(last)
        lit = lambda xs: F.array(*[F.lit(x) for x in xs])
        assert one(spark, A.gae(lit(r), lit(v), lit(m), 0.9, 0.8)) == pytest.approx(want[::-1])


def test_advantages_of_nulls_and_lone_rows(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, None, 5.0), (4, "b", 2.0)], "i int, g string, r double")
    assert {r["i"]: round(r["advantage"], 4) for r in ADV.grpo(df, "g", "r").collect()} == {1: -0.7071, 2: 0.7071, 3: 5.0, 4: 2.0}
    assert {r["i"]: r["advantage"] for r in ADV.rloo(df, "g", "r").collect()} == {1: -2.0, 2: 2.0, 3: 5.0, 4: 2.0}


def test_text_functions(spark):
    cases = [
        (T.clean_text(F.lit(" NaN ")), ""), (T.clean_text(F.lit(None).cast("string")), ""), (T.normalize_url(F.lit(" http://a.b/c// ")), "https://a.b/c"),
        (T.normalize_url_parts(F.lit("HTTP://A.b//c//d/?q=1#f")), "http://a.b/c/d?q=1"), (T.split_delimited(F.lit("a| b ||c")), ["a", "b", "c"]),
        (T.normalize_answer(F.lit("The  Cat, a-b!")), "cat ab"), (T.last_answer(F.lit("<answer>x</answer> <answer> y </answer>")), "y"), (T.last_answer(F.lit("none")), None),
        (T.parse_answers(F.lit("x"), F.lit("y|z && w|x")), ["x", "y", "z && w"]), (T.parse_answers(F.lit("x"), F.lit("True")), ["x"]), (T.gsm8k_strict(F.lit("so #### 1,234")), "1234"),
        (T.title_of(F.lit('"A b"\nc')), "A b"), (T.body_of(F.lit('"A b"\nc\nd')), "c\nd"), (T.utf8_prefix(F.lit("aé漢字"), 5), "aé"), (T.utf8_prefix(F.lit("aé漢字"), 6), "aé漢"),
        (T.minerva_normalize(F.lit("x = 12 \\text{ units}")), "12"), (T.minerva_normalize(F.lit("\\frac12")), "\\frac{1}{2}"), (T.turn_kind(F.lit("<answer>a</answer>")), "answer"),
        (T.multiset_similarity(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"))), 0.25), (T.is_safe_member(F.lit("a/../b")), False), (T.is_safe_member(F.lit("a/b")), True),
        (T.contains_phrase(F.lit("The Big, red fox."), F.lit("big red")), True), (T.contains_phrase(F.lit("abc"), F.lit("b")), False), (A.common_prefix(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3))), 1),
        (A.truncate(F.array(*[F.lit(i) for i in range(5)]), 3, "middle"), [0, 3, 4]), (A.pad(F.array(F.lit(1)), 3, F.lit(0), left=True), [0, 0, 1]),
    ]
    assert [one(spark, c) for c, _ in cases] == [w for _, w in cases]


def test_protocol(spark):
    call = '{"name": "search", "arguments": {"query": "x"}}'
    assert P.check_call(call) == "ok"
    assert P.check_call('{"name": "search", "name": "x", "arguments": {}}') == "duplicate_key"
    assert P.check_call('{"name": "vision_search", "arguments": {"image_index": true, "query": "x"}}') == "type:image_index"
    assert P.check_call('{"name": "search", "arguments": {"query": "%s"}}' % ("x" * 513)) == "length:query"
    thought = "<think>so</think>"
    assert P.check_trajectory(["user", "assistant", "tool", "assistant"], ["q", f"{thought}<tool_call>{call}</tool_call>", "r", f"{thought}\n<answer>a</answer> "]) == "ok"
    assert P.check_trajectory(["user", "assistant"], ["q", f"{thought}plain"]) == "turn_1:no_action"
    wrong = {
        "<answer>a</answer>": "no_think", "<think> </think><answer>a</answer>": "no_think", f"{thought}x<answer>a</answer>": "around_answer", f"{thought}<answer>a": "mismatched_answer", f"{thought}<answer> </answer>": "blank_answer",
        f"{thought}<answer>a <think>b</answer>": "control_tag", f"{thought}<search>x</search>": "legacy_tag", f"{thought}<tool_call>{call}</tool_call> more": "around_tool_call", f"{thought}<answer>a</answer><answer>b</answer>": "repeated",
        f"{thought}<tool_call>{call}</tool_call><answer>a</answer>": "call_and_answer", f"{thought}<tool_call>{call}": "mismatched_tool_call",
    }
    assert all(P.parse_turn(t) == ("invalid", why) for t, why in wrong.items()) and P.parse_turn(f"{thought}<answer> a </answer>\n") == ("answer", "a")
    states = spark.createDataFrame([(t, why) for t, why in wrong.items()] + [(f"{thought} <tool_call>{call}</tool_call>", "tool_call"), (f"{thought}<answer>a</answer>", "answer"), (None, None)], "t string, why string")
    assert states.where(~P.turn_state("t").eqNullSafe(F.col("why"))).count() == 0
    vision = '{"name": "vision_search", "arguments": {"image_index": 3, "query": "x"}}'
    assert P.check_call(vision) == "ok" and P.check_call(vision, 2) == "range:image_index" and P.check_call('{"name": "search", "arguments": {"query": "a <think>"}}') == "control_tag:query"
    flat = f"{thought}<tool_call>{call}</tool_call>user\n<tool_response>r</tool_response>\nassistant\n{thought}<answer>a</answer>\n"
    assert P.check_flat_trajectory(flat) == "ok" and P.check_flat_trajectory(flat + "x") == "after_answer" and P.check_flat_trajectory(flat.replace(">r<", "><|im_end|><")) == "control_tag:response"
    assert P.parse_channels(f"<|channel|>analysis<|message|>no<|end|>hi<|start|>assistant<|channel|>commentary to=functions.f <|constrain|>json<|message|>{{}}<|call|>") == ("hi", [("f", "{}")])
    assert P.parse_braces('ok <|tool_call>call:f{a:<|"|>x, y<|"|>,n:3,b:true}<tool_call|>') == ("ok", [("f", '{"a": "x, y", "b": true, "n": 3}')])
    assert P.boxed_strict("so \\boxed{3}", "3") == 1 and P.boxed_strict("\\boxed{3}" + "x" * 99, "3") == -1
    assert P.boxed_with_format("<think>a</think> \\boxed{3}", "3") == 1.0 and abs(P.boxed_with_format("\\boxed{3}", "3") - 0.9) < 1e-9
    assert P.plain_latex("x = \\dfrac12\\text{ cm}") == "\\frac{1}{2}" and P.plain_latex(".5") == "\\frac{1}{2}" and P.plain_latex("3/4") == "\\frac{3}{4}" and P.plain_latex("\\sqrt2") == "\\sqrt{2}"
    assert P.format_match("<think>a</think>\n<tool_call>\nb\n</tool_call>", "<tool_call>") == 1 and P.format_match("<think>a</think>", "<tool_call>") == 0
    judged = spark.createDataFrame([('{"score": 1}', 1.0), (' {"score":0.0}\n', 0.0), ('{"score": 0.5}', None), ('{"score": "1"}', None), ('{"score": true}', None), ('{"score": 1, "a": 2}', None), ("1", None), (None, None), ('{"score": 1e0}', 1.0)], "t string, want double")
    assert judged.where(~P.judge_score("t").eqNullSafe(F.col("want"))).count() == 0
    assert P.parse_hermes(f"a <tool_call>{call}</tool_call>") == ("a", [("search", '{"query": "x"}')])
    assert P.parse_xml("<tool_call><function=f><parameter=n>\n3\n</parameter></function></tool_call>")[1] == [("f", '{"n": 3}')]
    assert P.last_boxed("a \\boxed{\\frac{1}{2}} b") == "\\frac{1}{2}"
    assert P.equal_answers("\\frac{1}{2}", "0.5") and P.equal_answers("(1, 2]", "(1,2.0]") and not P.equal_answers("(1,2)", "[1,2]") and not P.equal_answers("x", "y")
    assert P.boxed_reward("so \\boxed{4}", "4.0") == 1.0
    assert P.tool_match(f"<tool_call>{call}</tool_call>", f"<tool_call>{call}</tool_call>") == 1.0
    assert parse_thresholds("0.5_2") == (0.5, 2.0) and parse_thresholds(3) == (None, 3.0)


def test_registry(tmp_path):
    r = Registry("thing")
    r.register("a")(len)
    assert r.get("a") is len and r.names() == ["a"]
    with pytest.raises(ValueError):
        r.register("a")(max)
    with pytest.raises(KeyError):
        r.get("b")
    p = tmp_path / "f.py"
    p.write_text("def f(x, y=1):\n    return x + y\n")
    assert load_function(str(p), "f", y=5)(1) == 6


def test_batches(spark):
    df = spark.range(10)
    assert sorted(r["id"] for r in B.slice_rows(df, "id", 1, 8, 3).collect()) == [1, 4, 7]
    assert B.pad_to_divisor(df, "id", 4).count() == 12 and B.pad_to_divisor(spark.range(3), "id", 10).count() == 10
    assert {r["c"] for r in B.chunk(df, "id", 5).groupBy("chunk").agg(F.count("*").alias("c")).collect()} == {2}
    with pytest.raises(ValueError):
        B.chunk(df, "id", 3)
    rows = df.withColumn("g", F.lit("x")).withColumn("r", F.lit(1.0)).withColumn("toks", F.array(F.lit(5), F.lit(6))).withColumn("mask", F.array(F.lit(1), F.lit(1)))
    padded = B.upsample(rows, "id", 4, "g", ["toks", "mask"], "pad-1", ["r", "mask"])
    assert padded.count() == 12 and padded.where("is_padding and g = 'pad-1' and r = 0 and size(toks) = 1 and toks[0] = 5 and mask[0] = 0").count() == 2
    assert sorted(r["id"] for r in B.pad_with_end(df, "id", 2).where("is_padding").collect()) == [9, 9] and B.pad_with_end(df, "id", 1, "first").where("is_padding").first()["id"] == 0
    batches = B.mini_batches(df, "id", 3, epochs=2, seed=4)
    assert batches.groupBy("epoch", "batch_no").count().where("count = 3").count() == 6 and batches.groupBy("epoch", "id").count().where("count > 1").count() == 0
    jagged = B.pack(df.withColumn("g", F.col("id") % 3), ["g"], "id", ["id"])
    assert sorted(r["length"] for r in jagged.collect()) == [3, 3, 4] and sorted(r["id"] for r in B.unpack(jagged, ["g"], ["id"]).collect()) == list(range(10))
    other = rows.where("id < 9").withColumn("r", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("r")))
    assert sorted(tuple(r) for r in B.differing(rows, other, "id").collect()) == [(3, "r"), (9, "id")]
    assert B.differing(other, other, "id").count() == 0 and B.union_checked(rows, rows.select("id", "r"), "id").count() == 10 and B.reorder(df, df.withColumn("place", -F.col("id")), "id", "place").first()["id"] == 9


def test_index_recall(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["doc_id"]) for r in R.dense_topk(q, e.select(F.col("vec_id").alias("doc_id"), "embedding"), "query_id", "doc_id", "embedding", 10).collect()}
    c = R.fit_centroids(e, "embedding", 32)
    index = R.index_vectors(e, "vec_id", "embedding", c)
    assert index.count() == e.count()
    found = {(r["query_id"], r["doc_id"]) for r in R.index_topk(index, q, "query_id", "embedding", c, 10, 16).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_searches_of_nothing(spark):
    none = spark.createDataFrame([], "id int, v array<float>, t string")
    some = spark.createDataFrame([(1, [1.0, 0.0], "the a"), (2, None, None)], "id int, v array<float>, t string")
    assert R.dense_topk(none, some, "id", "id", "v", 3).count() == 0 and R.dense_topk(some, none, "id", "id", "v", 3).count() == 0
    assert R.lexical_scores(none, "id", "t", some, "id", "t", 3).count() == 0
    assert R.dense_topk(some, some, "id", "id", "v", 3).collect()[0]["score"] == 1.0


def test_json_objects_and_archives(spark, tmp_path):
    import json
    import tarfile
    import zipfile

    doc = {"images": [{"id": i, "t": "é" * 5} for i in range(500)], "info": {"v": 1}, "pages": [], "skip": [1, 2]}
    plain = tmp_path / "a.json"
    plain.write_text(json.dumps(doc), encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.write(plain, "a.json")
    spark.dataSource.register(readers.JsonObjectSource)
    for path in (plain, tmp_path / "b.zip"):
        rows = spark.read.format("json_object").option("keys", "images,info").load(str(path)).collect()
        assert len(rows) == 501 and json.loads(rows[3]["element"]) == doc["images"][3]
    with tarfile.open(tmp_path / "c.tar", "w") as t:
        t.add(plain, "d/a.json")
    assert [r["member"] for r in readers.read_tar_members(spark, str(tmp_path / "c.tar")).collect()] == ["d/a.json"]
    with pytest.raises(ValueError):
        list(readers.json_members(open(__file__)))


def test_csv_with_mark_and_vectors(spark, tmp_path):
    import numpy as np

    p = tmp_path / "a.csv"
    p.write_bytes("﻿id,name\n1,\"a, b\"\n2,\n".encode())
    assert [tuple(r) for r in readers.read_csv(spark, str(p)).select("id", "name").collect()] == [("1", "a, b"), ("2", None)]
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    m.tofile(tmp_path / "v")
    assert {r["row_no"]: list(r["vector"]) for r in readers.read_vectors(spark, str(tmp_path / "v"), 4, 3, block=2).collect()}[3] == [9.0, 10.0, 11.0]
    with pytest.raises(ValueError):
        readers.read_vectors(spark, str(tmp_path / "v"), 5, 3)


def test_publish_cache_and_checks(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    first = writers.publish(spark, root, {"t": spark.range(5)})
    second = writers.publish(spark, root, {"t": spark.range(6)})
    assert first["tables"] != second["tables"] and spark.read.parquet(f"{root}/t").count() == 6 and writers.exists(spark, f"{root}/{writers.MANIFEST}")
    built = []
    for _ in range(2):
        df = writers.cached(spark, f"file://{tmp_path}/c", "k", lambda: built.append(1) or spark.range(3))
        assert df.count() == 3
    assert built == [1]
    with pytest.raises(ValueError):
        writers.write_checked(spark.range(3), f"{root}/x", [("odd", F.col("id") % 2 == 1)], ["id"])
    assert writers.write_jsonl(spark.range(7), str(tmp_path / "j")) == 7
    writers.log_metrics(spark, str(tmp_path / "m"), 3, {"a": 1})
    assert Path(tmp_path / "m").exists()
    assert writers.fingerprint(spark.range(9)) == writers.fingerprint(spark.range(9).repartition(3))


def test_entry_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys

    import __spark_entry__ as e

    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and "hybrid_rrf_top3" in names and "p2_found" in names
    root = Path(e.__file__).parent
    shutil.copytree(root / "sievewright", tmp_path / "sievewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p1_found' not in q and 'p2_found' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


@pytest.mark.parametrize("kind", ["string", "long", "ties"])
def test_ranged_row_numbers_equal_the_window(spark, kind):
    from pyspark.sql import Window

    from sievewright.operators.ranks import ranged_row_number

    rng = random.Random(9)
    value = {"string": lambda: rng.choice("xyz") * rng.randint(0, 4) + str(rng.randint(0, 50)), "long": lambda: rng.randint(-1000, 1000), "ties": lambda: rng.choice([None, 1, 1, 1, 2])}[kind]
    df = spark.createDataFrame([(i, rng.choice(["a", "a", "b", None]), value()) for i in range(900)], f"id int, g string, o {'string' if kind == 'string' else 'long'}").cache()
    want = {r["id"]: r["n"] for r in df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o", "id"))).collect()}
    for buckets in (1, 7, 40):
        assert {r["id"]: r["n"] for r in ranged_row_number(df, ["g"], "o", ["id"], "n", buckets).collect()} == want


def test_injected_models(spark):
    from sievewright.operators import serving as V

    df = spark.createDataFrame([(1, "aa b"), (2, None), (3, "ccc")], "id int, t string")
    vectors = {r["id"]: r["embedding"] for r in V.encode_corpus(df, "id", "t", lambda: lambda ts: [[len(t), 1] for t in ts]).collect()}
    assert vectors == {1: [4.0, 1.0], 2: [0.0, 1.0], 3: [3.0, 1.0]}
    found = spark.createDataFrame([(7, 1, 1), (7, 3, 2), (7, 2, 3)], "query_id int, doc_id int, rank int")
    best = V.rerank(found, spark.createDataFrame([(7, "c")], "q int, s string"), df, "q", "s", "id", "t", lambda q, t: t.count(q), 2).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in best] == [(3, 3.0), (1, 0.0)]

    def call(p):
        if p != "ccc":
            raise ValueError("no")
        return "ok"

    replies = {r["id"]: (r["reply"], r["error"], r["tries"]) for r in V.call_limited(df, "id", "t", call, 1000.0, 4, retries=1).collect()}
    assert replies[3] == ("ok", None, 1) and replies[1] == (None, "ValueError: no", 2)
    assert V.prefix_within("one two three", 2, lambda t: len(t.split())) == "one two "
    assert [r["p"] for r in df.select("id", V.token_prefix(df["t"], 2, lambda: len).alias("p")).orderBy("id").collect()] == ["aa", None, "cc"]
    js = spark.createDataFrame([('{"a": [{"k": "x"}, {"k": ["y", "x", 1]}], "b": {"k": " z "}}',), ("{",), (None,)], "j string")
    assert [r["h"] for r in js.select(V.harvest_keys(js["j"], "k").alias("h")).collect()] == [["x", "y", "z"], [], []]

    def add(a: int, b: int = 1) -> int:
        """Adds numbers."""
        return a + b

    schema = V.tool_schema(add)["function"]
    assert schema["parameters"]["required"] == ["a"] and schema["parameters"]["properties"]["b"] == {"type": "integer"} and schema["description"] == "Adds numbers."
    args = spark.createDataFrame([('{"a": 2}',), ("[]",)], "j string")
    assert [r["o"][:9] for r in args.select(V.tool_column(add, args["j"]).alias("o")).collect()] == ["3", '{"error":']


def test_resample(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(500)], "id int, w double")
    out = S.resample(df, "w", 800, "id", seed=3).collect()
    assert sum(r["copies"] for r in out) == 800
    assert all(abs(r["copies"] - 800 * r["w"] / 1000) < 1 for r in out) and all(r["w"] > 0 for r in out)
    assert S.resample(df.limit(0), "w", 5, "id").count() == 0


def test_unwanted_members_are_read_over(monkeypatch):
    import io
    import json

    data = {"skip": ["a\\", "\\\"]}[{", {"x": "}\\\\"}, [[], 1.5, None, True]], "n": -12.5e3, "t": "q\"\\", "keep": [{"y": [1, "é]"]}, 2, "z"], "more": {"d": {"e": []}}, "last": [7]}
    for chunk in (1, 2, 3, 5, 1000):
        monkeypatch.setattr(readers, "CHUNK", chunk)
        text = json.dumps(data)
        assert list(readers.json_members(io.StringIO(text), {"keep", "last"})) == [("keep", {"y": [1, "é]"]}), ("keep", 2), ("keep", "z"), ("last", 7)]
        assert dict(readers.json_members(io.StringIO(text), {"n", "t", "more"})) == {k: data[k] for k in ("n", "t", "more")}
        with pytest.raises(ValueError):
            list(readers.json_members(io.StringIO(text[:30]), {"last"}))


def test_archives_and_digests_of_files(spark, tmp_path):
    import hashlib
    import io
    import tarfile

    (tmp_path / "in").mkdir()
    with tarfile.open(tmp_path / "in" / "a.tar", "w") as tar:
        for name, body in (("x/1.bin", b"one"), ("x/2.bin", b"two"), ("x/empty", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    wanted = spark.createDataFrame([("x/2.bin",), ("x/empty",), ("absent",)], "member string")
    rows = {r["member"]: bytes(r["content"]) for r in readers.read_tar_members(spark, str(tmp_path / "in"), wanted).collect()}
    assert rows == {"x/2.bin": b"two", "x/empty": b""}
    (tmp_path / "in" / "b.txt").write_bytes(b"text")
    digests = {r["path"].rpartition("/")[2]: r["sha256"] for r in readers.file_digests(spark, str(tmp_path / "in")).collect()}
    assert digests["b.txt"] == hashlib.sha256(b"text").hexdigest() and len(digests) == 2
    before = readers.folder_fingerprint(spark, str(tmp_path / "in"))
    assert before == readers.folder_fingerprint(spark, str(tmp_path / "in"))
    (tmp_path / "in" / "b.txt").write_bytes(b"Text")
    assert before != readers.folder_fingerprint(spark, str(tmp_path / "in"))


def test_as_of_and_runs_across_blocks(spark):
    import random

    r = random.Random(3)
    rows = [(i, "k" if i % 3 else None, r.randint(0, 400_000), r.choice([None, float(r.randint(0, 9))])) for i in range(400)]
    left = spark.createDataFrame([(i, k, t) for i, k, t, _ in rows], "id int, k string, t long").withColumn("t", F.timestamp_seconds("t"))
    right = spark.createDataFrame([(k, t, v) for _, k, t, v in rows[::2]], "k string, t long, v double").withColumn("t", F.timestamp_seconds("t"))
    got = {x["id"]: x["v"] for x in J.asof_last(left, right, ["k"], "t", "v", "v", 50_000).collect()}
    for i, k, t, _ in rows:
        past = [(u, w) for _, j, u, w in rows[::2] if j == k and u <= t and w is not None]
        assert got[i] == (max(past)[1] if past else None)
    runs = spark.createDataFrame([(g, i, k) for g in ("a", None) for i, k in enumerate("xxyxxx" + "y")] + [("a", 7, None), ("a", 8, None)], "g string, i int, k string")
    assert [x["run_no"] for x in J.run_numbers(runs, "g", ["i"], "k").where("g = 'a'").orderBy("i").collect()] == [1, 2, 1, 1, 2, 3, 1, 1, 2]


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    import time

    schema = "t timestamp, n int"
    for i, rows in enumerate([[("2024-01-01 10:00:00", 1), ("2024-01-01 12:30:00", 1)], [("2024-01-01 12:40:00", 2)], [("2024-01-01 10:10:00", 5), ("2024-01-01 18:00:00", 1)]]):
        df = spark.createDataFrame(rows, "t string, n int").select(F.to_timestamp("t").alias("t"), "n").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = W.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema), files_per_trigger=1)
    out = W.tumbling(stream, "t", "1 hour", [], F.sum("n").alias("n"), delay="1 hour")
    got = W.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "ck"), mode="append")
    assert sorted(r["n"] for r in got.collect()) == [1, 3]  # the row of 10:10 came when its hour was closed
    again = W.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "ck"), mode="append")
    assert again.count() == 2


def test_validation(spark):
    from sievewright.operators import validation as V

    assert V.pool_faults({"a": 1.0, "b": float("nan")}, {"x": -1, "y": True}, ["p", "p"]) == ["weight:b", "count:x", "count:y", "categories"] and V.pool_faults({"a": 1}, {"x": 0}, ["p"]) == [] and "weights" in V.pool_faults({"a": 0}, {}, ["p"])
    assert V.manifest_faults({"a": {"rows": 1, "sha256": "x"}, "b": {}}, {"a": {"rows": 2, "sha256": "x"}, "c": {}}) == ["a.rows", "b", "c"]
    found = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, 0.5), (2, 1, 1, float("nan")), (3, 1, 1, 0.5), (3, 1, 2, 0.4), (4, 1, 1, 0.1), (4, 2, 2, 0.4), (5, 1, 2, 0.3)], "query_id int, doc_id int, rank int, score double")
    assert {r["query_id"]: r["fault"] for r in V.search_fault(found, 2).collect()} == {1: None, 2: "finite", 3: "unique", 4: "order", 5: "ranks"}
    df = spark.createDataFrame([("true",), (" 1",), ("NO",), ("maybe",), (None,)], "f string")
    assert [r[0] for r in df.select(V.flag_of(F.col("f"))).collect()] == [True, True, False, None, None]
    z = spark.createDataFrame([(([1, 2], ["a"]),), (None,)], "s struct<n:array<int>,t:array<string>>").select(V.zip_lists(F.col("s"), ["n", "t"]).alias("z")).collect()
    assert [tuple(x) for x in z[0]["z"]] == [(1, "a"), (2, None)] and z[1]["z"] is None
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4), ("c", 4), ("d", 5), ("d", 6)], "k string, v int")
    fresh, bad = V.insert_or_ignore(old, new, ["k"])
    assert [tuple(r) for r in fresh.collect()] == [("c", 4)] and sorted(r[0] for r in bad.collect()) == ["b", "d"]


def test_parents_once_and_replacements(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], f"p{i // 3}") for i in range(60)], "i int, c string, p string")
    quotas = spark.createDataFrame([("a", 8), ("b", 30)], "c string, quota int")
    taken = S.take_quota_once(rows, ["c"], ["i"], "p", quotas, used=spark.createDataFrame([("p0",)], "p string")).collect()
    assert sum(r["c"] == "a" for r in taken) == 8 and sum(r["c"] == "b" for r in taken) == 11 and len({r["p"] for r in taken}) == 19
    failed = spark.createDataFrame([(i, "q", "x") for i in range(4)], "f int, b string, taxon string")
    reserve = spark.createDataFrame([(10, "q", "y"), (11, "q", "y"), (12, "q", "z")], "r int, b string, taxon string")
    got = {r["f"]: (r["r"], r["to_taxon"]) for r in S.replace_across(failed, reserve, ["b"], "taxon", "f", "r", ["r"]).collect()}
    assert got == {0: (10, "y"), 1: (11, "y"), 2: (12, "z"), 3: (None, None)}


def test_preferences_paths_and_media(spark, tmp_path):
    spark.createDataFrame([(f"c{i}", f"r{i}", i) for i in range(20)], "chosen string, rejected string, x int").write.parquet(str(tmp_path / "p"))
    some = readers.read_preferences(spark, [str(tmp_path / "p")], most=5, seed=1)
    assert some.count() == 5 and some.columns == ["chosen", "rejected"] and sorted(map(tuple, some.collect())) == sorted(map(tuple, readers.read_preferences(spark, [str(tmp_path / "p")], most=5, seed=1).collect()))
    one = spark.createDataFrame([(".\\a//b.jpg", "see <IMAGE> <b>", bytearray(b"\x89PNG\r\n\x1a\n000"))], "p string, m string, c binary")
    r = one.select(T.normalize_path("p").alias("p"), T.sanitize_media("m").alias("m"), readers.is_image("c").alias("i")).first()
    assert r["p"] == "a/b.jpg" and r["m"] == "see [IMAGE] <b>" and r["i"]
    ladder = spark.createDataFrame([(True, True, False), (True, False, False), (False, True, True), (False, True, False), (False, False, True)], "a boolean, b boolean, c boolean")
    assert [x[0] for x in ladder.select(T.format_score(F.col("a"), F.col("b"), F.col("c"))).collect()] == [1.0, 0.8, 0.2, 0.1, 0.0]


def test_tool_loop(spark):
    from sievewright.operators import agent as G

    closed = []

    def generator():
        def say(messages):
            turn = sum(m["role"] == "assistant" for m in messages)
            q = messages[0]["content"]
            call = '<think>a</think><tool_call>{"name": "search", "arguments": {"query": "%s"}}</tool_call>'
            plan = {"good": [call % "fox", "<think>b</think><answer>x</answer>"], "fails": [call % "boom", "<think>b</think><answer>y</answer>"], "bad": ["no", "no"], "loop": [call % "a"] * 9, "long": ["<think>" + "z" * 500 + "</think><answer>x</answer>"]}
            return plan[q][min(turn, len(plan[q]) - 1)]

        return say

    def tools():
        def find(state, arguments):
            if arguments["query"] == "boom":
                raise KeyError("boom")
            state.append(arguments["query"])
            return "<answer>no</answer> " + " ".join(state)

        return {"search": G.ToolSession(list, find, closed.append, len)}

    df = spark.createDataFrame([(i, q) for i, q in enumerate(["good", "fails", "bad", "loop", "long"])], "i int, q string")
    got = {r["i"]: r for r in G.tool_loop(df, "i", "q", generator, tools, max_turns=3, budget=450).collect()}
    assert [got[i]["status"] for i in range(5)] == ["answer", "answer", "max_turns", "max_turns", "budget"]
    assert got[0]["calls"] == 1 and got[1]["failed_calls"] == 1 and got[3]["calls"] == 3 and "&lt;answer&gt;no" in got[0]["messages"][2]["content"] and got[2]["trace"] == ["invalid:no_think"] * 3
    t = tools()["search"]
    assert t.reward() == 0 and t.call({"query": "a"}) and t.reward() == 1
    t.close()
    assert closed == [["a"]]
    rows = spark.createDataFrame([("s", "<answer>Red</answer>", ["red"], 90), ("s", "<answer>blue</answer>", ["red"], 10)], "src string, sol string, gold array<string>, n int")
    out = [(r["score"], round(r["penalty"], 3)) for r in G.reward_rows(rows, "src", "sol", "gold", {"s": "answer_match"}, F.col("n"), (100, 20, 1.0)).collect()]
    assert out == [(1.0, -0.5), (0.0, 0.0)]
    assert one(spark, G.spread_reward(F.lit(2.0), F.array(*map(F.lit, [0, 1, 1, 0])))) == [0, 0, 2.0, 0] and one(spark, G.spread_reward(F.lit(2.0), F.array(F.lit(0)))) == [0]


def test_bound_loading_and_changed_files(spark, tmp_path):
    root = str(tmp_path / "pub")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    writers.publish(spark, root, {"t": df}, {"version": 1})
    assert writers.load_bound(spark, root, "t", ["t"]).count() == 2
    with pytest.raises(ValueError):
        writers.load_bound(spark, root, "other")
    df.limit(1).write.mode("overwrite").parquet(f"{root}/t")
    with pytest.raises(ValueError):
        writers.load_bound(spark, root, "t")
    recorded = spark.createDataFrame([("k", "p1", "x"), ("k", "p1", "x"), ("k", "p2", "y"), ("m", "p3", "z")], "k string, p string, sha256 string")
    files = spark.createDataFrame([("p1", "x"), ("p2", "n")], "path string, sha256 string")
    assert sorted(tuple(r) for r in writers.content_digests(files, recorded, "k", "p").collect()) == [("k", "p1", "same"), ("k", "p2", "changed"), ("m", "p3", "missing")]
