"""Queries that write with the writers and read back with the readers: exact round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievewright.functions import protocol as P
from sievewright.session import ensure_checkpoint_dir, table
from sievewright.sources import readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _place(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def io_csv(spark, sf):
    path = _place(spark)
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    return readers.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def io_jsonl(spark, sf):
    path = _place(spark)
    writers.write_jsonl(table(spark, sf, "documents").where("text is not null and trim(text) <> ''").select("doc_id", "text"), path)
    return readers.read_jsonl(spark, path, "doc_id bigint, text string")


@query("SELECT doc_id, contents FROM (SELECT doc_id, '\"' || coalesce(source, '') || '\"' || chr(10) || text AS contents FROM documents WHERE text IS NOT NULL)")
def io_corpus(spark, sf):
    path = _place(spark)
    contents = F.concat(F.lit('"'), F.coalesce("source", F.lit("")), F.lit('"\n'), F.col("text"))
    writers.write_jsonl(table(spark, sf, "documents").where("text is not null").select("doc_id", contents.alias("contents")), path)
    return readers.read_corpus(spark, path, "doc_id bigint, contents string")


@query("SELECT doc_id, n_chars FROM documents UNION ALL SELECT record_id, length(payload) FROM raw_records")
def io_mixed_formats(spark, sf):
    path = _place(spark)
    table(spark, sf, "documents").select("doc_id", "n_chars").write.parquet(f"{path}/a.parquet")
    table(spark, sf, "raw_records").select(F.col("record_id").alias("doc_id"), F.char_length("payload").cast("bigint").alias("n_chars")).write.json(f"{path}/b.json")
    return readers.read_any(spark, [f"{path}/a.parquet", f"{path}/b.json"], "doc_id bigint, n_chars bigint")


@query("SELECT category_key, name FROM categories")
def io_publish(spark, sf):
    path = _place(spark)
    writers.publish(spark, path, {"categories": table(spark, sf, "categories").select("category_key", "name")}, {"version": 3})
    return spark.read.parquet(f"{path}/categories")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def io_by_step(spark, sf):
    path = _place(spark)
    writers.dump_by_step(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return spark.read.schema("o_orderkey bigint, o_orderstatus string").json(path)


@query("SELECT sample_id, built_at, coalesce(len(messages), 0) > 0 AND messages[1].role = 'user' AS starts FROM sft_rows")
def io_starts_with_user(spark, sf):
    first = F.get("messages", F.lit(0))["role"]
    rows = table(spark, sf, "sft_rows")
    return rows.select("sample_id", "built_at", (F.coalesce(F.size("messages") > 0, F.lit(False)) & (first == "user")).alias("starts"))


_TAGS = r"</?(?:search|vision_search|information|vision_information)(?:\s[^>]*)?>"
_ALL_TAGS = r"(?:</?(?:think|tool_call|tool_response|answer|search|vision_search|information|vision_information)(?:\s[^>]*)?>|<\|im_(?:start|end)\|>)"


@query(rf"""WITH m AS (SELECT sample_id, built_at, unnest(messages) AS m, generate_subscripts(messages, 1) - 1 AS turn FROM sft_rows), c AS (SELECT sample_id, built_at, turn, coalesce(m.content, '') AS c FROM m WHERE m.role = 'assistant'),
    n AS (SELECT *, len(string_split(c, '<tool_call>')) - 1 AS co, len(string_split(c, '</tool_call>')) - 1 AS cc, len(string_split(c, '<answer>')) - 1 AS ao, len(string_split(c, '</answer>')) - 1 AS ac,
        regexp_replace(regexp_replace(c, '(?s)\A\s*<think>.*?</think>', ''), '(?s)\A\s+|\s+\z', '', 'g') AS act FROM c)
    SELECT sample_id, built_at, turn, CASE WHEN regexp_matches(c, '(?i){_TAGS}') THEN 'legacy_tag' WHEN co <> cc THEN 'mismatched_tool_call' WHEN ao <> ac THEN 'mismatched_answer' WHEN co > 0 AND ao > 0 THEN 'call_and_answer' WHEN co > 1 OR ao > 1 THEN 'repeated'
        WHEN NOT regexp_matches(regexp_extract(c, '(?s)\A\s*<think>(.*?)</think>', 1), '\S') THEN 'no_think' WHEN co > 0 AND NOT regexp_matches(act, '(?s)\A<tool_call>.*</tool_call>\z') THEN 'around_tool_call' WHEN co > 0 THEN 'tool_call'
        WHEN ao > 0 AND NOT regexp_matches(act, '(?s)\A<answer>.*</answer>\z') THEN 'around_answer' WHEN ao > 0 AND NOT regexp_matches(regexp_extract(act, '(?s)<answer>(.*?)</answer>', 1), '\S') THEN 'blank_answer'
        WHEN ao > 0 AND regexp_matches(regexp_extract(act, '(?s)<answer>(.*?)</answer>', 1), '(?i){_ALL_TAGS}') THEN 'control_tag' WHEN ao > 0 THEN 'answer' ELSE 'no_action' END AS state FROM n""")
def protocol_turns(spark, sf):
    """Every assistant turn through the protocol's grammar, as one expression."""
    turns = table(spark, sf, "sft_rows").select("sample_id", "built_at", F.posexplode("messages").alias("turn", "m")).where("m.role = 'assistant'")
    return turns.select("sample_id", "built_at", F.col("turn").cast("bigint").alias("turn"), P.turn_state(F.coalesce("m.content", F.lit(""))).alias("state"))


@query(None)
def protocol_turns_parsed(spark, sf):
    """The same through the full parser, payloads of calls included; a call's arguments need a JSON reader that sees repeated keys."""
    turns = table(spark, sf, "sft_rows").select("sample_id", F.posexplode("messages").alias("turn", "m")).where("m.role = 'assistant'")
    return turns.select("sample_id", "turn", P.turn_check(F.coalesce("m.content", F.lit(""))).alias("kind"))


@query(r"""WITH r AS (SELECT source_row_index, evidence_ok, CASE source_row_index % 4 WHEN 0 THEN '{"score": ' || coalesce(evidence_ok, 2) || '}' WHEN 1 THEN ' {"score":' || coalesce(evidence_ok, 0) || '.0} ' WHEN 2 THEN '{"score": 1, "why": "x"}' ELSE payload_json END AS raw FROM qa_candidates),
    j AS (SELECT source_row_index, CASE WHEN source_row_index % 4 = 0 AND evidence_ok IS NOT NULL THEN evidence_ok WHEN source_row_index % 4 = 1 THEN coalesce(evidence_ok, 0) END AS judged, source_row_index % 6 AS calls, evidence_ok FROM r)
    SELECT source_row_index, judged::DOUBLE AS judged, round(0.8 * judged + 0.2 * CASE WHEN coalesce(evidence_ok, 0) = 1 THEN 1 ELSE 0 END - 0.02 * power(greatest(0, calls - 2), 2), 6) AS reward FROM j""")
def judge_rewards(spark, sf):
    """Judge's replies read strictly, and the reward they give together with format and calls."""
    i, ok = F.col("source_row_index"), F.col("evidence_ok")
    q = table(spark, sf, "qa_candidates")
    raw = F.when(i % 4 == 0, F.concat(F.lit('{"score": '), F.coalesce(ok, F.lit(2)), F.lit("}"))).when(i % 4 == 1, F.concat(F.lit(' {"score":'), F.coalesce(ok, F.lit(0)), F.lit(".0} ")))
    raw = raw.when(i % 4 == 2, '{"score": 1, "why": "x"}').otherwise(F.col("payload_json"))
    q = q.select(i, P.judge_score(raw).alias("judged"), F.coalesce(ok == 1, F.lit(False)).alias("formed"), (i % 6).alias("calls"))
    return q.select("source_row_index", "judged", F.round(P.total_reward(F.col("judged"), F.col("formed"), F.col("calls")), 6).alias("reward"))


@query(r"""SELECT item_id, 'Q: ' || coalesce(question, '') || ' | A: ' || coalesce(answer, '') || ' | C: ' || coalesce(left(passage, 40), '') AS prompt, 2 AS turns FROM eval_items""")
def judge_prompts(spark, sf):
    messages = P.judge_prompt(F.col("question"), F.col("answer"), F.substring("passage", 1, 40), "Judge.", "Q: {question} | A: {reference} | C: {candidate}")
    return table(spark, sf, "eval_items").select("item_id", messages.alias("m")).select("item_id", F.col("m")[1]["content"].alias("prompt"), F.size("m").alias("turns"))


@query(None)
def protocol_scores(spark, sf):
    """Every sample's assistant turns scored against all its gold answers, by the scorer of its data source: its last <answer>, or
    its tool calls where the source's truths are calls. NULL without a gold answer."""
    turns = F.filter("messages", lambda m: m["role"] == "assistant")
    said = F.transform(turns, lambda m: F.coalesce(m["content"], F.lit("")))
    name = lambda c: F.regexp_replace(F.to_json(F.struct(c["function"]["name"].alias("name"))), r"\}$", "")
    call = lambda c: F.concat(F.lit("<tool_call>"), name(c), F.lit(',"arguments":'), F.coalesce(c["function"]["arguments"], F.lit("{}")), F.lit("}</tool_call>"))
    calls = F.transform(F.flatten(F.filter(F.transform(turns, lambda m: m["tool_calls"]), lambda x: x.isNotNull())), call)
    solution = F.when(F.col("data_source") == "tool_calls", F.concat_ws("\n", said, calls)).otherwise(F.concat_ws("\n", said))
    score = P.score_by_source(F.col("data_source"), solution, F.col("extra_info.answers"), {"tool_calls": "tool_match"}, default="answer_match")
    return table(spark, sf, "sft_rows").select("sample_id", "built_at", score.alias("score"))
