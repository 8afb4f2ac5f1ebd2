"""Calls to models and services the user brings: encoders, rerankers, scorers, tools; in Arrow batches, with limits and retries.

The callables are injected; nothing here talks to a network by itself.
"""

from __future__ import annotations

import inspect
import json
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any, get_type_hints

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def encode_corpus(df: DataFrame, key: str, text: str, encoder: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], batch: int = 256) -> DataFrame:
    """(key, embedding): `encoder()` is built once per task and called on batches; NULL texts are encoded as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"key": part["key"], "embedding": [list(map(float, v)) for v in encode(part["text"].fillna("").tolist())]})

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, embedding array<float>").withColumnRenamed("key", key)


def rerank(found: DataFrame, queries: DataFrame, docs: DataFrame, query_id: str, query: str, doc_id: str, text: str, scorer: Callable[[str, str], float], k: int) -> DataFrame:
    """The k best of each query's hits under a pairwise scorer; ties go to the earlier rank."""

    @F.pandas_udf("double")
    def score(qs: pd.Series, ts: pd.Series) -> pd.Series:
        return pd.Series([float(scorer(q or "", t or "")) for q, t in zip(qs, ts, strict=True)], dtype="float64")

    pairs = found.select("query_id", "doc_id", F.col("rank").alias("first_rank"))
    pairs = pairs.join(queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("__q")), "query_id").join(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t")), "doc_id")
    scored = pairs.withColumn("score", score("__q", "__t")).drop("__q", "__t")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_rank")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def call_limited(df: DataFrame, key: str, payload: str, call: Callable[[str], str], per_second: float, slots: int, retries: int = 2) -> DataFrame:
    """(key, reply, error, tries) of a call per row under a rate for the whole job.

    The rate is divided by the tasks that may run at once; a failed call is tried again with growing pauses, and a row that
    fails for good has its error and no reply.
    """
    pause = slots / per_second

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = time.monotonic()
        for frame in frames:
            out = []
            for k, p in zip(frame["key"], frame["payload"], strict=True):
                reply, error, tries = None, None, 0
                for tries in range(1, retries + 2):
                    time.sleep(max(0.0, ready - time.monotonic()))
                    ready = max(ready, time.monotonic()) + pause
                    try:
                        reply, error = call(p), None
                        break
                    except Exception as e:  # the caller's errors are data here
                        error = f"{type(e).__name__}: {e}"
                        ready += pause * tries
                out.append((k, reply, error, tries))
            yield pd.DataFrame(out, columns=["key", "reply", "error", "tries"])

    rows = df.select(F.col(key).alias("key"), F.col(payload).cast("string").alias("payload"))
    return rows.mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, reply string, error string, tries int").withColumnRenamed("key", key)


def prefix_within(text: str, budget: int, count: Callable[[str], int]) -> str:
    """The longest prefix of at most `budget` tokens, by binary search over its characters."""
    low, high = 0, len(text)
    if count(text) <= budget:
        return text
    while low < high:
        middle = (low + high + 1) // 2
        if count(text[:middle]) <= budget:
            low = middle
        else:
            high = middle - 1
    return text[:low]


def token_prefix(c: Column, budget: int, counter: Callable[[], Callable[[str], int]]) -> Column:
    """prefix_within as a column; `counter()` is built once per task."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else prefix_within(t, budget, count))

    return run(c)


def harvest(value: Any, names: frozenset[str]) -> list[str]:
    """Texts found under the given names anywhere in a JSON value, in order, once each."""
    found: dict[str, None] = {}
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                if k in names:
                    for t in x if isinstance(x, list) else [x]:
                        if isinstance(t, str) and t.strip():
                            found.setdefault(t.strip())
            stack += list(v.values())[::-1]
        elif isinstance(v, list):
            stack += v[::-1]
    return list(found)


def harvest_keys(c: Column, *names: str) -> Column:
    """harvest over a JSON text column; texts that are no JSON give an empty list."""
    wanted = frozenset(names)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            try:
                return harvest(json.loads(t), wanted) if t else []
            except (ValueError, RecursionError):
                return []

        return texts.map(one)

    return run(c)


#: Names of Python types in a tool's schema.
JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


def tool_schema(f: Callable[..., Any]) -> dict[str, Any]:
    """The call schema of a Python function: its name, first line of help, typed parameters and which are required."""
    hints = get_type_hints(f)
    parameters = inspect.signature(f).parameters
    properties = {n: {"type": JSON_TYPES.get(hints.get(n, str), "string")} for n in parameters}
    required = [n for n, p in parameters.items() if p.default is inspect.Parameter.empty]
    doc = (inspect.getdoc(f) or "").split("\n")[0]
    return {"type": "function", "function": {"name": f.__name__, "description": doc, "parameters": {"type": "object", "properties": properties, "required": required}}}


def tool_column(f: Callable[..., Any], arguments: Column) -> Column:
    """A Python function as a tool: JSON arguments in, its result as JSON out, errors as {"error": ...}."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                return json.dumps(f(**json.loads(t)), ensure_ascii=False)
            except Exception as e:  # a failing call is an answer of the tool
                return json.dumps({"error": f"{type(e).__name__}: {e}"}, ensure_ascii=False)

        return texts.map(one)

    return run(arguments)
