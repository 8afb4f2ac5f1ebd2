"""Conversations with tools: a bounded loop of turns per row, with injected model and tools, and the rewards of what came out.

Rows run independently in Arrow batches; nothing here talks to a network by itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import protocol as P

#: Columns of a finished conversation.
LOOP_SCHEMA = "messages array<struct<role:string,content:string>>, status string, turns int, calls int, failed_calls int, tokens int, trace array<string>"


class ToolSession:
    """One conversation's use of a tool: opened at its first call, closed at the end, rewarded in between."""

    def __init__(self, create: Callable[[], Any], execute: Callable[[Any, dict], str], release: Callable[[Any], None] | None = None, reward: Callable[[Any], float] | None = None):
        self._create, self._execute, self._release, self._reward, self._state, self.open = create, execute, release, reward, None, False

    def call(self, arguments: dict) -> str:
        if not self.open:
            self._state, self.open = self._create(), True
        return self._execute(self._state, arguments)

    def reward(self) -> float:
        return self._reward(self._state) if self.open and self._reward else 0.0

    def close(self) -> None:
        if self.open and self._release:
            self._release(self._state)
        self.open = False


def escape(text: str) -> str:
    return P._CONTROL.sub(lambda m: m[0].replace("<", "&lt;").replace(">", "&gt;"), text)


def run_conversation(question: str, generate: Callable[[list[dict]], str], tools: Mapping[str, ToolSession], max_turns: int, budget: int, count: Callable[[str], int] = len, image_count: int | None = None) -> tuple:
    """(messages, status, turns, calls, failed_calls, tokens, trace) of one conversation.

    Each turn must be a valid action. A call's reply, escaped, is the next tool message; an invalid turn gets the reason as its
    reply and may be tried again. It ends with an answer, after `max_turns`, or where the next message would exceed the budget.
    """
    messages = [{"role": "user", "content": question}]
    used, calls, failed, trace = count(question), 0, 0, []
    status = "max_turns"
    turns = 0
    try:
        for turns in range(1, max_turns + 1):
            text = generate(messages)
            if used + count(text) > budget:
                status = "budget"
                break
            used += count(text)
            messages.append({"role": "assistant", "content": text})
            kind, detail = P.parse_turn(text, image_count)
            trace.append(f"{kind}:{detail}")
            if kind == "answer":
                status = "answer"
                break
            if kind == "tool_call":
                call = json.loads(P._CALL.search(text)[1])
                try:
                    reply = escape(tools[call["name"]].call(call["arguments"]))
                    calls += 1
                except Exception as e:  # a tool's failure is the model's to deal with
                    reply, failed = f"error: {type(e).__name__}", failed + 1
                    trace.append(f"error:{call['name']}:{type(e).__name__}")
            else:
                reply = f"invalid turn: {detail}"
            if used + count(reply) > budget:
                status = "budget"
                break
            used += count(reply)
            messages.append({"role": "tool", "content": reply})
    finally:
        for t in tools.values():
            t.close()
    return messages, status, turns, calls, failed, used, trace


def tool_loop(
    df: DataFrame, key: str, question: str, generator: Callable[[], Callable[[list[dict]], str]], tools: Callable[[], Mapping[str, ToolSession]], max_turns: int = 6, budget: int = 32_768,
    count: Callable[[str], int] = len,
) -> DataFrame:
    """key and the conversation of every row; `generator()` is built once a task, `tools()` once a conversation. NULL questions are empty ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = generator()
        names = ["key", "messages", "status", "turns", "calls", "failed_calls", "tokens", "trace"]
        for frame in frames:
            yield pd.DataFrame([(k, *run_conversation(q or "", generate, tools(), max_turns, budget, count)) for k, q in zip(frame["key"], frame["question"], strict=True)], columns=names)

    rows = df.select(F.col(key).alias("key"), F.col(question).cast("string").alias("question"))
    return rows.mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, {LOOP_SCHEMA}").withColumnRenamed("key", key)


def reward_rows(df: DataFrame, source: str, solution: str, truth: str, scorers: dict[str, str], length: Column, overlong: tuple[int, int, float] | None = None, default: str = "boxed") -> DataFrame:
    """Adds `score`, `penalty` and `reward`: the source's scorer, less a linear penalty of the last `buffer` tokens below the most allowed.

    `overlong` is (most tokens, buffer, factor). The reward stands on a sequence's last token; spread_reward makes it an array.
    """
    d = df.withColumn("score", P.score_by_source(F.col(source), F.col(solution), F.col(truth), scorers, default))
    penalty = F.lit(0.0)
    if overlong is not None:
        most, buffer, factor = overlong
        penalty = F.least(F.lit(0.0), -(length - (most - buffer)) / F.lit(float(buffer)) * factor)
    return d.withColumn("penalty", penalty).withColumn("reward", F.col("score") + F.col("penalty"))


def spread_reward(reward: Column, mask: Column) -> Column:
    """An array of zeros with the reward at the last unmasked token; all zeros where there is none."""
    last = F.array_max(F.transform(mask, lambda m, i: F.when(m == 1, i)))
    return F.transform(mask, lambda _, i: F.when(i == last, reward).otherwise(0.0))
