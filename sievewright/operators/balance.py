"""Sequence-length balancing: partitions of a batch with even loads.

A batch is what one training step takes, so it fits a task; batches run in parallel as groups.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def workload(length: int) -> int:
    """Cost of a sequence: linear in its tokens, with a quadratic part."""
    return 24576 * length + length * length


def greedy_partition(loads: Sequence[float], parts: int) -> list[list[int]]:
    """Items from the largest down, each to the lightest part."""
    heap = [(0.0, p) for p in range(parts)]
    out: list[list[int]] = [[] for _ in range(parts)]
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        total, p = heapq.heappop(heap)
        out[p].append(i)
        heapq.heappush(heap, (total + loads[i], p))
    return [sorted(p) for p in out]


def differencing_partition(loads: Sequence[float], parts: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing: the two states with the widest spreads are merged, heavy parts onto light ones."""
    if equal_size and len(loads) % parts:
        raise ValueError(f"{len(loads)} items can't be cut into {parts} parts of equal size")
    order = sorted(range(len(loads)), key=lambda i: (loads[i], i))
    states: list[tuple[float, int, list[tuple[float, list[int]]]]] = []
    starts = [order[i : i + parts] for i in range(0, len(order), parts)] if equal_size else [[i] for i in order]
    for number, items in enumerate(starts):
        sums = sorted(((float(loads[i]), [i]) for i in items), reverse=True) + [(0.0, []) for _ in range(parts - len(items))]
        states.append((-(sums[0][0] - sums[-1][0]), number, sums))
    heapq.heapify(states)
    number = len(states)
    while len(states) > 1:
        _, _, a = heapq.heappop(states)
        _, _, b = heapq.heappop(states)
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda s: (-s[0], s[1]))
        heapq.heappush(states, (-(merged[0][0] - merged[-1][0]), number, merged))
        number += 1
    if not states:
        return [[] for _ in range(parts)]
    return [sorted(items) for _, items in sorted(states[0][2], key=lambda s: s[1])]


def micro_batches(lengths: Sequence[int], budget: int, least: int = 1) -> list[list[int]]:
    """As few balanced groups as hold the token budget on average, the small ones at both ends."""
    parts = max(least, math.ceil(sum(lengths) / budget)) if lengths else 0
    if not parts:
        return []
    groups = [g for g in differencing_partition([workload(n) for n in lengths], min(parts, len(lengths))) if g]
    groups.sort(key=lambda g: (sum(workload(lengths[i]) for i in g), g[0]), reverse=True)
    return groups[::2][::-1] + groups[1::2]


def zigzag(items: Sequence[int]) -> list[int]:
    """Every other item forward, the rest back: neighbours in load end far apart."""
    return [*items[::2], *items[1::2][::-1]]


def balance(df: DataFrame, batch: str, item: str, length: str, parts: int, method: str = "differencing", together: str | None = None) -> DataFrame:
    """(batch, item, part, place): parts of even workload in each batch. Items of one `together` value share a part."""
    cut = {"differencing": differencing_partition, "greedy": greedy_partition}[method]

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item", kind="stable").reset_index(drop=True)
        loads = frame["length"].map(lambda n: workload(int(n)))
        keys = frame["together"].fillna("").astype(str)
        units = list(dict.fromkeys(keys))
        sums = loads.groupby(keys).sum()
        out, rows_of = [], keys.groupby(keys).indices
        for p, own in enumerate(cut([float(sums[u]) for u in units], parts)):
            rows = [int(i) for u in own for i in rows_of[units[u]]]
            rows.sort(key=lambda i: (loads[i], i))
            out += [(frame["batch"][i], frame["item"][i], p, place) for place, i in enumerate(zigzag(rows))]
        return pd.DataFrame(out, columns=["batch", "item", "part", "place"])

    rows = df.select(F.col(batch).alias("batch"), F.col(item).alias("item"), F.coalesce(F.col(length), F.lit(0)).cast("bigint").alias("length"), F.col(together or item).cast("string").alias("together"))
    kinds = dict(rows.dtypes)
    done = rows.groupBy("batch").applyInPandas(assign, f"batch {kinds['batch']}, item {kinds['item']}, part int, place int")
    return done.withColumnRenamed("batch", batch).withColumnRenamed("item", item)
