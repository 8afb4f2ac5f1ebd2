"""Closed forms per step: learning rates, penalties, controllers, cost of a model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.arrays import clamp
from sievewright.operators.ranks import bucket_count, range_buckets, running_sum


def cosine_rate(step: Column, warmup: int, total: int, floor: float = 0.0, cycles: float = 0.5) -> Column:
    """Share of the peak rate: linear warm-up, then a cosine down to the floor."""
    done = (step - warmup) / F.lit(float(max(1, total - warmup)))
    wave = floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * cycles * 2 * done))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.greatest(F.lit(0.0), wave))


def constant_rate(step: Column, warmup: int) -> Column:
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(1.0)


def wsd_rate(step: Column, warmup: int, stable: int, decay: int, floor: float = 0.0) -> Column:
    """Warm-up, a plateau, then a cosine to the floor, which stays."""
    at = (step - warmup - stable) / F.lit(float(max(1, decay)))
    down = floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * at))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).when(step < warmup + stable, 1.0).when(step < warmup + stable + decay, down).otherwise(floor)


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float = 1.0) -> Column:
    """Zero up to limit - buffer, then linear to -factor at the limit and beyond."""
    return F.least(F.lit(0.0), -(length - (limit - buffer)) / buffer * factor)


def dense_flops(tokens: Column, square: Column, parameters: int, layers: int, heads: int, head_dim: int) -> Column:
    """Training operations of a dense transformer: six per parameter and token, twelve per head and pair of tokens."""
    return 6 * tokens * F.lit(float(parameters)) + 12 * square * F.lit(float(layers * heads * head_dim))


def controller_path(df: DataFrame, step: str, kl: str, start: float, target: float, horizon: float, n: float) -> DataFrame:
    """(step, coefficient) after each step of a clipped multiplicative controller: a running product.

    Summed up in logarithms, by ranges of steps.
    """
    factor = 1 + clamp(F.col(kl) / target - 1, -0.2, 0.2) * n / horizon
    buckets = bucket_count(df.count())
    path = running_sum(df.select(step, kl), [], step, [], F.log(factor), "__log", buckets, "double", range_buckets(df, step, buckets))
    return path.select(step, kl, (F.lit(start) * F.exp("__log")).alias("coefficient"))
