"""Folds and maps over token arrays. All run in the JVM, row by row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guard of masked denominators.
EPSILON = 1e-8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once: inside a lambda an outer expression would be evaluated for every item."""
    return F.transform(F.array(value), body)[0]


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def masked(a: Column, mask: Column) -> Column:
    """Values where the mask is 1, zeros elsewhere."""
    return F.zip_with(a, mask, lambda x, m: F.when(m == 1, x.cast("double")).otherwise(0.0))


def masked_sum(a: Column, mask: Column) -> Column:
    return array_sum(masked(a, mask))


def masked_mean(a: Column, mask: Column) -> Column:
    """Mean over the mask; 0 where everything is masked."""
    return masked_sum(a, mask) / (array_sum(F.transform(mask, lambda m: m.cast("double"))) + EPSILON)


def suffix_fold(a: Column, decay: float | Column = 1.0) -> Column:
    """y[t] = a[t] + decay * y[t + 1]: discounted returns, one pass from the end."""
    zero = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        now = x.cast("double") + F.lit(decay) * acc["last"]
        return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(F.reverse(a), zero, step, lambda acc: F.reverse(acc["out"]))


def masked_returns(rewards: Column, mask: Column, decay: float) -> Column:
    """Discounted reverse returns that start again at every masked token."""
    zero = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        now = x["reward"].cast("double") + F.lit(decay) * acc["last"]
        return F.struct((now * x["mask"]).alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(F.reverse(F.arrays_zip(rewards.alias("reward"), mask.alias("mask"))), zero, step, lambda acc: F.reverse(acc["out"]))


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates; masked tokens neither bring a difference nor pass one on."""
    zero = F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        on = x["mask"] == 1
        last = F.when(on, x["reward"] + gamma * acc["value"] - x["value"] + gamma * lam * acc["last"]).otherwise(acc["last"])
        return F.struct(F.when(on, x["value"].cast("double")).otherwise(acc["value"]).alias("value"), last.alias("last"), F.concat(acc["out"], F.array(last)).alias("out"))

    zipped = F.arrays_zip(rewards.alias("reward"), values.alias("value"), mask.alias("mask"))
    return F.aggregate(F.reverse(zipped), zero, step, lambda acc: F.reverse(acc["out"]))


def eos_mask(tokens: Column, eos: Column) -> Column:
    """1 up to and with the first end token, 0 after it."""
    at = F.array_position(tokens, eos)
    return F.transform(tokens, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def position_ids(mask: Column) -> Column:
    """Running count of the mask, from 0; positions before the first token are 0."""
    return F.transform(mask, lambda _, i: F.greatest(F.lit(0), F.aggregate(F.slice(mask, F.lit(1), i + 1), F.lit(0), lambda s, m: s + m.cast("int")) - 1))


def pad(a: Column, length: int, value: Column, left: bool = False) -> Column:
    """The array filled to the length; longer arrays stay as they are."""
    fill = F.array_repeat(value, F.greatest(F.lit(0), F.lit(length) - F.size(a)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def truncate(a: Column, length: int, side: str = "left") -> Column:
    """At most `length` items: the last ones (left), the first ones (right), or both ends (middle)."""
    n = F.size(a)
    if side == "right":
        return F.slice(a, 1, length)
    if side == "left":
        return F.when(n <= length, a).otherwise(F.slice(a, n - length + 1, F.lit(length)))
    head, tail = length // 2, length - length // 2
    return F.when(n <= length, a).otherwise(F.concat(F.slice(a, 1, head), F.slice(a, n - tail + 1, F.lit(tail))))


def unpad(tokens: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["t"])


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, F.least(F.size(a), F.size(b))).otherwise(at - 1).cast("int")


def log_sum_exp(a: Column) -> Column:
    return let(F.array_max(a), lambda top: top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of logits."""
    return let(log_sum_exp(logits), lambda z: z - F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - z) * x))


def l2_normalize(a: Column) -> Column:
    """The vector divided by its norm; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(F.when(norm == 0, 1.0).otherwise(norm), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def kl_estimate(log_prob: Column, reference: Column, kind: str) -> Column:
    """Per-token estimators of the divergence: k1, abs, k2 (squared), k3 (low variance, clamped twice)."""
    if kind == "k1":
        return log_prob - reference
    if kind == "abs":
        return F.abs(log_prob - reference)
    if kind == "k2":
        return 0.5 * F.pow(log_prob - reference, F.lit(2))
    if kind == "k3":
        d = F.least(F.lit(20.0), F.greatest(F.lit(-20.0), reference - log_prob))
        return F.least(F.lit(10.0), F.greatest(F.lit(-10.0), F.exp(d) - d - 1))
    raise ValueError(f"unknown estimator {kind}")


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))
