"""Corrections between the policy that generated tokens and the one that is trained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.arrays import EPSILON, array_sum, clamp, masked_mean, masked_sum

#: Bound of log-ratios before they are exponentiated.
SAFE = 20.0


def parse_thresholds(text: str | float) -> tuple[float | None, float]:
    """`hi` or `lo_hi`."""
    parts = [float(x) for x in str(text).split("_")]
    if len(parts) == 1:
        return None, parts[0]
    if len(parts) != 2 or parts[0] > parts[1]:
        raise ValueError(f"not a threshold: {text}")
    return parts[0], parts[1]


def log_ratio(new: Column, rollout: Column) -> Column:
    return F.zip_with(new, rollout, lambda a, b: a - b)


def importance_weights(ratio: Column, mask: Column, level: str = "token", upper: float | None = 2.0, band: tuple[float, float] | None = None) -> Column:
    """Weights per token; clamped from above, or zero outside a band (bounds included). At sequence level all tokens share one."""
    if level == "token":
        raw = F.transform(ratio, lambda x: F.exp(clamp(x, -SAFE, SAFE)))
    elif level == "sequence":
        whole = F.exp(clamp(masked_sum(ratio, mask), -SAFE, SAFE))
        raw = F.array_repeat(whole, F.size(ratio))
    else:
        raise ValueError(f"unknown level {level}")
    if band is not None:
        raw = F.transform(raw, lambda w: F.when(w.between(*band), w).otherwise(0.0))
    elif upper is not None:
        raw = F.transform(raw, lambda w: F.least(w, F.lit(upper)))
    return F.zip_with(raw, mask, lambda w, m: w * m)


def sequence_statistic(ratio: Column, mask: Column, statistic: str) -> Column:
    """What a sequence is rejected by: sum, mean or max of k1, k2 or k3 of its tokens (`seq_mean_k3` and so on)."""
    _, fold, kind = statistic.split("_")
    token = {
        "k1": lambda x: -x,
        "k2": lambda x: 0.5 * x * x,
        "k3": lambda x: F.exp(clamp(x, -SAFE, SAFE)) - 1 - clamp(x, -SAFE, SAFE),
    }[kind]
    values = F.transform(ratio, token)
    if fold == "sum":
        return masked_sum(values, mask)
    if fold == "mean":
        return masked_mean(values, mask)
    return F.array_max(F.zip_with(values, mask, lambda v, m: F.when(m == 1, v)))


def rejection_mask(ratio: Column, mask: Column, rules: dict[str, str | float]) -> Column:
    """The mask without rejected tokens and sequences; all rules must hold. Rules are `token_k1` and so on, or as above."""
    out = mask
    for rule, text in rules.items():
        lo, hi = parse_thresholds(text)
        if rule.startswith("token_"):
            kind = rule.split("_")[1]
            token = {"k1": lambda x: -x, "k2": lambda x: 0.5 * x * x, "k3": lambda x: F.exp(clamp(x, -SAFE, SAFE)) - 1 - clamp(x, -SAFE, SAFE)}[kind]
            fine = F.transform(F.transform(ratio, token), lambda v: ((v >= lo) if lo is not None else F.lit(True)) & (v <= hi))
            out = F.zip_with(out, fine, lambda m, ok: F.when(ok, m).otherwise(0))
        else:
            value = sequence_statistic(ratio, mask, rule)
            ok = (value <= hi) & ((value >= lo) if lo is not None else F.lit(True))
            out = F.when(ok, out).otherwise(F.transform(out, lambda m: m * 0))
    return out


def off_policy_metrics(df: DataFrame, new: str, rollout: str, mask: str) -> DataFrame:
    """One row: perplexities, divergences (k1, k3), difference of log perplexity and chi-square, over sequences with tokens."""
    n = array_sum(F.transform(F.col(mask), lambda m: m.cast("double")))
    rows = df.where(n > 0).select(
        masked_mean(F.col(new), F.col(mask)).alias("new_mean"), masked_mean(F.col(rollout), F.col(mask)).alias("old_mean"),
        masked_sum(log_ratio(F.col(new), F.col(rollout)), F.col(mask)).alias("log_ratio"), n.alias("n"),
        masked_sum(F.transform(log_ratio(F.col(new), F.col(rollout)), lambda x: F.exp(x) - x - 1), F.col(mask)).alias("k3"),
        masked_sum(F.transform(log_ratio(F.col(new), F.col(rollout)), lambda x: F.exp(2 * x)), F.col(mask)).alias("square"),
    )
    tokens = F.sum("n")
    return rows.agg(
        F.avg(F.exp(-F.col("new_mean"))).alias("training_ppl"), F.avg(F.exp(-F.col("old_mean"))).alias("rollout_ppl"), (-F.sum("log_ratio") / tokens).alias("kl"),
        (F.sum("k3") / tokens).alias("k3_kl"), F.avg(F.col("old_mean") - F.col("new_mean")).alias("log_ppl_diff"), (F.sum("square") / tokens - 1).alias("chi2_token"),
        (F.avg(F.exp(clamp(2 * F.col("log_ratio"), -SAFE, SAFE))) - 1).alias("chi2_seq"),
    )


def effective_sample_size(df: DataFrame, weights: str, mask: str) -> DataFrame:
    """One row: mean, least and largest weight over the mask, and the effective sample size."""
    s, q = masked_sum(F.col(weights), F.col(mask)), masked_sum(F.transform(F.col(weights), lambda w: w * w), F.col(mask))
    kept = F.transform(F.filter(F.arrays_zip(F.col(weights).alias("w"), F.col(mask).alias("m")), lambda x: x["m"] == 1), lambda x: x["w"])
    n = F.sum(array_sum(F.transform(F.col(mask), lambda m: m.cast("double"))))
    return df.agg((F.sum(s) / n).alias("mean_weight"), F.min(F.array_min(kept)).alias("min_weight"), F.max(F.array_max(kept)).alias("max_weight"), (F.pow(F.sum(s), F.lit(2)) / F.sum(q) / n).alias("ess"))


def normalize_weights(df: DataFrame, weights: str, mask: str, level: str = "token", out: str = "weights_normed") -> DataFrame:
    """Weights over their mean, which is one row: of all unmasked tokens, or of the sequences' means. A mean near 0 changes nothing."""
    n = array_sum(F.transform(F.col(mask), lambda m: m.cast("double")))
    total = masked_sum(F.col(weights), F.col(mask))
    if level == "token":
        mean = F.sum(total) / (F.sum(n) + EPSILON)
    elif level == "sequence":
        mean = F.sum(F.when(n > 0, total / (n + EPSILON))) / F.greatest(F.count_if(n > 0), F.lit(EPSILON))
    else:
        raise ValueError(f"unknown level {level}")
    factor = df.agg(mean.alias("__mean")).select(F.when(F.col("__mean") > EPSILON, F.col("__mean")).otherwise(1.0).alias("__mean"))
    return df.crossJoin(F.broadcast(factor)).withColumn(out, F.transform(weights, lambda w: w / F.col("__mean"))).drop("__mean")


def rejection_statistics(df: DataFrame, ratio: str, mask: str, statistic: str, thresholds: str | float, prefix: str = "") -> DataFrame:
    """One row on what a rejection by a sequence statistic would meet: mean, range, shares beyond the thresholds, deviation.

    The deviation is of values clamped to the thresholds (from 0 without a lower one), each weighing as its sequence's tokens.
    """
    lo, hi = parse_thresholds(thresholds)
    rows = df.select(sequence_statistic(F.col(ratio), F.col(mask), statistic).alias("v"), array_sum(F.transform(F.col(mask), lambda m: m.cast("double"))).alias("n")).where("n > 0")
    v, n = F.col("v"), F.col("n")
    c = clamp(v, lo if lo is not None else 0.0, hi)
    mean, square = F.sum(c * n) / F.sum(n), F.sum(c * c * n) / F.sum(n)
    low = F.avg(F.when(v < lo, 1.0).otherwise(0.0)) if lo is not None else F.lit(0.0)
    out = {
        "mean": F.sum(v * n) / F.sum(n), "max": F.max("v"), "min": F.min("v"), "fraction_high": F.avg(F.when(v > hi, 1.0).otherwise(0.0)), "fraction_low": low,
        "std": F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)), "seq_mean": F.avg("v"), "seq_std": F.coalesce(F.stddev_samp("v"), F.lit(0.0)), "seq_max_deviation": F.max(F.abs(v)),
    }
    return rows.agg(*[c.alias(prefix + k) for k, c in out.items()])


def correct(df: DataFrame, new: str, rollout: str, mask: str, level: str | None = "token", upper: float | None = 2.0, band: tuple[float, float] | None = None, rules: dict[str, str | float] | None = None, normalize: bool = False) -> DataFrame:
    """Adds `weights` (unless level is None) and `kept_mask`: the whole correction of a batch, one expression per sequence.

    Only the normalisation needs a pass over all sequences, of one row.
    """
    ratio = log_ratio(F.col(new), F.col(rollout))
    out = df.withColumn("kept_mask", rejection_mask(ratio, F.col(mask), rules or {}))
    if level is None:
        return out
    out = out.withColumn("weights", importance_weights(ratio, F.col(mask), level, upper, band))
    return normalize_weights(out, "weights", mask, level, "weights") if normalize else out
