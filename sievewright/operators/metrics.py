"""Metric reduction, two-level evaluation and resampled expectations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import arrays as A
from sievewright.operators.ranks import ranged_row_number


def reduce_by_name(df: DataFrame, metric: str, value: str) -> DataFrame:
    """One row per metric: the largest value if its name holds `max`, the least if `min`, else the mean."""
    m = F.lower(F.col(metric))
    picked = F.when(F.first(m.contains("max")), F.max(value)).when(F.first(m.contains("min")), F.min(value)).otherwise(F.avg(value))
    return df.groupBy(metric).agg(picked.alias("reduced"))


#: Exact rules first, then these parts of names, in this order.
NAME_RULES = (("timing_s/", "sum"), ("mean", "avg"), ("avg", "avg"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("total", "sum"))


def aggregate_by_rule(df: DataFrame, metric: str, value: str, weight: str, step: str, rules: dict[str, str] | None = None) -> DataFrame:
    """One row per metric under its rule: sum, avg, max, min, last or weighted_avg."""
    kind = F.lit("avg")
    for part, rule in reversed(NAME_RULES):
        kind = F.when(F.col(metric).contains(part), rule).otherwise(kind)
    for name, rule in (rules or {}).items():
        kind = F.when(F.col(metric) == name, rule).otherwise(kind)
    kinds = {
        "sum": F.sum(value), "avg": F.avg(value), "max": F.max(value), "min": F.min(value), "last": F.max_by(value, step),
        "weighted_avg": F.sum(F.col(value) * F.col(weight)) / F.sum(weight),
    }
    g = df.withColumn("__kind", kind).groupBy(metric, "__kind").agg(*[e.alias(f"__{k}") for k, e in kinds.items()])
    out = F.lit(None).cast("double")
    for k in kinds:
        out = F.when(F.col("__kind") == k, F.col(f"__{k}")).otherwise(out)
    return g.select(metric, out.alias("reduced"))


def two_level_mean(df: DataFrame, source: str, item: str, score: str, flag: Column | None = None) -> DataFrame:
    """Mean within items, then over the items of a source; the same over items that hold the flag."""
    items = df.groupBy(source, item).agg(F.avg(score).alias("item_mean"), F.bool_or(F.coalesce(flag, F.lit(False)) if flag is not None else F.lit(True)).alias("flagged"))
    return items.groupBy(source).agg(F.avg("item_mean").alias("score"), F.count("*").alias("n_items"), F.avg(F.when(F.col("flagged"), F.col("item_mean"))).alias("flagged_score"), F.count_if("flagged").alias("n_flagged"))


def expected_best(df: DataFrame, group: str, value: str, n: int, worst: bool = False, out: str = "expected") -> DataFrame:
    """Expectation of the best (worst) of n draws with replacement from each group, in closed form."""
    ordered = df.select(group, F.col(value).cast("double").alias("__v")).withColumn("__o", -F.col("__v") if worst else F.col("__v"))
    ranked = ranged_row_number(ordered, [group], "__o", [], "__i")
    sizes = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    i, size = F.col("__i"), F.col("__n")
    weight = F.pow(i / size, F.lit(n)) - F.pow((i - 1) / size, F.lit(n))
    return ranked.join(sizes, F.col(group).eqNullSafe(F.col("__g"))).groupBy(group).agg(F.sum(weight * F.col("__v")).alias(out))


def bootstrap(df: DataFrame, group: str, value: str, n: int, draws: int = 1000, seed: int = 42, statistic: str = "max", prediction: str | None = None) -> DataFrame:
    """(group, mean, deviation) of a statistic of n values drawn with replacement, over `draws` draws of a group's values.

    `majority` needs the predictions: a draw's value is that of the first drawn row with its most frequent prediction. A group
    is one prompt's samples, so it is small; groups run in parallel, a group's draws in steps of bounded size.
    """
    reduce = {"max": np.max, "min": np.min, "mean": np.mean, "majority": None}[statistic]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = frame["value"].to_numpy()
        rng, got = np.random.RandomState(seed), []
        for start in range(0, draws, 256):
            picks = rng.choice(len(values), size=(min(256, draws - start), n), replace=True)
            if reduce is not None:
                got.append(reduce(values[picks], axis=1))
                continue
            codes = pd.factorize(frame["prediction"], use_na_sentinel=False)[0][picks]
            votes = (codes[:, :, None] == codes[:, None, :]).sum(axis=2)
            got.append(values[picks[np.arange(len(picks)), votes.argmax(axis=1)]])
        got = np.concatenate(got)
        return pd.DataFrame([(key[0], float(got.mean()), float(got.std()))], columns=["grp", "mean", "deviation"])

    rows = df.select(F.col(group).alias("grp"), F.col(value).cast("double").alias("value"), (F.col(prediction) if prediction else F.lit(None).cast("string")).alias("prediction"))
    return rows.groupBy("grp").applyInPandas(run, f"grp {df.schema[group].dataType.simpleString()}, mean double, deviation double").withColumnRenamed("grp", group)


def majority_value(df: DataFrame, group: str, prediction: str, value: str, position: str, out: str = "majority") -> DataFrame:
    """The value of the first row that holds a group's most frequent prediction; ties go to the earlier prediction."""
    votes = df.groupBy(group, prediction).agg(F.count("*").alias("n"), F.min(F.struct(position, value)).alias("first"))
    best = votes.groupBy(group).agg(F.max_by("first", F.struct(F.col("n"), -F.col(f"first.{position}"))).alias("first"))
    return best.select(group, F.col(f"first.{value}").alias(out))


def imbalance(df: DataFrame, part: str, size: str) -> DataFrame:
    """One row: least, largest and mean load of the parts, and their spread."""
    loads = df.groupBy(part).agg(F.sum(size).alias("load"))
    return loads.agg(F.min("load").alias("min_load"), F.max("load").alias("max_load"), F.avg("load").alias("mean_load"), (F.max("load") - F.min("load")).alias("spread"))


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, one column per share): exact percentiles with linear interpolation, NULLs left out.

    Values are ranked in buckets, and only the rows at the wanted places are gathered: a group may hold any share of all rows.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("__g"), F.col(value).cast("double").alias("__v"))
    sizes = rows.groupBy("__g").agg(F.count("*").alias("__n")).withColumnRenamed("__g", "__s")
    ranked = ranged_row_number(rows, ["__g"], "__v", [], "__i").join(sizes, F.col("__g").eqNullSafe(F.col("__s")))
    place = {name: (F.col("__n") - 1) * p for name, p in shares.items()}
    wanted = [(F.col("__i") - 1).isin(F.floor(x), F.ceil(x)) for x in place.values()]
    near = ranked
    hit = wanted[0]
    for w in wanted[1:]:
        hit = hit | w
    near = near.where(hit)

    def at(x: Column) -> Column:
        low = F.max(F.when(F.col("__i") - 1 == F.floor(x), F.col("__v")))
        high = F.max(F.when(F.col("__i") - 1 == F.ceil(x), F.col("__v")))
        return low + (high - low) * F.max(x - F.floor(x))

    return near.groupBy(F.col("__g").alias(group)).agg(*[at(x).alias(name) for name, x in place.items()])


def timing_metrics(seconds: dict[str, float], prompt_tokens: int, response_tokens: int, devices: int) -> dict[str, float]:
    """Seconds of each stage, milliseconds per token of those that work on tokens, and the throughput of the step per device."""
    every = prompt_tokens + response_tokens
    tokens = {"gen": response_tokens} | dict.fromkeys(("ref", "values", "adv", "update_critic", "update_actor"), every)
    out = {f"timing_s/{k}": v for k, v in seconds.items()} | {f"timing_per_token_ms/{k}": v * 1000 / tokens[k] for k, v in seconds.items() if tokens.get(k)}
    if seconds.get("step"):
        out |= {"perf/total_num_tokens": every, "perf/time_per_step": seconds["step"], "perf/throughput": every / (seconds["step"] * devices)}
    return out


def variance_proxies(df: DataFrame, adv: str, old: str, squares: str, mask: str, gradient_norm: float | None = None, weights: str | None = None) -> DataFrame:
    """One row: signal, total power and noise of the gradient by the proxy 1 - 2p + sum of squares per token, and its parts."""
    m = F.col(mask)
    proxy = F.transform(F.arrays_zip(F.col(old).alias("o"), F.col(squares).alias("s")), lambda x: 1 - 2 * F.exp(x["o"]) + x["s"])
    w = F.lit(1.0) if weights is None else A.masked_mean(F.col(weights), m)
    scaled = proxy if weights is None else F.zip_with(proxy, F.col(weights), lambda p, r: p * r * r)
    rows = df.select(A.masked_mean(F.col(adv), m).alias("a"), A.masked_sum(scaled, m).alias("w"), F.greatest(F.lit(0.0), A.masked_sum(proxy, m)).alias("own"), w.alias("r"))
    signal = F.lit(None if gradient_norm is None else float(gradient_norm) ** 2).cast("double")
    power = F.avg(F.col("r") * F.col("r") * F.col("a") * F.col("a") * F.col("own"))
    noise = F.when(F.count("*") > 1, F.greatest(F.lit(0.0), (power - signal) / (F.count("*") - 1)))
    return rows.agg(
        F.coalesce(signal, F.lit(0.0)).alias("signal_strength"), power.alias("total_power"), F.coalesce(noise, F.lit(0.0)).alias("pure_noise"),
        F.avg(F.col("a") * F.col("a")).alias("expected_a_squared"), F.avg("w").alias("expected_w"),
    )
