"""Group advantages: each row's reward against the rewards of its group.

Rows carry a group column and a reward. A group's statistics are aggregated before the shuffle and joined back, so a group
of any size costs one row per partition; only the estimators that need an order within the group use a window, and they keep
two rows per group. Results equal the window form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.arrays import masked, suffix_fold
from sievewright.functions.registry import ADVANTAGES

EPSILON = 1e-6


def with_group(df: DataFrame, group: str, **statistics: Column) -> DataFrame:
    """Adds aggregates of each group to its rows; NULL groups are a group."""
    stats = df.groupBy(F.col(group).alias("__g")).agg(*[c.alias(k) for k, c in statistics.items()])
    return df.join(stats, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


@ADVANTAGES.register("grpo")
def grpo(df: DataFrame, group: str, reward: str, by_deviation: bool = True, out: str = "advantage") -> DataFrame:
    """(r - mean) / (deviation + eps); a lone row has mean 0 and deviation 1."""
    d = with_group(df, group, __n=F.count("*"), __m=F.avg(reward), __s=F.stddev_samp(reward))
    mean, dev = F.when(F.col("__n") == 1, 0.0).otherwise(F.col("__m")), F.when(F.col("__n") == 1, 1.0).otherwise(F.col("__s"))
    value = F.col(reward) - mean
    return d.withColumn(out, value / (dev + EPSILON) if by_deviation else value).drop("__n", "__m", "__s")


@ADVANTAGES.register("rloo")
def rloo(df: DataFrame, group: str, reward: str, lone_is_zero: bool = False, out: str = "advantage") -> DataFrame:
    """Reward against the mean of the others; a lone row keeps its reward, or gets 0."""
    d = with_group(df, group, __n=F.count("*"), __t=F.sum(reward))
    lone = F.lit(0.0) if lone_is_zero else F.col(reward)
    value = (F.col("__n") * F.col(reward) - F.col("__t")) / F.nullif(F.col("__n") - 1, F.lit(0))
    return d.withColumn(out, F.when(F.col("__n") == 1, lone).otherwise(value)).drop("__n", "__t")


@ADVANTAGES.register("opo")
def opo(df: DataFrame, group: str, reward: str, length: str, out: str = "advantage") -> DataFrame:
    """Reward against the group's mean weighted by length."""
    d = with_group(df, group, __n=F.count("*"), __b=F.sum(F.col(length) * F.col(reward)) / F.sum(length))
    return d.withColumn(out, F.col(reward) - F.when(F.col("__n") == 1, 0.0).otherwise(F.col("__b"))).drop("__n", "__b")


@ADVANTAGES.register("gpg")
def gpg(df: DataFrame, group: str, reward: str, norm: float = 1.0, out: str = "advantage") -> DataFrame:
    """Centred reward, scaled by all rows over rows with a reward."""
    total = df.agg(F.count("*").alias("__all"), F.greatest(F.count_if(F.col(reward) != 0), F.lit(1)).alias("__hit"))
    d = with_group(df, group, __n=F.count("*"), __m=F.avg(reward)).crossJoin(F.broadcast(total))  # one row
    value = F.col("__all") / F.col("__hit") * (F.col(reward) - F.when(F.col("__n") == 1, 0.0).otherwise(F.col("__m"))) / norm
    return d.withColumn(out, value).drop("__n", "__m", "__all", "__hit")


@ADVANTAGES.register("passk")
def passk(df: DataFrame, group: str, reward: str, row_id: str, by_deviation: bool = True, out: str = "advantage") -> DataFrame:
    """Only a group's best row counts: its lead over the second best, over the deviation. Lone rows are dropped as errors."""
    best = F.max_by(F.col(row_id), F.struct(F.col(reward), -F.col(row_id)))
    d = with_group(df, group, __n=F.count("*"), __s=F.stddev_samp(reward), __best=best, __top=F.max(reward))
    second = d.where(F.col(row_id) != F.col("__best")).groupBy(F.col(group).alias("__h")).agg(F.max(reward).alias("__second"))
    d = d.where("__n > 1").join(second, F.col(group).eqNullSafe(F.col("__h"))).drop("__h")
    lead = F.col("__top") - F.col("__second")
    lead = lead / (F.col("__s") + EPSILON) if by_deviation else lead
    return d.withColumn(out, F.when(F.col(row_id) == F.col("__best"), lead).otherwise(0.0)).drop("__n", "__s", "__best", "__top", "__second")


@ADVANTAGES.register("gdpo")
def gdpo(df: DataFrame, group: str, rewards: dict[str, float], row_id: str, out: str = "advantage") -> DataFrame:
    """Each reward normalised within its group, weighted, summed and whitened over all rows."""
    d = with_group(df, group, __n=F.count("*"), **{f"__m_{r}": F.avg(r) for r in rewards}, **{f"__s_{r}": F.stddev_samp(r) for r in rewards})
    mixed = sum(F.lit(w) * (F.col(r) - F.when(F.col("__n") == 1, 0.0).otherwise(F.col(f"__m_{r}"))) / (F.when(F.col("__n") == 1, 1.0).otherwise(F.col(f"__s_{r}")) + EPSILON) for r, w in rewards.items())
    d = d.withColumn("__mixed", mixed).drop("__n", *[f"__{k}_{r}" for r in rewards for k in "ms"])
    whole = d.agg(F.avg("__mixed").alias("__mean"), F.var_samp("__mixed").alias("__var"))
    return d.crossJoin(F.broadcast(whole)).withColumn(out, (F.col("__mixed") - F.col("__mean")) / F.sqrt(F.col("__var") + 1e-8)).drop("__mixed", "__mean", "__var")


@ADVANTAGES.register("reinforce_baseline")
def reinforce_baseline(df: DataFrame, group: str, reward: str, length: str, out: str = "advantage") -> DataFrame:
    """Reward less the group's mean, whitened over tokens: a row weighs as many times as it has tokens."""
    d = with_group(df, group, __n=F.count("*"), __m=F.avg(reward))
    d = d.withColumn("__c", F.col(reward) - F.when(F.col("__n") == 1, 0.0).otherwise(F.col("__m")))
    n = F.sum(length)
    mean = F.sum(F.col("__c") * F.col(length)) / n
    var = (F.sum(F.col("__c") * F.col("__c") * F.col(length)) / n - mean * mean) * n / (n - 1)
    whole = d.agg(mean.alias("__mean"), var.alias("__var"))
    return d.crossJoin(F.broadcast(whole)).withColumn(out, (F.col("__c") - F.col("__mean")) / F.sqrt(F.col("__var") + 1e-8)).drop("__n", "__m", "__c", "__mean", "__var")


def session_final(df: DataFrame, session: str, step: str, reward: str, out: str = "final_reward") -> DataFrame:
    """The reward of a session's last step, on every row of the session."""
    return with_group(df, session, **{out: F.max_by(reward, step)})


def optimal_token_baseline(
    df: DataFrame, group: str, seq: str, reward: str, old: str, squares: str, mask: str, compact: bool = False, zero_tail: bool = True, out: str = "advantage"
) -> DataFrame:
    """(seq, t, out): return-to-go less a baseline per group and position, weighted by the running variance proxy of each path.

    A row is a sequence with arrays of rewards, log-probabilities, sums of squared probabilities and the mask. `compact` counts
    positions among unmasked tokens only, as for turns that tools part, and leaves out sequences without any. A lone sequence
    has no baseline, nor has the tail in which a group's one longest sequence is alone. Sums per group and position are
    combined before the shuffle.
    """
    m = F.col(mask)
    proxy = F.transform(F.arrays_zip(F.col(old).alias("o"), F.col(squares).alias("s")), lambda x: 1 - 2 * F.exp(x["o"]) + x["s"])
    returns, weights = suffix_fold(masked(F.col(reward), m)), F.reverse(suffix_fold(F.reverse(masked(proxy, m))))
    rows = df.select(F.col(group).alias("__g"), F.col(seq).alias("__s"), F.arrays_zip(returns.alias("ret"), weights.alias("w"), m.alias("m")).alias("__x"))
    rows = rows.withColumn("__n", F.size(F.filter("__x", lambda x: x["m"] == 1)))
    if compact:
        rows = rows.where("__n > 0").withColumn("__x", F.filter("__x", lambda x: x["m"] == 1))
    lengths = rows.groupBy("__g", "__n").agg(F.count("*").alias("c"))
    # a group has no more lengths than its longest sequence has tokens
    lengths = lengths.groupBy("__g").agg(F.sum("c").alias("__all"), F.sort_array(F.collect_list(F.struct("__n", "c")), asc=False).alias("__l"))
    tail = F.when((F.col("__l")[0]["c"] == 1) & (F.size("__l") > 1), F.get("__l", F.lit(1))["__n"])
    lengths = lengths.select("__g", "__all", F.col("__l")[0]["__n"].alias("__top"), tail.alias("__second"))
    tokens = rows.select("__g", "__s", "__n", F.posexplode("__x").alias("__t", "x")).select("__g", "__s", "__n", (F.col("__t") + 1).cast("bigint").alias("t"), "x.*")
    base = tokens.groupBy("__g", "t").agg((F.sum(F.col("ret") * F.col("w") * F.col("m")) / (F.sum(F.col("w") * F.col("m")) + 1e-8)).alias("base"))
    alone = F.lit(zero_tail) & F.coalesce((F.col("__n") == F.col("__top")) & (F.col("t") > F.col("__second")), F.lit(False))
    value = (F.col("ret") - F.when((F.col("__all") == 1) | alone, 0.0).otherwise(F.col("base"))) * F.col("m")
    return tokens.join(base, ["__g", "t"]).join(lengths, "__g").select(F.col("__s").alias(seq), "t", value.alias(out))


def remax(reward: Column, baseline: Column, mask: Column) -> Column:
    """Return-to-go of unmasked rewards less the sequence's baseline where the mask is 1."""
    return F.zip_with(suffix_fold(masked(reward, mask)), mask, lambda g, m: g - baseline * m)
