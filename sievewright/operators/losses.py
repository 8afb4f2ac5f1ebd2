"""Forward values of policy and value losses over token arrays, and their aggregation.

A loss is a column expression per token; `aggregate_loss` folds it. A row is a sequence, so nothing but the final sums is
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.arrays import EPSILON, array_sum, clamp, let, log_sum_exp, masked_mean, masked_sum
from sievewright.functions.registry import LOSSES
from sievewright.operators.ranks import bucket_count, distributed_row_number, ranged_row_number
from sievewright.session import cut_lineage


def per_token(f: Callable[[Column], Column], **arrays: Column) -> Column:
    """Applies f to a struct of the arrays' items at each position."""
    return F.transform(F.arrays_zip(*[c.alias(k) for k, c in arrays.items()]), f)


def _ratio(x: Column, bound: float = 20.0) -> Column:
    return F.exp(clamp(x["new"] - x["old"], -bound, bound))


@LOSSES.register("vanilla")
def ppo_clip(x: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Clipped surrogate; with a negative advantage it is bounded once more."""
    r, a = _ratio(x), x["adv"]
    worst = F.greatest(-a * r, -a * clamp(r, 1 - low, 1 + high))
    return F.when(a < 0, F.least(worst, -a * dual)).otherwise(worst)


@LOSSES.register("sapo")
def sapo(x: Column, tau_positive: float = 1.0, tau_negative: float = 1.05) -> Column:
    """A sigmoid gate around ratio 1 in place of the clip."""
    tau = F.when(x["adv"] > 0, tau_positive).otherwise(tau_negative)
    return -(4.0 / tau) / (1 + F.exp(-tau * (_ratio(x) - 1))) * x["adv"]


@LOSSES.register("gpg")
def gpg_loss(x: Column) -> Column:
    return -x["new"] * x["adv"]


@LOSSES.register("cispo")
def cispo(x: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """The clipped ratio weighs the log-probability."""
    return -clamp(_ratio(x), 1 - low, 1 + high) * x["adv"] * x["new"]


@LOSSES.register("reinforce")
def reinforce(x: Column) -> Column:
    return -x["adv"] * x["new"]


@LOSSES.register("dppo_tv")
def dppo_tv(x: Column, threshold: float = 0.2) -> Column:
    """The surrogate without tokens whose probability has moved too far in the advantage's direction."""
    p, q = F.exp(x["new"]), F.exp(x["old"])
    out = ((x["adv"] > 0) & (p - q > threshold)) | ((x["adv"] < 0) & (q - p > threshold))
    return F.when(out, 0.0).otherwise(-x["adv"] * _ratio(x))


@LOSSES.register("dppo_kl")
def dppo_kl(x: Column, threshold: float = 0.05) -> Column:
    """As dppo_tv, by the divergence of the token against all others."""
    p, q = clamp(F.exp(x["new"]), 1e-6, 1 - 1e-6), clamp(F.exp(x["old"]), 1e-6, 1 - 1e-6)
    kl = q * F.log(q / p) + (1 - q) * F.log((1 - q) / (1 - p))
    out = (kl > threshold) & (((x["adv"] > 0) & (p > q)) | ((x["adv"] < 0) & (p < q)))
    return F.when(out, 0.0).otherwise(-x["adv"] * _ratio(x))


@LOSSES.register("value_clip")
def value_clip(x: Column, clip: float = 0.5) -> Column:
    """Half the larger squared error of the prediction and of its clipped form."""
    clipped = F.least(x["old"] + clip, F.greatest(x["old"] - clip, x["new"]))
    return 0.5 * F.greatest(F.pow(x["new"] - x["target"], F.lit(2)), F.pow(clipped - x["target"], F.lit(2)))


def sequence_ratio(new: Column, old: Column, mask: Column) -> Column:
    """exp of the mean log-ratio of a sequence's tokens."""
    return F.exp(masked_mean(F.zip_with(new, old, lambda a, b: a - b), mask))


def gspo(new: Column, old: Column, mask: Column, adv: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """Clipped surrogate of the sequence ratio, one value per sequence."""
    r = sequence_ratio(new, old, mask)
    return F.greatest(-adv * r, -adv * clamp(r, 1 - low, 1 + high))


def loss_value(loss: str, mask: str, mode: str, norm: float = 1.0) -> Column:
    """The aggregate of one mode: token-mean, seq-mean-token-sum, seq-mean-token-sum-norm or seq-mean-token-mean."""
    total, count = masked_sum(F.col(loss), F.col(mask)), array_sum(F.transform(F.col(mask), lambda m: m.cast("double")))
    if mode == "token-mean":
        return F.sum(total) / (F.sum(count) + EPSILON)
    if mode == "seq-mean-token-sum":
        return F.sum(F.when(count > 0, total)) / F.count_if(count > 0)
    if mode == "seq-mean-token-sum-norm":
        return F.sum(total) / norm
    if mode == "seq-mean-token-mean":
        return F.sum(F.when(count > 0, total / (count + EPSILON))) / F.count_if(count > 0)
    raise ValueError(f"unknown aggregation {mode}")


def aggregate_loss(df: DataFrame, loss: str, mask: str, mode: str, out: str = "loss", norm: float = 1.0) -> DataFrame:
    """One row with the loss under one mode; several modes share a pass through loss_value."""
    return df.agg(loss_value(loss, mask, mode, norm).alias(out))


def geo_mean(new: Column, old: Column, mask: Column, adv: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """A sequence's loss by the geometric mean of its ratios, each clipped on the side its advantage points to."""

    def clipped(x: Column) -> Column:
        sign, d = F.signum(x["a"]), x["n"] - x["o"]
        return sign * F.least(sign * d, sign * clamp(d, -low, high))

    logs = F.transform(F.arrays_zip(new.alias("n"), old.alias("o"), adv.alias("a")), clipped)
    return -masked_mean(adv, mask) * F.exp(masked_mean(logs, mask))


def token_rows(df: DataFrame, seq: str, **arrays: str) -> DataFrame:
    """(seq, t from 1, the arrays' items) of unmasked tokens; one of the arrays is `mask`."""
    zipped = F.arrays_zip(*[F.col(c).alias(k) for k, c in arrays.items()])
    rows = df.select(F.col(seq).alias("seq"), F.posexplode(zipped).alias("__t", "x")).where("x.mask = 1")
    return rows.select("seq", (F.col("__t") + 1).cast("bigint").alias("t"), *[f"x.{k}" for k in arrays if k != "mask"])


def with_covariance(tokens: DataFrame) -> DataFrame:
    """Adds `cov`, the product of a token's centred advantage and centred log-probability."""
    means = tokens.agg(F.avg("new").alias("__mn"), F.avg("adv").alias("__ma"))
    return tokens.crossJoin(F.broadcast(means)).withColumn("cov", (F.col("new") - F.col("__mn")) * (F.col("adv") - F.col("__ma"))).drop("__mn", "__ma")  # one row


def top_by(df: DataFrame, column: str, ties: list[str], share: float, least: int = 1, error: float = 1e-4) -> DataFrame:
    """The rows of the largest values, a share of all (rounded down, `least` at least); no task sorts or holds more than a bucket.

    A quantile of bounded error leaves little more than the wanted rows; only these are ranked.
    """
    df = cut_lineage(df)  # counted, cut and ranked: read three times
    n = df.count()
    wanted = max(least, int(n * share))
    if wanted >= n:
        return df
    edge = df.agg(F.percentile_approx(column, max(0.0, 1 - wanted / n - 2 * error), int(1 / error))).first()[0]
    near = cut_lineage(df.where(F.col(column) >= edge).withColumn("__down", -F.col(column)))
    return ranged_row_number(near, [], "__down", ties, "__rank").where(F.col("__rank") <= wanted).drop("__down", "__rank")


def random_rows(df: DataFrame, ties: list[str], wanted: int) -> DataFrame:
    """`wanted` rows by the smallest digests of their keys, ranked in buckets."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("/", *ties)), 1, 15), 16, 10).cast("bigint")
    spread = (draw - F.lit(2**59)) * 16
    df = cut_lineage(df)
    ranked = distributed_row_number(df.withColumn("__draw", spread), [], "__draw", ties, "__rank", bucket_count(df.count()))
    return ranked.where(F.col("__rank") <= wanted).drop("__draw", "__rank")


def clip_cov(tokens: DataFrame, low: float, high: float, share: float, cov_low: float, cov_high: float) -> DataFrame:
    """(seq, t, loss): the clipped surrogate of (seq, t, new, old, adv), 0 for a random share of the tokens whose covariance lies between the bounds.

    Tokens that the surrogate clips by itself are not drawn.
    """
    ratio = F.exp(F.col("new") - F.col("old"))
    one, two = -F.col("adv") * ratio, -F.col("adv") * clamp(ratio, 1 - low, 1 + high)
    rows = cut_lineage(with_covariance(tokens).withColumn("loss", F.greatest(one, two)).withColumn("clipped", two > one))
    fit = rows.where(~F.col("clipped") & (F.col("cov") > cov_low) & (F.col("cov") < cov_high)).select("seq", "t")
    drawn = random_rows(fit, ["seq", "t"], max(1, int(rows.count() * share))).withColumn("__hit", F.lit(True))
    return rows.join(drawn, ["seq", "t"], "left").select("seq", "t", F.when(F.col("__hit"), 0.0).otherwise(F.col("loss")).alias("loss"), F.coalesce("__hit", F.lit(False)).alias("dropped"))


def top_k_distillation(student: Column, teacher: Column, k: int) -> Column:
    """struct(loss, teacher_mass, student_mass, overlap): forward divergence over the teacher's k likeliest tokens, from two arrays of logits.

    overlap is the share of these tokens that are among the student's k likeliest.
    """

    def at_top(logits: Column) -> Column:
        order = F.sort_array(F.transform(logits, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))), asc=False)
        return F.transform(F.slice(order, 1, k), lambda s: -s["i"])

    def result(top: Column) -> Column:
        def of(z: Column) -> Column:
            t, s, zt, zs = z["t"], z["s"], z["zt"], z["zs"]
            pt = F.transform(top, lambda i: F.exp(F.get(t, i) - zt))
            loss = F.aggregate(top, F.lit(0.0), lambda a, i: a + F.exp(F.get(t, i) - zt) * ((F.get(t, i) - zt) - (F.get(s, i) - zs)))
            ps = F.transform(top, lambda i: F.exp(F.get(s, i) - zs))
            return F.struct(loss.alias("loss"), array_sum(pt).alias("teacher_mass"), array_sum(ps).alias("student_mass"), (F.size(F.array_intersect(top, at_top(s))) / k).alias("overlap"))

        return let(F.struct(teacher.alias("t"), student.alias("s"), log_sum_exp(teacher).alias("zt"), log_sum_exp(student).alias("zs")), of)

    return let(at_top(teacher), result)


def top_p(logits: Column, p: float, temperature: float = 1.0) -> Column:
    """The indices (from 0) that stay under nucleus filtering: the likeliest tokens up to the one that reaches probability p."""

    def pick(z: Column) -> Column:
        order = F.sort_array(F.transform(logits, lambda x, i: F.struct((x / temperature).alias("x"), (-i).alias("i"))), asc=False)
        start = F.struct(F.lit(0.0).alias("mass"), F.array().cast("array<int>").alias("kept"))
        step = lambda acc, s: F.when(acc["mass"] >= p, acc).otherwise(F.struct((acc["mass"] + F.exp(s["x"] - z)).alias("mass"), F.concat(acc["kept"], F.array((-s["i"]).cast("int"))).alias("kept")))
        return F.aggregate(order, start, step)["kept"]

    return let(log_sum_exp(F.transform(logits, lambda x: x / temperature)), pick)
