"""Queries over token baselines, covariance losses, corrections and training statistics, each beside the SQL it must equal.

The SQL is written from the formulas of the estimators, with windows over single tokens in place of the arrays' folds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import arrays as A
from sievewright.operators import advantage as ADV
from sievewright.operators import correction as C
from sievewright.operators import losses as L
from sievewright.operators import metrics as M
from sievewright.plans.analytics import _T, _tokens, rounded
from sievewright.session import cut_lineage, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- baselines per token


def _grouped(spark, sf):
    """Token sequences with their customer as the group and sums of squared probabilities."""
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("g"))
    return _tokens(spark, sf).withColumn("squares", F.transform("old", lambda o: 0.8 * F.exp(2 * o))).join(owner, "seq")


_W = "1 - 2 * exp(old) + 0.8 * exp(2 * old)"


@query(f"""WITH {_T}, x AS (SELECT t.*, o_custkey AS g, sum(reward * mask) OVER (PARTITION BY seq ORDER BY t DESC) AS ret, sum(({_W}) * mask) OVER (PARTITION BY seq ORDER BY t) AS w FROM t JOIN orders ON o_orderkey = seq),
    l AS (SELECT g, seq, sum(mask) AS len FROM x GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY len DESC) AS rk, count(*) OVER (PARTITION BY g) AS n, lead(len) OVER (PARTITION BY g ORDER BY len DESC) AS second FROM l),
    b AS (SELECT g, t, sum(ret * w * mask) / (sum(w * mask) + 1e-8) AS base FROM x GROUP BY 1, 2)
    SELECT x.seq, x.t, round((ret - CASE WHEN n = 1 OR (rk = 1 AND len > second AND x.t > second) THEN 0 ELSE base END) * mask, 5) + 0.0 AS advantage FROM x JOIN b ON x.g = b.g AND x.t = b.t JOIN r ON x.seq = r.seq""")
def adv_optimal_token(spark, sf):
    return rounded(ADV.optimal_token_baseline(_grouped(spark, sf), "g", "seq", "reward", "old", "squares", "mask"), digits=5)


@query(f"""WITH {_T}, x AS (SELECT seq, o_custkey AS g, row_number() OVER (PARTITION BY seq ORDER BY t) AS k, sum(reward) OVER (PARTITION BY seq ORDER BY t DESC) AS ret, sum({_W}) OVER (PARTITION BY seq ORDER BY t) AS w FROM t JOIN orders ON o_orderkey = seq WHERE mask = 1),
    l AS (SELECT g, seq, count(*) AS len FROM x GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY len DESC) AS rk, count(*) OVER (PARTITION BY g) AS n, lead(len) OVER (PARTITION BY g ORDER BY len DESC) AS second FROM l),
    b AS (SELECT g, k, sum(ret * w) / (sum(w) + 1e-8) AS base FROM x GROUP BY 1, 2)
    SELECT x.seq, x.k AS t, round(ret - CASE WHEN n = 1 OR (rk = 1 AND len > second AND x.k > second) THEN 0 ELSE base END, 5) + 0.0 AS advantage FROM x JOIN b ON x.g = b.g AND x.k = b.k JOIN r ON x.seq = r.seq""")
def adv_optimal_token_turns(spark, sf):
    """The same over positions counted among unmasked tokens."""
    return rounded(ADV.optimal_token_baseline(_grouped(spark, sf), "g", "seq", "reward", "old", "squares", "mask", compact=True), digits=5)


@query(f"""WITH {_T}, b AS (SELECT seq, avg(value) AS base FROM t GROUP BY 1)
    SELECT t.seq, t, round(sum(reward * mask) OVER (PARTITION BY t.seq ORDER BY t DESC) - base * mask, 5) + 0.0 AS advantage FROM t JOIN b ON t.seq = b.seq""")
def adv_remax(spark, sf):
    rows = _tokens(spark, sf).withColumn("base", A.array_sum(F.col("value")) / F.size("value"))
    return rows.select("seq", F.posexplode(ADV.remax(F.col("reward"), F.col("base"), F.col("mask"))).alias("t", "a")).select("seq", (F.col("t") + 1).cast("bigint").alias("t"), (F.round("a", 5) + 0.0).alias("advantage"))


# ---- losses


@query(f"""WITH {_T}, m AS (SELECT *, exp(new - old) AS r, (new - avg(new) OVER ()) * (adv - avg(adv) OVER ()) AS cov FROM t WHERE mask = 1),
    l AS (SELECT *, -adv * r AS one, -adv * least(1.02, greatest(0.98, r)) AS two FROM m),
    p AS (SELECT seq, t, row_number() OVER (ORDER BY substr(md5(seq || '/' || t), 1, 15), seq, t) AS rk FROM l WHERE two <= one AND cov > 0.001 AND cov < 0.02),
    d AS (SELECT seq, t FROM p WHERE rk <= (SELECT greatest(1, CAST(floor(count(*) * 0.01) AS BIGINT)) FROM l))
    SELECT round(sum(CASE WHEN d.seq IS NULL THEN greatest(one, two) ELSE 0 END) / (count(*) + 1e-8), 6) AS loss, count(d.seq) AS dropped FROM l LEFT JOIN d ON l.seq = d.seq AND l.t = d.t""")
def loss_clip_cov(spark, sf):
    """A random share of the tokens of middling covariance gets no gradient."""
    tokens = cut_lineage(L.token_rows(_tokens(spark, sf), "seq", new="new", old="old", adv="adv", mask="mask"))
    rows = L.clip_cov(tokens, 0.02, 0.02, 0.01, 0.001, 0.02)
    return rows.agg(F.round(F.sum("loss") / (F.count("*") + 1e-8), 6).alias("loss"), F.count_if("dropped").alias("dropped"))


@query(f"""WITH {_T}, c AS (SELECT seq, t, (new - avg(new) OVER ()) * (adv - avg(adv) OVER ()) AS cov, adv, new, old FROM t WHERE mask = 1),
    k AS (SELECT *, row_number() OVER (ORDER BY cov DESC, seq, t) AS rk FROM c), n AS (SELECT greatest(1, CAST(floor(count(*) * 0.002) AS BIGINT)) AS k FROM c)
    SELECT seq, t, round(-adv * exp(new - old) + abs(new - old), 6) AS loss FROM k, n WHERE rk <= k""")
def loss_kl_cov(spark, sf):
    """Tokens of the highest covariance, which get the divergence term."""
    tokens = cut_lineage(L.token_rows(_tokens(spark, sf), "seq", new="new", old="old", adv="adv", mask="mask"))
    top = L.top_by(L.with_covariance(tokens), "cov", ["seq", "t"], 0.002)
    return top.select("seq", "t", F.round(-F.col("adv") * F.exp(F.col("new") - F.col("old")) + F.abs(F.col("new") - F.col("old")), 6).alias("loss"))


@query(f"""WITH {_T}, c AS (SELECT *, sign(adv) * least(sign(adv) * (new - old), sign(adv) * least(0.02, greatest(-0.01, new - old))) AS d FROM t),
    s AS (SELECT seq, exp(sum(d * mask) / (sum(mask) + 1e-8)) AS r, sum(adv * mask) / (sum(mask) + 1e-8) AS a FROM c GROUP BY seq) SELECT round(avg(-a * r), 6) AS loss FROM s""")
def loss_geo_mean(spark, sf):
    return _tokens(spark, sf).agg(F.round(F.avg(L.geo_mean(F.col("new"), F.col("old"), F.col("mask"), F.col("adv"), 0.01, 0.02)), 6).alias("loss"))


_E = "e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 5) AS t, list_transform(list_reverse(embedding::DOUBLE[]), lambda x: x * 5) AS s FROM embeddings), z AS (SELECT *, ln(list_sum(list_transform(t, lambda x: exp(x)))) AS zt, ln(list_sum(list_transform(s, lambda x: exp(x)))) AS zs FROM e)"


@query(f"""WITH {_E}, x AS (SELECT vec_id, unnest(t) AS t, unnest(s) AS s, generate_subscripts(t, 1) AS i, zt, zs FROM z),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY t DESC, i) AS rt, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS rs FROM x)
    SELECT vec_id, round(sum(exp(t - zt) * ((t - zt) - (s - zs))), 6) + 0.0 AS loss, round(sum(exp(t - zt)), 6) AS teacher_mass, round(sum(exp(s - zs)), 6) AS student_mass, round(count(*) FILTER (WHERE rs <= 8) / 8.0::DOUBLE, 6) AS overlap FROM k WHERE rt <= 8 GROUP BY 1""")
def loss_distillation_top_k(spark, sf):
    """Forward divergence on the teacher's eight likeliest tokens, the mass both give them, and how many the student shares."""
    z = F.transform("embedding", lambda x: x.cast("double") * 5)
    rows = table(spark, sf, "embeddings").select("vec_id", z.alias("t"), F.reverse(z).alias("s"))
    return rounded(rows.select("vec_id", L.top_k_distillation(F.col("s"), F.col("t"), 8).alias("d")).select("vec_id", "d.*"), "vec_id")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 5 / 0.7) AS z FROM embeddings), x AS (SELECT vec_id, unnest(z) AS x, generate_subscripts(z, 1) - 1 AS i, ln(list_sum(list_transform(z, lambda x: exp(x)))) AS lse FROM e),
    c AS (SELECT *, coalesce(sum(exp(x - lse)) OVER (PARTITION BY vec_id ORDER BY x DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
    SELECT vec_id, count(*) AS n_kept, sum(i) AS kept_sum FROM c WHERE before < 0.6 GROUP BY 1""")
def logits_top_p(spark, sf):
    """Nucleus filtering at temperature 0.7: how many tokens stay, and the sum of their indices."""
    kept = L.top_p(F.transform("embedding", lambda x: x.cast("double") * 5), 0.6, 0.7)
    rows = table(spark, sf, "embeddings").select("vec_id", kept.alias("k"))
    return rows.select("vec_id", F.size("k").cast("bigint").alias("n_kept"), F.aggregate("k", F.lit(0).cast("bigint"), lambda a, i: a + i).alias("kept_sum"))


# ---- corrections


@query(f"""WITH {_T}, w AS (SELECT seq, t, mask, least(exp(new - old) * mask, 1.03) AS w FROM t), m AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS mean FROM w)
    SELECT seq, round(sum(w / mean), 6) AS weights FROM w, m GROUP BY seq""")
def corr_normalised_tokens(spark, sf):
    rows = C.correct(_tokens(spark, sf), "new", "old", "mask", upper=1.03, normalize=True)
    return rows.select("seq", F.round(A.array_sum(F.col("weights")), 6).alias("weights"))


@query(f"""WITH {_T}, s AS (SELECT seq, sum(mask) AS n, exp(least(20, greatest(-20, sum((new - old) * mask)))) AS w FROM t GROUP BY seq), k AS (SELECT seq, n, CASE WHEN w BETWEEN 0.9 AND 1.1 THEN w ELSE 0 END AS w FROM s),
    m AS (SELECT sum(w * n / (n + 1e-8)) / count(*) AS mean FROM k WHERE n > 0) SELECT seq, round(w * n / mean, 6) AS weights FROM k, m""")
def corr_normalised_sequences(spark, sf):
    rows = C.correct(_tokens(spark, sf), "new", "old", "mask", level="sequence", band=(0.9, 1.1), normalize=True)
    return rows.select("seq", F.round(A.array_sum(F.col("weights")), 6).alias("weights"))


@query(f"""WITH {_T}, s AS (SELECT seq, sum(mask) AS n, sum(0.5 * power(new - old, 2) * mask) / (sum(mask) + 1e-8) AS v FROM t GROUP BY seq HAVING sum(mask) > 0), c AS (SELECT *, least(0.002, greatest(0, v)) AS c FROM s)
    SELECT round(sum(v * n) / sum(n), 8) AS mean, round(max(v), 8) AS max, round(min(v), 8) AS min, round(avg(CASE WHEN v > 0.002 THEN 1.0 ELSE 0 END), 8) AS fraction_high, 0.0::DOUBLE AS fraction_low,
        round(sqrt(greatest(0, sum(c * c * n) / sum(n) - power(sum(c * n) / sum(n), 2))), 8) AS std, round(avg(v), 8) AS seq_mean, round(stddev_samp(v), 8) AS seq_std, round(max(abs(v)), 8) AS seq_max_deviation FROM c""")
def corr_rejection_statistics(spark, sf):
    rows = _tokens(spark, sf).withColumn("ratio", C.log_ratio(F.col("new"), F.col("old")))
    return rounded(C.rejection_statistics(rows, "ratio", "mask", "seq_mean_k2", 0.002), digits=8)


@query(f"""WITH {_T}, s AS (SELECT seq, max(abs(new - old)) FILTER (WHERE mask = 1) AS worst FROM t GROUP BY seq),
    k AS (SELECT t.seq, least(exp(new - old) * mask, 1.03) AS w, CASE WHEN worst IS NULL OR 0.5 * worst * worst > 0.003 THEN 0 ELSE mask END AS m FROM t JOIN s ON t.seq = s.seq)
    SELECT seq, round(sum(w * m), 6) + 0.0 AS weight, CAST(sum(m) AS BIGINT) AS kept FROM k GROUP BY seq""")
def corr_combined(spark, sf):
    """Clamped weights and the rejection of sequences by their worst token, in one pass."""
    rows = C.correct(_tokens(spark, sf), "new", "old", "mask", upper=1.03, rules={"seq_max_k2": 0.003})
    return rows.select("seq", (F.round(A.masked_sum(F.col("weights"), F.col("kept_mask")), 6) + 0.0).alias("weight"), F.aggregate("kept_mask", F.lit(0).cast("bigint"), lambda s, m: s + m.cast("bigint")).alias("kept"))


# ---- statistics


@query(f"""WITH {_T}, s AS (SELECT seq, sum(adv * mask) / (sum(mask) + 1e-8) AS a, sum(({_W}) * mask) AS w FROM t GROUP BY seq)
    SELECT round(0.0025, 8) AS signal_strength, round(avg(a * a * greatest(w, 0)), 8) AS total_power, round(greatest(0, (avg(a * a * greatest(w, 0)) - 0.0025) / (count(*) - 1)), 8) AS pure_noise, round(avg(a * a), 8) AS expected_a_squared, round(avg(w), 8) AS expected_w FROM s""")
def metric_variance_proxies(spark, sf):
    return rounded(M.variance_proxies(_grouped(spark, sf), "adv", "old", "squares", "mask", gradient_norm=0.05), digits=8)


@query("""WITH s AS (SELECT user_id, event_id // 1000 AS step, count(*) AS n, sum(value) AS seconds FROM events GROUP BY 1, 2)
    SELECT step, sum(n) AS tokens, round(sum(seconds) * 1000 / sum(n), 5) AS ms_per_token, round(sum(n) / (max(seconds) * 8), 6) AS throughput FROM s GROUP BY 1""")
def metric_throughput(spark, sf):
    """Per step: time per token, and tokens per second and device by the slowest worker."""
    s = table(spark, sf, "events").groupBy("user_id", F.expr("event_id div 1000").alias("step")).agg(F.count("*").alias("n"), F.sum("value").alias("seconds"))
    return s.groupBy("step").agg(F.sum("n").alias("tokens"), F.round(F.sum("seconds") * 1000 / F.sum("n"), 5).alias("ms_per_token"), F.round(F.sum("n") / (F.max("seconds") * 8), 6).alias("throughput"))


@query("""WITH u AS (SELECT o_orderpriority AS source, o_custkey, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT source, round(avg(m), 4) AS mean_at_n, round(avg(s), 4) AS std_at_n, max(n) AS most FROM u GROUP BY 1""")
def metric_mean_std_at_n(spark, sf):
    """Mean and population deviation of a prompt's samples, averaged over the prompts of a source."""
    u = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("source"), "o_custkey").agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s"), F.count("*").alias("n"))
    return u.groupBy("source").agg(F.round(F.avg("m"), 4).alias("mean_at_n"), F.round(F.avg("s"), 4).alias("std_at_n"), F.max("n").alias("most"))


@query("""SELECT l_returnflag, abs(s.keys - e.keys) <= 0.05 * e.keys AS keys_within FROM (SELECT l_returnflag, count(DISTINCT l_partkey) AS keys FROM lineitem GROUP BY 1) e JOIN (SELECT l_returnflag, count(DISTINCT l_partkey) AS keys FROM lineitem GROUP BY 1) s USING (l_returnflag)""")
def metric_sketches(spark, sf):
    """A distinct count by a mergeable sketch lies within its error of the exact count."""
    x = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.hll_sketch_agg("l_partkey", 14).alias("sketch"), F.count_distinct("l_partkey").alias("keys"))
    return x.select("l_returnflag", (F.abs(F.hll_sketch_estimate("sketch") - F.col("keys")) <= 0.05 * F.col("keys")).alias("keys_within"))


@query()
def metric_bootstrap_majority(spark, sf):
    """The value of the majority of four draws, by customer; drawn at random, so without SQL."""
    return M.bootstrap(table(spark, sf, "orders"), "o_custkey", "o_totalprice", 4, draws=200, statistic="majority", prediction="o_orderpriority")
