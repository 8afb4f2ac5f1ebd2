"""Queries over advantages, token folds, losses and corrections, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import arrays as A
from sievewright.operators import advantage as ADV
from sievewright.operators import correction as C
from sievewright.operators import losses as L
from sievewright.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *keys, digits=6):
    return df.select(*keys, *[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 7321).alias("reward"), (F.length("o_orderpriority") + 1).cast("double").alias("len"))


_O = "o AS (SELECT o_orderkey, o_custkey, o_totalprice / 7321 AS reward, CAST(length(o_orderpriority) + 1 AS DOUBLE) AS len FROM orders)"
_G = "g AS (SELECT o_custkey AS k, count(*) AS n, avg(reward) AS m, stddev_samp(reward) AS s, sum(reward) AS t, sum(len * reward) / sum(len) AS b FROM o GROUP BY 1)"
_OG = f"WITH {_O}, {_G}, j AS (SELECT * FROM o JOIN g ON o.o_custkey = g.k)"


@query(f"{_OG} SELECT o_orderkey, round(CASE WHEN n = 1 THEN reward / (1 + 1e-6) ELSE (reward - m) / (s + 1e-6) END, 6) AS advantage FROM j")
def adv_grpo(spark, sf):
    return rounded(ADV.grpo(_orders(spark, sf), "o_custkey", "reward").select("o_orderkey", "advantage"))


@query(f"{_OG} SELECT o_orderkey, round(CASE WHEN n = 1 THEN reward ELSE reward - m END, 6) AS advantage FROM j")
def adv_grpo_no_std(spark, sf):
    return rounded(ADV.grpo(_orders(spark, sf), "o_custkey", "reward", by_deviation=False).select("o_orderkey", "advantage"))


@query(f"{_OG} SELECT o_orderkey, round(CASE WHEN n = 1 THEN reward ELSE (n * reward - t) / (n - 1) END, 6) AS advantage FROM j")
def adv_rloo(spark, sf):
    return rounded(ADV.rloo(_orders(spark, sf), "o_custkey", "reward").select("o_orderkey", "advantage"))


@query(f"{_OG} SELECT o_orderkey, round(CASE WHEN n = 1 THEN 0.0 ELSE (n * reward - t) / (n - 1) END, 6) AS advantage FROM j")
def adv_rloo_vectorised(spark, sf):
    return rounded(ADV.rloo(_orders(spark, sf), "o_custkey", "reward", lone_is_zero=True).select("o_orderkey", "advantage"))


@query(f"{_OG} SELECT o_orderkey, round(reward - CASE WHEN n = 1 THEN 0 ELSE b END, 6) AS advantage FROM j")
def adv_opo(spark, sf):
    return rounded(ADV.opo(_orders(spark, sf), "o_custkey", "reward", "len").select("o_orderkey", "advantage"))


@query(f"{_OG}, w AS (SELECT count(*) / greatest(count(*) FILTER (WHERE reward <> 0), 1) AS a FROM o) SELECT o_orderkey, round(a * (reward - CASE WHEN n = 1 THEN 0 ELSE m END), 6) AS advantage FROM j, w")
def adv_gpg(spark, sf):
    return rounded(ADV.gpg(_orders(spark, sf), "o_custkey", "reward").select("o_orderkey", "advantage"))


@query(f"""{_OG}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY reward DESC, o_orderkey) AS rk, nth_value(reward, 2) OVER (PARTITION BY o_custkey ORDER BY reward DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM j WHERE n > 1)
    SELECT o_orderkey, round(CASE WHEN rk = 1 THEN (reward - second) / (s + 1e-6) ELSE 0.0 END, 6) AS advantage FROM r""")
def adv_passk(spark, sf):
    return rounded(ADV.passk(_orders(spark, sf), "o_custkey", "reward", "o_orderkey").select("o_orderkey", "advantage"))


@query(f"""WITH {_O}, g AS (SELECT o_custkey AS k, count(*) AS n, avg(reward) AS m1, stddev_samp(reward) AS s1, avg(len) AS m2, stddev_samp(len) AS s2 FROM o GROUP BY 1),
    x AS (SELECT o_orderkey, CASE WHEN n = 1 THEN reward / (1 + 1e-6) + 0.5 * len / (1 + 1e-6) ELSE (reward - m1) / (s1 + 1e-6) + 0.5 * (len - m2) / (s2 + 1e-6) END AS v FROM o JOIN g ON o_custkey = k)
    SELECT o_orderkey, round((v - avg(v) OVER ()) / sqrt(var_samp(v) OVER () + 1e-8), 6) + 0.0 AS advantage FROM x""")
def adv_gdpo(spark, sf):
    return rounded(ADV.gdpo(_orders(spark, sf), "o_custkey", {"reward": 1.0, "len": 0.5}, "o_orderkey").select("o_orderkey", "advantage"))


@query(f"""{_OG}, c AS (SELECT o_orderkey, len, reward - CASE WHEN n = 1 THEN 0 ELSE m END AS v FROM j),
    w AS (SELECT sum(v * len) / sum(len) AS mu, (sum(v * v * len) / sum(len) - power(sum(v * len) / sum(len), 2)) * sum(len) / (sum(len) - 1) AS va FROM c)
    SELECT o_orderkey, round((v - mu) / sqrt(va + 1e-8), 5) AS advantage FROM c, w""")
def adv_reinforce_baseline(spark, sf):
    return rounded(ADV.reinforce_baseline(_orders(spark, sf), "o_custkey", "reward", "len").select("o_orderkey", "advantage"), digits=5)


@query("WITH f AS (SELECT user_id, arg_max(value, event_id) AS final_reward FROM events GROUP BY 1) SELECT event_id, final_reward FROM events JOIN f USING (user_id)")
def adv_session_final(spark, sf):
    return ADV.session_final(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value").select("event_id", "final_reward")


def _tokens(spark, sf):
    """Orders as token sequences, their lines in order."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (-F.col("l_discount")).alias("new"), (-F.col("l_tax")).alias("old"), F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("mask"), (F.col("l_quantity") / 50).alias("value"))
    seqs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    pick = lambda f: F.transform("lines", f)
    return seqs.select(
        F.col("l_orderkey").alias("seq"), pick(lambda x: x["new"]).alias("new"), pick(lambda x: x["old"]).alias("old"), pick(lambda x: x["mask"]).alias("mask"),
        pick(lambda x: x["l_extendedprice"] / 7321).alias("reward"), pick(lambda x: x["value"]).alias("value"), pick(lambda x: x["value"] - 0.5).alias("adv"), pick(lambda x: x["l_linenumber"]).alias("ids"),
    )


_T = """t AS (SELECT l_orderkey AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS t, -l_discount AS new, -l_tax AS old,
    CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS mask, l_extendedprice / 7321 AS reward, l_quantity / 50 AS value, l_quantity / 50 - 0.5 AS adv, l_linenumber AS ids FROM lineitem)"""


def _flat(df, column, out, digits=5):
    return df.select("seq", F.posexplode(column).alias("t", out)).select("seq", (F.col("t") + 1).cast("bigint").alias("t"), F.round(out, digits).alias(out))


@query(f"WITH {_T} SELECT seq, t, round(sum(reward) OVER (PARTITION BY seq ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 5) AS ret FROM t")
def tok_reward_to_go(spark, sf):
    return _flat(_tokens(spark, sf), A.suffix_fold(F.col("reward")), "ret")


@query(f"""WITH {_T}, g AS (SELECT *, sum(1 - mask) OVER (PARTITION BY seq ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t)
    SELECT seq, t, round(sum(reward * power(0.9, t)) OVER (PARTITION BY seq, coalesce(b, 0) ORDER BY t DESC) / power(0.9, t), 5) AS ret FROM g""")
def tok_masked_returns(spark, sf):
    return _flat(_tokens(spark, sf), A.masked_returns(F.col("reward"), F.col("mask"), 0.9), "ret")


@query(f"""WITH {_T}, m AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY t) AS k, lead(value, 1, 0.0) OVER (PARTITION BY seq ORDER BY t) AS nv FROM t WHERE mask = 1)
    SELECT seq, t, round(sum((reward + 0.99 * nv - value) * power(0.99 * 0.95, k)) OVER (PARTITION BY seq ORDER BY k DESC) / power(0.99 * 0.95, k), 5) AS gae FROM m""")
def tok_gae(spark, sf):
    rows = _tokens(spark, sf).withColumn("gae", A.gae(F.col("reward"), F.col("value"), F.col("mask"), 0.99, 0.95))
    both = rows.select("seq", F.posexplode(F.arrays_zip("gae", "mask")).alias("t", "x")).where("x.mask = 1")
    return both.select("seq", (F.col("t") + 1).cast("bigint").alias("t"), F.round("x.gae", 5).alias("gae"))


@query(f"""WITH {_T}, e AS (SELECT *, sum(CASE WHEN ids = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t)
    SELECT seq, t, CASE WHEN coalesce(before, 0) = 0 THEN 1 ELSE 0 END AS m FROM e""")
def tok_eos_mask(spark, sf):
    rows = _tokens(spark, sf).select("seq", F.posexplode(A.eos_mask(F.col("ids"), F.lit(3))).alias("t", "m"))
    return rows.select("seq", (F.col("t") + 1).cast("bigint").alias("t"), "m")


@query(f"WITH {_T} SELECT seq, t, greatest(0, sum(mask) OVER (PARTITION BY seq ORDER BY t) - 1) AS pos FROM t")
def tok_position_ids(spark, sf):
    rows = _tokens(spark, sf).select("seq", F.posexplode(A.position_ids(F.col("mask"))).alias("t", "pos"))
    return rows.select("seq", (F.col("t") + 1).cast("bigint").alias("t"), F.col("pos").cast("bigint").alias("pos"))


@query(f"""WITH {_T} SELECT seq, round(sum(reward * mask), 5) AS msum, round(sum(reward * mask) / (sum(mask) + 1e-8), 5) AS mmean, count(*) AS n, sum(mask) AS n_on,
    CAST(least(count(*), 3) AS BIGINT) AS n_cut FROM t GROUP BY seq""")
def tok_masked_stats(spark, sf):
    r, m = F.col("reward"), F.col("mask")
    return _tokens(spark, sf).select(
        "seq", F.round(A.masked_sum(r, m), 5).alias("msum"), F.round(A.masked_mean(r, m), 5).alias("mmean"), F.size(r).cast("bigint").alias("n"), F.size(A.unpad(r, m)).cast("bigint").alias("n_on"),
        F.size(A.truncate(r, 3, "left")).cast("bigint").alias("n_cut"),
    )


@query(f"""WITH {_T}, w AS (SELECT sum(reward * mask) / sum(mask) AS mu, (sum(reward * reward * mask) / sum(mask) - power(sum(reward * mask) / sum(mask), 2)) * sum(mask) / (sum(mask) - 1) AS va FROM t)
    SELECT round(mu, 5) AS mean, round(va, 4) AS var, (SELECT round(max((reward - mu) / sqrt(va + 1e-8)), 4) FROM t, w) AS top FROM w""")
def tok_whiten(spark, sf):
    lines = _tokens(spark, sf).select(F.explode(F.arrays_zip("reward", "mask")).alias("x")).select("x.*")
    n, s, q = F.sum("mask"), F.sum(F.col("reward") * F.col("mask")), F.sum(F.col("reward") * F.col("reward") * F.col("mask"))
    stats = lines.agg((s / n).alias("mu"), ((q / n - F.pow(s / n, F.lit(2))) * n / (n - 1)).alias("va"), F.max("reward").alias("most"))
    return stats.select(F.round("mu", 5).alias("mean"), F.round("va", 4).alias("var"), F.round((F.col("most") - F.col("mu")) / F.sqrt(F.col("va") + 1e-8), 4).alias("top"))


@query(f"""WITH {_T}, k AS (SELECT seq, new - old AS k1, abs(new - old) AS ka, 0.5 * power(new - old, 2) AS k2, exp(old - new) - (old - new) - 1 AS k3, mask FROM t)
    SELECT seq, round(sum(k1 * mask), 6) + 0.0 AS k1, round(sum(ka * mask), 6) AS k_abs, round(sum(k2 * mask), 6) AS k2, round(sum(k3 * mask), 6) AS k3 FROM k GROUP BY seq""")
def loss_kl_estimators(spark, sf):
    def total(kind):
        return F.round(A.masked_sum(F.zip_with("new", "old", lambda a, b: A.kl_estimate(a, b, kind)), F.col("mask")), 6) + 0.0

    kinds = {"k1": "k1", "k_abs": "abs", "k2": "k2", "k3": "k3"}
    return _tokens(spark, sf).select("seq", *[total(k).alias(out) for out, k in kinds.items()])


def _loss(spark, sf, name, **kw):
    rows = _tokens(spark, sf)
    f = L.LOSSES.get(name)
    return rows.withColumn("loss", L.per_token(lambda x: f(x, **kw), new=F.col("new"), old=F.col("old"), adv=F.col("adv")))


def _token_mean(expr):
    return f"WITH {_T}, r AS (SELECT *, exp(new - old) AS ratio FROM t), l AS (SELECT mask, {expr} AS l FROM r) SELECT round(sum(l * mask) / (sum(mask) + 1e-8), 6) AS loss FROM l"


def _add_loss(name: str, loss: str, expr: str, **kw):
    def run(spark, sf):
        return rounded(L.aggregate_loss(_loss(spark, sf, loss, **kw), "loss", "mask", "token-mean"))

    run.__name__ = name
    query(_token_mean(expr))(run)


_add_loss("loss_ppo_clip", "vanilla", "CASE WHEN adv < 0 THEN least(greatest(-adv * ratio, -adv * least(1.05, greatest(0.95, ratio))), -adv * 3) ELSE greatest(-adv * ratio, -adv * least(1.05, greatest(0.95, ratio))) END", low=0.05, high=0.05)
_add_loss("loss_sapo", "sapo", "CASE WHEN adv > 0 THEN -4 / (1 + exp(-(ratio - 1))) * adv ELSE -(4 / 1.05) / (1 + exp(-1.05 * (ratio - 1))) * adv END")
_add_loss("loss_gpg", "gpg", "-new * adv")
_add_loss("loss_cispo", "cispo", "-least(1.02, greatest(0.98, ratio)) * adv * new", low=0.02, high=0.02)
_add_loss("loss_reinforce", "reinforce", "-adv * new")
_add_loss("loss_dppo_tv", "dppo_tv", "CASE WHEN (adv > 0 AND exp(new) - exp(old) > 0.02) OR (adv < 0 AND exp(old) - exp(new) > 0.02) THEN 0 ELSE -adv * ratio END", threshold=0.02)


@query(f"""WITH {_T}, p AS (SELECT mask, adv, exp(new - old) AS ratio, least(1 - 1e-6, greatest(1e-6, exp(new))) AS p, least(1 - 1e-6, greatest(1e-6, exp(old))) AS q FROM t),
    k AS (SELECT *, q * ln(q / p) + (1 - q) * ln((1 - q) / (1 - p)) AS kl FROM p),
    l AS (SELECT mask, CASE WHEN kl > 0.01 AND ((adv > 0 AND p > q) OR (adv < 0 AND p < q)) THEN 0 ELSE -adv * ratio END AS l FROM k) SELECT round(sum(l * mask) / (sum(mask) + 1e-8), 6) AS loss FROM l""")
def loss_dppo_kl(spark, sf):
    return rounded(L.aggregate_loss(_loss(spark, sf, "dppo_kl", threshold=0.01), "loss", "mask", "token-mean"))


@query(f"""WITH {_T}, s AS (SELECT seq, exp(sum((new - old) * mask) / (sum(mask) + 1e-8)) AS r, sum(adv * mask) / (sum(mask) + 1e-8) AS a FROM t GROUP BY seq)
    SELECT round(avg(greatest(-a * r, -a * least(1.02, greatest(0.98, r)))), 6) AS loss FROM s""")
def loss_gspo(spark, sf):
    rows = _tokens(spark, sf).withColumn("a", A.masked_mean(F.col("adv"), F.col("mask")))
    return rows.agg(F.round(F.avg(L.gspo(F.col("new"), F.col("old"), F.col("mask"), F.col("a"), 0.02, 0.02)), 6).alias("loss"))


@query(f"""WITH {_T}, l AS (SELECT mask, 0.5 * greatest(power(value - reward, 2), power(least(0.5 + 0.1, greatest(0.5 - 0.1, value)) - reward, 2)) AS l FROM t)
    SELECT round(sum(l * mask) / (sum(mask) + 1e-8), 5) AS loss FROM l""")
def loss_value_clip(spark, sf):
    rows = _tokens(spark, sf).withColumn("half", F.transform("value", lambda _: F.lit(0.5)))
    rows = rows.withColumn("loss", L.per_token(lambda x: L.value_clip(x, 0.1), new=F.col("value"), old=F.col("half"), target=F.col("reward")))
    return rounded(L.aggregate_loss(rows, "loss", "mask", "token-mean"), digits=5)


@query(f"""WITH {_T}, s AS (SELECT seq, sum(-adv * new * mask) AS l, sum(mask) AS n FROM t GROUP BY seq)
    SELECT round(sum(l) / (sum(n) + 1e-8), 6) AS token_mean, round(avg(l) FILTER (WHERE n > 0), 6) AS seq_sum, round(sum(l) / 1000, 6) AS seq_sum_norm, round(avg(l / (n + 1e-8)) FILTER (WHERE n > 0), 6) AS seq_mean FROM s""")
def loss_aggregation_modes(spark, sf):
    rows = _loss(spark, sf, "reinforce")
    modes = (("token-mean", "token_mean"), ("seq-mean-token-sum", "seq_sum"), ("seq-mean-token-sum-norm", "seq_sum_norm"), ("seq-mean-token-mean", "seq_mean"))
    out = rows.agg(*[L.loss_value("loss", "mask", mode, 1000.0).alias(name) for mode, name in modes])
    return rounded(out)


@query(f"""WITH {_T}, w AS (SELECT seq, t, least(exp(new - old), 1.03) * mask AS tis, CASE WHEN exp(new - old) BETWEEN 0.97 AND 1.03 THEN exp(new - old) ELSE 0 END * mask AS ice FROM t)
    SELECT seq, round(sum(tis), 6) AS tis, round(sum(ice), 6) AS ice FROM w GROUP BY seq""")
def corr_weights(spark, sf):
    rows = _tokens(spark, sf).withColumn("ratio", C.log_ratio(F.col("new"), F.col("old")))
    tis = C.importance_weights(F.col("ratio"), F.col("mask"), upper=1.03)
    ice = C.importance_weights(F.col("ratio"), F.col("mask"), band=(0.97, 1.03))
    return rows.select("seq", F.round(A.array_sum(tis), 6).alias("tis"), F.round(A.array_sum(ice), 6).alias("ice"))


@query(f"""WITH {_T}, s AS (SELECT seq, sum(0.5 * power(new - old, 2) * mask) AS k2, sum(mask) AS n FROM t GROUP BY seq),
    k AS (SELECT t.seq, CASE WHEN abs(new - old) <= 0.05 AND s.k2 / (n + 1e-8) <= 0.001 THEN mask ELSE 0 END AS m FROM t JOIN s ON t.seq = s.seq) SELECT seq, sum(m) AS kept FROM k GROUP BY seq""")
def corr_rejection(spark, sf):
    rows = _tokens(spark, sf).withColumn("ratio", C.log_ratio(F.col("new"), F.col("old")))
    kept = C.rejection_mask(F.col("ratio"), F.col("mask"), {"token_k1": "-0.05_0.05", "seq_mean_k2": 0.001})
    return rows.select("seq", F.aggregate(kept, F.lit(0).cast("bigint"), lambda s, m: s + m.cast("bigint")).alias("kept"))


@query(f"""WITH {_T}, s AS (SELECT seq, sum(mask) AS n, sum(new * mask) / (sum(mask) + 1e-8) AS nm, sum(old * mask) / (sum(mask) + 1e-8) AS om, sum((new - old) * mask) AS lr,
        sum((exp(new - old) - (new - old) - 1) * mask) AS k3, sum(exp(2 * (new - old)) * mask) AS sq FROM t GROUP BY seq HAVING sum(mask) > 0)
    SELECT round(avg(exp(-nm)), 6) AS training_ppl, round(avg(exp(-om)), 6) AS rollout_ppl, round(-sum(lr) / sum(n), 6) AS kl, round(sum(k3) / sum(n), 6) AS k3_kl, round(avg(om - nm), 6) AS log_ppl_diff,
        round(sum(sq) / sum(n) - 1, 6) AS chi2_token, round(avg(exp(2 * lr)) - 1, 6) AS chi2_seq FROM s""")
def corr_off_policy(spark, sf):
    return rounded(C.off_policy_metrics(_tokens(spark, sf), "new", "old", "mask"))


@query(f"""WITH {_T}, w AS (SELECT exp(new - old) AS w, mask FROM t)
    SELECT round(sum(w * mask) / sum(mask), 6) AS mean_weight, round(min(w) FILTER (WHERE mask = 1), 6) AS min_weight, round(max(w) FILTER (WHERE mask = 1), 6) AS max_weight, round(power(sum(w * mask), 2) / sum(w * w * mask) / sum(mask), 6) AS ess FROM w""")
def corr_effective_sample_size(spark, sf):
    rows = _tokens(spark, sf).withColumn("w", F.zip_with("new", "old", lambda a, b: F.exp(a - b)))
    return rounded(C.effective_sample_size(rows, "w", "mask"))


@query(f"""WITH {_T}, k AS (SELECT seq, reward - 0.1 * (new - old) AS r, mask FROM t) SELECT seq, round(sum(r * mask), 5) AS penalised FROM k GROUP BY seq""")
def loss_kl_penalised_reward(spark, sf):
    r = L.per_token(lambda x: x["reward"] - 0.1 * A.kl_estimate(x["new"], x["old"], "k1"), reward=F.col("reward"), new=F.col("new"), old=F.col("old"))
    return _tokens(spark, sf).select("seq", F.round(A.masked_sum(r, F.col("mask")), 5).alias("penalised"))


@query("""SELECT vec_id, round(ln(list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x)))), 6) AS lse, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm,
    round((embedding::DOUBLE[])[label + 1] - ln(list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x)))), 6) AS log_prob FROM embeddings""")
def tok_logits(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", "label", e.alias("e"))
    lse = A.log_sum_exp(F.col("e"))
    return rows.select("vec_id", F.round(lse, 6).alias("lse"), F.round(F.sqrt(A.inner_product(F.col("e"), F.col("e"))), 6).alias("norm"), F.round(F.element_at("e", F.col("label") + 1) - lse, 6).alias("log_prob"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id, e, ln(list_sum(list_transform(e, lambda x: exp(x)))) AS z FROM e)
    SELECT vec_id, round(z - list_sum(list_transform(e, lambda x: exp(x - z) * x)), 6) AS entropy FROM s""")
def tok_entropy(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(A.entropy(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("entropy"))


@query("SELECT c_custkey, round(24576 * length(c_name) + power(length(c_name), 2), 1) AS workload FROM customer")
def tok_workload(spark, sf):
    n = F.length("c_name")
    return table(spark, sf, "customer").select("c_custkey", F.round((24576 * n + n * n).cast("double"), 1).alias("workload"))
