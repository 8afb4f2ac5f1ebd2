"""Queries that build and validate question-answering data sets, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievewright.functions import arrays as A
from sievewright.functions import text as T
from sievewright.operators import schedules as SC
from sievewright.operators.advantage import with_group
from sievewright.operators.batch import number_rows
from sievewright.operators.ranks import ranged_row_number
from sievewright.plans.analytics import _T, _tokens
from sievewright.session import table
from sievewright.sources import writers as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- corpus and evidence


@query("SELECT url, count(DISTINCT section_id) AS sections, max(section_id) + 1 - count(DISTINCT section_id) AS gaps, bool_and(id = url || '#section-' || section_id) AS ids_fit FROM text_corpus GROUP BY url")
def kb_sections(spark, sf):
    t = table(spark, sf, "text_corpus")
    fits = F.col("id") == F.concat("url", F.lit("#section-"), F.col("section_id"))
    return t.groupBy("url").agg(F.count_distinct("section_id").alias("sections"), (F.max("section_id") + 1 - F.count_distinct("section_id")).alias("gaps"), F.bool_and(fits).alias("ids_fit"))


def _pairs(spark, sf):
    return table(spark, sf, "sft_rows").select("sample_id", "built_at", F.explode("extra_info.wiki_pairs").alias("w")).where("w is not null").select("sample_id", "built_at", F.col("w.normalized_url").alias("url"))


@query("SELECT DISTINCT id FROM text_corpus WHERE url IN (SELECT w.normalized_url FROM (SELECT unnest(extra_info.wiki_pairs) AS w FROM sft_rows))")
def kb_trim(spark, sf):
    return table(spark, sf, "text_corpus").select("id", "url").join(_pairs(spark, sf).select("url"), "url", "left_semi").select("id").distinct()


@query("""WITH p AS (SELECT sample_id, built_at, unnest(extra_info.wiki_pairs).normalized_url AS url FROM sft_rows), k AS (SELECT DISTINCT url FROM text_corpus)
    SELECT sample_id, built_at, count(DISTINCT p.url) AS pages, count(DISTINCT k.url) AS known, count(DISTINCT p.url) = count(DISTINCT k.url) AS resolvable FROM p LEFT JOIN k ON p.url = k.url GROUP BY 1, 2""")
def kb_evidence(spark, sf):
    known = table(spark, sf, "text_corpus").select("url").distinct().withColumn("hit", F.col("url"))
    g = table(spark, sf, "sft_rows").select("sample_id", "built_at", F.explode("extra_info.wiki_pairs").alias("w")).select("sample_id", "built_at", F.col("w.normalized_url").alias("url"))
    out = g.join(known, "url", "left").groupBy("sample_id", "built_at").agg(F.count_distinct("url").alias("pages"), F.count_distinct("hit").alias("known"))
    return out.withColumn("resolvable", F.col("pages") == F.col("known"))


@query("SELECT url FROM (SELECT DISTINCT unnest(extra_info.wiki_pairs).normalized_url AS url FROM sft_rows) WHERE url IS NOT NULL EXCEPT SELECT url FROM text_corpus")
def kb_missing_urls(spark, sf):
    return _pairs(spark, sf).select("url").where("url is not null").distinct().join(table(spark, sf, "text_corpus").select("url"), "url", "left_anti")


@query("SELECT sample_id, built_at, len(list_distinct(list_filter(list_transform(extra_info.wiki_pairs, lambda w: w.normalized_url), lambda u: u IS NOT NULL))) > 1 AS multi_page FROM sft_rows WHERE extra_info.wiki_pairs IS NOT NULL")
def kb_multi_page(spark, sf):
    urls = F.array_distinct(F.filter(F.transform("extra_info.wiki_pairs", lambda w: w["normalized_url"]), lambda u: u.isNotNull()))
    return table(spark, sf, "sft_rows").where("extra_info.wiki_pairs is not null").select("sample_id", "built_at", (F.size(urls) > 1).alias("multi_page"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND len(string_split(text, ' ')) <= 100")
def filter_overlong(spark, sf):
    return table(spark, sf, "documents").where("text is not null").where(F.size(F.split("text", " ")) <= 100).select("doc_id")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT lower(trim(image_key)) FROM sft_rows WHERE extra_info.official_split = 'val' INTERSECT SELECT lower(trim(image_key)) FROM sft_rows WHERE extra_info.official_split = 'train')) AS shared_images")
def heldout_overlap(spark, sf):
    s = table(spark, sf, "sft_rows")
    k = lambda split: s.where(F.col("extra_info.official_split") == split).select(F.lower(F.trim("image_key")).alias("k"))
    return k("val").intersect(k("train")).agg(F.count("*").alias("shared_images"))


@query("SELECT source_row_index, dedupe_key FROM qa_candidates QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY tiebreak, source_row_index) > 1")
def dedup_rejections(spark, sf):
    """Rows that lose against a smaller (tiebreak, row) of their key."""
    c = table(spark, sf, "qa_candidates").select("dedupe_key", "tiebreak", "source_row_index")
    d = with_group(c, "dedupe_key", best=F.min(F.struct("tiebreak", "source_row_index")))
    return d.where(F.col("source_row_index") != F.col("best.source_row_index")).select("source_row_index", "dedupe_key")


@query("SELECT category_key, image_key, CAST((row_number() OVER (PARTITION BY category_key ORDER BY image_key) - 1) // 10 AS BIGINT) AS page FROM (SELECT DISTINCT category_key, image_key FROM images WHERE category_key IS NOT NULL)")
def keyset_pages(spark, sf):
    d = table(spark, sf, "images").where("category_key is not null").select("category_key", "image_key").distinct()
    return ranged_row_number(d, ["category_key"], "image_key", [], "n").withColumn("page", F.floor((F.col("n") - 1) / 10)).drop("n")


@query("SELECT sample_id, built_at, array_to_string(list_transform(images[1:2], lambda x: x.image), ';') AS prefix, len(images) AS n FROM sft_rows WHERE images IS NOT NULL")
def image_prefix(spark, sf):
    rows = table(spark, sf, "sft_rows").where("images is not null")
    return rows.select("sample_id", "built_at", F.array_join(F.transform(F.slice("images", 1, 2), lambda x: x["image"]), ";").alias("prefix"), F.size("images").cast("bigint").alias("n"))


@query("""SELECT sample_id, built_at, len(regexp_extract_all(messages[1].content, '<image>')) AS placeholders, len(images) AS n_images FROM sft_rows WHERE len(messages) > 0 AND messages[1].content IS NOT NULL AND images IS NOT NULL""")
def placeholder_count(spark, sf):
    first = F.get("messages", F.lit(0))["content"]
    rows = table(spark, sf, "sft_rows").where(first.isNotNull() & F.col("images").isNotNull())
    return rows.select("sample_id", "built_at", F.regexp_count(first, F.lit("<image>")).cast("bigint").alias("placeholders"), F.size("images").cast("bigint").alias("n_images"))


@query("SELECT sample_id, built_at, len(list_filter(messages, lambda m: m.content IS NOT NULL AND trim(m.content) <> '')) AS kept FROM sft_rows WHERE messages IS NOT NULL")
def drop_null_members(spark, sf):
    kept = F.filter("messages", lambda m: m["content"].isNotNull() & (F.trim(m["content"]) != ""))
    return table(spark, sf, "sft_rows").where("messages is not null").select("sample_id", "built_at", F.size(kept).cast("bigint").alias("kept"))


def _rendered(s):
    lines = F.transform(F.filter("messages", lambda m: m["role"].isNotNull()), lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), F.coalesce(m["content"], F.lit(""))))
    return s.where(F.size(lines) > 0).select("sample_id", "built_at", F.array_join(lines, "\n").alias("rendered"))


def _mask_ranges(s):
    n = F.transform("messages", lambda m: F.char_length(F.coalesce(m["content"], F.lit(""))).cast("bigint"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("ends"))
    ends = F.aggregate(n, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + x)).alias("ends")))["ends"]
    d = s.where("messages is not null").withColumn("x", F.arrays_zip("messages", ends.alias("e"), n.alias("n")))
    d = d.select("sample_id", "built_at", F.posexplode("x").alias("turn", "y")).where("y.messages.role = 'assistant'")
    return d.select("sample_id", "built_at", (F.col("turn") + 1).cast("bigint").alias("turn"), (F.col("y.e") - F.col("y.n")).alias("mask_start"), F.col("y.e").alias("mask_end"))


@query("""SELECT sample_id, built_at, string_agg('<|' || m.role || '|>' || coalesce(m.content, ''), chr(10) ORDER BY i) AS rendered FROM (
    SELECT sample_id, built_at, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM sft_rows) WHERE m.role IS NOT NULL GROUP BY 1, 2""")
def chat_template(spark, sf):
    """Chats rendered by a fixed template, every delivery of every sample."""
    return _rendered(table(spark, sf, "sft_rows"))


@query("""WITH m AS (SELECT sample_id, built_at, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM sft_rows),
    l AS (SELECT *, length(coalesce(m.content, '')) AS n FROM m) SELECT sample_id, built_at, i AS turn, CAST(sum(n) OVER (PARTITION BY sample_id, built_at ORDER BY i) - n AS BIGINT) AS mask_start, CAST(sum(n) OVER (PARTITION BY sample_id, built_at ORDER BY i) AS BIGINT) AS mask_end
    FROM l QUALIFY m.role = 'assistant'""")
def assistant_mask_ranges(spark, sf):
    """Character ranges of assistant turns, in which a loss would count, in every delivery of every sample."""
    return _mask_ranges(table(spark, sf, "sft_rows"))


@query("""WITH r AS (SELECT sample_id, built_at, m.content AS c FROM (SELECT sample_id, built_at, unnest(messages) AS m FROM sft_rows) WHERE m.role = 'tool' AND m.content LIKE 'Doc 1%')
    SELECT sample_id, built_at, c[1:strpos(c || chr(10) || 'Doc 2(', chr(10) || 'Doc 2(') - 1] AS first_doc FROM r""")
def visible_segment(spark, sf):
    """The first document of a tool's listing, up to the next marker."""
    m = table(spark, sf, "sft_rows").select("sample_id", "built_at", F.explode("messages").alias("m")).where("m.role = 'tool' and m.content like 'Doc 1%'")
    return m.select("sample_id", "built_at", F.substring_index("m.content", "\nDoc 2(", 1).alias("first_doc"))


@query("SELECT category_key, 'data:image/jpeg;base64,' || base64(encode(name)) AS url FROM categories")
def data_url(spark, sf):
    return table(spark, sf, "categories").select("category_key", F.concat(F.lit("data:image/jpeg;base64,"), F.base64(F.encode("name", "UTF-8"))).alias("url"))


@query("""WITH k AS (SELECT DISTINCT source, lower(trim(category_key)) AS k FROM documents WHERE category_key IS NOT NULL AND source IS NOT NULL), b AS (SELECT source, substr(md5(k), 1, 2) AS b, sha256(string_agg(k, chr(10) ORDER BY k)) AS d FROM k GROUP BY 1, 2)
    SELECT source, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM b GROUP BY 1""")
def set_digest(spark, sf):
    """Digest of a set, whatever its order: a digest of its buckets' digests, so that no task gathers a whole source."""
    d = table(spark, sf, "documents").where("category_key is not null and source is not null").select("source", F.lower(F.trim("category_key")).alias("k")).distinct()
    return W.set_digest(d, "source", "k")


@query("""SELECT coarse_taxon, CASE WHEN evidence_ok IS NULL THEN 'unchecked' WHEN evidence_ok = 0 THEN 'no_evidence' END AS reason, count(*) AS n FROM qa_candidates WHERE coalesce(evidence_ok, 0) = 0
    GROUP BY GROUPING SETS ((coarse_taxon, reason), (reason), ())""")
def failure_counters(spark, sf):
    reason = F.when(F.col("evidence_ok").isNull(), "unchecked").when(F.col("evidence_ok") == 0, "no_evidence")
    d = table(spark, sf, "qa_candidates").where("coalesce(evidence_ok, 0) = 0").select("coarse_taxon", reason.alias("reason"))
    return d.groupingSets([["coarse_taxon", "reason"], ["reason"], []], "coarse_taxon", "reason").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // ((SELECT count(*) FROM orders) // 8) AS BIGINT) AS shard FROM orders QUALIFY shard < 8")
def contiguous_shards(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    size = max(1, o.count() // 8)
    return number_rows(o, "o_orderkey", "i").withColumn("shard", F.floor(F.col("i") / size)).where("shard < 8").drop("i")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def permutation_inverse(spark, sf):
    """Where each row goes when rows are ordered by price."""
    ranked = ranged_row_number(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [], "o_totalprice", ["o_orderkey"], "n")
    return ranked.select("o_orderkey", (F.col("n") - 1).alias("place"))


# ---- training statistics


@query("SELECT l_orderkey, max(l_linenumber) - min(l_linenumber) AS span, max(l_linenumber) <> min(l_linenumber) AS is_partial FROM lineitem GROUP BY 1")
def partial_span(spark, sf):
    span = F.max("l_linenumber") - F.min("l_linenumber")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(span.alias("span"), (span != 0).alias("is_partial"))


@query("""WITH s AS (SELECT event_id // 200 AS step, avg(value) AS kl FROM events GROUP BY 1)
    SELECT step, round(0.2 * exp(sum(ln(1 + least(0.2, greatest(-0.2, kl / 60 - 1)) * 64 / 1000)) OVER (ORDER BY step)), 6) AS coefficient FROM s""")
def kl_controller(spark, sf):
    steps = table(spark, sf, "events").groupBy(F.expr("event_id div 200").alias("step")).agg(F.avg("value").alias("kl"))
    return SC.controller_path(steps, "step", "kl", 0.2, 60.0, 1000.0, 64.0).select("step", F.round("coefficient", 6).alias("coefficient"))


@query("""SELECT step, round(CASE WHEN step < 10 THEN step / 10.0::DOUBLE ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (step - 10) / 90.0)) END, 9) AS cosine, round(CASE WHEN step < 10 THEN step / 10.0::DOUBLE WHEN step < 60 THEN 1.0 WHEN step < 100 THEN 0.5 * (1 + cos(pi() * (step - 60) / 40.0)) ELSE 0 END, 9) AS wsd,
    round(CASE WHEN step < 10 THEN step / 10.0::DOUBLE ELSE 1.0 END, 9) AS flat FROM (SELECT unnest(range(0, 120)) AS step)""")
def rate_schedules(spark, sf):
    s = spark.range(120).withColumnRenamed("id", "step")
    c = F.col("step")
    return s.select("step", F.round(SC.cosine_rate(c, 10, 100, 0.1), 9).alias("cosine"), F.round(SC.wsd_rate(c, 10, 50, 40), 9).alias("wsd"), F.round(SC.constant_rate(c, 10), 9).alias("flat"))


@query("SELECT doc_id, round(least(0, -(n_chars - 800) / 200.0::DOUBLE), 6) + 0.0 AS penalty, round(6 * n_chars * 1e9 + 12.0 * n_chars * n_chars * 32 * 8 * 128, 0) AS flops FROM documents")
def length_costs(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", (F.round(SC.overlong_penalty(n, 1000, 200), 6) + 0.0).alias("penalty"), F.round(SC.dense_flops(n, n * n, 10**9, 32, 8, 128), 0).alias("flops"))


@query(f"WITH {_T}, s AS (SELECT seq, t, new, lead(mask, 1, 0) OVER (PARTITION BY seq ORDER BY t) AS m FROM t) SELECT round(-sum(new * m) / sum(m), 6) AS loss FROM s")
def loss_sft(spark, sf):
    """Mean negative log-probability under the mask shifted left by one token."""
    shifted = F.concat(F.slice("mask", F.lit(2), F.greatest(F.lit(0), F.size("mask") - 1)), F.array(F.lit(0)))
    t = _tokens(spark, sf).withColumn("m", shifted)
    return t.agg(F.round(-F.sum(A.masked_sum(F.col("new"), F.col("m"))) / F.sum(A.array_sum(F.transform("m", lambda m: m.cast("double")))), 6).alias("loss"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 5) AS z FROM embeddings), s AS (SELECT vec_id, list_sort(z, 'DESC')[1:8] AS top, ln(list_sum(list_transform(z, lambda x: exp(x)))) AS lse FROM e)
    SELECT vec_id, round(list_sum(list_transform(top, lambda x: exp(x - lse))), 6) AS mass, round(top[8], 6) AS edge FROM s""")
def logits_top_k(spark, sf):
    """Probability mass of the eight likeliest tokens, and the logit at which a top-k filter cuts."""
    z = F.transform("embedding", lambda x: x.cast("double") * 5)
    s = table(spark, sf, "embeddings").select("vec_id", z.alias("z")).select("vec_id", F.slice(F.sort_array("z", asc=False), 1, 8).alias("top"), A.log_sum_exp(F.col("z")).alias("lse"))
    return s.select("vec_id", F.round(A.let(F.col("lse"), lambda v: F.aggregate("top", F.lit(0.0), lambda a, x: a + F.exp(x - v))), 6).alias("mass"), F.round(F.element_at("top", 8), 6).alias("edge"))


@query(f"""WITH {_T}, k AS (SELECT seq, t, mask, exp(old) * (old - new) AS kl FROM t) SELECT seq, round(sum(kl * mask), 6) + 0.0 AS forward_kl, round(max(kl) FILTER (WHERE mask = 1), 6) + 0.0 AS most FROM k GROUP BY seq""")
def loss_distillation(spark, sf):
    """Forward divergence of the teacher's token probabilities, and its largest token."""
    kl = F.zip_with("new", "old", lambda n, o: F.exp(o) * (o - n))
    kept = F.filter(F.zip_with(kl, "mask", lambda v, m: F.when(m == 1, v)), lambda v: v.isNotNull())
    return _tokens(spark, sf).select("seq", (F.round(A.masked_sum(kl, F.col("mask")), 6) + 0.0).alias("forward_kl"), (F.round(F.array_max(kept), 6) + 0.0).alias("most"))


@query(f"""WITH {_T}, s AS (SELECT seq, sum(reward) AS score, count(*) AS len, sum(mask) AS on_len, sum(value) AS v FROM t GROUP BY seq)
    SELECT round(avg(score), 4) AS score_mean, round(max(score), 4) AS score_max, round(min(score), 4) AS score_min, round(avg(len), 6) AS len_mean, round(avg(CASE WHEN len >= 7 THEN 1.0 ELSE 0.0 END), 6) AS clip_ratio,
        round(avg(CASE WHEN on_len = 0 THEN 1.0 ELSE 0.0 END), 6) AS aborted_ratio, round(1 - var_samp(score - v) / var_samp(score), 5) AS explained_variance FROM s""")
def batch_metrics(spark, sf):
    s = _tokens(spark, sf).select(A.array_sum(F.col("reward")).alias("score"), F.size("reward").alias("len"), A.array_sum(F.transform("mask", lambda m: m.cast("double"))).alias("on_len"), A.array_sum(F.col("value")).alias("v"))
    r = lambda c, d=4: F.round(c, d)
    return s.agg(
        r(F.avg("score")).alias("score_mean"), r(F.max("score")).alias("score_max"), r(F.min("score")).alias("score_min"), r(F.avg("len"), 6).alias("len_mean"), r(F.avg(F.when(F.col("len") >= 7, 1.0).otherwise(0.0)), 6).alias("clip_ratio"),
        r(F.avg(F.when(F.col("on_len") == 0, 1.0).otherwise(0.0)), 6).alias("aborted_ratio"), r(1 - F.var_samp(F.col("score") - F.col("v")) / F.var_samp("score"), 5).alias("explained_variance"),
    )


@query("SELECT l_returnflag, round(avg(CASE WHEN l_tax > 0 THEN l_discount / l_tax ELSE 0 END), 6) AS accepted FROM lineitem GROUP BY 1")
def ratio_mean(spark, sf):
    """Mean ratio with empty denominators counted as 0."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.when(F.col("l_tax") > 0, F.col("l_discount") / F.col("l_tax")).otherwise(0.0)), 6).alias("accepted"))


@query("""WITH m AS (SELECT source, lang, count(*) AS n, avg(n_chars) AS v FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2)
    SELECT source, lang, CASE WHEN n = max(n) OVER (PARTITION BY source) THEN 'core/' ELSE 'aux/' END || lang AS metric, round(v, 4) AS v FROM m""")
def metric_labels(spark, sf):
    m = table(spark, sf, "documents").where("source is not null and lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("v"))
    top = F.max("n").over(Window.partitionBy("source"))
    return m.select("source", "lang", F.concat(F.when(F.col("n") == top, "core/").otherwise("aux/"), F.col("lang")).alias("metric"), F.round("v", 4).alias("v"))


@query("SELECT doc_id, CASE WHEN starts_with(coalesce(source, ''), 'kb_') THEN source ELSE 'src/' || coalesce(source, 'none') END AS named FROM documents")
def metric_prefix(spark, sf):
    s = F.coalesce("source", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.when(s.startswith("kb_"), F.col("source")).otherwise(F.concat(F.lit("src/"), F.coalesce("source", F.lit("none")))).alias("named"))


@query("SELECT lower(trim(s.category_key)) AS k, count(*) AS n, count(*) FILTER (WHERE retrieval_resolvable) AS resolvable, count(DISTINCT image_key) AS images FROM sft_rows s WHERE lower(trim(category_key)) NOT IN ('', 'nan') GROUP BY 1 HAVING count(*) >= 3")
def min_candidates(spark, sf):
    k = T.key_text("category_key")
    g = table(spark, sf, "sft_rows").select(k.alias("k"), "retrieval_resolvable", "image_key").where("k is not null").groupBy("k")
    return g.agg(F.count("*").alias("n"), F.count_if("retrieval_resolvable").alias("resolvable"), F.count_distinct("image_key").alias("images")).where("n >= 3")
