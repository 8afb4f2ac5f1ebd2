"""Queries over joins, sets, batches, rules, selection and metrics, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievewright.operators import batch as B
from sievewright.operators import joins as J
from sievewright.operators import metrics as M
from sievewright.operators import rules as R
from sievewright.operators import selection as S
from sievewright.operators.components import entity_links, propagate_labels
from sievewright.session import broadcast_if_small, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KEY = "nullif(CASE WHEN lower(trim({0})) = 'nan' THEN '' ELSE lower(trim({0})) END, '')"


def _key(c):
    return F.nullif(F.when(F.lower(F.trim(c)) == "nan", F.lit("")).otherwise(F.lower(F.trim(c))), F.lit(""))


# ---- joins


@query(f"SELECT i.image_key, i.image_id, c.name AS category FROM images i LEFT JOIN categories c ON {_KEY.format('i.category_key')} = c.category_key")
def join_catalog(spark, sf):
    i, c = table(spark, sf, "images"), table(spark, sf, "categories").select("category_key", F.col("name").alias("category"))
    return i.select("image_key", "image_id", _key("category_key").alias("category_key")).join(c, "category_key", "left").drop("category_key")


@query(f"SELECT count(*) FILTER (WHERE {_KEY.format('i.category_key')} IS NULL) AS uncategorised, count(*) FILTER (WHERE {_KEY.format('i.category_key')} IS NOT NULL AND c.category_key IS NULL) AS unknown_category, (SELECT count(*) FROM categories c WHERE NOT EXISTS (SELECT 1 FROM images i WHERE {_KEY.format('i.category_key')} = c.category_key)) AS unused_categories FROM images i LEFT JOIN categories c ON {_KEY.format('i.category_key')} = c.category_key")
def join_catalog_integrity(spark, sf):
    i = table(spark, sf, "images").select(_key("category_key").alias("k"))
    c = table(spark, sf, "categories").select(F.col("category_key").alias("k"))
    known = i.join(c.withColumn("hit", F.lit(1)), "k", "left")
    counts = known.agg(F.count_if(F.col("k").isNull()).alias("uncategorised"), F.count_if(F.col("k").isNotNull() & F.col("hit").isNull()).alias("unknown_category"))
    return counts.crossJoin(c.join(i, "k", "left_anti").agg(F.count("*").alias("unused_categories")))


@query("SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def join_double_anti(spark, sf):
    banned = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    used = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(banned, "o_custkey", "left_anti").join(used, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05) GROUP BY 1")
def join_semi(spark, sf):
    hit = table(spark, sf, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(hit, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS customers, round(sum(c_acctbal), 2) AS customer_total FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers, round(sum(s_acctbal), 2) AS supplier_total FROM supplier GROUP BY 1)
    SELECT coalesce(c.k, s.k) AS nation, customers, customer_total, suppliers, supplier_total FROM c FULL JOIN s ON c.k = s.k""")
def join_full_outer(spark, sf):
    """All customers against all suppliers, each side summed up by nation, so that no nation multiplies its rows."""
    side = lambda n, p, one: table(spark, sf, n).groupBy(F.col(f"{p}_nationkey").alias("k")).agg(F.count("*").alias(f"{one}s"), F.round(F.sum(f"{p}_acctbal"), 2).alias(f"{one}_total"))
    c, s = side("customer", "c", "customer"), side("supplier", "s", "supplier")
    return c.join(s, c["k"] == s["k"], "full").select(F.coalesce(c["k"], s["k"]).alias("nation"), "customers", "customer_total", "suppliers", "supplier_total")


@query("""SELECT e.event_id, p.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_asof(spark, sf):
    """The last purchase at or before each event; a user's history is cut into days."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    p = table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", "ts", "value")
    return J.asof_last(e, p, ["user_id"], "ts", "value", "last_purchase").select("event_id", "last_purchase")


@query("""WITH b AS (SELECT event_id AS id, user_id, ts, ts + INTERVAL 6 HOUR AS te FROM events WHERE event_type = 'error')
    SELECT e.event_id, count(b.id) AS n_errors FROM events e JOIN b ON e.user_id = b.user_id AND e.ts > b.ts AND e.ts <= b.te GROUP BY 1""")
def join_interval(spark, sf):
    """Interval join with the time cut into blocks as part of the key: no user's history meets in one task."""
    hours = 6
    block = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / (hours * 3600))
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", block(F.col("ts")).alias("b"))
    errors = table(spark, sf, "events").where("event_type = 'error'").select("user_id", F.col("ts").alias("t0"), block(F.col("ts")).alias("b0"))
    errors = errors.select("user_id", "t0", F.explode(F.array("b0", F.col("b0") + 1)).alias("b"))
    near = e.join(errors, ["user_id", "b"]).where((F.col("ts") > F.col("t0")) & (F.col("ts") <= F.col("t0") + F.expr(f"INTERVAL {hours} HOURS")))
    return near.groupBy("event_id").agg(F.count("*").alias("n_errors"))


@query("""SELECT i.image_key, i.normalized_path FROM images i WHERE NOT EXISTS (SELECT 1 FROM sft_rows s WHERE s.image_key = i.image_key)
    AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(images).image AS p FROM sft_rows) x WHERE x.p = i.normalized_path)""")
def join_exclusion_either_key(spark, sf):
    """Excluded by key or by path: two anti joins, since an OR would need a nested loop."""
    s = table(spark, sf, "sft_rows")
    paths = s.select(F.explode("images").alias("x")).select(F.col("x.image").alias("normalized_path"))
    return table(spark, sf, "images").select("image_key", "normalized_path").join(s.select("image_key"), "image_key", "left_anti").join(paths, "normalized_path", "left_anti").select("image_key", "normalized_path")


@query("""WITH f AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE n_chars < 300 AND lang IS NOT NULL),
    r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE n_chars >= 1500)
    SELECT f.lang, f.k, f.doc_id AS failed_id, r.doc_id AS reserve_id FROM f LEFT JOIN r ON f.lang = r.lang AND f.k = r.k""")
def join_same_cell_replacement(spark, sf):
    d = table(spark, sf, "documents").where("lang is not null")
    failed = d.where("n_chars < 300").select("lang", F.col("doc_id").alias("failed_id"))
    reserve = d.where("n_chars >= 1500").select("lang", F.col("doc_id").alias("reserve_id"), (-F.col("n_chars")).alias("order"))
    return S.replace_in_cell(failed, reserve, ["lang"], ["failed_id"], ["order", "reserve_id"], "failed_id", "reserve_id")


@query("SELECT i.image_key FROM images i JOIN (SELECT DISTINCT image_key FROM sft_rows) s ON i.image_key = s.image_key GROUP BY 1 HAVING count(*) > 1")
def join_duplicate_deliveries(spark, sf):
    hit = table(spark, sf, "images").join(table(spark, sf, "sft_rows").select("image_key").distinct(), "image_key", "left_semi")
    return hit.groupBy("image_key").agg(F.count("*").alias("n")).where("n > 1").select("image_key")


@query("SELECT n_name, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND l_shipdate >= TIMESTAMP '1994-01-01' GROUP BY 1")
def join_star(spark, sf):
    t = lambda n: table(spark, sf, n)
    nations = t("nation").join(F.broadcast(t("region").where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t("customer").join(broadcast_if_small(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    lines = t("lineitem").where("l_shipdate >= timestamp_ntz'1994-01-01'").select("l_orderkey", "l_quantity")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.sum("l_quantity").alias("qty"))


# ---- sets and batches


@query("SELECT DISTINCT lower(trim(category_key)) AS k FROM images WHERE category_key IS NOT NULL UNION SELECT DISTINCT lower(trim(category_key)) FROM sft_rows WHERE category_key IS NOT NULL")
def set_union(spark, sf):
    k = lambda n: table(spark, sf, n).where("category_key is not null").select(F.lower(F.trim("category_key")).alias("k")).distinct()
    return k("images").union(k("sft_rows")).distinct()


@query("SELECT lower(trim(category_key)) AS k FROM documents WHERE category_key IS NOT NULL INTERSECT SELECT lower(trim(category_key)) FROM sft_rows WHERE category_key IS NOT NULL")
def set_intersect(spark, sf):
    k = lambda n: table(spark, sf, n).where("category_key is not null").select(F.lower(F.trim("category_key")).alias("k"))
    return k("documents").intersect(k("sft_rows"))


@query("SELECT category_key AS k FROM categories EXCEPT SELECT lower(trim(category_key)) FROM documents WHERE category_key IS NOT NULL")
def set_except(spark, sf):
    docs = table(spark, sf, "documents").where("category_key is not null").select(F.lower(F.trim("category_key")).alias("k"))
    return table(spark, sf, "categories").select(F.col("category_key").alias("k")).subtract(docs)


@query("SELECT o_orderkey, unnest(range(0, 3)) AS repeat_no FROM orders")
def batch_repeat(spark, sf):
    return B.repeat(table(spark, sf, "orders").select("o_orderkey"), 3)


@query("SELECT p_partkey, unnest(range(0, p_size)) AS repeat_no FROM part")
def batch_repeat_by_row(spark, sf):
    return B.repeat(table(spark, sf, "part").select("p_partkey", "p_size"), F.col("p_size")).drop("p_size")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i >= 10 AND i < 5000 AND (i - 10) % 7 = 0")
def batch_slice(spark, sf):
    return B.slice_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 10, 5000, 7)


@query("SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 64 AS INTEGER) AS chunk FROM customer")
def batch_split_sized(spark, sf):
    return B.split_sized(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 64)


@query("""WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier)
    SELECT s_suppkey, false AS is_padding FROM n UNION ALL SELECT s_suppkey, true FROM n JOIN (SELECT unnest(range(0, CAST((SELECT (64 - count(*) % 64) % 64 FROM supplier) AS BIGINT))) AS r) ON i = r % n""")
def batch_pad(spark, sf):
    return B.pad_to_divisor(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 64)


@query("SELECT l_orderkey, count(*) AS n_lines, list_sort(list(l_linenumber)) AS lines FROM lineitem GROUP BY 1")
def batch_fold(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list("l_linenumber")).alias("lines"))


@query("SELECT e.vec_id, i - 1 AS part, round(list_sum(list_slice(e.embedding::DOUBLE[], (i - 1) * 16 + 1, i * 16)), 6) AS s FROM embeddings e, (SELECT unnest(range(1, 5)) AS i)")
def batch_unfold(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("part"), "embedding")
    part = F.slice("embedding", (F.col("part") * 16 + 1).cast("int"), F.lit(16))
    return e.select("vec_id", "part", F.round(F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("s"))


# ---- rules and selection

_LEN = "CASE WHEN text IS NULL OR trim(text) = '' THEN 'no_text' WHEN source IS NULL THEN 'no_source' WHEN lang IS NULL OR trim(lang) = '' THEN 'no_lang' WHEN n_chars < 200 THEN 'short' END"


def _reasons(spark, sf):
    return R.cascade(table(spark, sf, "documents"), [("no_text", F.col("text").isNull() | (F.trim("text") == "")), ("no_source", F.col("source").isNull()), ("no_lang", F.col("lang").isNull() | (F.trim("lang") == "")), ("short", F.col("n_chars") < 200)])


@query(f"SELECT coalesce({_LEN}, '<kept>') AS reason, count(*) AS n FROM documents GROUP BY 1")
def rule_reason_counts(spark, sf):
    return R.reason_counts(_reasons(spark, sf))


@query(f"SELECT doc_id, reason FROM (SELECT doc_id, {_LEN} AS reason FROM documents) WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reason ORDER BY doc_id) <= 200")
def rule_preview(spark, sf):
    return R.preview(_reasons(spark, sf).select("doc_id", "reason"), ["doc_id"])


@query("SELECT coalesce(nullif(trim(lang), ''), '<missing>') AS lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def rule_profile(spark, sf):
    return table(spark, sf, "documents").groupBy(F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("<missing>")).alias("lang")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("""SELECT * FROM (SELECT sample_id, 'version' AS reason FROM sft_rows WHERE schema_version <> 3 UNION ALL SELECT sample_id, 'no_answers' FROM sft_rows WHERE coalesce(len(extra_info.answers), 0) = 0
    UNION ALL SELECT sample_id, 'turns' FROM sft_rows WHERE coalesce(len(messages), 0) <> 6 UNION ALL SELECT sample_id, 'images' FROM sft_rows WHERE coalesce(len(images), 0) = 0)""")
def rule_violations(spark, sf):
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    rules = [("version", F.col("schema_version") != 3), ("no_answers", n("extra_info.answers") == 0), ("turns", n("messages") != 6), ("images", n("images") == 0)]
    return R.violations(table(spark, sf, "sft_rows"), ["sample_id"], rules)


@query("SELECT image_key, count(DISTINCT (file_name, category_key)) AS payloads FROM images GROUP BY 1 HAVING count(DISTINCT (file_name, category_key)) > 1")
def rule_conflicts(spark, sf):
    return R.conflicts(table(spark, sf, "images"), ["image_key"], ["file_name", "category_key"])


@query("SELECT dedupe_key, source_row_index FROM qa_candidates QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY tiebreak, source_row_index) = 1")
def select_dedup(spark, sf):
    """The smallest (tiebreak, row) of each key, by an aggregate that combines before the shuffle."""
    best = table(spark, sf, "qa_candidates").groupBy("dedupe_key").agg(F.min(F.struct("tiebreak", "source_row_index")).alias("m"))
    return best.select("dedupe_key", F.col("m.source_row_index").alias("source_row_index"))


@query("""WITH q AS (SELECT coarse_taxon, question_type, CAST(floor(target_share * 200) AS BIGINT) AS quota FROM sample_targets),
    n AS (SELECT c.* EXCLUDE (coarse_taxon, question_type), t.canonical AS coarse_taxon, k.canonical AS question_type FROM qa_candidates c
          JOIN label_aliases t ON t.field_name = 'coarse_taxon' AND t.alias = lower(trim(c.coarse_taxon)) JOIN label_aliases k ON k.field_name = 'question_type' AND k.alias = lower(trim(c.question_type))),
    c AS (SELECT n.*, row_number() OVER (PARTITION BY coarse_taxon, question_type ORDER BY train_rank, tiebreak, source_row_index) AS cell_rank FROM n)
    SELECT source_row_index, coarse_taxon, question_type, cell_rank FROM c JOIN q USING (coarse_taxon, question_type) WHERE cell_rank <= quota""")
def select_quota(spark, sf):
    """Every spelling of a label competes for its cell's quota."""
    aliases, rows = table(spark, sf, "label_aliases"), table(spark, sf, "qa_candidates").select("source_row_index", "coarse_taxon", "question_type", "train_rank", "tiebreak")
    for c in ("coarse_taxon", "question_type"):
        names = aliases.where(F.col("field_name") == c).select(F.col("alias").alias("a"), F.col("canonical").alias("name"))
        rows = rows.join(broadcast_if_small(names), F.lower(F.trim(c)) == F.col("a")).withColumn(c, F.col("name")).drop("a", "name")
    quotas = table(spark, sf, "sample_targets").select("coarse_taxon", "question_type", F.floor(F.col("target_share") * 200).alias("quota"))
    return S.take_quota(rows, ["coarse_taxon", "question_type"], ["train_rank", "tiebreak", "source_row_index"], quotas).select("source_row_index", "coarse_taxon", "question_type", "cell_rank")


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE text IS NOT NULL) WHERE rank <= 5")
def select_top_per_group(spark, sf):
    return S.top_per_group(table(spark, sf, "documents").where("text is not null").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 5).select("source", "doc_id", "rank")


@query("SELECT lang, count(*) AS n, least(count(*), greatest(1, CAST(ceil(count(*) * 0.1) AS BIGINT))) AS target FROM documents GROUP BY 1")
def select_sample_target(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("target", S.sample_target(F.col("n"), 0.1))


@query("SELECT doc_id, sha256('s1' || chr(31) || doc_id) AS draw FROM documents ORDER BY draw LIMIT 100")
def select_digest_order(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", S.digest_order(F.col("doc_id"), seed="s1").alias("draw"))
    return d.orderBy("draw").limit(100)


@query("SELECT p_partkey, round(power(p_retailprice, 2) / sum(power(p_retailprice, 2)) OVER (), 9) AS share FROM part")
def select_resample_weights(spark, sf):
    return S.resample_weights(table(spark, sf, "part"), "p_retailprice", "pow", 2.0).select("p_partkey", F.round("share", 9).alias("share"))


@query("""WITH b AS (SELECT lower(trim(category_key)) AS k FROM documents WHERE category_key IS NOT NULL GROUP BY 1 HAVING count(*) < 3)
    SELECT d.doc_id FROM documents d WHERE lower(trim(d.category_key)) NOT IN (SELECT k FROM b)""")
def select_ban_sparse(spark, sf):
    d = table(spark, sf, "documents").where("category_key is not null").withColumn("k", F.lower(F.trim("category_key")))
    return d.join(d.groupBy("k").agg(F.count("*").alias("n")).where("n < 3"), "k", "left_anti").select("doc_id")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(parent_sample_id)) AS p, lower(trim(image_key)) AS c FROM sft_rows WHERE lower(trim(parent_sample_id)) NOT IN ('', 'nan') AND lower(trim(image_key)) NOT IN ('', 'nan')),
    links AS (SELECT DISTINCT x.c AS a, y.c AS b FROM e x JOIN e y ON x.p = y.p WHERE x.c <> y.c), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT a AS node, least(a, min(b)) AS label FROM reach GROUP BY a""")
def component_labels(spark, sf):
    """Images tied by the samples they stand in, labelled by the smallest image of their component."""
    edges = table(spark, sf, "sft_rows").select(_key("parent_sample_id").alias("p"), _key("image_key").alias("c"))
    return propagate_labels(entity_links(edges, "p", "c"))


# ---- metrics


@query("SELECT lang, source, count(*) AS n, sum(n_chars) AS chars, count(DISTINCT lower(trim(category_key))) AS cats FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def metric_distribution(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupingSets([["lang"], ["source"], ["lang", "source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct(F.lower(F.trim("category_key"))).alias("cats"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def metric_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def metric_rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


_MET = "m AS (SELECT CASE event_type WHEN 'click' THEN 'reward_max' WHEN 'view' THEN 'error_min' WHEN 'purchase' THEN 'loss' WHEN 'signup' THEN 'timing_s/gen' ELSE 'score_total' END AS metric, value, event_id FROM events)"


def _metrics(spark, sf):
    names = F.when(F.col("event_type") == "click", "reward_max").when(F.col("event_type") == "view", "error_min").when(F.col("event_type") == "purchase", "loss").when(F.col("event_type") == "signup", "timing_s/gen").otherwise("score_total")
    return table(spark, sf, "events").select(names.alias("metric"), "value", "event_id", F.lit(1.0).alias("w"))


@query(f"WITH {_MET} SELECT metric, round(CASE WHEN metric LIKE '%max%' THEN max(value) WHEN metric LIKE '%min%' THEN min(value) ELSE avg(value) END, 5) AS reduced FROM m GROUP BY 1")
def metric_reduce_by_name(spark, sf):
    return M.reduce_by_name(_metrics(spark, sf), "metric", "value").select("metric", F.round("reduced", 5).alias("reduced"))


@query(f"WITH {_MET} SELECT metric, round(CASE metric WHEN 'loss' THEN arg_max(value, event_id) WHEN 'reward_max' THEN max(value) WHEN 'error_min' THEN min(value) ELSE sum(value) END, 4) AS reduced FROM m GROUP BY 1")
def metric_aggregate_by_rule(spark, sf):
    return M.aggregate_by_rule(_metrics(spark, sf), "metric", "value", "w", "event_id", {"loss": "last"}).select("metric", F.round("reduced", 4).alias("reduced"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.95), 5) AS p95, round(quantile_cont(value, 0.99), 5) AS p99 FROM events GROUP BY 1")
def metric_percentiles(spark, sf):
    out = M.percentiles(table(spark, sf, "events"), "event_type", "value", {f"p{int(p * 100)}": p for p in (0.5, 0.95, 0.99)})
    return out.select("event_type", *[F.round(c, 5).alias(c) for c in ("p50", "p95", "p99")])


@query("""WITH i AS (SELECT coarse_taxon, parent_id, avg(CASE WHEN evidence_ok = 1 THEN 1.0 ELSE 0.0 END) AS m, bool_or(coalesce(evidence_ok, 0) = 1) AS f FROM qa_candidates GROUP BY 1, 2)
    SELECT coarse_taxon, round(avg(m), 6) AS score, count(*) AS n_items, round(avg(m) FILTER (WHERE f), 6) AS flagged_score, count(*) FILTER (WHERE f) AS n_flagged FROM i GROUP BY 1""")
def metric_two_level(spark, sf):
    rows = table(spark, sf, "qa_candidates").withColumn("score", F.when(F.col("evidence_ok") == 1, 1.0).otherwise(0.0))
    out = M.two_level_mean(rows, "coarse_taxon", "parent_id", "score", F.col("evidence_ok") == 1)
    return out.withColumn("score", F.round("score", 6)).withColumn("flagged_score", F.round("flagged_score", 6))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, round(sum(value * (power(i / n, 4) - power((i - 1) / n, 4))), 5) AS expected FROM r GROUP BY 1""")
def metric_best_at_n(spark, sf):
    return M.expected_best(table(spark, sf, "events"), "user_id", "value", 4).select("user_id", F.round("expected", 5).alias("expected"))


@query(None)
def metric_bootstrap(spark, sf):
    return M.bootstrap(table(spark, sf, "events"), "user_id", "value", 4)


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS p, arg_min(value, event_id) AS first_value FROM events GROUP BY 1, 2)
    SELECT user_id, first_value AS majority FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, p) = 1""")
def metric_majority(spark, sf):
    return M.majority_value(table(spark, sf, "events"), "user_id", "event_type", "value", "event_id")


@query("WITH l AS (SELECT n_chars % 16 AS part, sum(n_chars) AS load FROM documents GROUP BY 1) SELECT min(load) AS min_load, max(load) AS max_load, round(avg(load), 4) AS mean_load, max(load) - min(load) AS spread FROM l")
def metric_imbalance(spark, sf):
    out = M.imbalance(table(spark, sf, "documents").withColumn("part", F.col("n_chars") % 16), "part", "n_chars")
    return out.withColumn("mean_load", F.round("mean_load", 4))


@query("""WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c) SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS INTEGER) AS run_no FROM i""")
def metric_run_length(spark, sf):
    return J.run_numbers(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "run_no")


@query("SELECT l_shipmode_proxy AS flag, round(corr(l_discount, l_tax), 6) AS c, round(max(abs(l_discount - l_tax)), 6) AS most, round(avg(abs(l_discount - l_tax)), 6) AS mean, round(stddev_samp(abs(l_discount - l_tax)), 6) AS dev, count(*) FILTER (WHERE l_discount <> l_tax) AS differing FROM (SELECT l_returnflag AS l_shipmode_proxy, * FROM lineitem) GROUP BY 1")
def metric_differences(spark, sf):
    d = F.abs(F.col("l_discount") - F.col("l_tax"))
    r = lambda c: F.round(c, 6)
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(r(F.corr("l_discount", "l_tax")).alias("c"), r(F.max(d)).alias("most"), r(F.avg(d)).alias("mean"), r(F.stddev_samp(d)).alias("dev"), F.count_if(F.col("l_discount") != F.col("l_tax")).alias("differing"))


@query("SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS label FROM (SELECT DISTINCT user_id FROM events)")
def metric_factorize(spark, sf):
    """Labels from 0: ranks of distinct keys, by ranges rather than in one task."""
    return B.number_rows(table(spark, sf, "events").select("user_id").distinct(), "user_id", "label")


@query("SELECT user_id, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, arg_max(event_id, struct_pack(v := value, e := event_id)) AS slowest FROM events GROUP BY 1")
def metric_slowest(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.max_by("event_id", F.struct("value", "event_id")).alias("slowest"))
