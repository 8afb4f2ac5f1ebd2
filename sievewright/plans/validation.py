"""Queries that validate rows, conversations, searches and manifests, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.operators import batch as B
from sievewright.operators import retrieval as R
from sievewright.operators import selection as S
from sievewright.operators import validation as V
from sievewright.operators.ranks import ranged_row_number
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


_FULL = "coalesce(CASE WHEN lower(trim({0})) = 'nan' THEN '' ELSE trim({0}) END, '') <> ''"
ROLES = ("user", "assistant", "tool", "assistant", "tool", "assistant")


@query(f"""SELECT sample_id, built_at, CASE WHEN schema_version IS DISTINCT FROM 3 THEN 'version' WHEN NOT {_FULL.format('sample_id')} THEN 'sample_id' WHEN NOT {_FULL.format('parent_sample_id')} THEN 'parent' WHEN NOT {_FULL.format('image_key')} THEN 'image_key'
    WHEN coalesce(source_image_index, 0) <= 0 THEN 'image_index' WHEN lower(trim(coarse_taxon)) NOT IN (SELECT alias FROM label_aliases WHERE field_name = 'coarse_taxon') OR coarse_taxon IS NULL THEN 'taxon'
    WHEN coalesce(len(images), 0) <> 1 THEN 'one_image' WHEN NOT {_FULL.format('images[1].image')} THEN 'image_path' WHEN coalesce(len(extra_info.answers), 0) = 0 THEN 'answers' END AS fault FROM sft_rows""")
def valid_sft_rows(spark, sf):
    """First fault of every fine-tuning row; labels may be spelled as their aliases are."""
    aliases = table(spark, sf, "label_aliases").where("field_name = 'coarse_taxon'").select(F.col("alias").alias("__a"), F.lit(True).alias("__known")).dropDuplicates(["__a"])
    rows = table(spark, sf, "sft_rows").join(F.broadcast(aliases.limit(10_000)), F.lower(F.trim("coarse_taxon")) == F.col("__a"), "left")
    fault = V.first_fault(
        ("version", F.col("schema_version") == 3), ("sample_id", V.filled("sample_id")), ("parent", V.filled("parent_sample_id")), ("image_key", V.filled("image_key")), ("image_index", F.col("source_image_index") > 0),
        ("taxon", F.col("__known")), ("one_image", V.size_of("images") == 1), ("image_path", V.filled(F.get("images", F.lit(0))["image"])), ("answers", V.size_of("extra_info.answers") > 0),
    )
    return rows.select("sample_id", "built_at", fault.alias("fault"))


_CALLS = "coalesce(len(list_filter(messages[{0}].tool_calls, lambda c: c IS NOT NULL)), 0)"
_NAME = "list_filter(messages[{0}].tool_calls, lambda c: c IS NOT NULL)[1].function.name"


@query(f"""WITH n AS (SELECT *, CASE WHEN json_valid(tools) THEN CAST(json_extract(tools, '$[*].function.name') AS VARCHAR[]) END AS raw FROM sft_rows), k AS (SELECT *, list_transform(raw, lambda x: trim(x, '"')) AS names FROM n)
    SELECT sample_id, built_at, CASE WHEN list_transform(messages, lambda m: m.role) IS DISTINCT FROM ['user', 'assistant', 'tool', 'assistant', 'tool', 'assistant'] THEN 'roles' WHEN coalesce(len(names), 0) = 0 THEN 'tools'
    WHEN {_CALLS.format(2)} <> 1 THEN 'one_call:1' WHEN NOT coalesce(list_contains(names, {_NAME.format(2)}), false) THEN 'known_tool:1' WHEN messages[3].name IS DISTINCT FROM {_NAME.format(2)} OR messages[3].name IS NULL THEN 'answered:1' WHEN NOT {_FULL.format('messages[3].content')} THEN 'text:2'
    WHEN {_CALLS.format(4)} <> 1 THEN 'one_call:3' WHEN NOT coalesce(list_contains(names, {_NAME.format(4)}), false) THEN 'known_tool:3' WHEN messages[5].name IS DISTINCT FROM {_NAME.format(4)} OR messages[5].name IS NULL THEN 'answered:3' WHEN NOT {_FULL.format('messages[5].content')} THEN 'text:4'
    WHEN NOT {_FULL.format('messages[6].content')} THEN 'text:5' WHEN {_CALLS.format(6)} <> 0 THEN 'no_call:5' END AS fault FROM k""")
def valid_conversations(spark, sf):
    """First fault of every conversation: its roles, its tools, and turn by turn its calls."""
    fault = V.conversation_fault(F.col("messages"), ROLES, F.col("tools"))
    return table(spark, sf, "sft_rows").select("sample_id", "built_at", fault.alias("fault"))


_QI = "extra_info.query_images"


@query(f"""SELECT sample_id, built_at, CASE WHEN coalesce(len({_QI}), 0) = 0 THEN 'empty' WHEN len(list_filter({_QI}, lambda x: x IS NULL)) > 0 THEN 'null_item'
    WHEN len(list_filter({_QI}, lambda x, i: x.image_index IS DISTINCT FROM i)) > 0 THEN 'index' WHEN len(list_filter({_QI}, lambda x: NOT {_FULL.format('x.image_key')})) > 0 THEN 'text:image_key' WHEN len(list_filter({_QI}, lambda x: NOT {_FULL.format('x.image')})) > 0 THEN 'text:image'
    WHEN len({_QI}) <> len(list_distinct(list_transform({_QI}, lambda x: x.image_key))) THEN 'unique:image_key' END AS fault FROM sft_rows""")
def valid_image_lists(spark, sf):
    """First fault of every sample's list of query images: places from 1, keys and paths, each key once."""
    fault = V.image_list_fault(F.col("extra_info.query_images"), ("image_key", "image"), "image_index", ("image_key",))
    return table(spark, sf, "sft_rows").select("sample_id", "built_at", fault.alias("fault"))


@query(f"""SELECT image_key, array_to_string(list_filter([CASE WHEN NOT {_FULL.format('image_id')} THEN 'image_id' END, CASE WHEN NOT {_FULL.format('normalized_path')} THEN 'path' END, CASE WHEN NOT {_FULL.format('category_key')} THEN 'category' END, CASE WHEN observed_at IS NULL OR ingested_at < observed_at THEN 'times' END], lambda x: x IS NOT NULL), ';') AS faults, count(*) AS n
    FROM images GROUP BY 1, 2 HAVING faults <> ''""")
def image_failures(spark, sf):
    """All faults of every image, and how often it was delivered with them."""
    times = F.col("observed_at").isNotNull() & F.coalesce(~(F.col("ingested_at") < F.col("observed_at")), F.lit(True))
    faults = V.all_faults(("image_id", V.filled("image_id")), ("path", V.filled("normalized_path")), ("category", V.filled("category_key")), ("times", times))
    return table(spark, sf, "images").select("image_key", F.array_join(faults, ";").alias("faults")).where("faults <> ''").groupBy("image_key", "faults").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT vec_id AS query_id, CAST(NULL AS VARCHAR) AS fault FROM embeddings WHERE vec_id % 50 = 0")
def valid_search(spark, sf):
    """The vector search's hits hold all the rules of a result: count, finite scores, no repeats, ranks and order."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = R.dense_topk(q, e.select(F.col("vec_id").alias("doc_id"), "embedding"), "query_id", "doc_id", "embedding", 10)
    return V.search_fault(found, 10)


@query("""WITH a AS (SELECT image_key, file_name, category_key, ingested_at >= TIMESTAMP '2024-06-01' AS late FROM images), g AS (SELECT image_key, bool_or(NOT late) AS known, min((coalesce(file_name, ''), coalesce(category_key, ''))) AS lo, max((coalesce(file_name, ''), coalesce(category_key, ''))) AS hi FROM a WHERE late IS NOT NULL GROUP BY 1)
    SELECT 'insert' AS outcome, count(*) AS n FROM g WHERE NOT known AND lo = hi UNION ALL SELECT 'conflict', count(*) FROM g WHERE lo <> hi""")
def insert_images(spark, sf):
    """Late deliveries inserted into the table of the earlier ones: how many keys are new, and how many contradict."""
    i = table(spark, sf, "images").select("image_key", F.coalesce("file_name", F.lit("")).alias("file_name"), F.coalesce("category_key", F.lit("")).alias("category_key"), (F.col("ingested_at") >= F.expr("timestamp_ntz'2024-06-01'")).alias("late"))
    fresh, bad = V.insert_or_ignore(i.where("not late").drop("late"), i.where("late").drop("late"), ["image_key"])
    count = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("outcome"), "n")
    return count(fresh, "insert").unionByName(count(bad, "conflict"))


@query("""SELECT source_row_index, CASE WHEN NOT json_valid(payload_json) OR json_type(payload_json) <> 'OBJECT' THEN 'not_object' WHEN list_sort(json_keys(payload_json)) <> ['answer', 'question', 'wikipedia_url'] THEN 'keys'
    WHEN trim(coalesce(json_extract_string(payload_json, '$.question'), '')) = '' THEN 'string:question' WHEN trim(coalesce(json_extract_string(payload_json, '$.answer'), '')) = '' THEN 'string:answer' END AS fault FROM qa_candidates WHERE payload_json IS NOT NULL""")
def valid_payloads(spark, sf):
    """First fault of every candidate's payload: an object with exactly these members, question and answer not blank."""
    fault = V.json_fault(F.col("payload_json"), {"question": "string", "answer": "string", "wikipedia_url": "string"})
    return table(spark, sf, "qa_candidates").where("payload_json is not null").select("source_row_index", F.when(fault == "string:wikipedia_url", None).otherwise(fault).alias("fault"))


@query("""SELECT coalesce(nullif(lower(trim(question_type)), ''), '<missing>') || '|' || coalesce(len(images), 0) AS bucket, count(*) AS n, count(DISTINCT sample_id) AS samples FROM sft_rows GROUP BY 1""")
def bucket_counts(spark, sf):
    """Rows and samples by question type and number of images."""
    kind = F.coalesce(F.nullif(F.lower(F.trim("question_type")), F.lit("")), F.lit("<missing>"))
    rows = table(spark, sf, "sft_rows").select(F.concat(kind, F.lit("|"), V.size_of("images").cast("string")).alias("bucket"), "sample_id")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("samples"))


@query("""SELECT source_row_index, row_number() OVER (ORDER BY train_rank, tiebreak, source_row_index) AS place FROM qa_candidates WHERE evidence_ok = 1""")
def spool_scan(spark, sf):
    """Candidates with evidence in the order in which they are drawn."""
    c = table(spark, sf, "qa_candidates").where("evidence_ok = 1").select("source_row_index", "train_rank", "tiebreak")
    return ranged_row_number(c, [], "train_rank", ["tiebreak", "source_row_index"], "place").select("source_row_index", "place")


@query("""WITH d AS (SELECT unnest([0, 1]) AS epoch), k AS (SELECT o_orderkey, epoch::INTEGER AS epoch, row_number() OVER (PARTITION BY epoch ORDER BY substr(md5('7/' || epoch || '/' || o_orderkey), 1, 15), o_orderkey) - 1 AS i FROM orders, d)
    SELECT o_orderkey, epoch, CAST(i // 64 AS INTEGER) AS batch_no, CAST(i % 64 AS INTEGER) AS place FROM k WHERE i // 64 < (SELECT count(*) // 64 FROM orders)""")
def batch_mini(spark, sf):
    """Two epochs of mini-batches in shuffled orders."""
    return B.mini_batches(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 64, epochs=2, seed=7)


@query("""SELECT s_suppkey, false AS is_padding FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier), true FROM range(3)""")
def batch_pad_last(spark, sf):
    return B.pad_with_end(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 3)


@query("""WITH c AS (SELECT event_id // 100 AS batch, event_id, json_extract(props, '$.k')::BIGINT % 7 AS n FROM events), m AS (SELECT batch, max(n) AS width FROM c GROUP BY 1)
    SELECT event_id, n AS kept, width - n AS padded FROM c JOIN m USING (batch)""")
def batch_collate(spark, sf):
    """Sequences of a batch padded to its longest one: how much of each row is padding."""
    e = table(spark, sf, "events").select("event_id", F.expr("event_id div 100").alias("batch"), (F.get_json_object("props", "$.k").cast("bigint") % 7).alias("n"))
    width = e.groupBy("batch").agg(F.max("n").alias("width"))
    return e.join(width, "batch").select("event_id", F.col("n").alias("kept"), (F.col("width") - F.col("n")).alias("padded"))


@query("""WITH c AS (SELECT category_key, name, common_name, kingdom, class_name FROM categories), i AS (SELECT lower(trim(category_key)) AS k, count(DISTINCT image_key) AS images, min(image_key) AS first_image FROM images WHERE category_key IS NOT NULL GROUP BY 1)
    SELECT c.category_key, c.name || coalesce(' (' || c.common_name || ')', '') AS title, coalesce(i.images, 0) AS images, i.first_image, coalesce(kingdom, '?') || '>' || coalesce(class_name, '?') AS lineage FROM c LEFT JOIN i ON i.k = c.category_key""")
def sample_assembly(spark, sf):
    """Catalogue rows assembled to nested samples, read back member by member."""
    i = table(spark, sf, "images").where("category_key is not null").groupBy(F.lower(F.trim("category_key")).alias("k")).agg(F.count_distinct("image_key").alias("images"), F.min("image_key").alias("first_image"))
    c = table(spark, sf, "categories").join(i, F.col("category_key") == F.col("k"), "left")
    title = F.concat("name", F.coalesce(F.concat(F.lit(" ("), "common_name", F.lit(")")), F.lit("")))
    nested = F.struct(title.alias("title"), F.struct(F.coalesce("images", F.lit(0)).alias("images"), "first_image").alias("media"), F.array(F.coalesce("kingdom", F.lit("?")), F.coalesce("class_name", F.lit("?"))).alias("lineage"))
    d = c.select("category_key", nested.alias("sample"))
    return d.select("category_key", "sample.title", F.col("sample.media.images").alias("images"), F.col("sample.media.first_image").alias("first_image"), F.array_join("sample.lineage", ">").alias("lineage"))


@query("""WITH c AS (SELECT dedupe_key, min(source_row_index) AS row_index, min(parent_id) AS parent_id, min(coarse_taxon) AS taxon FROM qa_candidates WHERE parent_id IS NOT NULL GROUP BY 1),
    f AS (SELECT parent_id, min(row_index) AS row_index FROM c GROUP BY 1), r AS (SELECT row_index, row_number() OVER (ORDER BY row_index) AS rk FROM f)
    SELECT row_index, CASE WHEN rk <= 40 THEN 'train' ELSE 'reserve' END AS part FROM r WHERE rk <= 60""")
def select_parents_once(spark, sf):
    """Two parts filled one after the other, no parent in both."""
    c = table(spark, sf, "qa_candidates").where("parent_id is not null").groupBy("dedupe_key").agg(F.min("source_row_index").alias("row_index"), F.min("parent_id").alias("parent_id"))
    both = c.withColumn("part", F.explode(F.array(F.lit("train"), F.lit("reserve"))))
    quotas = spark.createDataFrame([("train", 40), ("reserve", 20)], "part string, quota int")
    return S.take_quota_once(both, ["part"], ["row_index"], "parent_id", quotas).select("row_index", "part")
