"""Queries over scalar text functions, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import text as T
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


_CLEAN = "CASE WHEN lower(trim({0})) = 'nan' THEN '' ELSE coalesce(trim({0}), '') END"
_W = "' ' || chr(9) || chr(10) || chr(13)"


@query(f"SELECT source_row_index, {_CLEAN.format('coarse_taxon')} AS taxon, {_CLEAN.format('question_type')} AS qtype FROM qa_candidates")
def text_clean(spark, sf):
    return table(spark, sf, "qa_candidates").select("source_row_index", T.clean_text("coarse_taxon").alias("taxon"), T.clean_text("question_type").alias("qtype"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_CLEAN.format('url')}, '^http://', 'https://'), '/+$', '') AS url FROM documents")
def text_url_v1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_url("url").alias("url"))


@query("""
    WITH p AS (SELECT unnest(extra_info.wiki_pairs) AS w FROM sft_rows),
         u AS (SELECT w.title AS title, coalesce(trim(w.url), '') AS url FROM p WHERE w IS NOT NULL)
    SELECT title, url AS raw_url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))
        || regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/+$', '')
        || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS url
    FROM u WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://')""")
def text_url_v2(spark, sf):
    pairs = table(spark, sf, "sft_rows").select(F.explode("extra_info.wiki_pairs").alias("w")).where("w is not null")
    pairs = pairs.select(F.col("w.title").alias("title"), T.clean_text("w.url").alias("raw_url")).where(F.col("raw_url").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"))
    return pairs.withColumn("url", T.normalize_url_parts("raw_url"))


@query("SELECT image_key, array_to_string(list_filter(list_transform(string_split(coalesce(trim(normalized_path), ''), '/'), lambda x: trim(x)), lambda x: x <> ''), ',') AS parts FROM images WHERE normalized_path IS NOT NULL AND lower(trim(normalized_path)) <> 'nan'")
def text_split_delimited(spark, sf):
    rows = table(spark, sf, "images").where("normalized_path is not null and lower(trim(normalized_path)) <> 'nan'")
    return rows.select("image_key", F.array_join(T.split_delimited("normalized_path", "/"), ",").alias("parts"))


@query("SELECT doc_id, len(list_distinct(string_split(lower(text), ' '))) AS n_distinct FROM documents WHERE text IS NOT NULL")
def text_distinct_words(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(F.array_distinct(F.split(F.lower("text"), " "))).cast("bigint").alias("n_distinct"))


@query("""
    SELECT sample_id, source_image_index, w.title AS title, w.url AS url, i AS pos FROM (
        SELECT sample_id, source_image_index, unnest(extra_info.wiki_pairs) AS w, generate_subscripts(extra_info.wiki_pairs, 1) AS i FROM sft_rows)""")
def text_zip_pairs(spark, sf):
    rows = table(spark, sf, "sft_rows")
    titles, urls = F.transform("extra_info.wiki_pairs", lambda w: w["title"]), F.transform("extra_info.wiki_pairs", lambda w: w["url"])
    pairs = rows.select("sample_id", "source_image_index", F.posexplode(F.arrays_zip(titles.alias("title"), urls.alias("url"))).alias("i", "w"))
    return pairs.select("sample_id", "source_image_index", F.col("w.title").alias("title"), F.col("w.url").alias("url"), (F.col("i") + 1).cast("bigint").alias("pos"))


@query("""
    SELECT q.source_row_index, t.canonical AS taxon, y.canonical AS qtype FROM qa_candidates q
    LEFT JOIN label_aliases t ON t.field_name = 'coarse_taxon' AND t.alias = lower(trim(q.coarse_taxon))
    LEFT JOIN label_aliases y ON y.field_name = 'question_type' AND y.alias = lower(trim(q.question_type))""")
def text_alias(spark, sf):
    rows = table(spark, sf, "qa_candidates").select("source_row_index", "coarse_taxon", "question_type")
    aliases = table(spark, sf, "label_aliases")
    for column, field, out in (("coarse_taxon", "coarse_taxon", "taxon"), ("question_type", "question_type", "qtype")):
        known = aliases.where(F.col("field_name") == field).select(F.col("alias").alias("k"), F.col("canonical").alias(out))
        rows = rows.withColumn("k", F.lower(F.trim(column))).join(broadcast_if_small(known), "k", "left").drop("k")
    return rows.select("source_row_index", "taxon", "qtype")


@query("""
    SELECT doc_id, 'doc:' || substr(sha256('{"lang":' || CASE WHEN lang IS NULL THEN 'null' ELSE '"' || lang || '"' END
        || ',"n_chars":' || n_chars || ',"source":' || CASE WHEN source IS NULL THEN 'null' ELSE '"' || source || '"' END || '}'), 1, 24) AS stable_id FROM documents""")
def hash_stable_id(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", T.stable_id("doc:", lang=F.col("lang"), source=F.col("source"), n_chars=F.col("n_chars")).alias("stable_id"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def hash_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""
    SELECT i.image_key, coalesce(nullif(trim(c.common_name), ''), c.name, '') AS title,
        array_to_string(list_filter([c.kingdom, c.phylum, c.class_name, c.order_name, c.family_name, c.genus], lambda x: x IS NOT NULL AND x <> ''), ' > ') AS taxonomy
    FROM images i JOIN categories c ON lower(trim(i.category_key)) = c.category_key""")
def text_vision_row(spark, sf):
    images = table(spark, sf, "images").select("image_key", F.lower(F.trim("category_key")).alias("category_key"))
    rows = images.join(table(spark, sf, "categories"), "category_key")
    path = F.filter(F.array("kingdom", "phylum", "class_name", "order_name", "family_name", "genus"), lambda x: x.isNotNull() & (x != ""))
    return rows.select("image_key", F.coalesce(F.nullif(F.trim("common_name"), F.lit("")), "name", F.lit("")).alias("title"), F.array_join(path, " > ").alias("taxonomy"))


@query("""
    SELECT sample_id, source_image_index, 'Image ' || q.image_index || ': ' || coalesce(q.image_key, '') AS line, q.source_split AS source_split FROM (
        SELECT sample_id, source_image_index, unnest(extra_info.query_images) AS q FROM sft_rows) WHERE q IS NOT NULL""")
def text_image_children(spark, sf):
    rows = table(spark, sf, "sft_rows").select("sample_id", "source_image_index", F.explode("extra_info.query_images").alias("q")).where("q is not null")
    line = F.concat(F.lit("Image "), F.col("q.image_index"), F.lit(": "), F.coalesce("q.image_key", F.lit("")))
    return rows.select("sample_id", "source_image_index", line.alias("line"), F.col("q.source_split").alias("source_split"))


@query("SELECT sample_id, built_at, coalesce(category_key, extra_info.question_id, '<none>') AS key, coalesce(retrieval_resolvable, false) AS resolvable FROM sft_rows")
def text_fallback_lookup(spark, sf):
    rows = table(spark, sf, "sft_rows")
    return rows.select("sample_id", "built_at", F.coalesce("category_key", "extra_info.question_id", F.lit("<none>")).alias("key"), F.coalesce("retrieval_resolvable", F.lit(False)).alias("resolvable"))


@query(r"""
    SELECT id, trim(split_part(contents, chr(10), 1), ' "') AS title,
        CASE WHEN instr(contents, chr(10)) > 0 THEN length(substr(contents, instr(contents, chr(10)) + 1)) ELSE 0 END AS body_chars FROM text_corpus""")
def text_title_body(spark, sf):
    rows = table(spark, sf, "text_corpus")
    chars = F.when(F.instr("contents", "\n") > 0, F.char_length("contents") - F.instr("contents", "\n")).otherwise(0)
    return rows.select("id", T.title_of("contents").alias("title"), chars.cast("bigint").alias("body_chars"))


@query("SELECT sample_id, built_at, array_to_string(list_filter(list_transform(extra_info.answers, lambda a: trim(a)), lambda a: a <> ''), ' | ') AS reference FROM sft_rows WHERE extra_info.answers IS NOT NULL")
def text_reference_answers(spark, sf):
    rows = table(spark, sf, "sft_rows").where("extra_info.answers is not null")
    return rows.select("sample_id", "built_at", F.array_join(F.filter(F.transform("extra_info.answers", F.trim), lambda a: a != ""), " | ").alias("reference"))


@query(r"""
    WITH m AS (SELECT sample_id, built_at, messages AS ms, len(messages) AS n, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM sft_rows),
         u AS (SELECT sample_id, built_at, arg_max(m.content, i) AS content FROM m WHERE m.role = 'user' AND m.content IS NOT NULL GROUP BY ALL)
    SELECT sample_id, built_at, trim(regexp_replace(content, '(?s)^.*question\. ', ''), ' ' || chr(10)) AS question FROM u""")
def text_last_user_turn(spark, sf):
    rows = table(spark, sf, "sft_rows")
    turns = F.filter("messages", lambda m: (m["role"] == "user") & m["content"].isNotNull())
    content = F.get(turns, F.size(turns) - 1)["content"]
    found = rows.where(F.size(turns) > 0).select("sample_id", "built_at", T.strip(F.regexp_replace(content, r"(?s)^.*question\. ", "")).alias("question"))
    return found.groupBy("sample_id", "built_at").agg(F.max("question").alias("question"))


@query("SELECT image_key, file_name, NOT starts_with(file_name, '/') AND NOT list_contains(string_split(file_name, '/'), '..') AND file_name <> '' AS safe FROM images WHERE file_name IS NOT NULL")
def text_safe_member(spark, sf):
    return table(spark, sf, "images").where("file_name is not null").select("image_key", "file_name", T.is_safe_member("file_name").alias("safe"))


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT item_id, {_NORM.format('question')} AS question, {_NORM.format('answer')} AS answer FROM eval_items")
def text_answer_norm(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", T.normalize_answer("question").alias("question"), T.normalize_answer("answer").alias("answer"))


@query(r"""
    WITH m AS (SELECT sample_id, built_at, extra_info.answers AS golds, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM sft_rows),
         p AS (SELECT sample_id, built_at, golds, i, nullif(trim(list_extract(regexp_extract_all(m.content, '<answer>([^<]*)</answer>', 1), -1)), '') AS prediction FROM m WHERE m.role = 'assistant')
    SELECT sample_id, built_at, i AS turn, prediction,
        CASE WHEN len(list_filter(golds, lambda g: lower(trim(g)) = lower(prediction))) > 0 THEN 1 ELSE 0 END AS em FROM p WHERE prediction IS NOT NULL""")
def text_exact_match(spark, sf):
    rows = table(spark, sf, "sft_rows").select("sample_id", "built_at", F.col("extra_info.answers").alias("golds"), F.posexplode("messages").alias("i", "m"))
    found = rows.where("m.role = 'assistant'").withColumn("prediction", T.last_answer("m.content")).where("prediction is not null")
    return found.select("sample_id", "built_at", (F.col("i") + 1).cast("bigint").alias("turn"), "prediction", T.exact_match(F.col("prediction"), F.col("golds")).alias("em"))


@query(r"""
    WITH m AS (SELECT sample_id, unnest(messages) AS m FROM sft_rows),
         k AS (SELECT sample_id, CASE WHEN m.tool_calls IS NOT NULL AND len(m.tool_calls) > 0 THEN 'structured' WHEN m.content LIKE '%<answer>%</answer>%' THEN 'answer' ELSE 'plain' END AS kind FROM m WHERE m.role = 'assistant')
    SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def text_turn_kind(spark, sf):
    turns = table(spark, sf, "sft_rows").select(F.explode("messages").alias("m")).where("m.role = 'assistant'")
    kind = F.when(F.size("m.tool_calls") > 0, "structured").otherwise(T.turn_kind(F.coalesce("m.content", F.lit(""))))
    return turns.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""
    WITH m AS (SELECT sample_id, built_at, list_transform(messages, lambda x: x.role) AS roles FROM sft_rows)
    SELECT sample_id, built_at, array_to_string(roles, ',') AS roles, coalesce(array_to_string(roles, ',') = 'user,assistant,tool,assistant,tool,assistant', false) AS valid FROM m""")
def text_turn_grammar(spark, sf):
    roles = F.transform("messages", lambda m: m["role"])
    joined = F.array_join(roles, ",")
    return table(spark, sf, "sft_rows").select("sample_id", "built_at", joined.alias("roles"), F.coalesce(joined == "user,assistant,tool,assistant,tool,assistant", F.lit(False)).alias("valid"))


@query(r"""
    WITH m AS (SELECT unnest(messages) AS m FROM sft_rows), c AS (SELECT unnest(m.tool_calls) AS c FROM m)
    SELECT c.function.name AS name, json_extract_string(c.function.arguments, '$.query') AS query, count(*) AS n FROM c WHERE c IS NOT NULL GROUP BY ALL""")
def text_tool_arguments(spark, sf):
    calls = table(spark, sf, "sft_rows").select(F.explode("messages").alias("m")).select(F.explode("m.tool_calls").alias("c")).where("c is not null")
    return calls.groupBy(F.col("c.function.name").alias("name"), F.get_json_object("c.function.arguments", "$.query").alias("query")).agg(F.count("*").alias("n"))


@query(None)
def text_phrase_norm(spark, sf):
    """All texts in all languages; no SQL, since engines differ in lower case and word characters beyond English."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.normalize_phrase("text").alias("phrase"))


@query(r"SELECT item_id, regexp_extract_all(right(passage, 300), '(-?[0-9.,]+)', 1)[-1] IS NOT NULL AS has_number FROM eval_items")
def text_gsm8k(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", F.coalesce(T.gsm8k_flexible("passage").isNotNull(), F.lit(False)).alias("has_number"))


@query("SELECT sample_id, built_at, 0.02 * power(greatest(0, len(messages) - 2), 2) AS penalty FROM sft_rows WHERE messages IS NOT NULL")
def text_retrieval_penalty(spark, sf):
    return table(spark, sf, "sft_rows").where("messages is not null").select("sample_id", "built_at", T.retrieval_penalty(F.size("messages")).alias("penalty"))


@query(r"SELECT id, regexp_replace(contents, '<(/?)(pre|table)(\s*)>', '&lt;\1\2\3&gt;', 'gi') = contents AS untouched FROM text_corpus")
def text_sanitize(spark, sf):
    return table(spark, sf, "text_corpus").select("id", (T.sanitize_tags("contents", ("pre", "table")) == F.col("contents")).alias("untouched"))


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 200 THEN text ELSE left(text, list_max(list_filter(range(0, 201), lambda i: octet_length(encode(left(text, i))) <= 200))) END AS prefix FROM documents WHERE text IS NOT NULL""")
def text_utf8_prefix(spark, sf):
    """The longest prefix of whole characters within 200 bytes."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.utf8_prefix("text", 200).alias("prefix"))


@query("""
    SELECT c.category_key, c.name, list_sort(list_distinct(list_filter([lower(trim(c.name)), lower(trim(c.common_name)), lower(trim(c.genus || ' ' || c.specific_epithet))], lambda x: x IS NOT NULL AND x <> ''))) AS aliases
    FROM categories c""")
def text_entity_aliases(spark, sf):
    names = F.array(F.lower(F.trim("name")), F.lower(F.trim("common_name")), F.lower(F.trim(F.concat("genus", F.lit(" "), "specific_epithet"))))
    return table(spark, sf, "categories").select("category_key", "name", F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))).alias("aliases"))


@query("SELECT source_row_index, json_extract_string(payload_json, '$.question') AS question, json_extract_string(payload_json, '$.wikipedia_url') AS url FROM qa_candidates")
def text_payload_decode(spark, sf):
    rows = table(spark, sf, "qa_candidates").select("source_row_index", F.from_json("payload_json", "question string, wikipedia_url string").alias("p"))
    return rows.select("source_row_index", F.col("p.question").alias("question"), F.col("p.wikipedia_url").alias("url"))


@query("SELECT category_key, count(*) AS n, sha256(string_agg(category_id, chr(10) ORDER BY category_id) || chr(10)) AS digest FROM (SELECT DISTINCT category_key, category_id FROM categories) GROUP BY category_key")
def hash_order_digest(spark, sf):
    ids = table(spark, sf, "categories").select("category_key", "category_id").distinct().groupBy("category_key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("category_id")).alias("ids"))
    return ids.select("category_key", "n", F.sha2(F.concat(F.array_join("ids", "\n"), F.lit("\n")), 256).alias("digest"))
