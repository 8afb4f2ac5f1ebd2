"""Queries over the operators of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import chunking, language, leakage, markup, mixing, sampling, splits
from sievewright.functions.text import clean_text, key_text
from sievewright.session import broadcast_if_small, cut_lineage, spread, table


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every section; one fetched again with the same text counts once, by its digest."""
    sections = table(spark, sf_dir, "text_corpus").select("id", "contents").where("id is not null")
    once = sections.withColumn("digest", F.unhex(F.md5("contents"))).dropDuplicates(["id", "digest"])
    return chunking.split_oversized(once, ["id"], "contents", limit=1800, overlap=150)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only ids of cut sections are shuffled, never their texts."""
    sections = table(spark, sf_dir, "text_corpus").select("id", "contents").where("id is not null")
    return chunking.split_oversized(spread(sections), ["id"], "contents", limit=1800, overlap=150).where("n_pieces > 1").select("id").distinct()


def p1_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section from its pieces again: the digest of the pieces without what they repeat, and whether all keep to the rules."""
    pieces = p1_pieces(spark, sf_dir)
    ordered = F.sort_array(F.collect_list(F.struct("piece_no", F.expr("substring(piece, repeated + 1)").alias("own"))))  # the pieces of one section
    within = F.bool_and((F.char_length("piece") <= 1800) & (F.char_length("piece") == F.col("piece_end") - F.col("piece_start")) & (F.col("repeated") <= 225))
    g = pieces.groupBy("id").agg(ordered.alias("ps"), within.alias("within"), (F.count("*") == F.max("n_pieces")).alias("complete"))
    return g.select("id", F.md5(F.array_join(F.transform("ps", lambda p: p["own"]), "")).alias("digest"), "within", "complete")


def _p3(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = ["coarse_taxon", "question_type"]
    named = sampling.canonical_labels(table(spark, sf_dir, "qa_candidates").select("dedupe_key", *cells), table(spark, sf_dir, "label_aliases"), cells)
    return sampling.proportional_sample(named, "dedupe_key", cells, table(spark, sf_dir, "sample_targets"))


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir)[0]


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir)[1].withColumn("target_rows", F.round("target_rows", 6)).withColumn("sampled_share", F.round("sampled_share", 9))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the sample in each cell; ranks without gaps, no key twice."""
    rows = p3_sample(spark, sf_dir).groupBy("coarse_taxon", "question_type")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("dedupe_key").alias("distinct_keys"), F.max("cell_rank").alias("last_rank"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_report(spark, sf_dir).where("short").select("coarse_taxon", "question_type")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = splits.entity_components(table(spark, sf_dir, "sft_rows"), "parent_sample_id", "category_key")
    return splits.tied_pairs(components).select(F.col("a").alias("category_key_a"), F.col("b").alias("category_key_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category key that is tied to others, the smallest key of its group, and the group's size."""
    components = splits.entity_components(table(spark, sf_dir, "sft_rows"), "parent_sample_id", "category_key")
    return splits.related_groups(components).select(F.col("label").alias("group_key"), F.col("node").alias("category_key"), "size")


def _p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sft_rows").select("sample_id", "parent_sample_id", "category_key", "coarse_taxon", "question_type", "built_at")
    label = F.concat_ws("/", F.lower(F.trim("coarse_taxon")), F.lower(F.trim("question_type")))
    return splits.split_related(rows, "parent_sample_id", "category_key", "sample_id", label)


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4(spark, sf_dir).select("sample_id", "parent_sample_id", "category_key", "built_at", "group_key", "split")


def p4_torn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and category keys whose rows are in more than one split, and the rows assigned."""
    rows = p4_splits(spark, sf_dir)
    torn = lambda c: rows.select(key_text(c).alias("k"), "split").where("k is not null").groupBy("k").agg(F.count_distinct("split").alias("n")).where("n > 1")
    counts = rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("split").isNull()).alias("without"))
    parents, keys = (torn(c).agg(F.count("*").alias(n)) for c, n in (("parent_sample_id", "torn_parents"), ("category_key", "torn_keys")))
    return counts.crossJoin(parents).crossJoin(keys)  # one row each


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split, in all and by coarse taxon."""
    rows = _p4(spark, sf_dir).groupBy("split", F.lower(F.trim("coarse_taxon")).alias("taxon")).agg(F.count("*").alias("n"))
    return rows.groupBy("split").agg(F.sum("n").alias("n_rows"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("taxon", F.lit("")), "n")))).alias("by_taxon"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct section as clean text, with the nodes of its tree by family; a section fetched again counts once."""
    sections = table(spark, sf_dir, "text_corpus").select("id", "contents").withColumn("digest", F.unhex(F.md5("contents")))
    return markup.clean_markup(sections.dropDuplicates(["id", "digest"]), ["id"], "contents")


def p5_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the clean texts of sections without any sign that markup uses."""
    plain = ~F.col("contents").rlike(r"[<&*_`#|\[\]{}\\$~'=>+-]|[0-9][.)]")
    sections = table(spark, sf_dir, "text_corpus").select("id", "contents").where(plain & F.col("id").isNotNull()).distinct()
    return markup.clean_markup(sections, ["id"], "contents").select("id", F.md5("clean").alias("digest"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose tree holds a node of a markup family; only their ids are shuffled."""
    sections = table(spark, sf_dir, "text_corpus").select("id", "contents").where("id is not null")
    return markup.clean_markup(spread(sections), ["id"], "contents").where("n_html + n_markdown + n_wiki + n_latex > 0").select("id").distinct()


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question or passage found in a document, with how it was found."""
    return leakage.leaked_items(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", ["question", "passage"])


def p6_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks whose document holds the passage letter by letter."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "passage")
    pairs = p6_found(spark, sf_dir).join(docs, "doc_id").join(broadcast_if_small(items), "item_id")
    return pairs.where((F.char_length("passage") >= 120) & F.contains("text", "passage")).select("doc_id", "item_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def _p7(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixing.mix_sources(docs, "doc_id", "source", mixing.token_count("text"), table(spark, sf_dir, "source_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir)[1]


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source keeps to its target and its repeats, no document twice in one pass."""
    mix, report = _p7(spark, sf_dir)
    used = mix.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("repeat_no").alias("d")).groupBy("source").agg(F.max("n").alias("most"), F.bool_and(F.col("n") == F.col("d")).alias("apart"))
    d = report.join(used, "source", "left")
    kept = (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & F.coalesce("apart", F.lit(True)) & (F.col("drawn_tokens") <= F.col("target_tokens"))
    return d.select("source", kept.alias("kept"), "documents")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_report(spark, sf_dir).where("short").select("source")


def _p8(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with text, and their language segments; blank and nan texts are missing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where(clean_text("text") != "")
    docs = spread(docs)
    return docs, language.language_segments(docs, "doc_id", "text", language.fitted_once(docs, "text", "lang", "doc_id"))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir)[1]


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with text: its languages, the main one with its confidence, and the label it came with."""
    docs, found = _p8(spark, sf_dir)
    return language.document_languages(found, "doc_id").join(docs.select("doc_id", "lang").withColumnRenamed("lang", "label"), "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _p8(spark, sf_dir)
    # documents' labels are small rows; the texts stay out of this join
    labels = docs.select("doc_id", language.label_code(F.col("lang")).alias("code"))
    judged = language.document_languages(cut_lineage(found), "doc_id").join(labels, "doc_id")
    cases = judged.where((F.col("lang") != "und") & (F.col("mixed") | F.col("code").isNull() | (F.col("code") != F.col("lang"))))
    return cases.select("doc_id", F.explode("langs").alias("lang_found"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_rejoined, p3_found, p3_sample, p3_counts, p3_report, p4_found, p4_groups, p4_splits, p4_torn, p4_shares, p5_found, p5_clean, p5_untouched, p6_found, p6_verbatim, p6_leaks, p7_found, p7_limits, p7_mix, p7_report, p8_found, p8_languages, p8_segments)}

_CELLS = """taxa AS (SELECT lower(trim(alias)) AS alias, canonical FROM label_aliases WHERE field_name = 'coarse_taxon'),
             types AS (SELECT lower(trim(alias)) AS alias, canonical FROM label_aliases WHERE field_name = 'question_type'),
             keyed AS (SELECT DISTINCT a.canonical AS coarse_taxon, b.canonical AS question_type, q.dedupe_key
                       FROM qa_candidates q JOIN taxa a ON lower(trim(q.coarse_taxon)) = a.alias JOIN types b ON lower(trim(q.question_type)) = b.alias WHERE q.dedupe_key IS NOT NULL),
             n AS (SELECT CAST(floor(count(DISTINCT dedupe_key) / 4) AS BIGINT) AS n FROM qa_candidates),
             goal AS (SELECT *, row_number() OVER (ORDER BY coarse_taxon, question_type) AS cell FROM sample_targets),
             mine AS (SELECT k.dedupe_key, min(g.cell) AS cell FROM keyed k JOIN goal g ON k.coarse_taxon = g.coarse_taxon AND k.question_type = g.question_type GROUP BY 1),
             ranked AS (SELECT m.cell, row_number() OVER (PARTITION BY m.cell ORDER BY dedupe_key) AS r, target_share, min_rows FROM mine m JOIN goal g ON m.cell = g.cell),
             floors AS (SELECT count(*) AS n FROM ranked WHERE r <= min_rows),
             seats AS (SELECT cell, r FROM ranked WHERE r <= min_rows OR target_share > 0
                       QUALIFY row_number() OVER (ORDER BY CASE WHEN r <= min_rows THEN 0 ELSE 1 END, CASE WHEN r <= min_rows THEN r ELSE (r - 0.5) / target_share END, cell) <= (SELECT n FROM n)),
             got AS (SELECT cell, count(*) AS sampled FROM seats GROUP BY 1),
             have AS (SELECT g.cell, count(k.dedupe_key) AS available FROM goal g LEFT JOIN keyed k ON k.coarse_taxon = g.coarse_taxon AND k.question_type = g.question_type GROUP BY 1)"""

SQL = {
    "p1_rejoined": "SELECT DISTINCT id, md5(contents) AS digest, true AS within, true AS complete FROM text_corpus WHERE contents <> '' AND id IS NOT NULL",
    "p5_untouched": r"""SELECT DISTINCT id, md5(contents) AS digest FROM text_corpus WHERE id IS NOT NULL AND NOT regexp_matches(contents, '[<&*_`#|\[\]{}\\$~''=>+-]|[0-9][.)]')""",
    "p6_verbatim": "SELECT d.doc_id, i.item_id FROM documents d, eval_items i WHERE length(i.passage) >= 120 AND contains(d.text, i.passage)",
    "p3_counts": f"""WITH {_CELLS} SELECT g.coarse_taxon, g.question_type, sampled AS n, sampled AS distinct_keys, sampled AS last_rank FROM got JOIN goal g ON g.cell = got.cell""",
    "p3_report": f"""WITH {_CELLS} SELECT g.coarse_taxon, g.question_type, target_share, CAST(min_rows AS BIGINT) AS min_rows, round(target_share * n, 6) AS target_rows, available, coalesce(sampled, 0) AS sampled, round(coalesce(sampled, 0) / n, 9) AS sampled_share,
            available < min_rows OR available < CAST(target_share AS DECIMAL(18, 9)) * CAST(n AS DECIMAL(18, 0)) AS short
        FROM goal g CROSS JOIN n JOIN have ON have.cell = g.cell LEFT JOIN got ON got.cell = g.cell""",
    "p4_groups": """WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(parent_sample_id)) AS p, lower(trim(category_key)) AS c FROM sft_rows
                             WHERE lower(trim(parent_sample_id)) NOT IN ('', 'nan') AND lower(trim(category_key)) NOT IN ('', 'nan')),
             links AS (SELECT DISTINCT x.c AS a, y.c AS b FROM e x JOIN e y ON x.p = y.p WHERE x.c <> y.c),
             reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT least(a, min(b)) AS group_key, a AS category_key, count(DISTINCT b) FILTER (WHERE b <> a) + 1 AS size FROM reach GROUP BY a""",
    "p4_torn": "SELECT count(*) AS n_rows, 0 AS without, 0 AS torn_parents, 0 AS torn_keys FROM sft_rows",
    "p7_limits": """SELECT lower(trim(t.source)) AS source, true AS kept, count(d.doc_id) AS documents FROM source_targets t LEFT JOIN documents d ON lower(trim(d.source)) = lower(trim(t.source)) GROUP BY 1""",
    # no case hangs on the tokenizer, so characters stand for tokens
    "p7_found": """WITH d AS (SELECT lower(trim(source)) AS s, length(coalesce(text, '')) AS n FROM documents), h AS (SELECT s, sum(n) AS n FROM d GROUP BY 1)
        SELECT lower(trim(t.source)) AS source FROM source_targets t LEFT JOIN h ON h.s = lower(trim(t.source)) WHERE coalesce(h.n, 0) * t.max_repeats < t.target_share * (SELECT sum(n) FROM d)""",
    "p1_found": "SELECT DISTINCT id FROM text_corpus WHERE length(contents) > 1800",
    "p3_found": """
        WITH taxa AS (SELECT lower(trim(alias)) AS alias, canonical FROM label_aliases WHERE field_name = 'coarse_taxon'),
             types AS (SELECT lower(trim(alias)) AS alias, canonical FROM label_aliases WHERE field_name = 'question_type'),
             cells AS (SELECT a.canonical AS coarse_taxon, b.canonical AS question_type, count(DISTINCT q.dedupe_key) AS available
                       FROM qa_candidates q JOIN taxa a ON lower(trim(q.coarse_taxon)) = a.alias
                       JOIN types b ON lower(trim(q.question_type)) = b.alias GROUP BY 1, 2),
             n AS (SELECT floor(count(DISTINCT dedupe_key) / 4) AS n FROM qa_candidates)
        SELECT t.coarse_taxon, t.question_type FROM sample_targets t CROSS JOIN n
        LEFT JOIN cells c ON c.coarse_taxon = t.coarse_taxon AND c.question_type = t.question_type
        WHERE coalesce(c.available, 0) < t.min_rows
           OR coalesce(c.available, 0) < CAST(t.target_share AS DECIMAL(18, 9)) * CAST(n.n AS DECIMAL(18, 0))""",
    "p4_found": """
        WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(parent_sample_id)) AS p, lower(trim(category_key)) AS c FROM sft_rows
                             WHERE lower(trim(parent_sample_id)) NOT IN ('', 'nan') AND lower(trim(category_key)) NOT IN ('', 'nan')),
             links AS (SELECT DISTINCT x.c AS a, y.c AS b FROM e x JOIN e y ON x.p = y.p WHERE x.c <> y.c),
             reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT a AS category_key_a, b AS category_key_b FROM reach WHERE a < b""",
}
