"""Queries over retrieval, balancing and streams, each beside the SQL it must equal where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievewright.operators import balance as BAL
from sievewright.operators import retrieval as R
from sievewright.operators.ranks import ranged_row_number
from sievewright.session import cut_lineage, ensure_checkpoint_dir, spread, table
from sievewright.streaming import windows as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_BM25 = f"""d AS (SELECT doc_id, {_TOK.format('text')} AS toks FROM documents WHERE text IS NOT NULL),
    n AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d), p AS (SELECT doc_id, unnest(toks) AS term FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, n),
    idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
    q AS (SELECT item_id, unnest({_TOK.format('question')}) AS term FROM eval_items), qt AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY 1, 2),
    s AS (SELECT qt.item_id AS query_id, tf.doc_id, round(sum(c * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len(d.toks) / avgdl))), 6) AS score
          FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN d ON d.doc_id = tf.doc_id CROSS JOIN n GROUP BY 1, 2),
    bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 50)"""


def _bm25(spark, sf, k=50):
    return R.lexical_scores(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "question", k)


@query(rf"SELECT doc_id, len({_TOK.format('text')}) AS n_tokens FROM documents WHERE text IS NOT NULL")
def bm25_tokens(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(R.tokens("text")).cast("bigint").alias("n_tokens"))


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_index(spark, sf):
    n, _, df = R.bm25_statistics(cut_lineage(R.inverted_index(table(spark, sf, "documents"), "doc_id", "text")))
    return R.idf_table(df, n).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_BM25} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf):
    return _bm25(spark, sf, 10).select("query_id", "doc_id", "rank")


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e


_DENSE = """c AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
    dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c)"""


def _dense(spark, sf, k):
    q, e = _vectors(spark, sf)
    return R.dense_topk(q, e.select(F.col("vec_id").alias("doc_id"), "embedding"), "query_id", "doc_id", "embedding", k)


@query(f"WITH {_DENSE} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM dn WHERE rank <= 10")
def dense_topk(spark, sf):
    return _dense(spark, sf, 10)


@query(f"WITH {_DENSE} SELECT d.query_id, CAST(min(rank) FILTER (WHERE a.label = b.label AND d.query_id <> d.doc_id) AS INTEGER) AS first_hit FROM dn d JOIN embeddings a ON a.vec_id = d.doc_id JOIN embeddings b ON b.vec_id = d.query_id WHERE rank <= 10 GROUP BY 1")
def dense_hit_at_k(spark, sf):
    return R.hit_at_k(_dense(spark, sf, 10), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "label")


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS l1 FROM embeddings")
def dense_normalise(spark, sf):
    from sievewright.functions.arrays import l2_normalize

    v = l2_normalize(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"))


@query(None)
def dense_index_topk(spark, sf):
    """Inverted vector index: fitted on a bounded sample, every row indexed; the same rows as dense_topk."""
    q, e = _vectors(spark, sf)
    centroids = R.fit_centroids(e, "embedding", lists=32)
    index = cut_lineage(R.index_vectors(e, "vec_id", "embedding", centroids))  # read by every pass
    return R.index_topk(index, q, "query_id", "embedding", centroids, k=10, probes=16)


@query(f"WITH {_BM25} SELECT term, count(*) AS n_docs, sum(tf) AS n_tokens, min(doc_id) AS first_doc FROM tf GROUP BY 1")
def bm25_postings(spark, sf):
    """The index by term, as stored: documents and occurrences of each."""
    p = R.postings(R.inverted_index(table(spark, sf, "documents"), "doc_id", "text"))
    return p.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_tokens"), F.min("doc_id").alias("first_doc"))


_LETTERS = "[" + ", ".join(f"(length(lower({{0}})) - length(replace(lower({{0}}), '{c}', '')))::DOUBLE" for c in "abcdefghijklmnopqrstuvwxyz") + "]"
_UNIT = "list_transform({0}, lambda x: x / CASE WHEN list_sum(list_transform({0}, lambda y: y * y)) = 0 THEN 1 ELSE sqrt(list_sum(list_transform({0}, lambda y: y * y))) END)"


@query(f"""WITH {_BM25}, dv AS (SELECT doc_id, {_LETTERS.format('text')} AS r FROM documents WHERE text IS NOT NULL), du AS (SELECT doc_id, {_UNIT.format('r')} AS v FROM dv),
    qv AS (SELECT item_id, {_LETTERS.format('question')} AS r FROM eval_items WHERE question IS NOT NULL), qu AS (SELECT item_id, {_UNIT.format('r')} AS v FROM qv),
    ds AS (SELECT item_id AS query_id, doc_id, round(list_inner_product(qu.v, du.v), 6) AS score FROM qu, du),
    de AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds QUALIFY rank <= 50),
    u AS (SELECT query_id, doc_id, rank, 0 AS l FROM de UNION ALL SELECT query_id, doc_id, rank, 1 FROM bm),
    f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(struct_pack(l := l, r := rank)) AS first FROM u GROUP BY 1, 2),
    fr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first.l, first.r) AS place FROM f QUALIFY place <= 100),
    sh AS (SELECT fr.query_id, fr.doc_id, count(*) AS shared FROM fr JOIN qt ON qt.item_id = fr.query_id JOIN tf ON tf.term = qt.term AND tf.doc_id = fr.doc_id GROUP BY 1, 2)
    SELECT fr.query_id, fr.doc_id, round(coalesce(shared, 0) / (length(text) + 100)::DOUBLE, 9) AS score, CAST(row_number() OVER (PARTITION BY fr.query_id ORDER BY round(coalesce(shared, 0) / (length(text) + 100)::DOUBLE, 9) DESC, fr.place) AS INTEGER) AS rank
    FROM fr JOIN documents d ON d.doc_id = fr.doc_id LEFT JOIN sh ON sh.query_id = fr.query_id AND sh.doc_id = fr.doc_id QUALIFY rank <= 3""")
def hybrid_rrf_top3(spark, sf):
    """The flagship: 50 documents by vectors and 50 by BM25 for every held-out question, fused, and of the fused the best three by a reranker.

    Encoder and reranker are injected; here they are deterministic expressions.
    """
    shared = lambda q, t: F.round(F.size(F.array_intersect(R.tokens(q), R.tokens(t))) / (F.char_length(t) + 100), 9)
    return R.hybrid(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "question", 3, R.letter_encoder, shared)


@query(f"""WITH {_BM25}, o AS (SELECT qt.item_id AS query_id, doc_id, round(count(*)::DOUBLE / min(length(text)), 9) AS score FROM qt JOIN tf USING (term) JOIN documents USING (doc_id) GROUP BY 1, 2),
    ov AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM o QUALIFY rank <= 50),
    u AS (SELECT query_id, doc_id, rank, 0 AS l FROM bm UNION ALL SELECT query_id, doc_id, rank, 1 FROM ov),
    f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(struct_pack(l := l, r := rank)) AS first FROM u GROUP BY 1, 2)
    SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first.l, first.r) AS INTEGER) AS rank FROM f QUALIFY rank <= 3""")
def hybrid_rrf_two_searches(spark, sf):
    """Two searches of all documents for every held-out question, BM25 and length-normalised overlap, fused, best three."""
    overlap = R.overlap_scores(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "question", 50)
    return R.fuse([_bm25(spark, sf), overlap], 3)


@query(None)
def balance_parts(spark, sf):
    docs = table(spark, sf, "documents").withColumn("batch", F.floor(F.col("doc_id") / 512).cast("int"))
    return BAL.balance(docs, "batch", "doc_id", "n_chars", 8)


@query(None)
def balance_groups(spark, sf):
    docs = table(spark, sf, "documents").withColumn("batch", F.floor(F.col("doc_id") / 512).cast("int"))
    return BAL.balance(docs, "batch", "doc_id", "n_chars", 8, method="greedy", together="source")


# ---- streams


def _places(spark) -> tuple[str, str]:
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{root}/table", f"{root}/state"


def _events(spark, sf):
    like = table(spark, sf, "events")
    return W.read_stream(spark, f"{sf}/events.parque[t]", like)  # a pattern, since a stream reads no single file


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    out = W.tumbling(_events(spark, sf), "ts", "6 hours", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return W.run_to_table(out, *_places(spark)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i) AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY 1, 2""")
def stream_sliding(spark, sf):
    out = W.tumbling(_events(spark, sf), "ts", "12 hours", ["event_type"], F.count("*").alias("n"), slide="6 hours")
    return W.run_to_table(out, *_places(spark)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, no""")
def stream_sessions(spark, sf):
    """Sessions with a gap of two hours, over the batch table."""
    out = W.sessions(table(spark, sf, "events"), "ts", "2 hours", ["user_id"], F.count("*").alias("n"))
    return out.drop("session_end").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def stream_late_rows(spark, sf):
    e = table(spark, sf, "events")
    newest = e.agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("edge"))
    return e.crossJoin(F.broadcast(newest)).where("ts < edge").select("event_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def stream_drop_oldest(spark, sf):
    return W.newest(table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id")


@query("SELECT user_id, least(20, count(*)) AS held, count(*) AS produced, greatest(0, count(*) - 20) AS dropped FROM events GROUP BY 1")
def stream_bounded_queue(spark, sf):
    """The stateful queue itself, run over the stream to its end."""
    out = W.bounded_queue(_events(spark, sf), "user_id", "event_id", "event_id", 20)
    return W.latest_by_key(W.run_to_table(out, *_places(spark), mode="update"), ["user_id"], ["produced"])


@query("""WITH v AS (SELECT event_id, event_id // 100 AS version FROM events), m AS (SELECT max(version) AS now FROM v)
    SELECT event_id, now - version AS staleness, 960 AS max_waiting FROM v, m WHERE now - version <= 6""")
def stream_staleness(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr("event_id div 100").alias("version"))
    return W.staleness_gate(e, F.col("version"), 160, 0.5, 4).select("event_id", "staleness", "max_waiting")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def stream_ready_steps(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"))
    return W.ready_steps(o, "o_custkey", "status").select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_type, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1, 2")
def stream_upsert(spark, sf):
    return W.latest_by_key(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT event_id // 500 AS interval_no, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY 1, 2")
def stream_interval_rollup(spark, sf):
    e = table(spark, sf, "events").withColumn("interval_no", F.expr("event_id div 500"))
    return e.groupBy("interval_no", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most"))


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def stream_watermarked(spark, sf):
    """Windows in append mode: a window comes out once the watermark, two days behind, has passed its end."""
    out = W.tumbling(_events(spark, sf), "ts", "6 hours", [], F.count("*").alias("n"), delay="2 days")
    return W.run_to_table(out, *_places(spark), mode="append").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_sessions_streamed(spark, sf):
    """The same sessions on the stream, each once the watermark has passed its end."""
    out = W.sessions(_events(spark, sf), "ts", "2 hours", ["user_id"], F.count("*").alias("n"), delay="1 day").drop("session_end")
    return W.run_to_table(out, *_places(spark), mode="append").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("""WITH k AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT CAST(i // 64 AS BIGINT) AS batch_no, count(*) AS n, count(DISTINCT user_id) AS users, min(event_id) AS first_event FROM k WHERE i // 64 < (SELECT count(*) // 64 FROM events) GROUP BY 1""")
def stream_batches(spark, sf):
    """Full batches of 64 samples in the order of arrival; the rest waits."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    full = e.count() // 64
    d = ranged_row_number(e, [], "event_id", [], "i").withColumn("batch_no", F.floor((F.col("i") - 1) / 64)).where(F.col("batch_no") < full)
    return d.groupBy("batch_no").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("event_id").alias("first_event"))


@query("""WITH s AS (SELECT event_id // 500 AS interval_no, sum(value) AS total, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS waited, count(*) FILTER (WHERE event_type = 'error') AS stale FROM events GROUP BY 1)
    SELECT interval_no, round(waited / total, 6) AS idle_ratio, stale, CASE WHEN interval_no % 4 = 0 THEN 0 ELSE sum(stale) OVER (PARTITION BY interval_no // 4 ORDER BY interval_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS carried FROM s""")
def stream_idle_ratio(spark, sf):
    """Share of waiting per interval, and the stale samples carried since the last synchronisation, which resets them."""
    s = table(spark, sf, "events").groupBy(F.expr("event_id div 500").alias("interval_no")).agg(
        F.sum("value").alias("total"), F.sum(F.when(F.col("event_type") == "view", F.col("value")).otherwise(0.0)).alias("waited"), F.count_if(F.col("event_type") == "error").alias("stale"))
    return W.carried_since_sync(s, "interval_no", "stale", 4).select("interval_no", F.round(F.col("waited") / F.col("total"), 6).alias("idle_ratio"), "stale", "carried")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def stream_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
