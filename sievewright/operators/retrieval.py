"""Lexical and vector retrieval of a stated query set against all rows, rank fusion and hit rates.

Searches read the corpus once per block of queries: a block's queries are broadcast, every task scores its rows against all
of them by one matrix product and keeps the best k rows per query and batch. So no pairs are shuffled but the kept ones, and
nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.arrays import l2_normalize, let
from sievewright.session import broadcast_if_small, cut_lineage

#: Queries scored in one pass over the corpus.
QUERY_BLOCK = 2048
#: Conventional constants of Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Constant of reciprocal-rank fusion.
FUSION = 60
#: Rows scored at once.
SCORE_ROWS = 2048


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores, repeats included."""
    return F.regexp_extract_all(F.lower(F.col(c) if isinstance(c, str) else c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _best(scores: np.ndarray, ids: np.ndarray | None, k: int, least: float | None) -> Iterator[tuple[int, np.ndarray]]:
    """Per query (column) the rows that may be among its k best, ties at the k-th place included."""
    for q in range(scores.shape[1]):
        s = scores[:, q]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            keep = np.flatnonzero(s >= edge - 1e-9)
        else:
            keep = np.arange(len(s))
        if least is not None:
            keep = keep[s[keep] > least]
        yield q, keep


def _ranked(found: DataFrame, k: int, digits: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    d = found.withColumn("score", F.round("score", digits))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(rows: Iterator, size: int = QUERY_BLOCK) -> Iterator[tuple]:
    """Queries in blocks; only one block is on the driver at a time."""
    return batched(rows, size)


def dense_topk(queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """query_id, doc_id, score, rank: the k largest inner products of each query, exactly. NULL vectors match nothing."""
    spark = corpus.sparkSession
    wanted = queries.where(F.col(vector).isNotNull()).select(query_id, vector).orderBy(query_id)
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("v"))
    schema = f"query_id {queries.schema[query_id].dataType.simpleString()}, doc_id {corpus.schema[doc_id].dataType.simpleString()}, score double"
    out = None
    for block in _blocks(wanted.toLocalIterator()):
        shared = spark.sparkContext.broadcast(([r[0] for r in block], np.array([r[1] for r in block], dtype=np.float64)))

        def score(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            for frame in frames:
                for at in range(0, len(frame), SCORE_ROWS):
                    part = frame.iloc[at : at + SCORE_ROWS]
                    ids = part["doc_id"].to_numpy()
                    s = np.stack(part["v"].to_list()).astype(np.float64) @ q.T
                    kept = [(i, keep) for i, keep in _best(s, ids, k, None)]
                    which = np.concatenate([np.full(len(keep), i) for i, keep in kept])
                    rows = np.concatenate([keep for _, keep in kept])
                    yield pd.DataFrame({"query_id": [names[i] for i in which], "doc_id": ids[rows], "score": s[rows, which]})

        found = rows.mapInPandas(score, schema)
        out = found if out is None else out.unionByName(found)
    return _ranked(out if out is not None else spark.createDataFrame([], schema), k, digits)


def inverted_index(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs): each document with its number of tokens, its distinct terms and how often it holds each. No shuffle.

    NULL texts aren't indexed. `postings` turns it round by term; write it once and search it as often as wanted.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), tokens(text).alias("toks"))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n int, terms array<string>, tfs array<int>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = batch.column(1)
            flat, sizes = toks.flatten(), pc.list_value_length(toks).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = pc.dictionary_encode(flat)
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            names = coded.dictionary
            # (row, term) pairs as one number, so that a batch is counted by one sort
            pairs, tfs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * (len(names) + 1) + coded.indices.to_numpy(), return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(sizes) + 1) * (len(names) + 1)).astype(np.int32)
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, names.take(pa.array(pairs % (len(names) + 1), pa.int64()))), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))],
                ["doc_id", "n", "terms", "tfs"],
            )

    return rows.mapInArrow(count, schema)


def postings(index: DataFrame) -> DataFrame:
    """(term, doc_id, tf, n): the index by term."""
    return index.select("doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("p.terms", "doc_id", F.col("p.tfs").alias("tf"), "n").withColumnRenamed("terms", "term")


def bm25_statistics(index: DataFrame) -> tuple[int, float, DataFrame]:
    """(number of documents, their mean length, (term, df) of all terms)."""
    n, mean = index.agg(F.count("*"), F.avg("n")).first()
    return n, float(mean or 0.0), index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf_table(df: DataFrame, n: int) -> DataFrame:
    """(term, df, idf): negative values are raised to EPSILON times the mean."""
    raw = df.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def search_index(index: DataFrame, queries: DataFrame, query_id: str, query: str, k: int, digits: int = 6) -> DataFrame:
    """query_id, doc_id, score, rank: BM25 with repeated query words counted, documents with a positive score only.

    A block's queries are broadcast as weights per term; a batch of documents is scored term by term, only where document and
    query share it, and gives up its k best per query.
    """
    spark = index.sparkSession
    n, mean_length, df = bm25_statistics(index)
    asked = ((r[0], r[1]) for r in queries.select(query_id, tokens(query)).orderBy(query_id).toLocalIterator() if r[1])
    schema = f"query_id {queries.schema[query_id].dataType.simpleString()}, doc_id {index.schema['doc_id'].dataType.simpleString()}, score double"
    blocks = list(_blocks(asked)) if n else []  # the query set is a stated, small table
    idf = cut_lineage(idf_table(df, n)) if len(blocks) > 1 else idf_table(df, n)
    out = None
    for block in blocks:
        vocabulary = sorted({t for _, ts in block for t in ts})
        # only terms of the block's queries are collected
        terms = spark.createDataFrame([(t,) for t in vocabulary], "term string")
        known = {r["term"]: r["idf"] for r in idf.join(F.broadcast(terms), "term").collect()}
        weights: dict[str, tuple[list[int], list[float]]] = {}
        for j, (_, ts) in enumerate(block):
            for t, c in Counter(ts).items():
                if t in known:
                    weights.setdefault(t, ([], []))
                    weights[t][0].append(j)
                    weights[t][1].append(c * known[t])
        shared = spark.sparkContext.broadcast(([q for q, _ in block], {t: (np.array(js), np.array(ws)) for t, (js, ws) in weights.items()}, mean_length))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, weights, mean = shared.value
            places = pa.array(list(weights), pa.string())
            kind = pa.array(names).type
            for whole in batches:
                for at in range(0, whole.num_rows, SCORE_ROWS):
                    batch = whole.slice(at, SCORE_ROWS)
                    terms, tfs = batch.column(2), batch.column(3)
                    sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
                    lengths = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                    place = pc.fill_null(pc.index_in(terms.flatten(), places), -1).to_numpy(zero_copy_only=False)
                    hit = np.flatnonzero(place >= 0)
                    if not len(hit):
                        continue
                    row, place = np.repeat(np.arange(len(sizes)), sizes)[hit], place[hit]
                    tf = tfs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)[hit]
                    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / max(mean, 1e-9)))
                    order = np.argsort(place, kind="stable")
                    edges = np.flatnonzero(np.diff(place[order], prepend=-1))
                    s = np.zeros((len(sizes), len(names)))
                    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                        js, ws = weights[places[int(place[order[a]])].as_py()]
                        mine = order[a:b]
                        s[np.ix_(row[mine], js)] += part[mine][:, None] * ws[None, :]
                    qs, rows, values = [], [], []
                    for j, keep in _best(s, None, k, 0.0):
                        if len(keep):
                            qs.append(np.full(len(keep), j))
                            rows.append(keep)
                            values.append(s[keep, j])
                    if qs:
                        own = pa.array(names, kind).take(pa.array(np.concatenate(qs)))
                        yield pa.RecordBatch.from_arrays([own, batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(values))], ["query_id", "doc_id", "score"])

        found = index.mapInArrow(score, schema)
        out = found if out is None else out.unionByName(found)
    return _ranked(out if out is not None else spark.createDataFrame([], schema), k, digits)


def lexical_scores(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int, digits: int = 6) -> DataFrame:
    """search_index over an index built for it; the texts are read and tokenised once."""
    return search_index(cut_lineage(inverted_index(docs, doc_id, text)), queries, query_id, query, k, digits)


def letter_encoder(text: Column | str, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """A deterministic stand-in for a model: the letters of a text by their number, as a vector of norm 1."""
    count = lambda low: F.array(*[(F.char_length(low) - F.char_length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in letters])
    return let(let(F.lower(F.col(text) if isinstance(text, str) else text), count), l2_normalize)


def hybrid(
    docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int, encode: Callable[[str], Column], rerank: Callable[[Column, Column], Column],
    each: int = 50, fused: int = 100,
) -> DataFrame:
    """query_id, doc_id, score, rank: the `each` best by vectors and by BM25, fused to `fused`, and of these the k best by the reranker.

    `encode` turns a text column's name into a vector column, `rerank` a query and a text column into a score. Only the fused
    candidates meet their texts; ties of the reranker go to the better fused rank.
    """
    known = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked = queries.where(F.col(query).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query).alias("query"))
    vectors = known.select("doc_id", encode("text").alias("v"))
    dense = dense_topk(asked.select("query_id", encode("query").alias("v")), vectors, "query_id", "doc_id", "v", each)
    found = cut_lineage(fuse([dense, lexical_scores(known, "doc_id", "text", asked, "query_id", "query", each)], fused))
    wanted = found.select("doc_id").distinct()
    pairs = found.select("query_id", "doc_id", F.col("rank").alias("first")).join(known.join(broadcast_if_small(wanted), "doc_id", "left_semi"), "doc_id").join(broadcast_if_small(asked), "query_id")
    scored = pairs.select("query_id", "doc_id", rerank(F.col("query"), F.col("text")).alias("score"), "first")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")  # at most `fused` rows
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first")


def overlap_scores(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int, digits: int = 9) -> DataFrame:
    """query_id, doc_id, score, rank: distinct query words a document holds, divided by its characters; all documents are scored."""
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.char_length(text).alias("n"), F.array_distinct(tokens(text)).alias("toks"))
    asked = ((r[0], r[1]) for r in queries.select(query_id, F.array_distinct(tokens(query))).orderBy(query_id).toLocalIterator() if r[1])
    schema = f"query_id {queries.schema[query_id].dataType.simpleString()}, doc_id {docs.schema[doc_id].dataType.simpleString()}, score double"
    out = None
    for block in _blocks(asked):
        place = {t: i for i, t in enumerate(sorted({t for _, ts in block for t in ts}))}
        wanted = np.zeros((len(place), len(block)))
        for j, (_, ts) in enumerate(block):
            wanted[[place[t] for t in ts], j] = 1
        shared = spark.sparkContext.broadcast(([q for q, _ in block], place, wanted))

        def score(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, place, wanted = shared.value
            for frame in frames:
                for at in range(0, len(frame), SCORE_ROWS):
                    part = frame.iloc[at : at + SCORE_ROWS]
                    ids, lengths = part["doc_id"].to_numpy(), part["n"].to_numpy(dtype=np.float64)
                    held = np.zeros((len(part), len(place)))
                    for i, ts in enumerate(part["toks"]):
                        held[i, [place[t] for t in ts if t in place]] = 1
                    s = (held @ wanted) / np.maximum(lengths, 1)[:, None]
                    for j, keep in _best(s, ids, k, 0.0):
                        if len(keep):
                            yield pd.DataFrame({"query_id": names[j], "doc_id": ids[keep], "score": s[keep, j]})

        found = rows.mapInPandas(score, schema)
        out = found if out is None else out.unionByName(found)
    return _ranked(out if out is not None else spark.createDataFrame([], schema), k, digits)


def fuse(lists: Sequence[DataFrame], k: int, constant: int = FUSION, digits: int = 9) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, doc_id, rank) lists; ties go to the earlier list, then the better rank."""
    every = None
    for i, ranked in enumerate(lists):
        part = ranked.select("query_id", "doc_id", "rank", F.lit(i).alias("list"))
        every = part if every is None else every.unionByName(part)
    scored = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), digits).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.list", "first.rank")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first")


def hit_at_k(found: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(query_id, first_hit): rank of the first other document with the query's label, NULL without one."""
    of_doc = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("doc_label"))
    of_query = labels.select(F.col(doc_id).alias("query_id"), F.col(label).alias("query_label"))
    judged = found.join(of_doc, "doc_id").join(of_query, "query_id")
    good = (F.col("doc_id") != F.col("query_id")) & (F.col("doc_label") == F.col("query_label"))
    return judged.groupBy("query_id").agg(F.min(F.when(good, F.col("rank"))).alias("first_hit"))


def fit_centroids(vectors: DataFrame, vector: str, lists: int, sample: int = 20_000, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of a bounded sample (documented parameter), normalised, for an inverted vector index."""
    n = vectors.count()
    drawn = vectors.select(vector).sample(min(1.0, 1.2 * sample / max(1, n)), seed=seed).limit(sample).collect()
    x = np.array([r[0] for r in drawn], dtype=np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def index_vectors(vectors: DataFrame, doc_id: str, vector: str, centroids: np.ndarray) -> DataFrame:
    """(doc_id, v, list): every row with its nearest centroid."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = (np.stack(frame["v"].to_list()) @ shared.value.T).argmax(axis=1) if len(frame) else []
            yield frame.assign(list=np.asarray(own, dtype="int32"))

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("v"))
    return rows.mapInPandas(assign, f"doc_id {vectors.schema[doc_id].dataType.simpleString()}, v array<float>, list int")


def list_radii(index: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Per list the largest distance of its rows from its centroid; -1 for a list without rows."""
    shared = index.sparkSession.sparkContext.broadcast(centroids)

    def farthest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame["list"].to_numpy()
            away = np.linalg.norm(np.stack(frame["v"].to_list()).astype(np.float64) - shared.value[own], axis=1) if len(frame) else []
            yield pd.DataFrame({"list": own, "away": away}).groupby("list", as_index=False).max()

    out = np.full(len(centroids), -1.0)
    for j, away in index.mapInPandas(farthest, "list int, away double").groupBy("list").agg(F.max("away")).collect():
        out[j] = away
    return out


def index_topk(index: DataFrame, queries: DataFrame, query_id: str, vector: str, centroids: np.ndarray, k: int, probes: int, digits: int = 6) -> DataFrame:
    """As dense_topk, and with the same rows: a query is scored against the lists of its `probes` nearest centroids, then
    against every other list that may hold a row as good as its k-th, since q.v <= q.c + |q| |v - c|."""
    spark = index.sparkSession
    schema = f"query_id {queries.schema[query_id].dataType.simpleString()}, doc_id {index.schema['doc_id'].dataType.simpleString()}, score double"
    radii, out = None, None
    for block in _blocks(queries.where(F.col(vector).isNotNull()).select(query_id, vector).toLocalIterator()):
        names, q = [r[0] for r in block], np.array([r[1] for r in block], dtype=np.float64)

        def scored(asked: np.ndarray, names=names, q=q) -> DataFrame:
            asking = {int(j): np.flatnonzero(asked[:, j]) for j in np.flatnonzero(asked.any(axis=0))}
            shared = spark.sparkContext.broadcast((names, q, asking))

            def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                names, q, asking = shared.value
                for frame in frames:
                    for j, part in frame.groupby("list"):
                        who = asking.get(int(j))
                        if who is None:
                            continue
                        ids, s = part["doc_id"].to_numpy(), np.stack(part["v"].to_list()).astype(np.float64) @ q[who].T
                        for i, keep in _best(s, ids, k, None):
                            yield pd.DataFrame({"query_id": names[who[i]], "doc_id": ids[keep], "score": s[keep, i]})

            # a list may hold any share of the rows: it is read by as many tasks as it has partitions
            return index.where(F.col("list").isin(list(asking))).mapInPandas(score, schema)

        radii = list_radii(index, centroids) if radii is None else radii
        near = np.zeros((len(q), len(centroids)), dtype=bool)
        np.put_along_axis(near, np.argsort(-(q @ centroids.T), axis=1)[:, :probes], True, axis=1)
        found = cut_lineage(_ranked(scored(near), k, digits))
        kth = {r["query_id"]: r["score"] for r in found.where(F.col("rank") == k).select("query_id", "score").collect()}
        edge = np.array([kth.get(n, -np.inf) for n in names])
        # rounded scores tie, so the edge is lowered by one unit of the last digit
        most = q @ centroids.T + np.linalg.norm(q, axis=1)[:, None] * radii[None, :]
        rest = ~near & (radii >= 0)[None, :] & (most >= (edge - 10.0**-digits)[:, None])
        found = found.drop("rank")
        if rest.any():
            found = found.unionByName(scored(rest))
        out = found if out is None else out.unionByName(found)
    return _ranked(out if out is not None else spark.createDataFrame([], schema), k, digits)


def format_documents(found: DataFrame, docs: DataFrame, doc_id: str, title: Column, text: Column) -> DataFrame:
    """(query_id, listing): `Doc i(Title: ...) text` lines in rank order."""
    named = docs.select(F.col(doc_id).alias("doc_id"), title.alias("title"), text.alias("body"))
    lines = found.join(named, "doc_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "title", "body"))).alias("ds"))
    return lines.select("query_id", F.array_join(F.transform("ds", lambda d: F.concat(F.lit("Doc "), d["rank"], F.lit("(Title: "), d["title"], F.lit(") "), d["body"])), "\n").alias("listing"))
