"""Mixes of sources with exact target shares, spread over output shards.

A source's target in tokens becomes whole passes over the source plus a part of one pass: whole blocks as far as they fit,
then documents of the blocks that follow (a bounded number, about BLOCK_DOCS), each taken if it still fits, so that a source
misses its quota by less than one of these documents. A splitting tree then divides the drawn blocks among the shards: every node draws the
left half's blocks of each source from the multivariate hypergeometric distribution, so the shards are what a global shuffle
of blocks would give, without one. Blocks of a source are permuted and handed out disjointly; rows carry a key that shuffles
them within their shard.

A block is a hash bucket of a source, so a source that holds a third of all rows is as many blocks as it needs. Only one row
per source comes to the driver. Whether a source is short is read off its draw: every repetition of every block was taken,
and the tokens still don't reach the target.

Defined cases: documents without a source count in the total only; NULL and empty texts have 0 tokens and are drawn with
their block; a source without documents, or whose documents times max_repeats don't reach its target, is used as often as
allowed and reported short; repeated documents are separate documents; an empty table reports zeros.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.text import key_text
from sievewright.operators.ranks import bucket_count, distributed_row_number, hash_order, running_sum
from sievewright.session import broadcast_if_small, cut_lineage

#: Sources a mix may have; each is a row on the driver.
MAX_SOURCES = 100_000
#: Documents a block holds on average, and the least number of blocks of a source.
BLOCK_DOCS, LEAST_BLOCKS = 20_000, 32


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):  # once a worker
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column | str, path: str | None = None) -> Column:
    """Tokens of a text under the public byte-level vocabulary at `path`; 0 for NULL."""
    path = path or default_tokenizer()

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def splitting_tree(counts: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many of each source's drawn blocks every shard gets. Rows differ by at most one block in all."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    stack = [(0, shards, np.asarray(counts, dtype=np.int64))]
    while stack:
        lo, hi, here = stack.pop()
        if hi - lo == 1:
            out[lo] = here
            continue
        mid = (lo + hi) // 2
        # ceiling for the left half keeps every shard's size within one block of the others
        want = -(-int(here.sum()) * (mid - lo) // (hi - lo))
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(here, want, method="marginals") if here.sum() else here
        stack += [(lo, mid, left), (mid, hi, here - left)]
    return out


def mix_sources(
    df: DataFrame, doc_id: str, source: str, tokens: Column, targets: DataFrame, shards: int = 16, seed: int = 0,
    target: str = "target_share", repeats: str = "max_repeats",
) -> tuple[DataFrame, DataFrame]:
    """(mix, report). The mix's total is the tokens of all documents.

    mix: doc_id, source, tokens, repeat_no (from 1), shard, shuffle_key. report: source, target_share, max_repeats,
    documents, tokens, target_tokens, drawn_tokens, drawn_share (of the mix), share_of_total (of the wanted total), short.
    """
    spark = df.sparkSession
    docs = cut_lineage(df.select(F.col(doc_id).alias("doc"), key_text(source).alias("source"), tokens.alias("tokens")))
    goals = targets.select(key_text(source).alias("source"), F.col(target).cast("decimal(38,18)").alias("share"), F.col(repeats).cast("bigint").alias("most"))
    goals = goals.where("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(goals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goals = sorted(goals, key=lambda r: r["source"])
    mine = docs.join(F.broadcast(spark.createDataFrame([(r["source"], i) for i, r in enumerate(goals)], "source string, src int")), "source")
    total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    have = {r["src"]: (r["docs"], r["tokens"]) for r in mine.groupBy("src").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).collect()}

    plan = []
    for i, r in enumerate(goals):
        n_docs, n_tokens = have.get(i, (0, 0))
        share, most = r["share"] or Decimal(0), r["most"] or 0
        quota = min(int(share * total), n_tokens * most)
        passes, part = divmod(quota, n_tokens) if n_tokens else (0, 0)
        plan.append((i, max(LEAST_BLOCKS, -(-n_docs // BLOCK_DOCS)), passes, part))
    planned = F.broadcast(spark.createDataFrame(plan, "src int, blocks bigint, passes bigint, part bigint"))
    placed = mine.join(planned, "src").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc"), F.col("blocks")).cast("int"))

    # one row per block
    blocks = placed.groupBy("src", "block").agg(F.sum("tokens").alias("block_tokens"), F.count("*").alias("block_docs"), F.first("passes").alias("passes"), F.first("part").alias("part"))
    blocks = cut_lineage(blocks.withColumn("draw", hash_order("src", "block", seed=seed + 1)))
    buckets = bucket_count(sum(b for _, b, _, _ in plan))
    blocks = running_sum(blocks, ["src"], "draw", ["block"], F.col("block_tokens"), "upto", buckets)
    blocks = running_sum(blocks, ["src"], "draw", ["block"], F.col("block_docs"), "docs_upto", buckets)
    blocks = cut_lineage(blocks.withColumn("fits", F.col("upto") <= F.col("part")))
    fitting = blocks.where("fits").groupBy("src").agg(F.max("upto").alias("filled"), F.max("docs_upto").alias("docs_filled"))
    every = blocks.where("passes > 0").select("src", "block", F.explode(F.sequence(F.lit(1).cast("bigint"), "passes")).alias("repeat_no"))
    drawn = every.unionByName(blocks.where("fits").select("src", "block", (F.col("passes") + 1).alias("repeat_no")))
    drawn = distributed_row_number(drawn.withColumn("draw", hash_order("src", "block", "repeat_no", seed=seed + 2)), ["src"], "draw", ["block", "repeat_no"], "turn", buckets)
    drawn = cut_lineage(drawn.select("src", "block", "repeat_no", "turn"))
    n_drawn = dict(drawn.groupBy("src").count().collect())
    tree = splitting_tree([n_drawn.get(i, 0) for i in range(len(goals))], shards, seed)
    ends = spark.createDataFrame([(i, [int(x) for x in np.cumsum(tree[:, i])]) for i in range(len(goals))], "src int, ends array<bigint>")
    handed = drawn.join(F.broadcast(ends), "src").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("turn")))).drop("ends", "turn")
    rows = placed.select("doc", "source", "src", "tokens", "block")
    whole = rows.join(broadcast_if_small(handed), ["src", "block"]).drop("block")

    # what is left of the part after its whole blocks: documents of the blocks that follow
    rest = blocks.where("not fits and part > 0").join(F.broadcast(fitting), "src", "left").na.fill(0, ["filled", "docs_filled"])
    rest = rest.where((F.col("part") > F.col("filled")) & (F.col("docs_upto") - F.col("block_docs") - F.col("docs_filled") < BLOCK_DOCS))
    rest = rest.select("src", "block", (F.col("part") - F.col("filled")).alias("room"), (F.col("passes") + 1).alias("repeat_no"))
    offered = rows.join(broadcast_if_small(rest), ["src", "block"]).drop("block").withColumn("shard", F.pmod(hash_order("doc", seed=seed + 5), F.lit(shards)).cast("int"))
    filling = offered.withColumn("draw", hash_order("doc", seed=seed + 3)).groupBy("src").applyInPandas(_fill, offered.schema).drop("room")
    picked = whole.unionByName(filling)
    mix = cut_lineage(picked.select("doc", "source", "src", "tokens", "repeat_no", "shard", hash_order("doc", "repeat_no", seed=seed + 4).alias("shuffle_key")))

    # the report reads the draw; targets that aren't whole tokens are compared as decimals
    goal = spark.createDataFrame(
        [(i, r["source"], r["share"] or Decimal(0), r["most"] or 0, *have.get(i, (0, 0)), (r["share"] or Decimal(0)) * total) for i, r in enumerate(goals)],
        "src int, source string, share decimal(38,18), max_repeats bigint, documents bigint, tokens bigint, target decimal(38,18)",
    )
    reached = mix.groupBy("src").agg(F.sum("tokens").alias("drawn_tokens"))
    taken = drawn.groupBy("src").agg(F.count("*").alias("taken"))
    there = blocks.groupBy("src").agg(F.count("*").alias("there"))
    report = goal.join(F.broadcast(reached), "src", "left").join(F.broadcast(taken), "src", "left").join(F.broadcast(there), "src", "left").na.fill(0, ["drawn_tokens", "taken", "there"])
    all_drawn = F.greatest(F.lit(1), F.coalesce(F.sum("drawn_tokens").over(Window.partitionBy(F.lit(0))), F.lit(0)))  # one row per source
    short = (F.col("taken") == F.col("there") * F.col("max_repeats")) & (F.col("drawn_tokens") < F.col("target"))
    report = report.select(
        "source", F.col("share").cast("double").alias("target_share"), "max_repeats", "documents", "tokens", F.col("target").cast("double").alias("target_tokens"), "drawn_tokens",
        (F.col("drawn_tokens") / all_drawn).alias("drawn_share"), (F.col("drawn_tokens") / F.lit(float(max(1, total)))).alias("share_of_total"), short.alias("short"),
    )
    return mix.drop("src").withColumnRenamed("doc", doc_id), report


def _fill(frame: pd.DataFrame) -> pd.DataFrame:
    """The documents of one source, in random order, that still fit into its room; their number is bounded by BLOCK_DOCS and a block."""
    frame = frame.sort_values(["draw", "doc"], kind="stable")
    left = int(frame["room"].iloc[0])
    taken = []
    for n in frame["tokens"].tolist():
        taken.append(0 < n <= left)
        left -= n if taken[-1] else 0
    return frame.loc[taken].drop(columns="draw")


def write_shards(mix: DataFrame, docs: DataFrame, doc_id: str, path: str) -> None:
    """Writes every drawn document with all its columns by shard, each shard shuffled.

    The texts are shuffled once for the join and once to their shard's range; no global sort runs in one task. A document's
    own columns named like the mix's are left out; of repeated ids one row gives the text.
    """
    own = docs.drop(*(set(mix.columns) - {doc_id})).dropDuplicates([doc_id])
    rows = mix.join(own, doc_id)
    rows.repartitionByRange("shard", "shuffle_key").sortWithinPartitions("shard", "shuffle_key").write.partitionBy("shard").parquet(path)
