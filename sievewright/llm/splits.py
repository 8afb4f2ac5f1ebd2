"""Train, validation and test splits that keep related records together.

Records that share an entity get one label by minimum-label propagation over the bipartite record–entity graph
(operators.components). Whole groups are then assigned, in bundles of bounded number, each where the label distributions
deviate least from the targets.

Defined cases: missing keys (NULL, blank, nan) tie nothing; a record without any key is a group of its own, held together
with its repetitions by its own id; an empty table gives an empty result; shares of 0 give an empty split. A group larger
than its split's share can't be cut, so the report's shares say what was reached.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import key_text
from sievewright.operators.components import entity_links, propagate_labels
from sievewright.operators.ranks import bucket_count, hash_order, running_sum
from sievewright.session import cut_lineage

#: Bundles of groups that are placed one by one, about, and labels that have a cell of their own in the driver's counts.
BUNDLES, CELLS = 2000, 1024


def entity_components(df: DataFrame, record: str, entity: str) -> DataFrame:
    """(node, label) of entities that are tied to another entity, in normalised spelling; see propagate_labels."""
    edges = df.select(key_text(record).alias("record_key"), key_text(entity).alias("entity_key"))
    return propagate_labels(entity_links(edges, "record_key", "entity_key"))


def tied_pairs(components: DataFrame) -> DataFrame:
    """(a, b), a < b: every two entities of one component."""
    a = components.select("label", F.col("node").alias("a"))
    b = components.select("label", F.col("node").alias("b"))
    return a.join(b, "label").where("a < b").select("a", "b")


def group_keys(df: DataFrame, record: str, entity: str, fallback: str, components: DataFrame, out: str = "group_key") -> DataFrame:
    """Adds the group every row belongs to; entities carry the prefix e:, records r:, lone rows o:."""
    rows = df.withColumn("__record", key_text(record)).withColumn("__entity", key_text(entity))
    owners = rows.where("__record is not null and __entity is not null").groupBy("__record").agg(F.min("__entity").alias("__owner"))
    lost = rows.where("__entity is null and __record is not null").join(owners, "__record", "left")
    found = rows.where("__entity is not null or __record is null").withColumn("__owner", F.lit(None).cast("string"))
    every = found.unionByName(lost).withColumn("__node", F.coalesce("__entity", "__owner"))
    labels = components.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
    named = F.when(F.col("__node").isNotNull(), F.concat(F.lit("e:"), F.coalesce("__label", "__node")))
    named = named.when(F.col("__record").isNotNull(), F.concat(F.lit("r:"), F.col("__record")))
    alone = named.otherwise(F.concat(F.lit("o:"), F.coalesce(F.col(fallback).cast("string"), F.lit(""))))
    return every.join(labels, "__node", "left").withColumn(out, alone).drop("__record", "__entity", "__owner", "__node", "__label")


class Placement:
    """Rows placed so far by split and label, and where the next ones deviate least from the targets."""

    def __init__(self, totals: np.ndarray, shares: Sequence[float]):
        whole = sum(shares)
        self.targets = np.array([totals * (s / whole) for s in shares], dtype=np.float64)
        self.open = np.array([s > 0 for s in shares])
        self.placed = np.zeros_like(self.targets)
        self.scale = np.maximum(self.targets, 1.0)
        self.wanted = self.targets.sum(axis=1)

    def put(self, added: np.ndarray) -> int:
        """The split in which `added` raises the sum of squared deviations, per label and in all, the least."""
        gap = self.placed - self.targets
        change = (((gap + added) ** 2 - gap**2) / self.scale).sum(axis=1)
        n, whole = added.sum(), gap.sum(axis=1)
        change += ((whole + n) ** 2 - whole**2) / np.maximum(self.wanted, 1.0)
        best = int(np.where(self.open, change, np.inf).argmin())
        self.placed[best] += added
        return best


def assign_groups(df: DataFrame, group: str, label: Column, shares: Sequence[tuple[str, float]], seed: int = 0) -> DataFrame:
    """(group, split, rows): a split for every group, with label shares alike across splits.

    Groups are gathered, in random order within the label most of their rows have, into bundles of about 1 / BUNDLES of all
    rows; a group larger than that is a bundle of its own. Bundles are placed one by one, largest first, each where label
    distributions then deviate least from the targets. The driver holds one line of label counts per bundle, whatever the size.
    """
    spark = df.sparkSession
    counts = cut_lineage(df.select(group, F.coalesce(label.cast("string"), F.lit("")).alias("label")).groupBy(group, "label").agg(F.count("*").alias("n")))
    common = counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(CELLS).collect()
    total, n_groups = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct(group)).first()
    cells = spark.createDataFrame([(r["label"], i) for i, r in enumerate(common)], "label string, cell int")
    # labels beyond the CELLS most frequent ones are told apart by a hash over as many cells again
    rare = F.pmod(F.xxhash64("label"), F.lit(CELLS)).cast("int") + CELLS
    celled = counts.join(F.broadcast(cells), "label", "left").withColumn("cell", F.coalesce("cell", rare)).groupBy(group, "cell").agg(F.sum("n").alias("n"))
    sizes = celled.groupBy(group).agg(F.sum("n").alias("rows"), F.max_by("cell", F.struct("n", -F.col("cell"))).alias("stratum"))
    step = max(1.0, total / BUNDLES)
    drawn = sizes.withColumn("draw", hash_order(group, seed=seed))
    filled = running_sum(drawn, ["stratum"], "draw", [group], F.when(F.col("rows") < step, F.col("rows")).otherwise(0), "upto", bucket_count(n_groups))
    alone = F.col("rows") >= step
    bundle = F.when(alone, F.concat(F.lit("g"), F.col(group))).otherwise(F.concat(F.lit("b"), "stratum", F.lit("."), F.floor((F.col("upto") - 1) / F.lit(step))))
    bundled = cut_lineage(filled.select(group, "rows", bundle.alias("bundle")))
    lines = celled.join(bundled.select(group, "bundle"), group).groupBy("bundle", "cell").agg(F.sum("n").alias("n")).collect()  # at most about 2 * BUNDLES + 2 * CELLS bundles
    by_bundle: dict[str, list[tuple[int, int]]] = {}
    for r in lines:
        by_bundle.setdefault(r["bundle"], []).append((r["cell"], r["n"]))
    used = sorted({c for own in by_bundle.values() for c, _ in own})
    at = {c: i for i, c in enumerate(used)}
    totals = np.zeros(len(used))
    for own in by_bundle.values():
        for c, n in own:
            totals[at[c]] += n
    placement, chosen = Placement(totals, [s for _, s in shares]), []
    for name, own in sorted(by_bundle.items(), key=lambda kv: (-sum(n for _, n in kv[1]), kv[0])):
        added = np.zeros(len(used))
        for c, n in own:
            added[at[c]] = n
        chosen.append((name, shares[placement.put(added)][0]))
    placed = F.broadcast(spark.createDataFrame(chosen, "bundle string, split string"))
    return bundled.join(placed, "bundle").select(group, "split", "rows")


def split_related(
    df: DataFrame, record: str, entity: str, row_id: str, label: Column, seed: int = 0,
    shares: Sequence[tuple[str, float]] = (("train", 0.9), ("validation", 0.05), ("test", 0.05)),
) -> DataFrame:
    """Every input row with group_key and split; the input's own columns of these names are replaced."""
    clean = df.drop("group_key", "split")
    rows = group_keys(clean, record, entity, row_id, entity_components(clean, record, entity))
    assigned = cut_lineage(assign_groups(rows, "group_key", label, shares, seed)).drop("rows")
    return rows.join(assigned, "group_key")


def related_groups(components: DataFrame) -> DataFrame:
    """(label, node, size): every tied entity with its group and the group's size; tied_pairs is its expansion."""
    sizes = components.groupBy("label").agg(F.count("*").alias("size"))
    return components.join(sizes, "label").select("label", "node", "size")
