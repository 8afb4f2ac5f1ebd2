"""Connected components of record–entity graphs by minimum-label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import cut_lineage


def entity_links(edges: DataFrame, record: str, entity: str) -> DataFrame:
    """First round of propagation: every record takes its smallest entity and hands it to its other entities.

    Two entities are connected through records exactly when they are connected through these (a, b) links, b < a. Both
    sides are aggregated before the shuffle, so a hot record or entity costs one row per partition.
    """
    pairs = edges.select(F.col(record).alias("r"), F.col(entity).alias("a")).where("r is not null and a is not null").distinct()
    hubs = pairs.groupBy("r").agg(F.min("a").alias("b"), F.max("a").alias("z")).where("z > b").drop("z")
    return pairs.join(hubs, "r").where("a > b").select("a", "b").distinct()


def propagate_labels(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, label): the smallest node of each node's component.

    One round: every node takes the smallest label among its neighbours and itself, labels are followed to their end by
    pointer doubling, and the links are rewritten to labels. Only local minima survive a round as end points, so the graph
    shrinks geometrically and the number of rounds is logarithmic. Every round is cut off by a checkpoint. Nodes without
    links aren't in the result. Nothing but row counts comes to the driver.
    """
    links = cut_lineage(links)
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a"))
        label = cut_lineage(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")))
        for _ in range(max_rounds):
            # follow each label two pointers further; labels are nodes of the same table
            ends = label.select(F.col("node").alias("label"), F.col("label").alias("next"))
            further = label.select(F.col("node").alias("next"), F.col("label").alias("last"))
            ahead = label.join(ends, "label").join(further, "next").select("node", "label", "last")
            moved = cut_lineage(ahead.select("node", F.col("last").alias("label"), (F.col("last") != F.col("label")).alias("moved")))
            label = moved.select("node", "label")
            if moved.where("moved").isEmpty():
                break
        maps.append(label)
        to = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
        tb = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        renamed = links.join(to, "a").join(tb, "b").where("la <> lb")
        links = cut_lineage(renamed.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct())
    else:
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("label"), F.col("label").alias("last"))
        out = out.join(step, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return cut_lineage(out) if len(maps) > 1 else out
