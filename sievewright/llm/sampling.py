"""Samples that follow target proportions of categories.

Divisor method: within a category rows are numbered in random order and row r gets the priority (r - 0.5) / target. Rows
that fill the minimum of a small category come first, then the globally smallest priorities are kept, so the seats of
exhausted categories pass to the others by themselves. Row numbers are taken in buckets (see operators.ranks): a category
may hold any share of all rows. Only one row per category comes to the driver.

Defined cases: rows without a key are no candidates; rows whose labels aren't known belong to no cell but count in the
total; repeated keys count once, a key with two cells belongs to the smaller one in the sample and to both in the report's
`available`; a target of 0 gets only its minimum; an empty table gives an empty sample and a report of zeros.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import strip
from sievewright.operators.ranks import bucket_count, distributed_row_number, hash_order
from sievewright.session import broadcast_if_small, cut_lineage

#: Cells that targets may have; each is one row on the driver.
MAX_CELLS = 100_000


def canonical_labels(df: DataFrame, aliases: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Replaces each field by its canonical name; labels are compared trimmed and in lower case, others become NULL."""
    for field in fields:
        known = aliases.where(F.col("field_name") == field).select(F.lower(strip("alias")).alias("__alias"), F.col("canonical").alias("__canonical")).dropDuplicates(["__alias"])
        spelled = df.withColumn("__alias", F.lower(strip(F.col(field).cast("string"))))
        df = spelled.join(broadcast_if_small(known), "__alias", "left").withColumn(field, F.col("__canonical")).drop("__alias", "__canonical")
    return df


def divisor_seats(seats: int, targets: Sequence[Fraction], floors: Sequence[int], available: Sequence[int]) -> list[int]:
    """Seats of each category when `seats` rows of the smallest priorities (rank - 1/2) / target are kept, floors first."""
    low = [min(f, a) for f, a in zip(floors, available, strict=True)]
    if sum(low) >= seats:  # not even the minimums fit: they are filled evenly, rank by rank
        got = [0] * len(low)
        ranks = heapq.merge(*([(r, i) for r in range(1, n + 1)] for i, n in enumerate(low)))
        for _, (_, i) in zip(range(seats), ranks, strict=False):
            got[i] += 1
        return got

    def kept(at: Fraction) -> list[int]:
        return [max(f, min(a, int(at * t + Fraction(1, 2)))) for t, f, a in zip(targets, low, available, strict=True)]

    small, large = Fraction(0), Fraction(1)
    limit = sum(max(f, a if t > 0 else f) for t, f, a in zip(targets, low, available, strict=True))
    seats = min(seats, limit)
    while sum(kept(large)) < seats:
        large *= 2
    for _ in range(200):
        middle = (small + large) / 2
        if sum(kept(middle)) <= seats:
            small = middle
        else:
            large = middle
        if sum(kept(small)) == seats:
            break
    got = kept(small)
    queue = [((Fraction(2 * g + 1, 2) / t), i) for i, (g, t, a) in enumerate(zip(got, targets, available, strict=True)) if t > 0 and g < a]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < available[i]:
            heapq.heappush(queue, (Fraction(2 * got[i] + 1, 2) / targets[i], i))
    return got


def proportional_sample(
    df: DataFrame, key: str, cells: Sequence[str], targets: DataFrame, fraction: Fraction = Fraction(1, 4), seed: int = 0,
    target: str = "target_share", minimum: str = "min_rows",
) -> tuple[DataFrame, DataFrame]:
    """(sample, report). `df` has canonical cells, `targets` one row per cell with its share and least rows.

    sample: key, cells, cell_rank, priority. report: cells, target_share, min_rows, target_rows, available, sampled,
    sampled_share, short: the ranks of the cell's rows end before its quota at its own share, or before its minimum.
    """
    spark, names = df.sparkSession, list(cells)
    known = df.where(F.col(key).isNotNull()).select(key, *names)
    pairs = cut_lineage(known.distinct())  # partial aggregation first: a hot key shuffles once per partition
    total = pairs.select(key).distinct().count()
    seats = int(total * fraction)
    rows = targets.select(*names, F.col(target).cast("decimal(38,18)"), F.col(minimum)).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    goal = {tuple(r)[: len(names)]: (Fraction(r[-2] or 0), r[-1] or 0) for r in rows}
    order = sorted(goal, key=lambda c: tuple(x or "" for x in c))
    wanted = spark.createDataFrame([(*c, i) for i, c in enumerate(order)], ", ".join(f"{n} string" for n in names) + ", cell int")
    celled = pairs.join(F.broadcast(wanted), names)
    # a key with rows in two cells can be drawn in the smaller one only; within a cell such borrowed rows are ranked last
    homes = celled.groupBy(key).agg(F.min("cell").alias("home"))
    owned_of = dict(homes.groupBy(F.col("home").alias("cell")).count().collect())
    got = divisor_seats(seats, [goal[c][0] for c in order], [goal[c][1] for c in order], [owned_of.get(i, 0) for i in range(len(order))])
    at_home = celled.select(key, "cell").join(homes, key).withColumn("owned", F.col("cell") == F.col("home"))
    half = F.shiftrightunsigned(hash_order(key, seed=seed), 1)
    draw = F.when(F.col("owned"), half + F.lit(-(2**63))).otherwise(half)
    ranked = distributed_row_number(at_home.withColumn("draw", draw), ["cell"], "draw", [key], "cell_rank", bucket_count(total))
    # rows that the unredistributed quota and the minimum of a cell call for
    needs = [max(goal[c][1], -(-goal[c][0] * seats // 1)) for c in order]
    plan = spark.createDataFrame(
        [(i, *c, float(goal[c][0]), goal[c][1], float(goal[c][0] * seats), got[i], int(needs[i])) for i, c in enumerate(order)],
        "cell int, " + ", ".join(f"{n} string" for n in names) + ", target_share double, min_rows bigint, target_rows double, seats bigint, need bigint",
    )
    drawn = F.col("cell_rank") <= F.col("seats")
    placed = ranked.join(F.broadcast(plan), "cell")
    sample = placed.where(drawn).select(key, *names, "cell_rank", ((F.col("cell_rank") - 0.5) / F.nullif("target_share", F.lit(0.0))).alias("priority"))
    # the report reads the ranks that the draw gave: how far a cell's ranks reach, and which of them were kept
    reached = placed.groupBy("cell").agg(F.max("cell_rank").alias("available"), F.count_if(drawn).alias("sampled"))
    report = plan.join(reached, "cell", "left").na.fill(0, ["available", "sampled"])
    share = F.col("sampled") / F.lit(float(seats or 1))
    report = report.select(*names, "target_share", "min_rows", "target_rows", "available", "sampled", share.alias("sampled_share"), (F.col("available") < F.col("need")).alias("short"))
    return sample, report
