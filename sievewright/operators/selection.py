"""Quotas, apportionment and deterministic draws."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.operators.ranks import bucket_count, hash_order, ranged_row_number, running_sum
from sievewright.session import broadcast_if_small, cut_lineage


def digest_order(*fields: Column, seed: str = "") -> Column:
    """Hexadecimal digest to order rows by: the same shuffle on every run and cluster."""
    return F.sha2(F.concat_ws("\x1f", F.lit(seed), *[f.cast("string") for f in fields]), 256)


def largest_remainder(total: int, weights: Sequence[float]) -> list[int]:
    """Shares of `total` in proportion to the weights; ties of remainders go to the earlier one."""
    exact = [Fraction(w).limit_denominator(10**12) for w in weights]
    whole = sum(exact)
    if whole <= 0:
        raise ValueError("weights must have a positive sum")
    floors = [math.floor(total * w / whole) for w in exact]
    order = sorted(range(len(exact)), key=lambda i: (floors[i] - total * exact[i] / whole, i))
    for i in order[: total - sum(floors)]:
        floors[i] += 1
    return floors


def balanced_totals(total: int, parts: int, offset: int = 0) -> list[int]:
    """Equal shares; the remainder goes to the parts after `offset`, in a circle."""
    base, rest = divmod(total, parts)
    return [base + ((i - offset) % parts < rest) for i in range(parts)]


def quota_matrix(rows: Sequence[int], columns: Sequence[int]) -> list[list[int]]:
    """Integer cells with exactly these row and column sums: every row is apportioned by what the columns still have.

    What a column can't hold goes, one by one, to the column with the most room, earlier ones first; the last row takes the rest.
    """
    if sum(rows) != sum(columns):
        raise ValueError("margins have different sums")
    left, cells = list(columns), []
    for need in rows[:-1]:
        row = largest_remainder(need, left) if need else [0] * len(left)
        spilled = sum(max(0, c - x) for c, x in zip(row, left, strict=True))
        row = [min(c, x) for c, x in zip(row, left, strict=True)]
        for _ in range(spilled):
            row[max(range(len(row)), key=lambda j: (left[j] - row[j], -j))] += 1
        cells.append(row)
        left = [x - c for x, c in zip(left, row, strict=True)]
    return [*cells, left] if rows else []


def fit_capacity(quota: Sequence[int], capacity: Sequence[int]) -> list[int]:
    """Moves what a cell can't hold to the cells with the most room; fails if there isn't enough in all."""
    if sum(quota) > sum(capacity):
        raise ValueError("quotas exceed the capacity")
    out = [min(q, c) for q, c in zip(quota, capacity, strict=True)]
    for _ in range(sum(quota) - sum(out)):
        i = max(range(len(out)), key=lambda j: (capacity[j] - out[j], -j))
        out[i] += 1
    return out


def fallback_events(before: Sequence[int], after: Sequence[int]) -> list[tuple[int, int, int]]:
    """(from, to, amount): how the losses of some cells became the gains of others, both in order."""
    losses = [[i, b - a] for i, (b, a) in enumerate(zip(before, after, strict=True)) if b > a]
    gains = [[i, a - b] for i, (b, a) in enumerate(zip(before, after, strict=True)) if a > b]
    events = []
    while losses and gains:
        n = min(losses[0][1], gains[0][1])
        events.append((losses[0][0], gains[0][0], n))
        for queue in (losses, gains):
            queue[0][1] -= n
            if not queue[0][1]:
                queue.pop(0)
    return events


def take_quota(df: DataFrame, cell: Sequence[str], order: Sequence[Column | str], quotas: DataFrame, quota: str = "quota") -> DataFrame:
    """The first `quota` rows of every cell. Spark cuts each task's rows at the largest quota before it shuffles them."""
    most = quotas.agg(F.max(quota)).first()[0] or 0
    ranked = df.withColumn("cell_rank", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).where(F.col("cell_rank") <= int(most))
    return ranked.join(broadcast_if_small(quotas), list(cell)).where(F.col("cell_rank") <= F.col(quota)).drop(quota)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sample_target(n: Column, fraction: float) -> Column:
    """Rows to draw from a stratum of n: the fraction, rounded up, at least one."""
    return F.least(n, F.greatest(F.lit(1), F.ceil(n * F.lit(fraction)))).cast("bigint")


def replace_in_cell(failed: DataFrame, reserve: DataFrame, cell: Sequence[str], failed_order: Sequence[str], reserve_order: Sequence[str], failed_id: str, reserve_id: str) -> DataFrame:
    """The k-th failed row of a cell with the cell's k-th reserve row; NULL where the reserve is used up. Cells may be hot."""
    f = ranged_row_number(failed, cell, failed_order[0], failed_order[1:], "k").select(*cell, failed_id, "k")
    r = ranged_row_number(reserve, cell, reserve_order[0], reserve_order[1:], "k").select(*cell, reserve_id, "k")
    return f.join(r, [*cell, "k"], "left")


def resample_weights(df: DataFrame, weight: str, kind: str = "pow", power: float = 1.0, out: str = "share", key: str | None = None, seed: int = 0) -> DataFrame:
    """Shares to resample rows with: weights to a power, scaled between the least and the largest one, or a random part of the largest."""
    if kind == "pow":
        return df.crossJoin(F.broadcast(df.agg(F.sum(F.pow(F.col(weight), F.lit(power))).alias("__all")))).withColumn(out, F.pow(F.col(weight), F.lit(power)) / F.col("__all")).drop("__all")
    if kind == "max_min":
        ends = df.agg(F.min(weight).alias("__lo"), F.max(weight).alias("__hi"))
        return df.crossJoin(F.broadcast(ends)).withColumn(out, (F.col(weight) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))).drop("__lo", "__hi")
    if kind == "max_random":
        draw = (hash_order(key, seed=seed) / F.lit(2.0**64) + F.lit(0.5)) if key else F.lit(1.0)
        return df.crossJoin(F.broadcast(df.agg(F.max(weight).alias("__hi")))).withColumn(out, F.greatest(F.lit(0.0), F.col(weight) / F.nullif("__hi", F.lit(0.0)) * draw)).drop("__hi")
    raise ValueError(f"unknown kind {kind}")


def resample(df: DataFrame, weight: str, n: int, key: str, seed: int = 0, out: str = "copies") -> DataFrame:
    """Draws n rows in proportion to their weights, with replacement, by systematic resampling: each row with its copies.

    A row's copies differ from n times its share by less than one. Weights below zero count as zero.
    """
    w = F.greatest(F.lit(0.0), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(w), F.lit(0.0))).first()
    if not total:
        return df.withColumn(out, F.lit(0).cast("bigint")).where("false")
    d = df.withColumn("__all", F.lit("")).withColumn("__draw", hash_order(key, seed=seed)).withColumn("__w", w)
    d = running_sum(d, ["__all"], "__draw", [key], F.col("__w"), "__upto", bucket_count(rows), dtype="double")
    scale, start = n / total, (seed * 0.6180339887498949 + 0.5) % 1.0
    copies = F.floor(F.col("__upto") * scale + start) - F.floor((F.col("__upto") - F.col("__w")) * scale + start)
    return d.withColumn(out, copies).where(F.col(out) > 0).drop("__all", "__draw", "__w", "__upto")


def take_quota_once(df: DataFrame, cell: Sequence[str], order: Sequence[str], parent: str, quotas: DataFrame, quota: str = "quota", used: DataFrame | None = None) -> DataFrame:
    """As take_quota in the order of `quotas`' rows, and no parent is taken twice, in no cell; parents in `used` are out from the start.

    A parent stands for its first row in each cell. Cells are filled one after another, as each takes parents from the later
    ones; a cell is one distributed pass, cut off by a checkpoint, so cells are driver-sized.
    """
    wanted = quotas.select(*cell, quota).collect()
    taken, out = used.select(parent).distinct() if used is not None else None, None
    for r in wanted:
        mine = df
        for c in cell:
            mine = mine.where(F.col(c).eqNullSafe(F.lit(r[c])))
        if taken is not None:
            mine = mine.join(taken, parent, "left_anti")
        # the first row of every parent, by an aggregate that combines before the shuffle
        first = mine.groupBy(parent).agg(F.min_by(F.struct(*mine.columns), F.struct(*order)).alias("__x")).select("__x.*")
        best = cut_lineage(first.orderBy(*order).limit(int(r[quota])))
        out = best if out is None else out.unionByName(best)
        taken = best.select(parent) if taken is None else taken.union(best.select(parent))
    return out if out is not None else df.limit(0)


def replace_across(left_over: DataFrame, reserve: DataFrame, bucket: Sequence[str], taxon: str, failed_id: str, reserve_id: str, order: Sequence[str]) -> DataFrame:
    """(failed_id, reserve_id) for rows their own cell had no reserve for: the k-th of a bucket gets the k-th of its remaining reserves.

    Reserves are dealt from the taxon that has the most left, so the remaining counts stay even: the r-th from the end of a
    taxon comes when that taxon is the fullest. Both sides are ranked in buckets.
    """
    counts = reserve.groupBy(*bucket, taxon).agg(F.count("*").alias("__n"))
    r = ranged_row_number(reserve, [*bucket, taxon], order[0], list(order[1:]), "__i").join(counts, [*bucket, taxon])
    # a taxon with n rows gives its i-th when n - i + 1 are left; fuller ones first, then by name
    r = r.withColumn("__left", -(F.col("__n") - F.col("__i") + 1))
    r = ranged_row_number(r, bucket, "__left", [taxon], "k").select(*bucket, F.col(taxon).alias("to_taxon"), reserve_id, "k")
    f = ranged_row_number(left_over, bucket, failed_id, [], "k").select(*bucket, F.col(taxon).alias("from_taxon"), failed_id, "k")
    return f.join(r, [*bucket, "k"], "left")
