"""Ranks and running sums over groups of any size.

A window over a group puts the whole group into one task. Here every group is cut into buckets by the leading part of
its order key; one pass sums the buckets, a window over the small bucket table turns the sums into offsets, and the
window over rows runs inside one bucket only. The result equals the plain window for a unique order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.session import broadcast_if_small

#: Rows a bucket holds on average, and values that bounds of ranges are drawn from.
BUCKET_ROWS, SAMPLE_ROWS = 100_000, 20_000


def hash_order(*cols: Column | str, seed: int = 0) -> Column:
    """A reproducible pseudo-random long for ordering, spread over the whole range."""
    return F.xxhash64(F.lit(seed), *cols)


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    return max(1, -(-rows // bucket_rows))


def range_buckets(df: DataFrame, order: str, buckets: int, seed: int = 0) -> Column:
    """A bucket number for a column of any ordered type, by bounds of a bounded sample (SAMPLE_ROWS values); NULLs come first.

    Only the buckets' sizes hang on the sample, no result does.
    """
    if buckets <= 1:
        return F.lit(0)
    n = df.count()
    drawn = df.select(order).where(F.col(order).isNotNull()).sample(min(1.0, SAMPLE_ROWS / max(1, n)), seed=seed).limit(2 * SAMPLE_ROWS)
    values = sorted(r[0] for r in drawn.collect())
    bounds = sorted({values[i * len(values) // buckets] for i in range(1, buckets)}) if values else []
    if not bounds:
        return F.lit(0)
    return F.when(F.col(order).isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(order))))


def hash_buckets(order: str, buckets: int) -> Column:
    """A bucket number for a column of longs spread over their whole range: equal steps, lower ones first."""
    step = F.floor((F.col(order) / F.lit(2.0**64) + F.lit(0.5)) * F.lit(buckets))
    return F.least(step, F.lit(buckets - 1)).cast("int")


def running_sum(
    df: DataFrame, groups: Sequence[str], order: str, ties: Sequence[str], value: Column, out: str, buckets: int, dtype: str = "bigint", bucket: Column | None = None
) -> DataFrame:
    """Adds `out`, the sum of `value` over the rows of the same group up to and with this one.

    `order` is a column of longs spread over their whole range (see hash_order), or of any type with `bucket` from
    range_buckets; `ties` make the order unique. Rows with NULL group columns form a group of their own.
    """
    b, v, before = f"__{out}_bucket", f"__{out}_value", f"__{out}_before"
    rows = df.withColumn(b, bucket if bucket is not None else hash_buckets(order, buckets)).withColumn(v, value.cast(dtype))
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(f"__{out}_g{i}") for i, g in enumerate(groups)]
    names = [f"__{out}_g{i}" for i in range(len(groups))]
    for g, name in zip(keys, names, strict=True):
        rows = rows.withColumn(name, g)
    inside = Window.partitionBy(*names, b).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    if buckets == 1:
        return rows.withColumn(out, F.sum(v).over(inside)).drop(b, v, *names)
    sums = rows.groupBy(*names, b).agg(F.sum(v).alias(before))
    earlier = Window.partitionBy(*names).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)).cast(dtype))
    joined = rows.join(broadcast_if_small(offsets), [*names, b], "left")
    return joined.withColumn(out, (F.col(before) + F.sum(v).over(inside)).cast(dtype)).drop(b, v, before, *names)


def distributed_row_number(df: DataFrame, groups: Sequence[str], order: str, ties: Sequence[str], out: str, buckets: int) -> DataFrame:
    """row_number() over (partition by groups order by order, ties) for an order of spread longs."""
    return running_sum(df, groups, order, ties, F.lit(1), out, buckets)


def ranged_row_number(df: DataFrame, groups: Sequence[str], order: str, ties: Sequence[str], out: str, buckets: int | None = None) -> DataFrame:
    """The same for an order of any type; the number of buckets follows the rows."""
    buckets = buckets or bucket_count(df.count())
    return running_sum(df, groups, order, ties, F.lit(1), out, buckets, bucket=range_buckets(df, order, buckets))
