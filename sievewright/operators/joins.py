"""Joins by time whose hot keys are cut into blocks of time, so that no key's history meets in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.operators.ranks import ranged_row_number


def asof_last(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, value: str, out: str, block_seconds: int = 86_400) -> DataFrame:
    """Left rows with the right side's last value at or before their time; of values of one time the largest.

    A window orders the rows of one key and block; the last value of earlier blocks comes from a table with one row per key and
    block, which is combined before the shuffle. Values that are NULL count as no value.
    """
    block = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / block_seconds).alias("__b")
    values = right.where(F.col(value).isNotNull()).groupBy(*keys, ts).agg(F.max(value).alias("__v")).select(*keys, ts, "__v", block)
    rows = left.select("*", block)
    both = rows.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__side", F.lit(1))
    both = both.unionByName(values.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "__b").orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__in", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1").drop("__v", "__side")
    ends = values.groupBy(*keys, "__b").agg(F.max_by("__v", ts).alias("__end"))
    steps = rows.select(*keys, "__b").distinct().withColumn("__end", F.lit(None).cast(right.schema[value].dataType)).unionByName(ends).groupBy(*keys, "__b").agg(F.max("__end").alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("__carried", F.last("__end", ignorenulls=True).over(earlier)).drop("__end")
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__b").eqNullSafe(F.col("__kb"))]
    carried = carried.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__kb"), "__carried")
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = found.join(carried, on, "left").withColumn(out, F.coalesce("__in", "__carried"))
    return joined.select(*left.columns, out)


def run_numbers(df: DataFrame, group: str, order: Sequence[str], key: str, out: str = "run_no") -> DataFrame:
    """The number of each row within its run of equal keys.

    A row's place in its group less its place among the group's rows of the same key is the same throughout a run, and differs
    between runs of one key. Both places are ranked in buckets, and a run's first place is an aggregate.
    """
    n = ranged_row_number(df, [group], order[0], list(order[1:]), "__n")
    n = ranged_row_number(n, [group, key], order[0], list(order[1:]), "__m").withColumn("__run", F.col("__n") - F.col("__m"))
    starts = n.groupBy(F.col(group).alias("__g"), F.col(key).alias("__k"), F.col("__run").alias("__r")).agg(F.min("__n").alias("__start"))
    on = F.col(group).eqNullSafe(F.col("__g")) & F.col(key).eqNullSafe(F.col("__k")) & (F.col("__run") == F.col("__r"))
    return n.join(starts, on).withColumn(out, (F.col("__n") - F.col("__start") + 1).cast("int")).select(*df.columns, out)
