"""Batch algebra: repeat, slice, pad, chunk and reorder rows.

Rows have no order in Spark, so every operator that depends on one takes a unique ordering column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.operators.ranks import bucket_count, distributed_row_number, ranged_row_number


def number_rows(df: DataFrame, order: str, out: str = "row_no") -> DataFrame:
    """Adds a row number from 0 in the order of a unique column, by ranges: no task sorts more than a bucket."""
    d = ranged_row_number(df.withColumn("__all", F.lit("")), ["__all"], order, [], out)
    return d.withColumn(out, F.col(out) - 1).drop("__all")


def repeat(df: DataFrame, times: Column | int, out: str = "repeat_no") -> DataFrame:
    """Every row `times` times, numbered from 0; a column gives each row its own number of times."""
    n = F.lit(times) if isinstance(times, int) else times
    return df.where(n > 0).withColumn(out, F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))


def slice_rows(df: DataFrame, order: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    d = number_rows(df, order, "__i").where((F.col("__i") >= start) & ((F.col("__i") - start) % step == 0))
    return (d.where(F.col("__i") < stop) if stop is not None else d).drop("__i")


def chunk(df: DataFrame, order: str, parts: int, out: str = "chunk") -> DataFrame:
    """Equal contiguous parts; the number of rows must be divisible."""
    n = df.count()
    if n % parts:
        raise ValueError(f"{n} rows can't be cut into {parts} equal parts")
    return number_rows(df, order, "__i").withColumn(out, F.floor(F.col("__i") / max(1, n // parts)).cast("int")).drop("__i")


def split_sized(df: DataFrame, order: str, size: int, out: str = "chunk") -> DataFrame:
    return number_rows(df, order, "__i").withColumn(out, F.floor(F.col("__i") / size).cast("int")).drop("__i")


def pad_to_divisor(df: DataFrame, order: str, divisor: int, out: str = "is_padding") -> DataFrame:
    """Rows from the start are repeated, in a circle, until their number is divisible."""
    n = df.count()
    need = -n % divisor if n else 0
    d = number_rows(df, order, "__i")
    times = F.floor((F.lit(need) - F.col("__i") + n - 1) / F.lit(max(1, n)))
    extra = repeat(d.where(F.col("__i") < need), times, "__r").drop("__r")
    return d.withColumn(out, F.lit(False)).unionByName(extra.withColumn(out, F.lit(True))).drop("__i")


def union_checked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Joins two batches by key; columns they share must be equal, or the join fails at run time."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    r = right.select(key, *[F.col(c).alias(f"__r_{c}") for c in shared], *[c for c in right.columns if c not in left.columns])
    d = left.join(r, key)
    for c in shared:
        d = d.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs"))))
    return d.drop(*[f"__r_{c}" for c in shared])


def reorder(df: DataFrame, permutation: DataFrame, key: str, place: str) -> DataFrame:
    return df.join(permutation, key).orderBy(place)


def upsample(df: DataFrame, order: str, multiple: int, group: str, tokens: Sequence[str], fresh: str, zeros: Sequence[str] = ()) -> DataFrame:
    """Pads to a multiple with rows of one token made from the first row: arrays cut to one item, one new group for all, values of 0.

    They are flagged, so that no statistic of the batch counts them.
    """
    n = df.count()
    first = df.orderBy(order).limit(1)
    fake = repeat(first, -n % multiple, "__r").drop("__r") if n % multiple else first.limit(0)
    fake = fake.withColumn(group, F.lit(fresh).cast(df.schema[group].dataType))
    for c in tokens:
        fake = fake.withColumn(c, F.slice(c, 1, 1))
    for c in zeros:
        fake = fake.withColumn(c, F.transform(c, lambda x: x * 0) if df.schema[c].dataType.typeName() == "array" else F.lit(0).cast(df.schema[c].dataType))
    return df.withColumn("is_padding", F.lit(False)).unionByName(fake.withColumn("is_padding", F.lit(True)))


def pad_with_end(df: DataFrame, order: str, rows: int, end: str = "last", out: str = "is_padding") -> DataFrame:
    """`rows` copies of the first or the last row behind the others."""
    edge = df.orderBy(order if end == "first" else F.desc(order)).limit(1)
    extra = repeat(edge, rows, "__r").drop("__r") if rows else edge.limit(0)
    return df.withColumn(out, F.lit(False)).unionByName(extra.withColumn(out, F.lit(True)))


def mini_batches(df: DataFrame, key: str, size: int, epochs: int = 1, seed: int = 0) -> DataFrame:
    """Every row once an epoch with its `epoch`, `batch_no` and `place`, in another order each epoch; a rest that fills no batch is left out.

    The order is that of digests of seed, epoch and key, ranked in buckets.
    """
    n = df.count()
    d = df.crossJoin(df.sparkSession.range(epochs).select(F.col("id").cast("int").alias("epoch")))  # a few rows
    text = F.concat_ws("/", F.lit(str(seed)), "epoch", F.col(key).cast("string"))
    d = d.withColumn("__draw", (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") - F.lit(2**59)) * 16)
    d = distributed_row_number(d, ["epoch"], "__draw", [key], "__i", bucket_count(n))
    d = d.withColumn("batch_no", F.floor((F.col("__i") - 1) / size).cast("int")).withColumn("place", ((F.col("__i") - 1) % size).cast("int"))
    return d.where(F.col("batch_no") < n // size).drop("__i", "__draw")


def pack(df: DataFrame, group: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Jagged form: one row per group with an array per column and `offsets`; `unpack` is its inverse. Groups are small by their meaning."""
    items = F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    d = df.groupBy(*group).agg(items.alias("__x"))
    return d.select(*group, *[F.col("__x").getField(c).alias(c) for c in columns], F.size("__x").alias("length"))


def unpack(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.select(*group, F.explode(F.arrays_zip(*columns)).alias("x")).select(*group, *[f"x.{c}" for c in columns])


def differing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, column) of every value in which two tables with the same columns differ, NaN equal to itself; a missing row differs in `key`."""
    other = right.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__r_{c}") for c in right.columns])
    d = left.join(other, F.col(key).eqNullSafe(F.col("__k")), "full")
    gone = F.col(f"__r_{key}").isNull() != F.col(key).isNull()
    names = [F.when(~gone & ~F.col(c).eqNullSafe(F.col(f"__r_{c}")), F.lit(c)) for c in left.columns if c != key]
    bad = F.filter(F.array(F.when(gone, F.lit(key)), *names), lambda x: x.isNotNull())
    return d.select(F.coalesce(F.col(key), F.col("__k")).alias(key), F.explode(bad).alias("column"))
