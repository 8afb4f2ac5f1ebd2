"""Rule cascades: the first rule a row breaks is its reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of each reason that a preview shows.
PREVIEW = 200


def cascade(df: DataFrame, rules: Sequence[tuple[str, Column]], out: str = "reason") -> DataFrame:
    """Adds the name of the first rule whose condition is true; NULL for rows that pass. NULL conditions don't hold."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    return df.withColumn(out, reason)


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(reason), F.lit("<kept>")).alias(reason)).agg(F.count("*").alias("n"))


def preview(df: DataFrame, order: Sequence[str], reason: str = "reason", rows: int = PREVIEW) -> DataFrame:
    """The first rows of each reason; the window keeps no more than `rows` per task before the shuffle."""
    w = Window.partitionBy(reason).orderBy(*order)
    return df.where(F.col(reason).isNotNull()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= rows).drop("__n")


def violations(df: DataFrame, key: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, reason) for every rule a row breaks; empty means valid."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]))
    return df.select(*key, F.explode(broken).alias("reason"))


def conflicts(df: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Keys that come with more than one payload."""
    return df.groupBy(*key).agg(F.count_distinct(F.struct(*payload)).alias("payloads")).where("payloads > 1")
