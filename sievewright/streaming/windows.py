"""Event-time windows, bounded queues and roll-ups over streams, each with its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    """A stream over the Parquet files of a path or pattern, with the schema of a batch table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], *aggregates: Column, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Aggregates by event-time window; with `slide` windows overlap, with `delay` late rows are dropped on a stream."""
    d = df.withColumn("__ts", F.col(ts).cast("timestamp"))
    d = d.withWatermark("__ts", delay) if delay else d
    window = F.window("__ts", width, slide) if slide else F.window("__ts", width)
    out = d.groupBy(window, *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *aggregates: Column, delay: str | None = None) -> DataFrame:
    """Aggregates by session: events of a key less than `gap` apart; with `delay` late rows are dropped on a stream."""
    d = df.withColumn("__ts", F.col(ts).cast("timestamp"))
    d = d.withWatermark("__ts", delay) if delay else d
    out = d.groupBy(F.session_window("__ts", gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in out.columns if c != "session_window"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result, written to a shared path; a restart goes on where it was.

    A batch that is written again replaces what it wrote before: it has a folder of its own, or is the whole result.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={batch_id}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def newest(df: DataFrame, keys: list[str], order: list[str], capacity: int) -> DataFrame:
    """Batch form of the bounded queue: what a queue that drops its oldest holds at the end."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= capacity).drop("__n")


def bounded_queue(stream: DataFrame, key: str, item: str, order: str, capacity: int) -> DataFrame:
    """(key, held, produced, dropped) after each micro-batch: a queue per key that drops its oldest items.

    Dropped items are counted, not errors. State holds at most `capacity` items a key.
    """
    kind = stream.schema[item].dataType.simpleString()
    at = stream.schema[order].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, orders, produced, dropped = state.get if state.exists else ([], [], 0, 0)
        held = list(zip(orders, items, strict=True))
        for frame in frames:
            held += list(zip(frame["at"].tolist(), frame["item"].tolist(), strict=True))
            produced += len(frame)
            held.sort()  # cut frame by frame, so a key's batch is never held whole
            dropped += max(0, len(held) - capacity)
            held = held[-capacity:]
        state.update(([i for _, i in held], [o for o, _ in held], produced, dropped))
        yield pd.DataFrame([(k[0], len(held), produced, dropped)], columns=["key", "held", "produced", "dropped"])

    rows = stream.select(F.col(key).alias("key"), F.col(item).alias("item"), F.col(order).alias("at"))
    out = rows.groupBy("key").applyInPandasWithState(
        step, f"key {stream.schema[key].dataType.simpleString()}, held long, produced long, dropped long",
        f"items array<{kind}>, orders array<{at}>, produced long, dropped long", "update", GroupStateTimeout.NoTimeout,
    )
    return out.withColumnRenamed("key", key)


def staleness_gate(df: DataFrame, version: Column, required: int, threshold: float, sync_every: int) -> DataFrame:
    """Keeps rows that are not staler than the gate allows; adds their staleness and the most samples that may wait."""
    most = int(required * (1 + threshold) * sync_every)
    newest_version = df.agg(F.max(version).alias("__now"))
    d = df.crossJoin(F.broadcast(newest_version)).withColumn("staleness", F.col("__now") - version).drop("__now")
    return d.where(F.col("staleness") <= F.lit(int(threshold * sync_every) + sync_every)).withColumn("max_waiting", F.lit(most))


def ready_steps(df: DataFrame, step: str, status: str) -> DataFrame:
    """Finished rows of the steps in which nothing is running."""
    done = df.groupBy(step).agg(F.bool_and(F.coalesce(F.col(status) != "running", F.lit(True))).alias("__done")).where("__done").drop("__done")
    return df.join(done, step, "left_semi").where(F.col(status) == "success")


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: upserts applied. Aggregated before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return best.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def carried_since_sync(df: DataFrame, step: str, count: str, every: int, out: str = "carried") -> DataFrame:
    """Sum of `count` over the earlier steps since the last synchronisation, one every `every` steps; a window holds one interval's steps."""
    w = Window.partitionBy(F.floor(F.col(step) / every)).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(count).over(w), F.lit(0)))
