"""Writers: staged publishing with the manifest last, checked tables, metrics and caches by fingerprint."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_MANIFEST.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, s = _fs(spark, source)
    t = _fs(spark, target)[1]
    fs.mkdirs(t.getParent())
    if not fs.rename(s, t):
        raise OSError(f"can't move {source} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)  # not spark.read: it takes names with an underscore for hidden
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def require_empty(violations: DataFrame, what: str) -> None:
    """Raises with a few examples where a table of violations isn't empty."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {[r.asDict() for r in some]}")


def fingerprint(df: DataFrame, *columns: str) -> str:
    """Order-independent digest of a table: its rows, and sums of two row hashes taken where the rows are."""
    names = list(columns) or df.columns
    h, g = F.xxhash64(*names), F.xxhash64(F.lit(1), *names)
    r = df.agg(F.count("*"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(g.cast("decimal(38,0)")), F.lit(0))).first()
    return f"{r[0]}-{int(r[1]) % 2**64:016x}{int(r[2]) % 2**64:016x}"


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], manifest: dict | None = None) -> dict:
    """Writes tables to a staging folder, swaps them in and writes the manifest last; what was there comes back on failure."""
    staging, backup = f"{root}/_staging", f"{root}/_backup"
    for folder in (staging, backup):
        delete(spark, folder)
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
    info = dict(manifest or {})
    info["tables"] = {name: fingerprint(spark.read.parquet(f"{staging}/{name}")) for name in sorted(tables)}
    moved, placed = [], []
    try:
        delete(spark, f"{root}/{MANIFEST}")
        for name in tables:
            if exists(spark, f"{root}/{name}"):
                move(spark, f"{root}/{name}", f"{backup}/{name}")
                moved.append(name)
            move(spark, f"{staging}/{name}", f"{root}/{name}")
            placed.append(name)
        write_text(spark, f"{root}/{MANIFEST}", json.dumps(info, sort_keys=True, ensure_ascii=False))
    except Exception:
        for name in placed:
            delete(spark, f"{root}/{name}")
        for name in moved:
            move(spark, f"{backup}/{name}", f"{root}/{name}")
        raise
    finally:
        delete(spark, staging)
    delete(spark, backup)
    return info


def cached(spark: SparkSession, root: str, key: str, build) -> DataFrame:
    """The table built under this key, if its manifest is there and its rows still have their fingerprint; else built anew."""
    path = f"{root}/{key}"
    if exists(spark, f"{path}/{MANIFEST}"):
        info = json.loads(read_text(spark, f"{path}/{MANIFEST}"))
        df = spark.read.parquet(f"{path}/data")
        if info["tables"].get("data") == fingerprint(df):
            return df
    publish(spark, path, {"data": build()}, {"key": key})
    return spark.read.parquet(f"{path}/data")


def write_checked(df: DataFrame, path: str, rules: Sequence[tuple[str, Column]], key: Sequence[str]) -> None:
    """Writes Parquet only if no row breaks a rule."""
    from sievewright.operators.rules import violations

    require_empty(violations(df, key, rules), f"rows for {path}")
    df.write.parquet(path)


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines with NULLs dropped; returns the rows written, counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation("rows")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def log_metrics(spark: SparkSession, path: str, step: int, metrics: dict[str, float]) -> None:
    """Appends one {step, data} line."""
    row = [(step, {k: float(v) for k, v in metrics.items()})]
    spark.createDataFrame(row, "step long, data map<string,double>").coalesce(1).write.mode("append").json(path)


def dump_by_step(df: DataFrame, path: str, step: str = "step") -> None:
    """Generations by step, one folder each, so that a step can be read or replaced alone."""
    df.write.mode("append").partitionBy(step).json(path)


def set_digest(df: DataFrame, group: str, key: str, out: str = "digest") -> DataFrame:
    """(group, out): a digest of each group's distinct keys that hangs on no order: sorted and digested in 256 buckets, then the buckets' digests."""
    bucketed = df.select(group, F.col(key).alias("__k"), F.substring(F.md5(F.col(key)), 1, 2).alias("__b")).distinct()
    parts = bucketed.groupBy(group, "__b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("__k")), "\n"), 256).alias("__d"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__b", "__d"))), lambda x: x["__d"]), "\n")
    return parts.groupBy(group).agg(F.sha2(joined, 256).alias(out))


def load_bound(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A published table, if its rows and fingerprint are still those of the manifest beside it; else ValueError."""
    known = json.loads(read_text(spark, f"{root}/{MANIFEST}")).get("tables", {}).get(name)
    if known is None:
        raise ValueError(f"the manifest at {root} has no table {name}")
    df = spark.read.parquet(f"{root}/{name}")
    if fingerprint(df) != known:
        raise ValueError(f"{name} at {root} isn't what its manifest says")
    return df.select(*columns) if columns else df


def content_digests(files: DataFrame, recorded: DataFrame, key: str, path: str) -> DataFrame:
    """(key, path, state) of every recorded file, distinct: `same`, `changed` or `missing` by its digest; `files` has path and sha256."""
    r = recorded.select(F.col(key).alias("__key"), F.col(path).alias("__path"), F.col("sha256").alias("__sha")).distinct()
    found = r.join(files.select(F.col("path").alias("__p"), "sha256"), F.col("__p") == F.col("__path"), "left")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("__sha"), "same").otherwise("changed")
    return found.select(F.col("__key").alias(key), F.col("__path").alias(path), state.alias("state"))
