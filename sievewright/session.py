"""Session settings and the helpers every operator shares: table access, lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a table may be broadcast; beyond them the join is left to the optimizer.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def build_session(app: str = "sievewright", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. A session that names none gets a temporary one if it runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"sievewright-checkpoint-{os.getpid()}")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoints go to the shared folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs a read, not a recomputation.

    A checkpoint keeps its plan's size estimate, and a join's estimate is the product of its sides'. In a loop of self-joins
    its digits grow threefold a step, until the driver does nothing but multiply; an estimate past a long becomes Spark's
    default for an unknown size.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cut = df.checkpoint(eager=True)
    plan = cut._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < 1 << 63:
        return cut
    return DataFrame(cut.sparkSession._jsparkSession.internalCreateDataFrame(plan.toRdd(), cut._jdf.schema(), False), cut.sparkSession)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table proven small: by its size statistic, else by counting rows and bytes of at most max_rows + 1 rows.

    A larger table gets no hint and joins by shuffle.
    """
    known = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if 4 * int(str(known)) <= BROADCAST_BYTES:  # files are compressed
        return F.broadcast(df)
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) if t in ("string", "binary") else F.lit(16) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))), F.lit(16))
    if any(t.startswith(("array", "map", "struct")) for _, t in df.dtypes):
        width = width + F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c, t in df.dtypes if t.startswith(("array", "map", "struct"))])))
    n, size = df.select(width.alias("w")).limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """Deals out the rows of an input that has fewer partitions than the cluster has cores, for work that costs far more than its input's size.

    A larger input is read where it lies, without a shuffle; no result hangs on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores // 2 else df
