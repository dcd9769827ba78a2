"""Session defaults, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile

from typing import Any

from pyspark import Broadcast, SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "adspark", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for; on a cluster the caller's own session is used."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's spark.checkpoint.dir, else (tests, one machine) a temporary one."""
    sc: SparkContext = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"adspark-checkpoint-{os.getpid()}")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """Read <root>/<name>.parquet; with columns, only those (the scan prunes to them)."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def bounded_rows(df: DataFrame, bound: int, what: str) -> list:
    """Collect a small table after proving its size: more than `bound` rows raise instead of reaching the driver."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what} has more than {bound} rows; it is no reference table")
    return rows


def bounded_bytes(rows: list, most: int, what: str) -> list:
    """The rows of a reference table whose strings together prove small enough to be sent to every task; else an error."""
    size = sum(len(x.encode()) if isinstance(x, str) else 8 for r in rows for v in r for x in (v if isinstance(v, list) else [v]))
    if size > most:
        raise ValueError(f"{what} holds {size} bytes, more than {most}; it is no reference table")
    return rows


def spread(df: DataFrame, bytes_per_core: int = 32 << 20) -> DataFrame:
    """The rows of a small table that comes in fewer files than there are cores, dealt out to all cores; larger ones as they are.

    For passes that cost much more than moving the rows. What may be moved is bounded by `bytes_per_core`.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_per_core and 0 < len(df.inputFiles()) < cores else df


def hash_below(key: Column | str, share: float) -> Column:
    """Whether a key's 64-bit hash lies in the lowest `share` of all hashes: a repeatable sample that stays whole at any size."""
    return F.xxhash64(key) < F.lit(min(2**63 - 1, -(2**63) + int(share * 2**64)))


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key (rows delivered twice are equal in all columns that matter); NULL keys form one group."""
    return df.dropDuplicates(list(keys))


def wide_partitions(df: DataFrame, least: int = 1) -> int:
    """Number of partitions worth using: the session's shuffle width or its parallelism, the larger."""
    s = df.sparkSession
    return max(least, int(s.conf.get("spark.sql.shuffle.partitions")), s.sparkContext.defaultParallelism)


def busy_partitions(df: DataFrame) -> int:
    """Number of partitions for work that costs much more than moving the rows: those of a materialised table, one per core at least."""
    return max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)


def column_or_null(df: DataFrame, name: str, kind: str):
    """The named column cast to `kind`, or NULL of that type where the table has none."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


class Shared:
    """A broadcast object that travels with its class; `value` is rebuilt once per task."""

    def __init__(self, spark: SparkSession, value: Any):
        self.sent: Broadcast = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.held: Any = None

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "held": None}

    @property
    def value(self) -> Any:
        if self.held is None:
            self.held = cloudpickle.loads(self.sent.value)
        return self.held
