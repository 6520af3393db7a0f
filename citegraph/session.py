"""Session defaults and the two ways an iterative job cuts its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A broadcast side must have been measured and found at or below this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
_ROW_OVERHEAD = 64

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One store may emit any share of the changes: merge its sessions per task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "citegraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; cluster settings win over ours."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables (`spark.checkpoint.dir`).

    Only a local session without that setting gets a temporary one of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: iterative jobs need a shared folder that outlives executors"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="citegraph-"))
    return sc.getCheckpointDir().rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables; all of one application lie together, to be removed with it."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _write_and_read(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and continue from the written table.

    A lost executor re-reads files instead of losing the work. A written table also has a true
    size: a checkpointed frame keeps the *estimated* size of its plan, which multiplies at every
    join and, squared round after round, becomes a number too long to compute with.
    """
    return _write_and_read(df, work_folder(df.sparkSession, "table"))


class Rounds:
    """Tables of an iteration: each step is written, then the step before it is removed."""

    def __init__(self, spark: SparkSession) -> None:
        self._root = work_folder(spark, "rounds")
        self._spark = spark
        self._n = 0

    def step(self, df: DataFrame) -> DataFrame:
        out = _write_and_read(df, f"{self._root}/{self._n}")
        if self._n:
            jvm = self._spark.sparkContext._jvm
            old = jvm.org.apache.hadoop.fs.Path(f"{self._root}/{self._n - 1}")
            old.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        self._n += 1
        return out


def measure(df: DataFrame, *text_columns: str) -> tuple[int, int]:
    """(rows, bytes) of a narrow table whose size lies in `text_columns`; one aggregation."""
    size = sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in text_columns), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), size.alias("b")).first()
    return row["n"], row["b"] + row["n"] * _ROW_OVERHEAD


def broadcast_if_small(df: DataFrame, measured_bytes: int) -> DataFrame:
    """A broadcast hint for a side within the bound; a larger one is left to a shuffle join."""
    return F.broadcast(df) if measured_bytes <= BROADCAST_BYTES else df
