"""Session helpers: table access, shared stage folder, lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured row count is at most this.
BROADCAST_ROWS = 50_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster: the same path, or --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is set and all tasks run in this process.

    On a cluster a folder of one machine would lose the tables of the others, so there the setting must be given.
    """
    reachable(spark)
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(sc, "_loom_dir", None) or tempfile.mkdtemp(prefix="loom-")
        sc._loom_dir = where
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back.

    The shuffle files of the write are deleted at its end, for nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder, which survives the loss of executors.

    A written table, not checkpoint(): that carries the statistics and constraints of the plan along, and in loops
    these grow from round to round. The files of the ``done`` tables, which no later step reads, are deleted.
    """
    out = staged(df, "cut")
    for d in done:
        drop_staged(d)
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    path = getattr(df, "_loom_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if it has at most ``rows`` rows (counted up to the bound), else ``df``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def real_number(col):
    """Null for null, NaN and infinities."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)
