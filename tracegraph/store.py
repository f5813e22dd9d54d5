"""Where jobs cut their lineage: written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and all runs on this machine (tests, a laptop), one of
    our own. A cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tracegraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(spark)}/tracegraph-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table", instead_of: DataFrame | None = None) -> DataFrame:
    """The rows written once as Parquet and read back: later jobs start there, and a lost executor costs no rerun.

    The table of ``instead_of``, which an earlier call gave and nothing will read any more, is deleted after that."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    if instead_of is not None:
        forget(instead_of)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the tables that ``saved`` gave; nothing may read them any more. Others are left alone."""
    for df in tables:
        old = _PATHS.pop(df, None)
        if old:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(old)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tasks(spark: SparkSession) -> int:
    """Into how many tasks to deal a step that makes much of few bytes: those that a shuffle has, and a few for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
