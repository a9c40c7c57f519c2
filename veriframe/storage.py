"""The folder that driver and executors share, and what a run writes there."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``.

    Where the session does not name one, a folder of its own is made and set in
    local mode; on a cluster, whose executors wouldn't see it, RuntimeError.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="veriframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The JVM's path object and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether there is such a folder, in any store that Spark reads."""
    where, store = hadoop_path(spark, path)
    return store.exists(where) and store.getFileStatus(where).isDirectory()


@cache
def _run_folder(base: str, application: str) -> str:
    """The folder of this run, which the driver's JVM removes when it ends."""
    path = f"{base}/veriframe/{application}"
    where, store = hadoop_path(SparkSession.active(), path)
    store.mkdirs(where)
    store.deleteOnExit(where)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_run_folder(shared_dir(spark), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The lineage ends there: a lost executor costs a read of the file, not the
    work before it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Remove all that this run has cut off so far.  Results that still read from it can't be read any more."""
    where, store = hadoop_path(spark, f"{shared_dir(spark)}/veriframe/{spark.sparkContext.applicationId}")
    store.delete(where, True)
