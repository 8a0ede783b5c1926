"""Tables that cut the lineage of iterative plans, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session without one gets a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or None
    if at is None:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="morphloom-")
        sc.setCheckpointDir(at)
    return at


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends if not dropped before."""
    path = f"{shared_folder(spark).rstrip('/')}/morphloom-{uuid.uuid4().hex}/{name}"
    at, fs = _file_system(spark, path.rsplit("/", 1)[0])
    fs.deleteOnExit(at)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of ``new_path`` that nothing reads any more."""
    at, fs = _file_system(spark, path.rsplit("/", 1)[0])
    fs.delete(at, True)


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """df, written once as a table and read again: later stages neither recompute it nor lose it with an executor."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, new_path(df.sparkSession, name))
