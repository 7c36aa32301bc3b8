"""The folder that the driver and all executors share, and tables that are kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of a local session. A cluster must name one."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="fernweave-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def state_of(spark: SparkSession, path: str) -> tuple[int, int, int] | None:
    """(time of change, bytes, files) of a table's folder or file, or None where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    sums = fs.getContentSummary(p)
    return fs.getFileStatus(p).getModificationTime(), sums.getLength(), sums.getFileCount()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, cut off from its lineage."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
