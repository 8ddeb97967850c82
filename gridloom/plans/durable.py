"""Materialise intermediate tables where every executor can see them.

Iterative operators cut their lineage through :func:`durable`, which writes
Parquet below ``spark.checkpoint.dir``.  Unlike ``localCheckpoint`` the files
survive the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme and authority of the default file system if it has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, qualified; a private one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return qualified(spark, folder).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the application's own folder, which may go once the application has ended."""
    return f"{shared_dir(spark)}/gridloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader over the files."""
    return write_to(df, fresh_path(df.sparkSession, label))


def write_to(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables of an iteration: each is written, and the one before the last is deleted."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.label, self.paths = spark, label, []

    def write(self, df: DataFrame) -> DataFrame:
        self.paths.append(fresh_path(self.spark, self.label))
        out = write_to(df, self.paths[-1])
        if len(self.paths) > 2:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(0))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return out
