"""The folder that driver and executors share, for tables that lie between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder is made only where that is unset and the master is local, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This session's folder in the shared one; it goes with the session's JVM."""
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)  # only a folder that is there can be entered
    return path


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the session's folder."""
    return f"{session_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame, kind: str = "table") -> DataFrame:
    """The rows as a table in the session's folder: plans and recovery stay short, and later readers see the same rows."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
