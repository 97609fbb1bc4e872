"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir.

    Without the setting a local session, as in tests, has a temporary folder; a cluster must have it.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = context.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(where)
    return f"{where.rstrip('/')}/tables/{context.applicationId}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application has stored, for when all results that read it are written."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(scratch(spark)).getParent()
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The same table, computed once, written as Parquet under spark.checkpoint.dir and read from there.

    What is read several times is so computed once, its lineage ends, and an executor
    that is lost costs no more than its tasks. Folders are named by the application.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
