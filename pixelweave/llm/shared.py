"""Storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """The cluster's checkpoint folder; one of its own only for a session without one, as in tests."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = context.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: for small tables that are read several times."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _tables(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """The same as a written table: compressed and read by column."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark) -> None:
    """Deletes the tables that this application has stored; for when all results that read them are written."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few bytes that are broadcast at most: some 20 MB as a hash table.
BROADCAST_ROWS = 250_000


def small_side(df: DataFrame) -> DataFrame:
    """A stored table of keys, marked for broadcast if it has been counted to be small; else Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def distinct_hash(df: DataFrame, *columns: Column) -> Column:
    """A 64-bit hash of the columns that no two different values in df share.

    Values of one hash are told apart by a second one; those that differ (some two
    pairs in 10 billion values) are hashed anew. Nulls of a column must not be
    skipped over by another's value: give whether it is null as a column of its own.
    """
    own, other = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    clashes = df.select(own.alias("h"), other.alias("g")).groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low < high").select("h").collect()
    return F.when(own.isin([r.h for r in clashes]), F.xxhash64(F.lit(2), *columns)).otherwise(own) if clashes else own


#: Type of pair_hash.
PAIR = "struct<x: bigint, y: bigint>"


def pair_hash(*columns: Column) -> Column:
    """128 bits of the columns as two longs, so that no pass over the values is needed to tell them apart.

    Nulls of a column must not be skipped over by another's value, as in distinct_hash.
    """
    return F.struct(F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit(1), *columns).alias("y"))
