"""Training samples, guards for rare classes, spatial folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import Shape

MIN_CLASS_SAMPLES = 100


def order_key(seed: int, pixel: Column) -> Column:
    """A fixed random order of pixels: md5 of seed and pixel."""
    return F.md5(F.concat(F.lit(f"{seed}:"), pixel.cast("string")))


def class_guard(labels: DataFrame, label: str, classes: list[int], least: int = MIN_CLASS_SAMPLES) -> DataFrame:
    """(class, n, target): where labels of a class go; classes of fewer than `least` pixels go elsewhere.

    Class 3 goes to 2, others to the largest class that has enough (2 if none has).
    Targets are not followed on.
    """
    spark = labels.sparkSession
    counts = labels.filter(F.col(label) > 0).groupBy(F.col(label).cast("int").alias("class")).agg(F.count("*").alias("n"))
    full = spark.createDataFrame([(k,) for k in classes], "class int").join(F.broadcast(counts), "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    largest = full.filter(F.col("n") >= least).agg(F.coalesce(F.max_by("class", F.struct("n", (-F.col("class")).alias("k"))), F.lit(2)).alias("largest"))
    target = F.when(F.col("n") >= least, F.col("class")).when(F.col("class") == 3, 2).otherwise(F.col("largest"))
    return full.crossJoin(F.broadcast(largest)).select("class", "n", target.alias("target"))


def stratified_pair(pixels: DataFrame, label: str, classes: list[int], per_class: int, seed: int = 42) -> DataFrame:
    """Up to per_class pixels a class and date, in the order of order_key: the first for before, the next for after.

    pixels: pixel_id and the label. Adds rank and date; no pixel serves both dates.
    Each class is a top-k, so that no task sorts a whole class.
    """
    keyed = pixels.withColumn("_key", order_key(seed, F.col("pixel_id")))
    tops = [keyed.filter(F.col(label) == k).orderBy("_key", "pixel_id").limit(2 * per_class) for k in classes]
    taken = reduce(DataFrame.unionByName, tops)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_key", "pixel_id"))
    return taken.withColumn("rank", rank).withColumn("date", F.when(F.col("rank") <= per_class, "before").otherwise("after")).drop("_key")


def balanced_binary(pixels: DataFrame, label: str, n: int, seed: int = 42) -> DataFrame:
    """Classes 1 and 2 alike: half of n each, or all of the smaller class; half of those for each date."""
    counts = {r[0]: r[1] for r in pixels.filter(F.col(label).isin(1, 2)).groupBy(label).count().collect()}
    per_class = min(n // 2, counts.get(1, 0), counts.get(2, 0))
    return stratified_pair(pixels, label, [1, 2], per_class // 2, seed)


def spatial_block(shape: Shape, rows: int = 4, cols: int = 4) -> Column:
    """Block number of a pixel: equal blocks, the last ones take the remainder."""
    r = F.least(F.floor(F.col("r") / max(1, shape.height // rows)), F.lit(rows - 1))
    c = F.least(F.floor(F.col("c") / max(1, shape.width // cols)), F.lit(cols - 1))
    return (r * cols + c).cast("int")
