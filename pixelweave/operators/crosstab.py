"""Cross tabulations and agreement of class maps and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(pixels: DataFrame, before: str, after: str, n_classes: int, keep: Column | None = None) -> DataFrame:
    """(class_before, class_after, n, row_pct) of all pairs of classes 1..n_classes, zeros included.

    Class 0 and classes above n_classes are left out; rows of no pixel have 0 %.
    """
    spark = pixels.sparkSession
    both = pixels.filter(F.col(before).between(1, n_classes) & F.col(after).between(1, n_classes))
    both = both.filter(keep) if keep is not None else both
    counts = both.groupBy(F.col(before).cast("int").alias("class_before"), F.col(after).cast("int").alias("class_after")).agg(F.count("*").alias("n"))
    cells = spark.range(n_classes * n_classes).select(F.expr(f"cast(id div {n_classes} + 1 as int)").alias("class_before"), (F.col("id") % n_classes + 1).cast("int").alias("class_after"))
    full = cells.join(F.broadcast(counts), ["class_before", "class_after"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("class_before"))
    return full.withColumn("row_pct", F.coalesce(F.try_divide(F.col("n") * F.lit(100.0), total), F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Aggregate: pixels in both masks over pixels in either, 0 if there are none."""
    return F.coalesce(F.try_divide(F.count_if(a & b).cast("double"), F.count_if(a | b)), F.lit(0.0))


def class_scores(pixels: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs on either side."""
    pairs = pixels.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    rows = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("class"), "n", F.lit(0).alias("as_p")), F.struct(F.col("p").alias("class"), "n", F.lit(1).alias("as_p")))).alias("x"), (F.col("t") == F.col("p")).alias("hit"))
    side = lambda k: F.coalesce(F.sum(F.when(F.col("x.as_p") == k, F.col("x.n"))), F.lit(0))
    hit = F.coalesce(F.sum(F.when(F.col("hit") & (F.col("x.as_p") == 0), F.col("x.n"))), F.lit(0))
    sums = rows.groupBy(F.col("x.class").alias("class")).agg(hit.alias("hit"), side(0).alias("support"), side(1).alias("found"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return sums.select("class", ratio(F.col("hit"), F.col("found")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("support") + F.col("found")).alias("f1"), "support")


def macro_f1(pixels: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: mean F1 over the classes of either side, and accuracy."""
    scores = class_scores(pixels, truth, predicted)
    return scores.agg(F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"))
