"""Histograms and automatic thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import valued

BINS = 256


def histogram(df: DataFrame, value: str, by: tuple[str, ...] = (), bins: int = BINS, positive: bool = True) -> DataFrame:
    """(by, bin, centre, n) of equal bins from least to largest value; empty bins have no row.

    Bins are closed on the left, the last on both sides. positive keeps values over 0
    alone. NaN counts as NULL does, and infinite values are in no bin.
    """
    finite = valued(F.col(value)) & (F.abs(value) < float("inf"))
    x = df.filter(finite & ((F.col(value) > 0) if positive else F.lit(True))).select(*by, F.col(value).cast("double").alias("_x"))
    ends = x.groupBy(*by).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    both = x.join(ends, list(by)) if by else x.crossJoin(F.broadcast(ends))
    span = F.col("_high") - F.col("_low")
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("_x") - F.col("_low"), span) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = both.groupBy(*by, "_low", "_high", at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select(*by, "bin", (F.col("_low") + (F.col("bin") + 0.5) * span / bins).alias("centre"), "n")


def otsu(df: DataFrame, value: str, by: tuple[str, ...] = (), bins: int = BINS) -> DataFrame:
    """(by, threshold): the centre of the first bin that best parts the positive values.

    0 if all values are alike. Groups without positive values have no row; without
    groups there is always one row, NULL if there are no positive values. Only the
    histogram, at most `bins` rows a group, is ordered.
    """
    h = histogram(df, value, by, bins)
    group = Window.partitionBy(*(by or [F.lit(0)]))
    up_to = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = h.select(
        *by, "bin", "centre", F.sum("n").over(up_to).cast("double").alias("wb"), F.sum(F.col("n") * F.col("centre")).over(up_to).alias("sb"),
        F.sum("n").over(group).cast("double").alias("whole"), F.sum(F.col("n") * F.col("centre")).over(group).alias("total"),
    )
    wf = F.col("whole") - F.col("wb")
    gap = F.try_divide(F.col("sb"), F.col("wb")) - F.try_divide(F.col("total") - F.col("sb"), wf)
    spread = F.when(wf > 0, F.col("wb") * wf * gap * gap)
    best = F.max_by("centre", F.when(spread > 0, F.struct(spread.alias("s"), (-F.col("bin")).alias("b"))))
    out = F.when(F.count("*") > 0, F.coalesce(best, F.lit(0.0))).alias("threshold")
    return h.groupBy(*by).agg(out)
