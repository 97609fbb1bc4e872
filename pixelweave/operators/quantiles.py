"""Exact percentiles by narrowing down ranges of values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Ranges that values are counted in at once, and different values that are put in order at last.
RANGES, FEW = 4096, 20_000


def valued(x: Column) -> Column:
    """Whether a measure has a value: NaN, as NULL, is a masked pixel."""
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def percentile(df: DataFrame, value: str, q: float) -> float | None:
    """The q-th percentile of a column, interpolated as F.percentile does; None if it has no values.

    NaN counts as NULL does. Infinite values have their ranks and are told by their
    number alone. A pass counts the values in equal ranges between their ends; the next one looks at
    the range that holds the rank asked for, until it has few different values. No
    task sees more than its share of the values, or of the counts of one range.
    """
    x = stored(df.filter(valued(F.col(value))).select(F.col(value).cast("double").alias("x")))
    finite = F.abs("x") < float("inf")
    low, high, n, under, over = x.agg(F.min(F.when(finite, F.col("x"))), F.max(F.when(finite, F.col("x"))), F.count("*"), F.count_if(F.col("x") == -float("inf")), F.count_if(F.col("x") == float("inf"))).first()
    if not n:
        return None
    inner = x.filter(finite)
    at = lambda rank: -math.inf if rank < under else math.inf if rank >= n - over else _ranked(inner, rank - under, low, high)
    place = q * (n - 1)
    share = place - int(place)
    first = at(int(place))
    second = at(int(place) + 1) if share else first
    if second == first:
        return first
    # the difference of values with an infinite one is not a number
    return first + (second - first) * share if math.isfinite(second - first) else first * (1 - share) + second * share


def _ranked(x: DataFrame, rank: int, low: float, high: float) -> float:
    """The value that so many others are before; it lies between low and high."""
    before, inside = 0, x
    while low < high:
        step = high / RANGES - low / RANGES
        at = F.least(F.floor(F.col("x") / step - low / step), F.lit(RANGES - 1)) if step > 0 else F.lit(0)
        counts = inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
        for r in counts:
            if before + r.n > rank:
                break
            before += r.n
        narrower = (r.low, r.high) != (low, high)
        low, high = r.low, r.high
        inside = x.filter(F.col("x").between(low, high))
        if r.n <= FEW or not narrower:
            values = inside.groupBy("x").agg(F.count("*").alias("n")).orderBy("x")
            for v in values.toLocalIterator():
                if before + v.n > rank:
                    return v.x
                before += v.n
    return low
