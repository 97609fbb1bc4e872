"""Statistics tables of method results, long and wide, areas and the summary table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display
from ..functions.areas import hectares, square_km, square_metres
from ..functions.change import CVA_TYPES
from .methods import ChangeResult


def _stack(one: DataFrame, method: str, metrics: list[tuple[str, Column, str]]) -> DataFrame:
    """A row for each metric of a one-row table, in order."""
    rows = F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(method).alias("method"), F.lit(name).alias("metric"), value.cast("double").alias("value"), F.lit(unit).alias("unit")) for k, (name, value, unit) in enumerate(metrics)))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def _slug(label: str) -> str:
    """As display.metric_slug, of a name that is known when the query is built."""
    return label.lower().replace(" ", "_").replace("/", "_")


def long_statistics(result: ChangeResult) -> DataFrame:
    """(ordinal, method, metric, value, unit) of a result, by one aggregate over its pixels.

    Unchanged pixels are all that are not changed, masked ones among them.
    """
    p = result.pixels
    columns = set(p.columns)
    valid = next(c for c in ("magnitude", "delta", "abs_diff") if c in columns)
    share = lambda n: F.coalesce(F.try_divide(n * F.lit(100.0), F.count_if(F.col(valid).isNotNull())), F.lit(0.0))
    rounded = lambda x, n: F.round(x, n)
    # Names and units of the metrics.
    metrics = [
        ("total_pixels", F.count("*"), "px"), ("changed_pixels", F.count_if("changed"), "px"), ("unchanged_pixels", F.count("*") - F.count_if("changed"), "px"),
        ("change_pct", rounded(share(F.count_if("changed")), 4), "%"), ("threshold", rounded(F.max("threshold"), 6), ""),
    ]
    if "delta" in columns:
        means = [("ndvi_before", "ndvi_b"), ("ndvi_after", "ndvi_a"), ("delta_ndvi", "delta")]
        metrics += [(f"{n}_mean", rounded(F.avg(c), 6), "") for n, c in means]
        metrics += [(f"{n}_std", rounded(F.stddev_pop(c), 6), "") for n, c in (means[2], means[0], means[1])]
        metrics += [("vegetation_gain_pct", rounded(share(F.count_if("gain")), 4), "%"), ("vegetation_loss_pct", rounded(share(F.count_if("loss")), 4), "%")]
    size = "magnitude" if "magnitude" in columns else "abs_diff" if "abs_diff" in columns else None
    if size:
        own = [(f"{size}_{n}", rounded(f(size), 4), "") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max))]
        if size == "magnitude":
            for k, label in CVA_TYPES.items():
                n = F.count_if(F.col("change_type") == k)
                own += [(f"cva_{_slug(label)}_px", n, "px"), (f"cva_{_slug(label)}_pct", rounded(share(n), 4), "%")]
        metrics += own
    one = p.agg(*(v.alias(f"m{k}") for k, (_, v, _) in enumerate(metrics)))
    return _stack(one, result.method, [(n, F.col(f"m{k}"), u) for k, (n, _, u) in enumerate(metrics)])


def area_statistics(pixels: DataFrame, method: str = "", pixel_size: float = 10) -> DataFrame:
    """Areas of changed and unchanged pixels; the share is of all pixels, masked ones among them."""
    one = pixels.agg(F.count_if("changed").alias("changed"), F.count("*").alias("total")).withColumn("unchanged", F.col("total") - F.col("changed"))
    return one.select(
        F.lit(method).alias("method"),
        F.round(square_metres(F.col("changed"), pixel_size), 2).alias("changed_area_m2"),
        F.round(hectares(F.col("changed"), pixel_size), 4).alias("changed_area_ha"),
        F.round(square_km(F.col("changed"), pixel_size), 6).alias("changed_area_km2"),
        F.round(hectares(F.col("unchanged"), pixel_size), 4).alias("unchanged_area_ha"),
        F.round(F.coalesce(F.try_divide(F.col("changed") * F.lit(100.0), F.col("total")), F.lit(0.0)), 4).alias("change_pct"),
        F.col("total").alias("valid_pixels"),
    )


def all_areas(results: list[ChangeResult], pixel_size: float = 10) -> DataFrame:
    return reduce(DataFrame.unionByName, (area_statistics(r.pixels, r.method, pixel_size) for r in results))


def compare(results: list[ChangeResult]) -> DataFrame:
    """One row for each method; what a method does not have is NULL."""
    rows = []
    for r in results:
        p, columns = r.pixels, set(r.pixels.columns)
        valid = next(c for c in ("magnitude", "delta", "abs_diff") if c in columns)
        share = lambda n, valid=valid: F.round(F.coalesce(F.try_divide(n * F.lit(100.0), F.count_if(F.col(valid).isNotNull())), F.lit(0.0)), 4)
        own = [share(F.count_if("changed")).alias("change_pct"), F.count_if("changed").alias("changed_pixels"), F.count("*").alias("total_pixels"), F.round(F.max("threshold"), 6).alias("threshold")]
        if "delta" in columns:
            own += [share(F.count_if("gain")).alias("ndvi_gain_pct"), share(F.count_if("loss")).alias("ndvi_loss_pct"), F.round(F.avg("delta"), 6).alias("delta_ndvi_mean")]
        if "magnitude" in columns:
            own += [share(F.count_if(F.col("change_type") == k)).alias(f"cva_{_slug(label)}_pct") for k, label in CVA_TYPES.items()]
        one = p.agg(*own)
        rows.append(one.select(F.lit(r.method).alias("method"), *one.columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def summary_table(wide: DataFrame, crop_km2: float = 400.0) -> DataFrame:
    """Method, share, area and threshold as strings, from compare(); areas are of a crop of crop_km2."""
    exact = F.col("threshold")
    threshold = F.when(exact.isNull(), "N/A").when(F.col("method") == "NDVI Differencing", F.concat(F.lit("±"), display.fixed(exact, 4))).otherwise(display.fixed(exact, 2))
    area = F.concat(display.fixed(F.col("change_pct") * (crop_km2 / 100), 0), F.lit(" km²"))
    return wide.select("method", display.percent(F.col("change_pct")).alias("change"), area.alias("changed_area"), threshold.alias("threshold"))
