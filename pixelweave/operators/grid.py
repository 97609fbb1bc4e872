"""Pixel grids: dense grids, joins of dates and layers, masks.

A pixel table has integer columns r and c; a grid is dense if it has a row for
each of height x width pixels.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scene-classification codes of clouds and their shadows.
CLOUDY = (3, 8, 9, 10)


@dataclass(frozen=True)
class Shape:
    height: int
    width: int


def shape_of(pixels: DataFrame) -> Shape:
    """Extent of a pixel table from its largest row and column (one small aggregate)."""
    r, c = pixels.agg(F.max("r"), F.max("c")).first()
    return Shape(0 if r is None else r + 1, 0 if c is None else c + 1)


def dense(pixels: DataFrame, shape: Shape) -> DataFrame:
    """All pixels of the extent; columns of those that are missing are NULL."""
    cells = pixels.sparkSession.range(shape.height * shape.width)
    width = max(shape.width, 1)
    cells = cells.select(F.expr(f"cast(id div {width} as int)").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    return cells.join(pixels, ["r", "c"], "left")


def extents(pixels: DataFrame, *by: str) -> DataFrame:
    """(by, height, width) of each grid of a pixel table."""
    return pixels.groupBy(*by).agg((F.max("r") + 1).cast("int").alias("height"), (F.max("c") + 1).cast("int").alias("width"))


def dense_by(pixels: DataFrame, sizes: DataFrame, *by: str) -> DataFrame:
    """All pixels of each grid's extent (see extents), with height and width; columns of those that are missing are NULL.

    The rows of a grid are dealt out before their pixels are made, so that no task makes a whole grid.
    """
    rows = sizes.select(*by, "height", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r")).repartition(*by, "r")
    cells = rows.select(*by, "height", "width", "r", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("c"))
    return cells.join(pixels, [*by, "r", "c"], "left")


def crop(pixels: DataFrame, x_off: int = 0, y_off: int = 0, x_size: int = 1000, y_size: int = 1000) -> DataFrame:
    """The pixels of a window; a predicate that Parquet can prune by."""
    return pixels.filter(F.col("r").between(y_off, y_off + y_size - 1) & F.col("c").between(x_off, x_off + x_size - 1))


def shift_geotransform(gt: Column, x_off: Column, y_off: Column) -> Column:
    """Affine origin of a window of the raster."""
    return F.struct(
        (gt["origin_x"] + x_off * gt["px_w"]).alias("origin_x"), gt["px_w"].alias("px_w"), gt["rot_x"].alias("rot_x"),
        (gt["origin_y"] + y_off * gt["px_h"]).alias("origin_y"), gt["rot_y"].alias("rot_y"), gt["px_h"].alias("px_h"),
    )


def align(before: DataFrame, after: DataFrame) -> DataFrame:
    """Joins two dates on the pixel; other columns get the suffixes _b and _a."""
    left = before.select("r", "c", *(F.col(x).alias(f"{x}_b") for x in before.columns if x not in ("r", "c")))
    right = after.select("r", "c", *(F.col(x).alias(f"{x}_a") for x in after.columns if x not in ("r", "c")))
    return left.join(right, ["r", "c"])


def stack_bands(bands: dict[str, DataFrame], value: str = "x") -> DataFrame:
    """One table (r, c, a column a band) of separate band tables (r, c, value); what a band does not have is NULL.

    Full outer joins on the pixel; all of them deal out by the same key, so each band is shuffled once.
    """
    tables = [t.select("r", "c", F.col(value).alias(name)) for name, t in bands.items()]
    return reduce(lambda a, b: a.join(b, ["r", "c"], "full_outer"), tables)


def cloudy(scl: Column) -> Column:
    return scl.isin(*CLOUDY)


def clear(pixels: DataFrame, scl: DataFrame, scale: int = 2, out: str = "clear") -> DataFrame:
    """Adds whether the half-resolution layer (r20, c20, scl) says a pixel is not cloudy; NULL layers are clear."""
    low = scl.select("r20", "c20", (~cloudy(F.col("scl"))).alias(out))
    keyed = pixels.withColumn("r20", F.expr(f"r div {scale}").cast("int")).withColumn("c20", F.expr(f"c div {scale}").cast("int"))
    return keyed.join(low, ["r20", "c20"], "left").withColumn(out, F.coalesce(out, F.lit(True))).drop("r20", "c20")


def masked(pixels: DataFrame, valid: Column, *columns: str) -> DataFrame:
    """Columns are NULL where the pixel is not valid."""
    return pixels.withColumns({c: F.when(valid, F.col(c)) for c in columns})


def raster_info(pixels: DataFrame, *bands: str) -> DataFrame:
    """Width, height and, for each band, minimum, maximum and mean, as one row a band."""
    whole = pixels.agg((F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height"), *(f(b).alias(f"{n}_{b}") for b in bands for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))
    rows = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), *(F.col(f"{n}_{b}").alias(n) for n in ("min", "max", "mean"))) for b in bands)))
    return whole.select("width", "height", rows.alias("x")).select("width", "height", "x.*")


def normalise(pixels: DataFrame, band: str, out: str) -> DataFrame:
    """(x - min) / (max - min); 0 everywhere if the range is 0."""
    ends = pixels.agg(F.min(band).alias("_low"), F.max(band).alias("_high"))
    scaled = F.when(F.col("_high") == F.col("_low"), F.lit(0.0)).otherwise(F.try_divide(F.col(band) - F.col("_low"), F.col("_high") - F.col("_low")))
    return pixels.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("_low", "_high")


def scene_zscore(pixels: DataFrame, *columns: str) -> DataFrame:
    """Columns less their mean over their population deviation (1 if that is 0)."""
    ends = pixels.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return pixels.crossJoin(F.broadcast(ends)).withColumns(scaled).drop(*(f"_{k}_{c}" for k in "ms" for c in columns))
