"""Tile grids, pixels in tiles, statistics and stitching of tiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.areas import hectares, square_km


def tile_grid(spark: SparkSession, width: int, height: int, n_x: int, n_y: int, overlap: int = 50) -> DataFrame:
    """Thirteen integers for each tile; the last row and column of tiles take the remainder."""
    w, h = width // n_x, height // n_y
    tiles = spark.range(n_x * n_y).select(F.col("id").cast("int").alias("tile_id"), F.expr(f"cast(id div {n_x} as int)").alias("tile_row"), F.expr(f"cast(id % {n_x} as int)").alias("tile_col"))
    tiles = tiles.withColumns({"dest_x": F.col("tile_col") * w, "dest_y": F.col("tile_row") * h})
    tiles = tiles.withColumns({
        "x_size_inner": F.when(F.col("tile_col") < n_x - 1, F.lit(w)).otherwise(width - F.col("dest_x")),
        "y_size_inner": F.when(F.col("tile_row") < n_y - 1, F.lit(h)).otherwise(height - F.col("dest_y")),
        "x_off": F.greatest(F.lit(0), F.col("dest_x") - overlap),
        "y_off": F.greatest(F.lit(0), F.col("dest_y") - overlap),
    })
    tiles = tiles.withColumns({
        "x_size": F.least(F.lit(width), F.col("dest_x") + F.col("x_size_inner") + overlap) - F.col("x_off"),
        "y_size": F.least(F.lit(height), F.col("dest_y") + F.col("y_size_inner") + overlap) - F.col("y_off"),
        "x_off_inner": F.col("dest_x") - F.col("x_off"),
        "y_off_inner": F.col("dest_y") - F.col("y_off"),
    })
    return tiles.select("tile_id", "tile_row", "tile_col", "x_off", "y_off", "x_size", "y_size", "x_off_inner", "y_off_inner", "x_size_inner", "y_size_inner", "dest_x", "dest_y")


def half_resolution(tiles: DataFrame, scale: int = 2) -> DataFrame:
    """The tiles' windows in a layer of lower resolution; sizes are 1 at least."""
    half = lambda c: F.expr(f"cast({c} div {scale} as int)")
    return tiles.select("tile_id", half("x_off").alias("x_off"), half("y_off").alias("y_off"), F.greatest(F.lit(1), half("x_size")).alias("x_size"), F.greatest(F.lit(1), half("y_size")).alias("y_size"))


def _owners(at: str, n: int, parts: int, overlap: int) -> Column:
    """Tiles along an axis whose window, overlap included, has the coordinate."""
    size = max(n // parts, 1)
    clip = lambda x: F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(x / size).cast("int")))
    return F.sequence(clip(F.col(at) - overlap), clip(F.col(at) + overlap))


def in_tiles(pixels: DataFrame, width: int, height: int, n_x: int, n_y: int, overlap: int = 50) -> DataFrame:
    """A row for each pixel and tile whose window has it, by arithmetic: tile_row, tile_col, tile_id, inner."""
    rows = pixels.withColumn("tile_row", F.explode(_owners("r", height, n_y, overlap))).withColumn("tile_col", F.explode(_owners("c", width, n_x, overlap)))
    own = lambda at, n, parts: F.least(F.lit(parts - 1), F.floor(F.col(at) / max(n // parts, 1)).cast("int"))
    inner = (F.col("tile_row") == own("r", height, n_y)) & (F.col("tile_col") == own("c", width, n_x))
    return rows.withColumn("tile_id", F.col("tile_row") * n_x + F.col("tile_col")).withColumn("inner", inner)


def in_footprints(pixels: DataFrame, footprints: DataFrame, side: int = 64) -> DataFrame:
    """A row for each pixel and rectangle that has it; rectangles (r0, c0, height, width) are of any size and may overlap.

    A pixel is in one square bin, a rectangle in all that it touches: an equi-join on
    the bin, then a look at the borders within it. Columns of both sides come along.
    Rectangles without area, or with NULL for a border, have no pixels.
    """
    at = lambda x: F.floor(x / side).cast("int")
    whole = footprints.filter("height > 0 and width > 0 and r0 is not null and c0 is not null")
    rows = whole.withColumn("_br", F.explode(F.sequence(at(F.col("r0")), at(F.col("r0") + F.col("height") - 1))))
    cells = rows.withColumn("_bc", F.explode(F.sequence(at(F.col("c0")), at(F.col("c0") + F.col("width") - 1))))
    placed = pixels.withColumns({"_br": at(F.col("r")), "_bc": at(F.col("c"))}).join(cells, ["_br", "_bc"])
    inside = (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r0") + F.col("height")) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c0") + F.col("width"))
    return placed.filter(inside).drop("_br", "_bc")


def footprint_statistics(pixels: DataFrame, footprints: DataFrame, by: str, value: str, side: int = 64) -> DataFrame:
    """(by, n, low, high): number of pixels, least and largest value under the rectangles (r0, c0, height, width) of each key.

    As in_footprints, grouped by the key; but rectangles that are the same are looked
    up once, and their figures are joined to all that have them. So pairs of pixel and
    rectangle grow with the different rectangles, not with the footprints.
    """
    border = ["r0", "c0", "height", "width"]
    found = in_footprints(pixels.select("r", "c", F.col(value).alias("_x")), footprints.select(*border).distinct(), side)
    figures = found.groupBy(*border).agg(F.count("*").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    return footprints.select(by, *border).join(figures, border).groupBy(by).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def tile_statistics(pixels: DataFrame, changed: str, valid: str | None = None) -> DataFrame:
    """Counts, share and area of change for each tile (tile_id, tile_row, tile_col)."""
    ok = F.col(valid) if valid else F.lit(True)
    out = pixels.groupBy("tile_id", "tile_row", "tile_col").agg(F.count_if(ok).alias("valid_pixels"), F.count_if(ok & F.col(changed)).alias("changed_pixels"))
    return out.withColumns({
        "change_pct": F.round(F.coalesce(F.try_divide(F.col("changed_pixels") * F.lit(100.0), F.col("valid_pixels")), F.lit(0.0)), 4),
        "changed_area_ha": F.round(hectares(F.col("changed_pixels")), 2),
        "changed_area_km2": F.round(square_km(F.col("changed_pixels")), 4),
    })


def rollup(tile_stats: DataFrame) -> DataFrame:
    """Change over all tiles."""
    return tile_stats.agg(F.sum("valid_pixels").alias("valid_pixels"), F.sum("changed_pixels").alias("changed_pixels")).withColumn("change_pct", F.round(F.try_divide(F.col("changed_pixels") * F.lit(100.0), F.col("valid_pixels")), 4))


def stitch(parts: DataFrame, cells: DataFrame, value: str, fill) -> DataFrame:
    """The inner pixels of processed tiles on the full grid; what no tile covers gets the fill value."""
    own = parts.filter("inner").select("r", "c", value)
    return cells.select("r", "c").join(own, ["r", "c"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def tile_table(tile_stats: DataFrame, n_x: int) -> DataFrame:
    """Change in % as a table of the tile rows by tile columns; missing tiles are 0."""
    wide = tile_stats.groupBy("tile_row").pivot("tile_col", list(range(n_x))).agg(F.first("change_pct"))
    return wide.select("tile_row", *(F.coalesce(F.col(str(k)), F.lit(0.0)).alias(f"col_{k}") for k in range(n_x)))


def tiled(pixels: DataFrame, width: int, height: int, n_x: int, n_y: int, overlap: int, function: Callable, schema: str) -> DataFrame:
    """Runs a function from pandas frame to pandas frame on each tile with its overlap, for code that is not expressions.

    Its result has r, c, tile_id and what else the schema names; only inner pixels
    are kept, so the result is already stitched.
    """
    dealt = in_tiles(pixels, width, height, n_x, n_y, overlap)
    made = dealt.groupBy("tile_id").applyInPandas(lambda frame: function(frame.drop(columns=["tile_row", "tile_col", "inner"])), schema)
    inner = in_tiles(made.withColumnRenamed("tile_id", "of"), width, height, n_x, n_y, 0).filter("of = tile_id")
    return inner.drop("of", "tile_id", "tile_row", "tile_col", "inner")
