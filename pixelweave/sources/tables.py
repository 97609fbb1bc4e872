"""CSV results, Parquet rasters, label rasters on another grid, and paths of scene files."""

from __future__ import annotations

import glob
import math
import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_csv(table: DataFrame, path: str) -> None:
    """One CSV part with a header; an empty table is an error. For tables of statistics, which are small."""
    if table.isEmpty():
        raise ValueError("there is nothing to write")
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_raster(pixels: DataFrame, path: str, tile: int = 1024) -> None:
    """Pixels as Parquet, partitioned and sorted by tile so that windows prune files and row groups."""
    placed = pixels.withColumn("tile_row", F.expr(f"r div {tile}")).withColumn("tile_col", F.expr(f"c div {tile}"))
    placed.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "r", "c").write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(path)


def read_raster(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, tile: int = 1024) -> DataFrame:
    """Pixels of a raster, or of a window (x_off, y_off, x_size, y_size) of it; NaN is NULL."""
    pixels = spark.read.parquet(path)
    if window:
        x, y, w, h = window
        pixels = pixels.filter(F.col("tile_row").between(y // tile, (y + h - 1) // tile) & F.col("tile_col").between(x // tile, (x + w - 1) // tile))
        pixels = pixels.filter(F.col("r").between(y, y + h - 1) & F.col("c").between(x, x + w - 1))
    floats = [c for c, kind in pixels.dtypes if kind in ("double", "float")]
    return pixels.drop("tile_row", "tile_col").withColumns({c: F.nanvl(c, F.lit(None).cast(pixels.schema[c].dataType)) for c in floats})


def mosaic(rasters: list[DataFrame]) -> DataFrame:
    """Pixels of several rasters of one grid; where they overlap the later raster counts."""
    ranked = reduce(DataFrame.unionByName, (r.withColumn("_rank", F.lit(k)) for k, r in enumerate(rasters)))
    top = F.row_number().over(Window.partitionBy("r", "c").orderBy(F.desc("_rank")))
    return ranked.withColumn("_top", top).filter("_top = 1").drop("_rank", "_top")


@dataclass(frozen=True)
class Geotransform:
    origin_x: float
    px_w: float
    origin_y: float
    px_h: float

    def centre(self, r: Column, c: Column) -> tuple[Column, Column]:
        return self.origin_x + (c + 0.5) * self.px_w, self.origin_y + (r + 0.5) * self.px_h

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.floor((y - self.origin_y) / self.px_h).cast("int"), F.floor((x - self.origin_x) / self.px_w).cast("int")


def resample_nearest(target: DataFrame, target_gt: Geotransform, source: DataFrame, source_gt: Geotransform, value: str, zone: int | None = None, north: bool = True) -> DataFrame:
    """Target pixels (r, c) with the value of the source pixel under their centre, NULL if there is none.

    An equi-join on the computed place. With a zone the target is in that UTM zone
    and the source in longitude and latitude.
    """
    x, y = target_gt.centre(F.col("r"), F.col("c"))
    if zone is not None:
        x, y = utm_to_degrees(x, y, zone, north)
    r, c = source_gt.place(x, y)
    low = source.select(F.col("r").alias("_r"), F.col("c").alias("_c"), value)
    return target.withColumns({"_r": r, "_c": c}).join(low, ["_r", "_c"], "left").drop("_r", "_c")


# Semi-major axis and flattening of the WGS 84 ellipsoid, UTM scale and false origin.
_A, _FLAT, _K0, _EAST, _NORTH = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def utm_to_degrees(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude of UTM metres, by Krüger's series to the third order (below a millimetre)."""
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3)
    delta = (2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3)
    xi = (y - (0.0 if north else _NORTH)) / (_K0 * radius)
    eta = (x - _EAST) / (_K0 * radius)
    xi_, eta_ = xi, eta
    for j, b in enumerate(beta, start=1):
        xi_ = xi_ - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_ = eta_ - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_) / F.cosh(eta_))
    lat = chi
    for j, d in enumerate(delta, start=1):
        lat = lat + d * F.sin(2 * j * chi)
    return zone * 6.0 - 183.0 + F.degrees(F.atan2(F.sinh(eta_), F.cos(xi_))), F.degrees(lat)


def degrees_to_utm(lon: Column, lat: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """UTM metres of longitude and latitude, the inverse of utm_to_degrees."""
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    phi, away = F.radians(lat), F.radians(lon - (zone * 6.0 - 183.0))
    e = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, start=1):
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return _EAST + _K0 * radius * x, (0.0 if north else _NORTH) + _K0 * radius * y


def data_root(given: str | None = None, variable: str = "RASTER_DATA_ROOT") -> str:
    """The data folder: as given, else the environment's, else ./data; looked up only when called."""
    for where in (given, os.environ.get(variable), os.path.join(os.getcwd(), "data")):
        if where and os.path.isdir(where):
            return where
    raise FileNotFoundError("no data folder was given or found")


def band_file(root: str, archive: str, date: str, band: str, resolution: str = "R10m") -> str:
    """Path of a band's file in a scene archive, a made-up one in the archive's pattern if it isn't there."""
    granules = os.path.join(root, archive, "GRANULE")
    found = sorted(os.listdir(granules)) if os.path.isdir(granules) else []
    if not found:
        return os.path.join(granules, "???", "IMG_DATA", resolution, f"{band}.jp2")
    images = os.path.join(granules, found[0], "IMG_DATA", resolution)
    own = [f for f in sorted(os.listdir(images)) if band in f and f.endswith(".jp2")] if os.path.isdir(images) else []
    return os.path.join(images, own[0] if own else f"{date}_{band}_10m.jp2")


def label_files(root: str, names: tuple[str, ...] = (), pattern: str = "*label*.tif") -> list[str]:
    """Land-cover files of a folder: those of the given names that are there, else all of the pattern."""
    named = [os.path.join(root, n) for n in names if os.path.exists(os.path.join(root, n))]
    found = named or sorted(glob.glob(os.path.join(root, pattern)))
    if not found:
        raise FileNotFoundError(f"no land-cover file in {root}")
    return found


@dataclass(frozen=True)
class PairConfig:
    """Files and window of a pair of scenes."""

    name: str
    before: dict[str, str]
    after: dict[str, str]
    scl_before: str | None = None
    scl_after: str | None = None
    x_off: int = 4000
    y_off: int = 4000
    x_size: int = 2000
    y_size: int = 2000

    @property
    def scl_window(self) -> tuple[int, int, int, int]:
        return self.x_off // 2, self.y_off // 2, self.x_size // 2, self.y_size // 2

    def check_files(self) -> tuple[bool, list[str]]:
        named = [*self.before.values(), *self.after.values(), *(p for p in (self.scl_before, self.scl_after) if p)]
        missing = [p for p in named if not os.path.exists(p)]
        return not missing, missing

    def summary(self) -> str:
        return f"{self.name}: window {self.x_size} x {self.y_size} at ({self.x_off}, {self.y_off}), {len(self.before)} bands a date"
