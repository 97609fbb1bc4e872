"""Full-scene runs tile by tile that go on where they stopped."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tiling import in_tiles, tile_grid

_LEDGER = "tile_id int, run string, layout string"


def _read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet folder, or no rows if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def finished(spark: SparkSession, target: str) -> DataFrame:
    """(tile_id, run, layout) of the tiles that a run into target has finished."""
    return _read(spark, f"{target}/ledger", _LEDGER)


def run_result(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The inner pixels of all finished tiles; what a stopped run left without a ledger row is not seen."""
    kept = StructType.fromDDL(f"{schema}, run string")
    return _read(spark, f"{target}/pixels", kept).join(finished(spark, target).select("tile_id", "run"), ["tile_id", "run"], "left_semi").drop("run")


def tiled_run(pixels: DataFrame, width: int, height: int, n_x: int, n_y: int, overlap: int, function: Callable, schema: str, target: str, tiles_at_once: int = 8, most: int | None = None) -> DataFrame:
    """Runs a function from pandas frame to pandas frame on each tile with its overlap, as tiling.tiled does, and keeps what is done.

    schema has r, c and tile_id. Tiles go in groups of tiles_at_once: a job writes a
    group's inner pixels under a name of its own, and then, as one file, their rows of
    the ledger. A tile is done when the ledger says so, so what fails or is killed
    half-way leaves nothing that counts. A run into the same folder does the tiles
    that the ledger lacks; one of another layout is an error. Tiles without pixels are
    done as well. With most, a run stops after so many tiles. Only tile numbers come
    to the driver.
    """
    spark = pixels.sparkSession
    layout = f"{width}x{height} {n_x}x{n_y} {overlap}"
    done = finished(spark, target)
    others = [r[0] for r in done.filter(F.col("layout") != layout).select("layout").distinct().collect()]
    if others:
        raise ValueError(f"{target} has tiles of the layout {others[0]}, not {layout}")
    todo = tile_grid(spark, width, height, n_x, n_y, overlap).join(done, "tile_id", "left_anti").select("tile_id").orderBy("tile_id")
    ids = [r[0] for r in todo.collect()][:most]
    dealt = in_tiles(pixels, width, height, n_x, n_y, overlap)
    for first in range(0, len(ids), tiles_at_once):
        group, run = ids[first : first + tiles_at_once], uuid.uuid4().hex
        own = dealt.filter(F.col("tile_id").isin(group))
        made = own.groupBy("tile_id").applyInPandas(lambda frame: function(frame.drop(columns=["tile_row", "tile_col", "inner"])), schema)
        inner = in_tiles(made.withColumnRenamed("tile_id", "of"), width, height, n_x, n_y, 0).filter("of = tile_id")
        inner.select(*made.columns).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{target}/pixels")
        rows = spark.createDataFrame([(k, run, layout) for k in group], _LEDGER)
        rows.coalesce(1).write.mode("append").parquet(f"{target}/ledger")
    return run_result(spark, target, schema)
