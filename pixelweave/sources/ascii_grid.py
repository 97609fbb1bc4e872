"""Rasters in ASCII grid files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """(file, r, c, value) of ASCII grids; the header's NODATA value is NULL.

    Header lines are a name and a number; lines after the last row are left out.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))).alias("lines"))
    heads = F.filter("lines", lambda x: x.rlike(r"^[A-Za-z_]+ [-+0-9.eE]+$"))
    number = lambda name: F.try_element_at(F.transform(F.filter(heads, lambda x: F.upper(F.split_part(x, F.lit(" "), F.lit(1))) == name), lambda x: F.split_part(x, F.lit(" "), F.lit(2)).cast("double")), F.lit(1))
    body = F.filter("lines", lambda x: x.rlike(r"^[-+0-9]"))
    rows = files.select("file", number("NCOLS").cast("int").alias("width"), number("NROWS").cast("int").alias("height"), number("NODATA_VALUE").alias("nodata"), F.posexplode(body).alias("r", "line")).filter("r < height")
    cells = rows.select("file", "r", "width", "nodata", F.posexplode(F.split("line", " ")).alias("c", "value")).filter("c < width")
    value = F.col("value").cast("double")
    return cells.select("file", "r", "c", F.when(F.coalesce(value != F.col("nodata"), F.lit(True)), value).alias("value"))


def to_ascii_grid(tiles: DataFrame, value: str, nodata: float = -9999.0) -> DataFrame:
    """(tile_id, content): the text of each tile's pixels (tile_id, r, c, value), with rows and columns from the tile's first.

    Tiles have all their pixels; NULL is the NODATA value. A line is put together by
    an aggregate of its row, a tile by one of its lines.
    """
    cells = tiles.select("tile_id", "r", "c", F.coalesce(F.col(value).cast("double"), F.lit(nodata)).alias("x"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda p: p["x"].cast("string")), " ")
    lines = cells.groupBy("tile_id", "r").agg(line.alias("line"), F.count("*").alias("width"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda p: p["line"]), "\n")
    whole = lines.groupBy("tile_id").agg(F.max("width").alias("width"), F.count("*").alias("height"), body.alias("body"))
    head = F.format_string(f"NCOLS %d\nNROWS %d\nNODATA_VALUE {nodata:g}\n", "width", "height")
    return whole.select("tile_id", F.concat(head, "body").alias("content"))


def write_ascii_grid(grids: DataFrame, path: str) -> None:
    """A folder of a text file for each tile of to_ascii_grid."""
    grids.select("tile_id", F.col("content").alias("value")).repartition("tile_id").write.mode("overwrite").partitionBy("tile_id").text(path)
