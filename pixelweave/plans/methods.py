"""The three threshold methods: band differences, NDVI differences, change vectors.

Each takes a pair table (r, c, bands with suffixes _b and _a, NULL where masked)
and its extent. The measure is blurred in one pass over the pair and kept in the
shared folder; the threshold and the result's tables read it from there, so the
pair is read once, whatever is asked of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import change, indices
from ..operators import focal, grid
from ..operators.otsu import otsu
from ..operators.storage import stored


@dataclass
class ChangeResult:
    """pixels: one row for each pixel of the extent, with `changed`; summary: one row. Both are lazy."""

    method: str
    pixels: DataFrame
    summary: DataFrame


def _smoothed(cells: DataFrame, shape: grid.Shape, values: list[str], smooth: bool) -> DataFrame:
    """Dense cells with smoothed_<value> (blurred if asked) for each value, all in one pass, kept in the shared folder."""
    cells = grid.dense(cells, shape)
    names = {f"smoothed_{v}": F.col(v) for v in values}
    rest = tuple(c for c in cells.columns if c not in ("r", "c"))
    cells = cells.withColumns(names)
    return stored(focal.gaussian(cells, shape, *names, carry=rest) if smooth else cells)


def _thresholds(kept: DataFrame, values: list[str]) -> dict[str, float | None]:
    """Threshold of each smoothed value, by two passes over those columns; None if nothing of it is positive."""
    rows = kept.select(F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(f"smoothed_{v}").alias("x")) for v in values))).alias("v")).select("v.*")
    found = {r["name"]: r["threshold"] for r in otsu(rows, "x", ("name",)).collect()}
    return {v: found.get(v) for v in values}


def _with_threshold(kept: DataFrame, shape: grid.Shape, value: str, threshold: float | None, by_tile: int | None = None) -> DataFrame:
    """The kept cells with smoothed and threshold of one value.

    by_tile finds a threshold for each square tile of that side instead of the scene.
    """
    cells = kept.withColumnRenamed(f"smoothed_{value}", "smoothed")
    if threshold is None and by_tile:
        cells = cells.withColumn("_tile", F.expr(f"(r div {by_tile}) * {max(1, -(-shape.width // by_tile))} + c div {by_tile}"))
        return cells.join(F.broadcast(otsu(cells, "smoothed", ("_tile",))), "_tile", "left").drop("_tile")
    if threshold is None:
        threshold = _thresholds(kept, [value])[value]
    return cells.withColumn("threshold", F.lit(threshold).cast("double"))


def _summary(pixels: DataFrame, valid: str, *more, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and share of change among valid pixels (0 if there are none), in all or of each scene."""
    share = lambda n: F.coalesce(F.try_divide(n * F.lit(100.0), F.count_if(F.col(valid).isNotNull())), F.lit(0.0))
    return pixels.groupBy(*by).agg(F.count("*").alias("total_pixels"), F.count_if(F.col(valid).isNotNull()).alias("valid_pixels"), F.count_if("changed").alias("changed_pixels"), share(F.count_if("changed")).alias("change_pct"), F.max("threshold").alias("threshold"), *(m(share) for m in more))


def _band_measure(band: str) -> dict[str, Column]:
    diff = change.difference(F.col(f"{band}_b"), F.col(f"{band}_a"))
    return {"diff": diff, "abs_diff": F.abs(diff)}


def _ndvi_measure() -> dict[str, Column]:
    before, after = (indices.ndvi(F.col(f"b04_{d}"), F.col(f"b08_{d}")) for d in "ba")
    return {"ndvi_b": before, "ndvi_a": after, "delta": after - before, "abs_delta": F.abs(after - before)}


def _vector_measure(bands: tuple[str, ...], x_band: str, y_band: str) -> dict[str, Column]:
    deltas = {b: F.col(f"{b}_a") - F.col(f"{b}_b") for b in bands}
    return {"magnitude": change.magnitude(list(deltas.values())), "direction": change.direction(deltas[x_band], deltas[y_band])}


def _cells(pair: DataFrame, *measures: dict[str, Column]) -> DataFrame:
    return pair.select("r", "c", *(v.alias(k) for m in measures for k, v in m.items()))


def _band_result(pixels: DataFrame, by: tuple[str, ...] = ()) -> ChangeResult:
    pixels = pixels.withColumn("changed", change.over(F.col("smoothed"), F.col("threshold")))
    return ChangeResult("Band Differencing", pixels, _summary(pixels, "abs_diff", by=by))


def _ndvi_result(pixels: DataFrame, by: tuple[str, ...] = ()) -> ChangeResult:
    pixels = pixels.withColumns({
        "changed": change.over(F.col("smoothed"), F.col("threshold")),
        "gain": change.over(F.col("delta"), F.col("threshold")),
        "loss": change.over(-F.col("delta"), F.col("threshold")),
    })
    return ChangeResult("NDVI Differencing", pixels, _summary(pixels, "delta", lambda share: share(F.count_if("gain")).alias("gain_pct"), lambda share: share(F.count_if("loss")).alias("loss_pct"), by=by))


def _vector_result(pixels: DataFrame, by: tuple[str, ...] = ()) -> ChangeResult:
    pixels = pixels.withColumn("changed", change.over(F.col("smoothed"), F.col("threshold")))
    pixels = pixels.withColumn("change_type", change.direction_class(F.col("direction"), F.col("smoothed"), F.col("threshold")))
    return ChangeResult("CVA", pixels, _summary(pixels, "magnitude", by=by))


def band_differencing(pair: DataFrame, shape: grid.Shape, band: str = "b04", threshold: float | None = None, smooth: bool = True, by_tile: int | None = None) -> ChangeResult:
    """Change where the blurred absolute difference of a band is over the threshold."""
    kept = _smoothed(_cells(pair, _band_measure(band)), shape, ["abs_diff"], smooth)
    return _band_result(_with_threshold(kept, shape, "abs_diff", threshold, by_tile))


def ndvi_differencing(pair: DataFrame, shape: grid.Shape, threshold: float | None = None, smooth: bool = True, by_tile: int | None = None) -> ChangeResult:
    """Change by the blurred absolute NDVI difference; gain and loss by the difference as it is."""
    kept = _smoothed(_cells(pair, _ndvi_measure()), shape, ["abs_delta"], smooth)
    return _ndvi_result(_with_threshold(kept, shape, "abs_delta", threshold, by_tile))


def change_vectors(pair: DataFrame, shape: grid.Shape, bands: tuple[str, ...] = indices.BANDS, x_band: str = "b04", y_band: str = "b08", threshold: float | None = None, smooth: bool = True, by_tile: int | None = None) -> ChangeResult:
    """Change by the blurred length of the change vector, its type by the vector's direction."""
    kept = _smoothed(_cells(pair, _vector_measure(bands, x_band, y_band)), shape, ["magnitude"], smooth)
    return _vector_result(_with_threshold(kept, shape, "magnitude", threshold, by_tile))


def all_methods(pair: DataFrame, shape: grid.Shape, smooth: bool = True) -> list[ChangeResult]:
    """Band differences, NDVI differences and change vectors of a pair, blurred in one pass and kept once."""
    values = ["abs_diff", "abs_delta", "magnitude"]
    measures = [_band_measure("b04"), _ndvi_measure(), _vector_measure(indices.BANDS, "b04", "b08")]
    kept = _smoothed(_cells(pair, *measures), shape, values, smooth)
    found = _thresholds(kept, values)
    own = [kept.select("r", "c", *m, F.col(f"smoothed_{v}").alias("smoothed"), F.lit(found[v]).cast("double").alias("threshold")) for v, m in zip(values, measures)]
    return [make(pixels) for make, pixels in zip((_band_result, _ndvi_result, _vector_result), own)]


def methods_by_scene(pairs: DataFrame, scene: str = "scene_id", smooth: bool = True) -> list[ChangeResult]:
    """Band differences, NDVI differences and change vectors of many pairs at once, each scene with its own extent and thresholds.

    pairs is a pair table with a column that names the scene; pixels and summary have
    it too. Whatever the number of scenes, they are one plan: extents and thresholds are
    small tables with a row a scene, the tiles of all scenes are blurred in one pass, and a large
    scene is as many tiles, not a task. A null scene is a scene of its own.
    """
    values = {"abs_diff": _band_measure("b04"), "abs_delta": _ndvi_measure(), "magnitude": _vector_measure(indices.BANDS, "b04", "b08")}
    names = [k for m in values.values() for k in m]
    key = F.coalesce(F.concat(F.lit("="), F.col(scene).cast("string")), F.lit("-")).alias("_scene")
    cells = pairs.select(key, F.col(scene).alias("_name"), "r", "c", *(v.alias(k) for m in values.values() for k, v in m.items()))
    sizes = stored(cells.groupBy("_scene", "_name").agg((F.max("r") + 1).cast("int").alias("height"), (F.max("c") + 1).cast("int").alias("width")))
    full = grid.dense_by(cells.drop("_name"), sizes.drop("_name"), "_scene").withColumns({f"smoothed_{v}": F.col(v) for v in values})
    smoothed = [f"smoothed_{v}" for v in values]
    kept = stored(focal.gaussian(full, grid.Shape("height", "width"), *smoothed, carry=tuple(names), by=("_scene",)) if smooth else full)
    rows = kept.select("_scene", F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(f"smoothed_{v}").alias("x")) for v in values))).alias("v")).select("_scene", "v.*")
    found = stored(otsu(rows, "x", ("_scene", "name")))
    results = []
    for (value, measure), make in zip(values.items(), (_band_result, _ndvi_result, _vector_result)):
        thresholds = sizes.select("_scene", "_name").join(found.filter(F.col("name") == value).drop("name"), "_scene", "left")
        pixels = kept.select("_scene", "r", "c", *measure, F.col(f"smoothed_{value}").alias("smoothed")).join(thresholds, "_scene")
        result = make(pixels.drop("_scene").withColumnRenamed("_name", scene), (scene,))
        results.append(result)
    return results


def type_counts(result: ChangeResult) -> DataFrame:
    """Pixels of each change type and their share of the valid ones; types without pixels are 0."""
    spark = result.pixels.sparkSession
    counts = result.pixels.groupBy("change_type").agg(F.count("*").alias("n"))
    valid = result.pixels.agg(F.count_if(F.col("magnitude").isNotNull()).alias("valid"))
    names = spark.createDataFrame(list(change.CVA_TYPES.items()), "change_type int, label string")
    out = names.join(counts, "change_type", "left").crossJoin(F.broadcast(valid))
    return out.select("change_type", "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)) * F.lit(100.0), F.col("valid")), F.lit(0.0)).alias("pct"))
