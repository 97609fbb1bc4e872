"""Named queries of the engine over the driver's tables, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scenes, sqltext
from .functions import change, classes, display, indices
from .operators import crosstab, focal, grid, sampling, tiling
from .operators.otsu import histogram, otsu
from .operators.quantiles import percentile
from .operators.storage import scratch, stored
from .plans import consensus, forests, integrated, learning, methods, reporting, tiled_run
from .sources import ascii_grid, images, tables, tiff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, ctes: str | None = None, select: str | None = None):
    """Registers a query and, where SQL can express it, its oracle: WITH ctes select."""

    def keep(f):
        QUERIES[name] = f
        if select:
            SQL[name] = (f"WITH {ctes}\n" if ctes else "") + select
        return f

    return keep


def r6(x: Column, name: str) -> Column:
    return F.round(x, 6).alias(name)


# Scans and masks


@query("scan_crop", scenes.SCENES, "SELECT * FROM scenes WHERE r BETWEEN 10 AND 59 AND c BETWEEN 2 AND 41")
def scan_crop(spark, sf):
    return grid.crop(scenes.scenes(spark, sf), 2, 10, 40, 50)


@query("raster_info", scenes.DENSE, "SELECT max(c) + 1 AS width, max(r) + 1 AS height, 'x' AS band, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean FROM dense")
def raster_info(spark, sf):
    return grid.raster_info(scenes.dense_grid(spark, sf), "x").select("width", "height", "band", *(r6(F.col(n), n) for n in ("min", "max", "mean")))


@query("cloud_mask", scenes.SCENES, "SELECT r, c, scene, scl NOT IN (3, 8, 9, 10) AS clear FROM scenes")
def cloud_mask(spark, sf):
    return scenes.scenes(spark, sf).select("r", "c", "scene", (~grid.cloudy(F.col("scl"))).alias("clear"))


@query(
    "scl_join",
    scenes.SCENES,
    """SELECT p.r, p.c, coalesce(s.clear, true) AS clear FROM (SELECT DISTINCT r, c FROM scenes) p
LEFT JOIN (SELECT r // 2 AS r20, c // 2 AS c20, sum(l_orderkey) % 11 NOT IN (3, 8, 9, 10) AS clear FROM lines WHERE scene = 'before' GROUP BY ALL) s ON p.r // 2 = s.r20 AND p.c // 2 = s.c20""",
)
def scl_join(spark, sf):
    pixels = scenes.scenes(spark, sf).select("r", "c").distinct()
    return grid.clear(pixels, scenes.scl20(spark, sf)).select("r", "c", "clear")


@query("align_dates", scenes.PAIR, "SELECT * FROM pair")
def align_dates(spark, sf):
    return scenes.pair(spark, sf)


@query("valid_both", scenes.CLEAR, "SELECT r, c, valid FROM clear")
def valid_both(spark, sf):
    return scenes.clear_pair(spark, sf).select("r", "c", "valid")


@query("apply_mask", scenes.CLEAR, "SELECT r, c, b04_b, b08_b, b04_a, b08_a FROM clear")
def apply_mask(spark, sf):
    return scenes.clear_pair(spark, sf).select("r", "c", "b04_b", "b08_b", "b04_a", "b08_a")


@query("mask_counts", scenes.CLEAR, "SELECT count(*) AS pixels, count_if(valid) AS valid, count(b04_b) AS present, round(100.0 * count_if(NOT valid) / count(*), 6) AS cloud_pct FROM clear")
def mask_counts(spark, sf):
    return scenes.clear_pair(spark, sf).agg(F.count("*").alias("pixels"), F.count_if("valid").alias("valid"), F.count("b04_b").alias("present"), r6(F.lit(100.0) * F.count_if(~F.col("valid")) / F.count("*"), "cloud_pct"))


@query(
    "geotransform_shift",
    None,
    "SELECT CAST(l_linenumber AS INT) AS tile, 500000.0 + l_linenumber * 120 * 10.0 AS origin_x, 3900000.0 + l_linenumber * 80 * -10.0 AS origin_y FROM (SELECT DISTINCT l_linenumber FROM lineitem)",
)
def geotransform_shift(spark, sf):
    tiles = scenes.table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("int").alias("tile")).distinct()
    gt = F.struct(F.lit(500000.0).alias("origin_x"), F.lit(10.0).alias("px_w"), F.lit(0.0).alias("rot_x"), F.lit(3900000.0).alias("origin_y"), F.lit(0.0).alias("rot_y"), F.lit(-10.0).alias("px_h"))
    return tiles.withColumn("gt", grid.shift_geotransform(gt, F.col("tile") * 120, F.col("tile") * 80)).select("tile", "gt.origin_x", "gt.origin_y")


@query(
    "mosaic",
    scenes.SCENES,
    "SELECT r, c, coalesce(max(b04) FILTER (WHERE scene = 'after'), max(b04) FILTER (WHERE scene = 'before')) AS b04 FROM scenes GROUP BY r, c",
)
def mosaic(spark, sf):
    both = scenes.scenes(spark, sf)
    return tables.mosaic([both.filter(F.col("scene") == s).select("r", "c", "b04") for s in ("before", "after")])


@query(
    "resample_nearest",
    scenes.LABELS,
    "SELECT t.r, t.c, s.wc FROM dense t LEFT JOIN labelled s ON s.r = CAST(floor((t.r + 0.5) * 10 / 25) AS INT) AND s.c = CAST(floor((t.c + 0.5) * 10 / 25) AS INT)",
)
def resample_nearest(spark, sf):
    gt = lambda size: tables.Geotransform(300000.0, size, 4000000.0, -size)
    return tables.resample_nearest(scenes.dense_grid(spark, sf).select("r", "c"), gt(10.0), scenes.label_map(spark, sf), gt(25.0), "wc")


@query(
    "stack_bands",
    scenes.SCENES,
    "SELECT r, c, a.x AS b02, b.x AS b04, d.x AS b08 FROM (SELECT r, c, b02 AS x FROM scenes WHERE scene = 'before') a FULL JOIN (SELECT r, c, b04 AS x FROM scenes WHERE scene = 'after') b USING (r, c) FULL JOIN (SELECT r, c, b08 AS x FROM scenes WHERE scene = 'after' AND scl <> 3) d USING (r, c)",
)
def stack_bands(spark, sf):
    both = scenes.scenes(spark, sf)
    band = lambda name, where: both.filter(where).select("r", "c", F.col(name).alias("x"))
    return grid.stack_bands({"b02": band("b02", "scene = 'before'"), "b04": band("b04", "scene = 'after'"), "b08": band("b08", "scene = 'after' and scl != 3")})


@query("raster_window", scenes.DENSE, "SELECT r, c, x FROM dense WHERE r BETWEEN 5 AND 64 AND c BETWEEN 30 AND 79")
def raster_window(spark, sf):
    """Written as tiles of Parquet and read back as a window, which prunes tiles."""
    path = scratch(spark)
    tables.write_raster(scenes.dense_grid(spark, sf), path, tile=32)
    return tables.read_raster(spark, path, (30, 5, 50, 60), tile=32)


@query("csv_round_trip", scenes.LABELS, "SELECT wc, count(*) AS n, round(avg(r), 6) AS mean_r FROM labelled GROUP BY wc")
def csv_round_trip(spark, sf):
    path = scratch(spark)
    tables.write_csv(scenes.label_map(spark, sf).groupBy("wc").agg(F.count("*").alias("n"), r6(F.avg("r"), "mean_r")), path)
    return spark.read.schema("wc int, n long, mean_r double").option("header", True).csv(path)


@query("ascii_round_trip", scenes.DENSE, "SELECT CAST(r // 25 AS INT) AS tile_id, CAST(r % 25 AS INT) AS r, c, CASE WHEN r % 7 <> 0 THEN x END AS x FROM dense")
def ascii_round_trip(spark, sf):
    path = scratch(spark)
    tiles = scenes.dense_grid(spark, sf).select(F.expr("cast(r div 25 as int)").alias("tile_id"), "r", "c", F.when(F.col("r") % 7 != 0, F.col("x")).alias("x"))
    ascii_grid.write_ascii_grid(ascii_grid.to_ascii_grid(tiles, "x"), path)
    back = ascii_grid.read_ascii_grid(spark, f"{path}/tile_id=*")
    return back.select(F.regexp_extract("file", "tile_id=([0-9]+)", 1).cast("int").alias("tile_id"), "r", "c", F.col("value").alias("x"))


# Map algebra


@query("band_diff", scenes.CLEAR, "SELECT r, c, b04_a - b04_b AS diff, abs(b04_a - b04_b) AS abs_diff FROM clear")
def band_diff(spark, sf):
    diff = change.difference(F.col("b04_b"), F.col("b04_a"))
    return scenes.clear_pair(spark, sf).select("r", "c", diff.alias("diff"), F.abs(diff).alias("abs_diff"))


_INDEX_SQL = {
    "ndvi": "(b08_b - b04_b) / nullif(b08_b + b04_b, 0)", "ndwi": "(b03_b - b08_b) / nullif(b03_b + b08_b, 0)", "brightness": "(b02_b + b03_b + b04_b + b08_b) / 4",
    "savi": "1.5 * (b08_b - b04_b) / nullif(b08_b + b04_b + 0.5, 0)", "evi": "2.5 * (b08_b - b04_b) / nullif(b08_b + 6 * b04_b - 7.5 * b02_b + 1, 0)", "bsi": "(b04_b + b02_b - b08_b) / nullif(b04_b + b02_b + b08_b, 0)",
}


def _index(name: str):
    @query(name, scenes.CLEAR, f"SELECT r, c, round({_INDEX_SQL[name]}, 6) AS {name} FROM clear")
    def run(spark, sf):
        features = {c: f for c, f in zip(indices.FEATURES, indices.feature_columns("_b"))}
        return scenes.clear_pair(spark, sf).select("r", "c", features[name].alias("x")).select("r", "c", r6(F.col("x"), name))

    return run


for _name in _INDEX_SQL:
    _index(_name)


@query("ndvi_delta", scenes.MAPS, "SELECT r, c, round(ndvi_b, 6) AS before, round(ndvi_a, 6) AS after, round(delta, 6) AS delta, round(abs(delta), 6) AS abs_delta FROM maps")
def ndvi_delta(spark, sf):
    rows = scenes.class_maps(spark, sf)
    return rows.select("r", "c", r6(F.col("ndvi_b"), "before"), r6(F.col("ndvi_a"), "after"), r6(F.col("delta"), "delta"), r6(F.abs("delta"), "abs_delta"))


_FEATURES_SQL = ", ".join([f"{b}_b AS {b}" for b in indices.BANDS] + [f"{v} AS {k}" for k, v in _INDEX_SQL.items()])


@query("feature_stack", scenes.CLEAR, f"SELECT r, c, {', '.join(f'round({k}, 6) AS {k}' for k in indices.FEATURES)}, {' AND '.join(f'{k} IS NOT NULL' for k in indices.FEATURES)} AS present FROM (SELECT r, c, {_FEATURES_SQL} FROM clear)")
def feature_stack(spark, sf):
    return learning.date_features(scenes.clear_pair(spark, sf), "b").select("r", "c", *(r6(F.col(k), k) for k in indices.FEATURES), "present")


@query(
    "feature_stack_texture",
    f"""{sqltext.FULL},
top AS (SELECT quantile_cont(b08_b, 0.99) AS p99 FROM clear WHERE b08_b > 0),
scaled AS (SELECT r, c, coalesce(least(1.0, greatest(0.0, b08_b / nullif(p99, 0))), 0.0) AS x FROM cells LEFT JOIN clear USING (r, c) CROSS JOIN top),
{sqltext.box('scaled', 'tex', 'x')}""",
    "SELECT r, c, round(b08_b, 6) AS b08, CASE WHEN b08_b IS NOT NULL THEN round(homogeneity, 6) END AS homogeneity, CASE WHEN b08_b IS NOT NULL THEN round(contrast, 6) END AS contrast FROM clear JOIN tex USING (r, c)",
)
def feature_stack_texture(spark, sf):
    pair, shape = _pair(spark, sf)
    out = learning.with_texture(learning.date_features(pair, "b"), shape)
    return out.select("r", "c", *(r6(F.col(k), k) for k in ("b08", "homogeneity", "contrast")))


_ANGLE = "degrees(atan2(b08_a - b08_b, b04_a - b04_b))"


@query("change_vector", scenes.MAPS, "SELECT r, c, round(magnitude, 6) AS magnitude FROM maps")
def change_vector(spark, sf):
    return scenes.class_maps(spark, sf).select("r", "c", r6(F.col("magnitude"), "magnitude"))


@query("direction", scenes.CLEAR, f"SELECT r, c, round(CASE WHEN {_ANGLE} < 0 THEN {_ANGLE} + 360 ELSE {_ANGLE} END, 6) AS direction FROM clear")
def direction(spark, sf):
    return scenes.clear_pair(spark, sf).select("r", "c", r6(change.direction(F.col("b04_a") - F.col("b04_b"), F.col("b08_a") - F.col("b08_b")), "direction"))


@query(
    "direction_class",
    f"{scenes.MAPS}, turned AS (SELECT r, c, magnitude, CASE WHEN {_ANGLE} < 0 THEN {_ANGLE} + 360 ELSE {_ANGLE} END AS d FROM maps)",
    "SELECT r, c, coalesce(CASE WHEN magnitude > 700 THEN CASE WHEN d >= 180 AND d < 270 THEN 1 WHEN d >= 90 AND d < 180 THEN 2 WHEN d >= 0 AND d < 90 THEN 3 WHEN d >= 270 THEN 4 END END, 0) AS change_type FROM turned",
)
def direction_class(spark, sf):
    rows = scenes.class_maps(spark, sf)
    angle = change.direction(F.col("b04_a") - F.col("b04_b"), F.col("b08_a") - F.col("b08_b"))
    return rows.select("r", "c", change.direction_class(angle, F.col("magnitude"), F.lit(700.0)).alias("change_type"))


@query("mask_union", scenes.MAPS, "SELECT r, c, loss OR gain AS changed FROM maps")
def mask_union(spark, sf):
    return scenes.class_maps(spark, sf).select("r", "c", change.either(F.col("loss"), F.col("gain")).alias("changed"))


@query("normalize_band", scenes.DENSE, "SELECT r, c, round((x - (SELECT min(x) FROM dense)) / (SELECT max(x) - min(x) FROM dense), 6) AS scaled FROM dense")
def normalize_band(spark, sf):
    return grid.normalise(scenes.dense_grid(spark, sf), "x", "scaled").select("r", "c", r6(F.col("scaled"), "scaled"))


@query("zscore", scenes.DENSE, "SELECT r, c, round((x - (SELECT avg(x) FROM dense)) / (SELECT stddev_pop(x) FROM dense), 5) AS z FROM dense")
def zscore(spark, sf):
    return grid.scene_zscore(scenes.dense_grid(spark, sf), "x").select("r", "c", F.round("x", 5).alias("z"))


@query("pixel_index", scenes.DENSE, "SELECT r, c, CAST(r * 100 + c AS BIGINT) AS pixel_id, (r * 100 + c) // 100 AS r2, (r * 100 + c) % 100 AS c2 FROM dense")
def pixel_index(spark, sf):
    rows = scenes.dense_grid(spark, sf).select("r", "c", (F.col("r").cast("long") * 100 + F.col("c")).alias("pixel_id"))
    return rows.select("*", F.expr("cast(pixel_id div 100 as int)").alias("r2"), (F.col("pixel_id") % 100).cast("int").alias("c2"))


@query("sibling_band", None, "SELECT p_partkey, replace('T31_' || p_name || '_B04_10m.jp2', '_B04_', '_B08_') AS nir, replace(lower(p_type), ' ', '_') AS slug, replace(replace(replace(p_type, ' ', '_'), '+', ''), '__', '_') AS file FROM part")
def sibling_band(spark, sf):
    path = F.concat(F.lit("T31_"), F.col("p_name"), F.lit("_B04_10m.jp2"))
    return scenes.table(spark, sf, "part").select("p_partkey", display.sibling_band(path, "B08").alias("nir"), display.metric_slug(F.col("p_type"), slashes=False).alias("slug"), display.file_slug(F.col("p_type")).alias("file"))


# Classes


@query("recode_classes", scenes.LABELS, "SELECT r, c, CASE WHEN wc IN (10, 40) THEN 1 WHEN wc IN (50, 60, 70) THEN 2 WHEN wc IN (80, 90, 95) THEN 3 WHEN wc IN (20, 30, 100) THEN 4 ELSE 0 END AS label FROM labelled")
def recode_classes(spark, sf):
    return scenes.label_map(spark, sf).select("r", "c", classes.recode(F.col("wc"), classes.CODE_TO_CLASS).alias("label"))


@query("recode_binary", scenes.LABELS, "SELECT r, c, CASE WHEN wc IN (10, 20, 30, 40, 100) THEN 1 WHEN wc IN (50, 60, 70, 80, 90, 95) THEN 2 ELSE 0 END AS label FROM labelled")
def recode_binary(spark, sf):
    labels = scenes.label_map(spark, sf)
    dim = classes.class_table(spark, classes.CODE_TO_BINARY)
    return labels.join(F.broadcast(dim), labels.wc == dim.code, "left").select("r", "c", F.coalesce("class", F.lit(0)).alias("label"))


@query("pseudo_labels", scenes.MAPS, "SELECT r, c, coalesce(CASE WHEN ndvi_b > 0.45 THEN 1 WHEN ndvi_b < 0.38 THEN 2 END, 0) AS label FROM maps")
def pseudo_labels(spark, sf):
    return scenes.class_maps(spark, sf).select("r", "c", classes.pseudo_label(F.col("ndvi_b"), 0.45, 0.38).alias("label"))


@query("class_counts", scenes.LABELS, "SELECT wc, count(*) AS n FROM labelled GROUP BY wc")
def class_counts(spark, sf):
    return scenes.label_map(spark, sf).groupBy("wc").agg(F.count("*").alias("n"))


@query("class_colours", scenes.MAPS, "SELECT class_b AS class, list_extract(['#ffffff', '#2dc653', '#c1440e', '#457b9d', '#f4d35e'], class_b + 1) AS colour, CASE WHEN class_b = 0 THEN 0.25 ELSE 1.0 END AS opacity, count(*) AS n FROM maps GROUP BY ALL")
def class_colours(spark, sf):
    colour, opacity = classes.colour(F.col("class_b"))
    return scenes.class_maps(spark, sf).groupBy(F.col("class_b").alias("class"), colour.alias("colour"), opacity.alias("opacity")).agg(F.count("*").alias("n"))


# Histograms, thresholds, neighbourhoods


@query("histogram_256", f"{scenes.DENSE}, {sqltext.histogram('dense', 'h', 'x')}", "SELECT bin, round(centre, 4) AS centre, n FROM h")
def histogram_256(spark, sf):
    return histogram(scenes.dense_grid(spark, sf), "x").select("bin", F.round("centre", 4).alias("centre"), "n")


@query("histogram_80", f"{scenes.DENSE}, {sqltext.histogram('dense', 'h', 'x', 80, 'x IS NOT NULL')}", "SELECT bin, round(centre, 4) AS centre, n FROM h")
def histogram_80(spark, sf):
    return histogram(scenes.dense_grid(spark, sf), "x", bins=80, positive=False).select("bin", F.round("centre", 4).alias("centre"), "n")


@query("percentiles", scenes.DENSE, "SELECT round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99, round(stddev_pop(x), 6) AS deviation FROM dense WHERE x > 0")
def percentiles(spark, sf):
    x = scenes.dense_grid(spark, sf).filter("x > 0")
    p95, p99 = (F.lit(percentile(x, "x", q)) for q in (0.95, 0.99))
    return x.agg(r6(F.stddev_pop("x"), "deviation")).select(r6(p95, "p95"), r6(p99, "p99"), "deviation")


@query("otsu_global", f"{scenes.DENSE}, {sqltext.otsu('dense', 't', 'x')}", "SELECT round(threshold, 6) AS threshold FROM t")
def otsu_global(spark, sf):
    return otsu(scenes.dense_grid(spark, sf), "x").select(r6(F.col("threshold"), "threshold"))


@query("otsu_per_tile", f"{scenes.DENSE}, tiles AS (SELECT (r // 25) * 4 + c // 25 AS tile, x FROM dense), {sqltext.otsu('tiles', 't', 'x', 'tile')}", "SELECT CAST(tile AS INT) AS tile, round(threshold, 6) AS threshold FROM t")
def otsu_per_tile(spark, sf):
    tiles = scenes.dense_grid(spark, sf).withColumn("tile", F.expr("cast((r div 25) * 4 + c div 25 as int)"))
    return otsu(tiles, "x", ("tile",)).select("tile", r6(F.col("threshold"), "threshold"))


@query("gaussian_blur", f"{scenes.DENSE}, {sqltext.blurred('dense', 'b', 'x')}", "SELECT r, c, round(smoothed, 6) AS x FROM b")
def gaussian_blur(spark, sf):
    cells = scenes.dense_grid(spark, sf)
    return focal.gaussian(cells, grid.shape_of(cells), "x", tile=64).select("r", "c", r6(F.col("x"), "x"))


_UNIT = f"{scenes.DENSE}, unit AS (SELECT r, c, x / 100 AS x FROM dense), {sqltext.box('unit', 't', 'x')}"


def _texture(spark, sf):
    cells = scenes.dense_grid(spark, sf).select("r", "c", (F.col("x") / 100).alias("x"))
    return focal.box_texture(cells, grid.shape_of(cells), "x", tile=64)


@query("box_homogeneity", _UNIT, "SELECT r, c, round(homogeneity, 6) AS homogeneity FROM t")
def box_homogeneity(spark, sf):
    return _texture(spark, sf).select("r", "c", r6(F.col("homogeneity"), "homogeneity"))


@query("local_contrast", _UNIT, "SELECT r, c, round(contrast, 6) AS contrast FROM t")
def local_contrast(spark, sf):
    return _texture(spark, sf).select("r", "c", r6(F.col("contrast"), "contrast"))


_FULL_MAPS = f"""{scenes.MAPS},
extent AS (SELECT max(r) AS h, max(c) AS w FROM pair),
cells AS (SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c FROM (SELECT unnest(range(h + 1)) AS i FROM extent), (SELECT unnest(range(w + 1)) AS j FROM extent)),
full_maps AS (SELECT r, c, coalesce(class_b, 0) AS class_b, coalesce(class_a, 0) AS class_a, coalesce(valid, false) AS valid, coalesce(rf, false) AS rf, coalesce(ndvi, false) AS ndvi FROM cells LEFT JOIN maps USING (r, c)),
{sqltext.majority('full_maps', 'm', ['class_b', 'class_a'], [1, 2, 3, 4])}"""


def _majority(spark, sf):
    maps = stored(scenes.class_maps(spark, sf))
    shape = grid.shape_of(maps)
    cells = grid.dense(maps.select("r", "c", "class_b", "class_a", "valid", "rf", "ndvi"), shape)
    return cells, focal.majority(cells, shape, ["class_b", "class_a"], [1, 2, 3, 4], F.col("valid"), tile=64)


@query("majority_filter", _FULL_MAPS, "SELECT r, c, class_b, class_a FROM m")
def majority_filter(spark, sf):
    return _majority(spark, sf)[1]


@query(
    "majority_compare",
    f"{_FULL_MAPS}, j AS (SELECT f.valid, f.rf, f.ndvi, f.valid AND m.class_b > 0 AND m.class_a > 0 AND m.class_b <> m.class_a AS now FROM full_maps f JOIN m USING (r, c))",
    """SELECT count_if(valid) AS total_pixels, round(100.0 * count_if(valid AND rf) / count_if(valid), 6) AS change_pct_original, round(100.0 * count_if(now) / count_if(valid), 6) AS change_pct_smoothed,
round(100.0 * count_if(valid AND rf) / count_if(valid) - 100.0 * count_if(now) / count_if(valid), 6) AS reduction_pp,
round(coalesce(CAST(count_if(valid AND rf AND ndvi) AS DOUBLE) / nullif(count_if(valid AND (rf OR ndvi)), 0), 0), 6) AS jaccard_original,
round(coalesce(CAST(count_if(valid AND now AND ndvi) AS DOUBLE) / nullif(count_if(valid AND (now OR ndvi)), 0), 0), 6) AS jaccard_smoothed FROM j""",
)
def majority_compare(spark, sf):
    cells, smooth = _majority(spark, sf)
    old = cells.select("r", "c", *(F.coalesce(k, F.lit(False)).alias(n) for k, n in (("valid", "valid"), ("rf", "changed_before"), ("ndvi", "ndvi"))))
    rows = smooth.join(old, ["r", "c"]).withColumn("changed", F.col("valid") & (F.col("class_b") > 0) & (F.col("class_a") > 0) & (F.col("class_b") != F.col("class_a")))
    out = learning.majority_comparison(rows, "ndvi")
    return out.select("total_pixels", *(r6(F.col(k), k) for k in out.columns[1:]))


# Methods


def _pair(spark, sf):
    """The masked pair, read and joined once, and its extent."""
    pair = stored(scenes.clear_pair(spark, sf))
    return pair, grid.shape_of(pair)


def _run(method, spark, sf, **options):
    return method(*_pair(spark, sf), **options)


def _figures(result):
    s = result.summary
    return s.select(*(r6(F.col(k), k) if k.endswith("pct") or k == "threshold" else F.col(k) for k in s.columns))


def _figures_sql(source: str, valid: str, more: str = "") -> str:
    return f"SELECT count(*) AS total_pixels, count({valid}) AS valid_pixels, count_if(changed) AS changed_pixels, round(coalesce(100.0 * count_if(changed) / nullif(count({valid}), 0), 0), 6) AS change_pct, round(max(threshold), 6) AS threshold{more} FROM {source}"


@query("run_band_diff", sqltext.BAND_DIFF, _figures_sql("bd", "abs_diff"))
def run_band_diff(spark, sf):
    return _figures(_run(methods.band_differencing, spark, sf))


@query("run_ndvi_diff", sqltext.NDVI_DIFF, _figures_sql("nd", "delta", ", round(coalesce(100.0 * count_if(gain) / nullif(count(delta), 0), 0), 6) AS gain_pct, round(coalesce(100.0 * count_if(loss) / nullif(count(delta), 0), 0), 6) AS loss_pct"))
def run_ndvi_diff(spark, sf):
    return _figures(_run(methods.ndvi_differencing, spark, sf))


@query("run_cva", sqltext.CVA, _figures_sql("cv", "magnitude"))
def run_cva(spark, sf):
    return _figures(_run(methods.change_vectors, spark, sf))


@query("ndvi_change_map", sqltext.NDVI_DIFF, "SELECT r, c, changed, gain, loss FROM nd")
def ndvi_change_map(spark, sf):
    return _run(methods.ndvi_differencing, spark, sf).pixels.select("r", "c", "changed", "gain", "loss")


_TYPES = "(VALUES (1, 'Vegetation Loss'), (2, 'Vegetation Gain'), (3, 'Urban/Soil Gain'), (4, 'Water/Shadow'))"


@query(
    "cva_type_stats",
    sqltext.CVA,
    f"SELECT t.change_type, t.label, coalesce(n, 0) AS n, round(coalesce(100.0 * coalesce(n, 0) / nullif((SELECT count(magnitude) FROM cv), 0), 0), 6) AS pct FROM {_TYPES} t(change_type, label) LEFT JOIN (SELECT change_type, count(*) AS n FROM cv GROUP BY change_type) USING (change_type)",
)
def cva_type_stats(spark, sf):
    return methods.type_counts(_run(methods.change_vectors, spark, sf)).select("change_type", "label", "n", r6(F.col("pct"), "pct"))


# Cross tabulations and agreement

_CELLS = "(SELECT unnest(range(1, 5)) AS class_before), (SELECT unnest(range(1, 5)) AS class_after)"


def _matrix_sql(where: str) -> str:
    return f"""matrix AS (SELECT CAST(class_before AS INT) AS class_before, CAST(class_after AS INT) AS class_after, coalesce(k.n, 0) AS n, coalesce(100.0 * coalesce(k.n, 0) / nullif(sum(coalesce(k.n, 0)) OVER (PARTITION BY class_before), 0), 0) AS row_pct FROM {_CELLS}
LEFT JOIN (SELECT class_b, class_a, count(*) AS n FROM maps WHERE class_b > 0 AND class_a > 0 AND {where} GROUP BY ALL) k ON class_b = class_before AND class_a = class_after)"""


_MATRIX = "SELECT class_before, class_after, n, round(row_pct, 6) AS row_pct FROM matrix"


@query("transition_matrix", f"{scenes.MAPS}, {_matrix_sql('true')}", _MATRIX)
def transition_matrix(spark, sf):
    return crosstab.transitions(scenes.class_maps(spark, sf), "class_b", "class_a", 4).select("class_before", "class_after", "n", r6(F.col("row_pct"), "row_pct"))


@query("transition_matrix_conf", f"{scenes.MAPS}, {_matrix_sql('conf_b >= 0.6 AND conf_a >= 0.6')}", _MATRIX)
def transition_matrix_conf(spark, sf):
    sure = (F.col("conf_b") >= 0.6) & (F.col("conf_a") >= 0.6)
    return crosstab.transitions(scenes.class_maps(spark, sf), "class_b", "class_a", 4, sure).select("class_before", "class_after", "n", r6(F.col("row_pct"), "row_pct"))


_PAIRS = [("ndvi", "rf"), ("ndvi", "cva"), ("ndvi", "bd"), ("rf", "cva"), ("rf", "bd"), ("cva", "bd")]


def _jaccard_sql(a: str, b: str, ok: str = "true") -> str:
    return f"round(coalesce(CAST(count_if({ok} AND {a} AND {b}) AS DOUBLE) / nullif(count_if({ok} AND ({a} OR {b})), 0), 0), 6)"


@query("jaccard_pairs", scenes.MAPS, f"SELECT {', '.join(f'{_jaccard_sql(a, b)} AS {a}_{b}' for a, b in _PAIRS)} FROM maps")
def jaccard_pairs(spark, sf):
    return scenes.class_maps(spark, sf).agg(*(r6(crosstab.jaccard(F.col(a), F.col(b)), f"{a}_{b}") for a, b in _PAIRS))


_SEVERITY = """CASE WHEN delta IS NULL OR NOT valid THEN 0 WHEN loss AND delta < -0.20 THEN 1 WHEN loss AND delta < -0.10 THEN 2 WHEN loss THEN 3 WHEN gain THEN 4
WHEN ndvi_b >= 0.22 AND ndvi_a >= 0.18 THEN 5 WHEN ndvi_b < 0.12 THEN 6 WHEN ndvi_b >= 0.12 AND ndvi_b < 0.22 THEN 7 ELSE 0 END"""
_STATES = ", ".join(f"({k}, '{v}')" for k, v in change.SEVERITIES.items())


@query(
    "ndvi_severity",
    f"{scenes.MAPS}, s AS (SELECT {_SEVERITY} AS severity FROM maps)",
    f"SELECT t.severity, t.label, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM s), 6) AS pct FROM (VALUES {_STATES}) t(severity, label) LEFT JOIN (SELECT severity, count(*) AS n FROM s GROUP BY severity) USING (severity)",
)
def ndvi_severity(spark, sf):
    return consensus.ndvi_severity(scenes.class_maps(spark, sf)).select("severity", "label", "n", r6(F.col("pct"), "pct"))


def _scored_sql(source: str) -> str:
    return f"""top AS (SELECT quantile_cont(magnitude, 0.95) AS p95 FROM {source} WHERE magnitude > 0),
scored AS (SELECT *, CASE WHEN valid AND delta IS NOT NULL THEN CAST(ndvi AS INT) + CAST(rf AS INT) + CAST(cva AS INT) + CAST(bd AS INT) ELSE 0 END AS agreement,
  CASE WHEN valid AND delta IS NOT NULL THEN round(0.45e0 * CAST(ndvi AS INT) + 0.30e0 * CAST(rf AS INT) * greatest(0.0, least(1.0, (least(conf_b, conf_a) - 0.6e0) / (1 - 0.6e0)))
    + 0.20e0 * CAST(cva AS INT) * (0.5e0 + 0.5e0 * least(1.0, greatest(0.0, coalesce(magnitude, 0) / p95))) + 0.05e0 * CAST(bd AS INT), 6) ELSE 0.0 END AS score FROM {source} CROSS JOIN top),
voted AS (SELECT * REPLACE (valid AND delta IS NOT NULL AS valid), CASE WHEN score >= 0.55 THEN 2 WHEN score >= 0.35 THEN 1 ELSE 0 END AS consensus_class FROM scored)"""


_SCORED = f"{scenes.MAPS}, {_scored_sql('maps')}"


def _scored(spark, sf):
    return consensus.consensus(stored(scenes.class_maps(spark, sf)))


@query("consensus_map", _SCORED, "SELECT r, c, agreement, score, consensus_class FROM voted")
def consensus_map(spark, sf):
    return _scored(spark, sf).select("r", "c", "agreement", "score", "consensus_class")


@query(
    "consensus_summary",
    _SCORED,
    f"SELECT count_if(valid) AS valid_pixels, round(100.0 * count_if(valid AND consensus_class >= 1) / count_if(valid), 6) AS change_pct_any, round(100.0 * count_if(valid AND consensus_class = 2) / count_if(valid), 6) AS change_pct_confirmed, {', '.join(f'{_jaccard_sql(a, b, chr(118) + "alid")} AS jaccard_{a}_{b}' for a, b in _PAIRS)} FROM voted",
)
def consensus_summary(spark, sf):
    out = consensus.consensus_summary(_scored(spark, sf))
    return out.select("valid_pixels", *(r6(F.col(k), k) for k in out.columns[1:]))


_INTEGRATED = f"""{sqltext.ALL_METHODS}{scenes.MAPS[len(scenes.CLEAR):]},
joined AS (SELECT nd.r, nd.c, nd.delta, nd.ndvi_b, nd.ndvi_a, nd.loss, nd.gain, nd.changed AS ndvi, cv.magnitude, cv.changed AS cva, bd.changed AS bd, m.conf_b, m.conf_a, coalesce(m.valid, false) AS valid, coalesce(m.rf, false) AS rf
  FROM nd JOIN cv USING (r, c) JOIN bd USING (r, c) LEFT JOIN maps m USING (r, c)),
{_scored_sql('joined')}"""


def _integrated(spark, sf):
    """All four methods of the pair; the forest's classes and confidences are stand-ins by arithmetic."""
    maps = stored(scenes.class_maps(spark, sf)).withColumn("changed", F.col("rf"))
    forest = learning.ForestResult(maps, None, 0.75, 0.0, 0.0)
    return integrated.integrated(*_all(spark, sf), forest)


@query("integrated_map", _INTEGRATED, "SELECT r, c, agreement, score, consensus_class FROM voted")
def integrated_map(spark, sf):
    return _integrated(spark, sf).scored.select("r", "c", "agreement", "score", "consensus_class")


@query(
    "integrated_summary",
    _INTEGRATED,
    f"SELECT count_if(valid) AS valid_pixels, round(100.0 * count_if(valid AND consensus_class >= 1) / count_if(valid), 6) AS change_pct_any, round(100.0 * count_if(valid AND consensus_class = 2) / count_if(valid), 6) AS change_pct_confirmed, {', '.join(f'{_jaccard_sql(a, b, chr(118) + "alid")} AS jaccard_{a}_{b}' for a, b in _PAIRS)} FROM voted",
)
def integrated_summary(spark, sf):
    out = _integrated(spark, sf).summary
    return out.select("valid_pixels", *(r6(F.col(k), k) for k in out.columns[1:]))


@query(
    "integrated_severity",
    f"{_INTEGRATED}, s AS (SELECT {_SEVERITY} AS severity FROM joined)",
    f"SELECT t.severity, t.label, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM s), 6) AS pct FROM (VALUES {_STATES}) t(severity, label) LEFT JOIN (SELECT severity, count(*) AS n FROM s GROUP BY severity) USING (severity)",
)
def integrated_severity(spark, sf):
    return _integrated(spark, sf).severity.select("severity", "label", "n", r6(F.col("pct"), "pct"))


@query("agreement_hist", _SCORED, "SELECT agreement, count(*) AS n FROM voted GROUP BY agreement")
def agreement_hist(spark, sf):
    return _scored(spark, sf).groupBy("agreement").agg(F.count("*").alias("n"))


@query(
    "credible_transitions",
    f"""{scenes.MAPS}, {_matrix_sql('conf_b >= 0.6 AND conf_a >= 0.6')},
totals AS (SELECT CASE WHEN count_if(rf) > 0 THEN CAST(count_if(ndvi) AS DOUBLE) / count_if(rf) ELSE 1.0 END AS scale_factor FROM maps WHERE valid),
off AS (SELECT *, CASE WHEN class_before <> class_after THEN row_pct * scale_factor ELSE 0.0 END AS o FROM matrix CROSS JOIN totals),
scaled AS (SELECT *, CASE WHEN class_before <> class_after THEN o ELSE greatest(0.0, 100 - sum(o) OVER (PARTITION BY class_before)) END AS scaled_pct FROM off),
judged AS (SELECT *, (class_before = 2 AND class_after = 1 AND scaled_pct > 15) OR (class_before <> class_after AND ((class_before = 3 AND scaled_pct > 30) OR (class_after = 3 AND scaled_pct > 10))) AS suspect FROM scaled)""",
    "SELECT class_before, class_after, round(scaled_pct, 5) AS scaled_pct, suspect, round(coalesce(CASE WHEN suspect THEN 0 ELSE scaled_pct END / nullif(sum(CASE WHEN suspect THEN 0 ELSE scaled_pct END) OVER (PARTITION BY class_before), 0) * 100, 0), 5) AS credible_pct FROM judged",
)
def credible_transitions(spark, sf):
    maps = scenes.class_maps(spark, sf)
    matrix = crosstab.transitions(maps, "class_b", "class_a", 4, (F.col("conf_b") >= 0.6) & (F.col("conf_a") >= 0.6))
    totals = maps.filter("valid").agg(F.count_if("ndvi").cast("double").alias("ndvi_n"), F.count_if("rf").cast("double").alias("rf_n"))
    out = consensus.credible_transitions(matrix, F.col("ndvi_n"), F.col("rf_n"), totals)
    return out.select("class_before", "class_after", F.round("scaled_pct", 5).alias("scaled_pct"), "suspect", F.round("credible_pct", 5).alias("credible_pct"))


@query(
    "confidence_sweep",
    f"""{scenes.MAPS}, taus AS (SELECT i, round(0.5 + 0.05 * i, 2) AS threshold FROM (SELECT unnest(range(9)) AS i)),
swept AS (SELECT i, threshold, (SELECT count_if(valid) FROM maps) AS valid, count(*) AS n, count_if(rf) AS c, coalesce(CAST(count_if(rf AND ndvi) AS DOUBLE) / nullif(count_if(rf OR ndvi), 0), 0) AS jaccard
  FROM taus JOIN maps ON valid AND least(conf_b, conf_a) >= threshold GROUP BY ALL)""",
    "SELECT CAST(threshold AS DOUBLE) AS threshold, round(100.0 * n / valid, 6) AS coverage_pct, round(100.0 * c / n, 6) AS change_pct, round(jaccard, 6) AS jaccard, jaccard > 0 AND row_number() OVER (ORDER BY jaccard DESC, i) = 1 AS best FROM swept",
)
def confidence_sweep(spark, sf):
    out = consensus.confidence_sweep(scenes.class_maps(spark, sf).withColumn("changed", F.col("rf")))
    return out.select("threshold", *(r6(F.col(k), k) for k in ("coverage_pct", "change_pct", "jaccard")), "best")


@query(
    "macro_f1",
    f"{scenes.MAPS}, k AS (SELECT class_b AS t, class_a AS p FROM maps WHERE valid), s AS (SELECT x.class, count_if(t = x.class AND p = x.class) AS hit, count_if(t = x.class) AS support, count_if(p = x.class) AS found FROM k, (SELECT t AS class FROM k UNION SELECT p FROM k) x GROUP BY x.class)",
    "SELECT round(avg(2.0 * hit / (support + found)), 6) AS macro_f1, round(CAST(sum(hit) AS DOUBLE) / sum(support), 6) AS accuracy FROM s",
)
def macro_f1(spark, sf):
    out = crosstab.macro_f1(scenes.class_maps(spark, sf).filter("valid"), "class_b", "class_a")
    return out.select(r6(F.col("macro_f1"), "macro_f1"), r6(F.col("accuracy"), "accuracy"))


@query(
    "class_report",
    f"{scenes.MAPS}, k AS (SELECT class_b AS t, class_a AS p FROM maps WHERE valid), s AS (SELECT x.class, count_if(t = x.class AND p = x.class) AS hit, count_if(t = x.class) AS support, count_if(p = x.class) AS found FROM k, (SELECT t AS class FROM k UNION SELECT p FROM k) x GROUP BY x.class)",
    "SELECT class, round(coalesce(1.0 * hit / nullif(found, 0), 0), 6) AS precision, round(coalesce(1.0 * hit / nullif(support, 0), 0), 6) AS recall, round(2.0 * hit / (support + found), 6) AS f1, support FROM s",
)
def class_report(spark, sf):
    out = crosstab.class_scores(scenes.class_maps(spark, sf).filter("valid"), "class_b", "class_a")
    return out.select("class", *(r6(F.col(k), k) for k in ("precision", "recall", "f1")), "support")


# Statistics


def _long_sql(source: str, method: str, metrics: list[tuple[str, str, str]]) -> str:
    return "\nUNION ALL ".join(f"SELECT {k} AS ordinal, '{method}' AS method, '{name}' AS metric, CAST({value} AS DOUBLE) AS value, '{unit}' AS unit FROM {source}" for k, (name, value, unit) in enumerate(metrics))


def _share_sql(n: str, valid: str) -> str:
    return f"round(coalesce(100.0 * count_if({n}) / nullif(count({valid}), 0), 0), 4)"


def _universal(valid: str) -> list[tuple[str, str, str]]:
    return [("total_pixels", "count(*)", "px"), ("changed_pixels", "count_if(changed)", "px"), ("unchanged_pixels", "count(*) - count_if(changed)", "px"), ("change_pct", _share_sql("changed", valid), "%"), ("threshold", "round(max(threshold), 6)", "")]


def _sizes(column: str) -> list[tuple[str, str, str]]:
    return [(f"{column}_mean", f"round(avg({column}), 4)", ""), (f"{column}_std", f"round(stddev_pop({column}), 4)", ""), (f"{column}_max", f"round(max({column}), 4)", "")]


_CVA_SLUGS = {k: v.lower().replace(" ", "_").replace("/", "_") for k, v in change.CVA_TYPES.items()}


@query("stats_long_bd", sqltext.BAND_DIFF, _long_sql("bd", "Band Differencing", _universal("abs_diff") + _sizes("abs_diff")))
def stats_long_bd(spark, sf):
    return reporting.long_statistics(_run(methods.band_differencing, spark, sf))


_NDVI_LONG = [(f"{n}_mean", f"round(avg({c}), 6)", "") for n, c in (("ndvi_before", "ndvi_b"), ("ndvi_after", "ndvi_a"), ("delta_ndvi", "delta"))] + [(f"{n}_std", f"round(stddev_pop({c}), 6)", "") for n, c in (("delta_ndvi", "delta"), ("ndvi_before", "ndvi_b"), ("ndvi_after", "ndvi_a"))]


@query("stats_long_ndvi", sqltext.NDVI_DIFF, _long_sql("nd", "NDVI Differencing", _universal("delta") + _NDVI_LONG + [("vegetation_gain_pct", _share_sql("gain", "delta"), "%"), ("vegetation_loss_pct", _share_sql("loss", "delta"), "%")]))
def stats_long_ndvi(spark, sf):
    return reporting.long_statistics(_run(methods.ndvi_differencing, spark, sf))


@query("stats_long_cva", sqltext.CVA, _long_sql("cv", "CVA", _universal("magnitude") + _sizes("magnitude") + [x for k, s in _CVA_SLUGS.items() for x in ((f"cva_{s}_px", f"count_if(change_type = {k})", "px"), (f"cva_{s}_pct", _share_sql(f"change_type = {k}", "magnitude"), "%"))]))
def stats_long_cva(spark, sf):
    return reporting.long_statistics(_run(methods.change_vectors, spark, sf))


def _all(spark, sf):
    return _run(methods.all_methods, spark, sf)


def _wide_sql() -> str:
    own = {"bd": ("Band Differencing", "abs_diff"), "nd": ("NDVI Differencing", "delta"), "cv": ("CVA", "magnitude")}
    rows = []
    for source, (method, valid) in own.items():
        ndvi = (_share_sql("gain", "delta"), _share_sql("loss", "delta"), "round(avg(delta), 6)") if source == "nd" else ("NULL",) * 3
        types = [_share_sql(f"change_type = {k}", valid) if source == "cv" else "NULL" for k in _CVA_SLUGS]
        more = ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for v, n in zip((*ndvi, *types), ("ndvi_gain_pct", "ndvi_loss_pct", "delta_ndvi_mean", *(f"cva_{s}_pct" for s in _CVA_SLUGS.values()))))
        rows.append(f"SELECT '{method}' AS method, {_share_sql('changed', valid)} AS change_pct, count_if(changed) AS changed_pixels, count(*) AS total_pixels, round(max(threshold), 6) AS threshold, {more} FROM {source}")
    return "\nUNION ALL ".join(rows)


@query("compare_methods", sqltext.ALL_METHODS, _wide_sql())
def compare_methods(spark, sf):
    return reporting.compare(_all(spark, sf))


@query(
    "summary_table",
    f"{sqltext.ALL_METHODS}, wide AS ({_wide_sql()})",
    "SELECT method, printf('%.2f%%', change_pct) AS change, printf('%.0f km²', change_pct * 4) AS changed_area, CASE WHEN method = 'NDVI Differencing' THEN printf('±%.4f', threshold) ELSE printf('%.2f', threshold) END AS threshold FROM wide",
)
def summary_table(spark, sf):
    return reporting.summary_table(reporting.compare(_all(spark, sf)))


@query(
    "area_stats",
    sqltext.ALL_METHODS,
    "\nUNION ALL ".join(
        f"""SELECT '{m}' AS method, round(count_if(changed) * 100.0, 2) AS changed_area_m2, round(count_if(changed) * 100.0 / 10000, 4) AS changed_area_ha, round(count_if(changed) * 100.0 / 1000000, 6) AS changed_area_km2,
round((count(*) - count_if(changed)) * 100.0 / 10000, 4) AS unchanged_area_ha, round(100.0 * count_if(changed) / count(*), 4) AS change_pct, count(*) AS valid_pixels FROM {s}"""
        for s, m in (("bd", "Band Differencing"), ("nd", "NDVI Differencing"), ("cv", "CVA"))
    ),
)
def area_stats(spark, sf):
    return reporting.all_areas(_all(spark, sf))


# Tiles

_GRID = """tiles AS (SELECT CAST(i AS INT) AS tile_id, CAST(i // 3 AS INT) AS tile_row, CAST(i % 3 AS INT) AS tile_col, CAST(i % 3 * 33 AS INT) AS dest_x, CAST(i // 3 * (h // 4) AS INT) AS dest_y, h FROM (SELECT unnest(range(12)) AS i), (SELECT max(event_id) // 100 + 1 AS h FROM events)),
sized AS (SELECT *, CAST(CASE WHEN tile_col < 2 THEN 33 ELSE 100 - dest_x END AS INT) AS x_size_inner, CAST(CASE WHEN tile_row < 3 THEN h // 4 ELSE h - dest_y END AS INT) AS y_size_inner, greatest(0, dest_x - 5) AS x_off, greatest(0, dest_y - 5) AS y_off FROM tiles),
tile_grid AS (SELECT tile_id, tile_row, tile_col, x_off, y_off, CAST(least(100, dest_x + x_size_inner + 5) - x_off AS INT) AS x_size, CAST(least(h, dest_y + y_size_inner + 5) - y_off AS INT) AS y_size, dest_x - x_off AS x_off_inner, dest_y - y_off AS y_off_inner, x_size_inner, y_size_inner, dest_x, dest_y FROM sized)"""


def _event_grid(spark, sf):
    cells = scenes.dense_grid(spark, sf)
    return cells, grid.shape_of(cells)


@query("tile_grid", _GRID, "SELECT * FROM tile_grid")
def tile_grid(spark, sf):
    return tiling.tile_grid(spark, 100, _event_grid(spark, sf)[1].height, 3, 4, 5)


@query("scl_tile", _GRID, "SELECT tile_id, x_off // 2 AS x_off, y_off // 2 AS y_off, greatest(1, x_size // 2) AS x_size, greatest(1, y_size // 2) AS y_size FROM tile_grid")
def scl_tile(spark, sf):
    return tiling.half_resolution(tiling.tile_grid(spark, 100, _event_grid(spark, sf)[1].height, 3, 4, 5))


_IN_TILES = f"""{_GRID}, {scenes.DENSE},
placed AS (SELECT d.*, g.tile_id, g.tile_row, g.tile_col, d.c >= g.dest_x AND d.c < g.dest_x + g.x_size_inner AND d.r >= g.dest_y AND d.r < g.dest_y + g.y_size_inner AS inner_px
  FROM dense d JOIN tile_grid g ON d.c >= g.x_off AND d.c < g.x_off + g.x_size AND d.r >= g.y_off AND d.r < g.y_off + g.y_size)"""


@query("pixels_in_tiles", _IN_TILES, "SELECT r, c, tile_id, inner_px FROM placed")
def pixels_in_tiles(spark, sf):
    cells, shape = _event_grid(spark, sf)
    return tiling.in_tiles(cells, 100, shape.height, 3, 4, 5).select("r", "c", "tile_id", F.col("inner").alias("inner_px"))


@query(
    "pixels_in_footprints",
    f"{scenes.DENSE}, f AS (SELECT p_partkey, p_partkey * 7 % 100 AS r0, p_size * 13 % 100 AS c0, 1 + p_size % 9 AS height, 1 + p_partkey % 40 AS width FROM part)",
    "SELECT p_partkey, count(*) AS n, min(x) AS low, max(x) AS high FROM f JOIN dense ON r >= r0 AND r < r0 + height AND c >= c0 AND c < c0 + width GROUP BY p_partkey",
)
def pixels_in_footprints(spark, sf):
    """Pixels under a rectangle of its own for each part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    shapes = scenes.table(spark, sf, "part").select(key, (key * 7 % 100).alias("r0"), (size * 13 % 100).alias("c0"), (1 + size % 9).alias("height"), (1 + key % 40).alias("width"))
    return tiling.footprint_statistics(scenes.dense_grid(spark, sf), shapes, "p_partkey", "x", 16)


_LON, _LAT = sqltext.utm_to_degrees("300000.0 + (c + 0.5) * 4000.0", "4000000.0 - (r % 100 + 0.5) * 4000.0", "31 + r % 2")


@query(
    "warp_labels",
    f"{scenes.LABELS}, placed AS (SELECT r, c, CAST(31 + r % 2 AS INT) AS zone, {_LON} AS lon, {_LAT} AS lat FROM dense), spots AS (SELECT *, CAST(floor((lat - 36.5) / -0.04) AS INT) AS sr, CAST(floor((lon - CASE zone WHEN 31 THEN 0.5 ELSE 6.5 END) / 0.05) AS INT) AS sc FROM placed)",
    "SELECT s.r, s.c, zone, round(lon, 7) AS lon, round(lat, 7) AS lat, wc FROM spots s LEFT JOIN labelled l ON l.r = s.sr AND l.c = s.sc",
)
def warp_labels(spark, sf):
    """Labels in degrees on a grid in metres of two UTM zones: rows of pixels take turns."""
    cells, labels = scenes.dense_grid(spark, sf).select("r", "c"), scenes.label_map(spark, sf)
    parts = []
    for k, west in ((0, 0.5), (1, 6.5)):
        own = cells.filter(F.col("r") % 2 == k).withColumns({"row": F.col("r"), "r": (F.col("r") % 100).cast("int")})
        x, y = tables.Geotransform(300000.0, 4000.0, 4000000.0, -4000.0).centre(F.col("r"), F.col("c"))
        lon, lat = tables.utm_to_degrees(x, y, 31 + k)
        own = own.withColumns({"lon": F.round(lon, 7), "lat": F.round(lat, 7), "zone": F.lit(31 + k)})
        found = tables.resample_nearest(own, tables.Geotransform(300000.0, 4000.0, 4000000.0, -4000.0), labels, tables.Geotransform(west, 0.05, 36.5, -0.04), "wc", zone=31 + k)
        parts.append(found.select(F.col("row").alias("r"), "c", "zone", "lon", "lat", "wc"))
    return parts[0].unionByName(parts[1])


@query("tiled_run", scenes.DENSE, "SELECT r, c, round(x * 2 + 1, 6) AS x FROM dense")
def tiled_run_query(spark, sf):
    """A run into a folder that stops after six tiles, and one that does the rest."""
    cells, shape = _event_grid(spark, sf)
    target = scratch(spark)

    def twice(frame):
        return frame.assign(x=(frame.x * 2 + 1).round(6))[["r", "c", "x", "tile_id"]]

    for most in (6, None):
        done = tiled_run.tiled_run(cells, 100, shape.height, 3, 4, 5, twice, "r int, c int, x double, tile_id int", target, tiles_at_once=3, most=most)
    return done.select("r", "c", "x")


_TILE_STATS = """stats AS (SELECT tile_id, tile_row, tile_col, count(*) AS valid_pixels, count_if(x > 50) AS changed_pixels FROM placed WHERE inner_px GROUP BY ALL),
tile_stats AS (SELECT *, round(100.0 * changed_pixels / valid_pixels, 4) AS change_pct, round(changed_pixels * 100.0 / 10000, 2) AS changed_area_ha, round(changed_pixels * 100.0 / 1000000, 4) AS changed_area_km2 FROM stats)"""


def _tile_stats(spark, sf):
    cells, shape = _event_grid(spark, sf)
    inner = tiling.in_tiles(cells, 100, shape.height, 3, 4, 5).filter("inner").withColumn("changed", F.col("x") > 50)
    return tiling.tile_statistics(inner, "changed")


@query("tile_stats", f"{_IN_TILES}, {_TILE_STATS}", "SELECT * FROM tile_stats")
def tile_stats(spark, sf):
    return _tile_stats(spark, sf)


@query("tile_rollup", f"{_IN_TILES}, {_TILE_STATS}", "SELECT CAST(sum(valid_pixels) AS BIGINT) AS valid_pixels, CAST(sum(changed_pixels) AS BIGINT) AS changed_pixels, round(100.0 * sum(changed_pixels) / sum(valid_pixels), 4) AS change_pct FROM tile_stats")
def tile_rollup(spark, sf):
    return tiling.rollup(_tile_stats(spark, sf))


@query("tile_pivot", f"{_IN_TILES}, {_TILE_STATS}", "SELECT tile_row, " + ", ".join(f"coalesce(max(change_pct) FILTER (WHERE tile_col = {k}), 0.0) AS col_{k}" for k in range(3)) + " FROM tile_stats GROUP BY tile_row")
def tile_pivot(spark, sf):
    return tiling.tile_table(_tile_stats(spark, sf), 3)


@query("stitch", _IN_TILES, "SELECT d.r, d.c, coalesce(round(p.x * 2, 6), -1.0) AS x FROM dense d LEFT JOIN (SELECT * FROM placed WHERE inner_px AND tile_id <> 7) p USING (r, c)")
def stitch(spark, sf):
    cells, shape = _event_grid(spark, sf)
    parts = tiling.in_tiles(cells, 100, shape.height, 3, 4, 5).filter("tile_id != 7").withColumn("x", F.round(F.col("x") * 2, 6))
    return tiling.stitch(parts, cells, "x", -1.0)


@query(
    "tiled_ndvi",
    f"""{sqltext.FULL},
nd_cells AS (SELECT r, c, abs(ndvi_a - ndvi_b) AS abs_delta FROM cells LEFT JOIN (SELECT r, c, (b08_b - b04_b) / nullif(b08_b + b04_b, 0) AS ndvi_b, (b08_a - b04_a) / nullif(b08_a + b04_a, 0) AS ndvi_a FROM clear) USING (r, c)),
{sqltext.blurred('nd_cells', 'nd_s', 'abs_delta')}, tiles AS (SELECT r, c, smoothed, (r // 50) * 2 + c // 50 AS tile FROM nd_s), {sqltext.otsu('tiles', 'nd_t', 'smoothed', 'tile')}""",
    "SELECT r, c, round(threshold, 6) AS threshold, coalesce(smoothed > threshold, false) AS changed FROM tiles LEFT JOIN nd_t USING (tile)",
)
def tiled_ndvi(spark, sf):
    result = _run(methods.ndvi_differencing, spark, sf, by_tile=50)
    return result.pixels.select("r", "c", r6(F.col("threshold"), "threshold"), "changed")


# Many scenes at once

_BY_SCENE = f"""{scenes.CLEAR},
parts AS (SELECT CAST((r // 25) * 4 + c // 25 AS INT) AS scene_id, CAST(r % 25 AS INT) AS r, CAST(c % 25 AS INT) AS c, abs(b04_a - b04_b) AS abs_diff,
  abs((b08_a - b04_a) / nullif(b08_a + b04_a, 0) - (b08_b - b04_b) / nullif(b08_b + b04_b, 0)) AS abs_delta, CASE WHEN valid THEN sqrt({' + '.join(f'({b}_a - {b}_b) * ({b}_a - {b}_b)' for b in indices.BANDS)}) END AS magnitude FROM clear),
sizes AS (SELECT scene_id, max(r) + 1 AS h, max(c) + 1 AS w FROM parts GROUP BY scene_id),
cells AS (SELECT scene_id, CAST(r AS INT) AS r, CAST(unnest(range(w)) AS INT) AS c FROM (SELECT scene_id, w, unnest(range(h)) AS r FROM sizes)),
full_cells AS (SELECT * FROM cells LEFT JOIN parts USING (scene_id, r, c)),
{", ".join(f"{sqltext.blurred('full_cells', f'{v}_s', v, 'scene_id')}, {sqltext.otsu(f'{v}_s', f'{v}_t', 'smoothed', 'scene_id')}" for v in ("abs_diff", "abs_delta", "magnitude"))}"""


@query(
    "scenes_batch",
    _BY_SCENE,
    "\nUNION ALL ".join(
        f"SELECT '{name}' AS method, scene_id, count(*) AS total_pixels, count(smoothed) AS valid_pixels, count_if(coalesce(smoothed > threshold, false)) AS changed_pixels, round(max(threshold), 6) AS threshold FROM {v}_s LEFT JOIN {v}_t USING (scene_id) GROUP BY scene_id"
        for name, v in (("Band Differencing", "abs_diff"), ("NDVI Differencing", "abs_delta"), ("CVA", "magnitude"))
    ),
)
def scenes_batch(spark, sf):
    """The three methods on the blocks of the pair as scenes of their own: one plan for all."""
    parts = scenes.clear_pair(spark, sf).withColumns({"scene_id": F.expr("cast((r div 25) * 4 + c div 25 as int)"), "r": (F.col("r") % 25).cast("int"), "c": (F.col("c") % 25).cast("int")})
    tables = [m.summary.select(F.lit(m.method).alias("method"), "scene_id", "total_pixels", "valid_pixels", "changed_pixels", r6(F.col("threshold"), "threshold")) for m in methods.methods_by_scene(parts)]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


# Sampling and ablation tables


@query(
    "class_guard",
    f"{scenes.LABELS}, k AS (SELECT r, c, CASE WHEN wc IN (10, 40) THEN 1 WHEN wc IN (50, 60, 70) THEN 2 WHEN wc IN (80, 90, 95) AND r % 10 = 0 THEN 3 WHEN wc = 100 AND r = 3 THEN 4 ELSE 0 END AS label FROM dense JOIN labelled USING (r, c)), n AS (SELECT t.class, count(k.label) AS n FROM (VALUES (1), (2), (3), (4)) t(class) LEFT JOIN k ON k.label = t.class GROUP BY t.class)",
    "SELECT class, n, CASE WHEN n >= 100 THEN class WHEN class = 3 THEN 2 ELSE coalesce((SELECT arg_max(class, (n, -class)) FROM n WHERE n >= 100), 2) END AS target FROM n",
)
def class_guard(spark, sf):
    wc = F.col("wc")
    label = F.when(wc.isin(10, 40), 1).when(wc.isin(50, 60, 70), 2).when(wc.isin(80, 90, 95) & (F.col("r") % 10 == 0), 3).when((wc == 100) & (F.col("r") == 3), 4).otherwise(0)
    return sampling.class_guard(scenes.label_map(spark, sf).withColumn("label", label), "label", [1, 2, 3, 4])


_SAMPLE = f"""{scenes.LABELS}, usable AS (SELECT CAST(r * 100 + c AS BIGINT) AS pixel_id, CASE WHEN wc IN (10, 40) THEN 1 WHEN wc IN (50, 60, 70) THEN 2 WHEN wc IN (80, 90, 95) THEN 3 WHEN wc IN (20, 30, 100) THEN 4 ELSE 0 END AS label FROM labelled),
ranked AS (SELECT pixel_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(pixel_id AS VARCHAR)), pixel_id) AS rank FROM usable WHERE label > 0)"""


@query("stratified_sample", _SAMPLE, "SELECT pixel_id, label, CAST(rank AS INT) AS rank, CASE WHEN rank <= 40 THEN 'before' ELSE 'after' END AS date FROM ranked WHERE rank <= 80")
def stratified_sample(spark, sf):
    usable = scenes.label_map(spark, sf).select((F.col("r").cast("long") * 100 + F.col("c")).alias("pixel_id"), classes.recode(F.col("wc"), classes.CODE_TO_CLASS).alias("label"))
    return sampling.stratified_pair(usable, "label", [1, 2, 3, 4], 40)


@query(
    "binary_sample",
    f"{_SAMPLE.replace('usable AS', 'four AS').replace('FROM usable WHERE label > 0', 'FROM usable').replace('ranked AS', 'usable AS (SELECT pixel_id, label FROM four WHERE label IN (1, 2)), per AS (SELECT least(100, count_if(label = 1), count_if(label = 2)) // 2 AS k FROM usable), ranked AS')}",
    "SELECT pixel_id, label, CAST(rank AS INT) AS rank, CASE WHEN rank <= k THEN 'before' ELSE 'after' END AS date FROM ranked, per WHERE rank <= 2 * k",
)
def binary_sample(spark, sf):
    usable = scenes.label_map(spark, sf).select((F.col("r").cast("long") * 100 + F.col("c")).alias("pixel_id"), classes.recode(F.col("wc"), classes.CODE_TO_CLASS).alias("label"))
    return sampling.balanced_binary(usable, "label", 200)


@query("spatial_folds", scenes.DENSE, "SELECT r, c, CAST(least(r // greatest(1, (SELECT max(r) + 1 FROM dense) // 4), 3) * 4 + least(c // 25, 3) AS INT) AS fold FROM dense")
def spatial_folds(spark, sf):
    cells, shape = _event_grid(spark, sf)
    return cells.select("r", "c", sampling.spatial_block(shape).alias("fold"))


@query(
    "ablation_verdict",
    "f AS (SELECT CASE l_linenumber WHEN 1 THEN 'Baseline (all 10)' ELSE 'No ' || l_linenumber END AS name, sum(l_partkey) % 100 / 1000e0 AS f1, sum(l_suppkey) % 100 / 500e0 AS jaccard, sum(l_orderkey) % 1000 / 10e0 AS change_pct FROM lineitem GROUP BY l_linenumber), d AS (SELECT f.*, f.f1 - b.f1 AS d1, f.jaccard - b.jaccard AS dj, f.change_pct - b.change_pct AS dc FROM f, f b WHERE b.name = 'Baseline (all 10)')",
    "SELECT name, printf('%+.4f', d1) AS delta_f1, printf('%+.4f', dj) AS delta_jaccard, printf('%+.2f', dc) AS delta_change, CASE WHEN name = 'Baseline (all 10)' THEN 'BASELINE' WHEN d1 > 0.02 OR dj > 0.05 THEN 'BETTER (removing helps)' WHEN d1 < -0.02 THEN 'WORSE (removing hurts)' ELSE 'NEUTRAL (±noise)' END AS verdict FROM d",
)
def ablation_verdict(spark, sf):
    """Figures of the experiments by arithmetic over the lines, a line number each."""
    name = F.when(F.col("l_linenumber") == 1, "Baseline (all 10)").otherwise(F.concat(F.lit("No "), F.col("l_linenumber").cast("string")))
    share = lambda key, n, of, out: (F.sum(key) % n / F.lit(float(of))).alias(out)
    figures = scenes.table(spark, sf, "lineitem").groupBy("l_linenumber", name.alias("name")).agg(share("l_partkey", 100, 1000, "f1"), share("l_suppkey", 100, 500, "jaccard"), share("l_orderkey", 1000, 10, "change_pct"))
    return learning.verdicts(figures.drop("l_linenumber")).select("name", display.signed(F.col("delta_f1")).alias("delta_f1"), display.signed(F.col("delta_jaccard")).alias("delta_jaccard"), display.signed(F.col("delta_change"), 2).alias("delta_change"), "verdict")


@query(
    "experiment_dedup",
    f"e AS (SELECT p_partkey AS ordinal, p_name AS name, list_transform([p_size % 10, p_size * 3 % 10, p_partkey % 7], lambda k: list_extract({list(indices.FEATURES)}, CAST(k AS INT) + 1)) AS features FROM part)",
    "SELECT ordinal, name, CAST(len(features) AS INT) AS n_features, array_to_string(list_sort(features), ',') AS feature_set FROM e QUALIFY row_number() OVER (PARTITION BY list_sort(features) ORDER BY ordinal) = 1",
)
def experiment_dedup(spark, sf):
    """An experiment of three features for each part."""
    names = F.array(*map(F.lit, indices.FEATURES))
    picks = F.array(F.col("p_size") % 10, F.col("p_size") * 3 % 10, F.col("p_partkey").cast("int") % 7)
    listed = scenes.table(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"), F.transform(picks, lambda k: F.get(names, k)).alias("features"))
    return learning.distinct_experiments(listed).select("ordinal", "name", F.size("features").alias("n_features"), F.array_join(F.array_sort("features"), ",").alias("feature_set"))


_IMPORTANCES = "figures AS (SELECT CAST(l_linenumber AS VARCHAR) AS pair, l_returnflag || l_linestatus AS feature, CAST(count(*) AS DOUBLE) AS importance FROM lineitem GROUP BY ALL)"


def _importances(spark, sf):
    """Stand-ins for importances of features in the forests of several pairs, so that SQL can rank them."""
    rows = scenes.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("pair"), F.concat("l_returnflag", "l_linestatus").alias("feature")).agg(F.count("*").cast("double").alias("importance"))
    return rows.groupBy("pair").agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("importances"))


@query("top_features", _IMPORTANCES, "SELECT pair, CAST(rank AS INT) AS rank, feature, importance FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY importance DESC, feature) AS rank FROM figures) WHERE rank <= 5")
def top_features(spark, sf):
    return learning.top_features(_importances(spark, sf))


@query(
    "importance_shift",
    _IMPORTANCES,
    "SELECT feature, a.importance AS first, b.importance AS second, b.importance - a.importance AS delta, CASE WHEN feature = 'NO' THEN CASE WHEN b.importance - a.importance < -0.03 THEN 'CONFIRMED' WHEN abs(b.importance - a.importance) < 0.03 THEN 'INCONCLUSIVE' ELSE 'UNEXPECTED' END END AS finding FROM figures a JOIN figures b USING (feature) WHERE a.pair = '1' AND b.pair = '2'",
)
def importance_shift(spark, sf):
    return learning.importance_shift(_importances(spark, sf), "1", "2", "NO")


_PRESENT = " AND ".join(f"({v.replace('_b', d)}) IS NOT NULL" for d in ("_b", "_a") for v in _INDEX_SQL.values())


@query(
    "usable_labels",
    f"{scenes.CLEAR}, {scenes.LABELS}",
    f"SELECT r, c, CASE WHEN wc IN (10, 40) THEN 1 WHEN wc IN (50, 60, 70) THEN 2 WHEN wc IN (80, 90, 95) THEN 3 ELSE 4 END AS label, CAST(r * 100 + c AS BIGINT) AS pixel_id FROM clear JOIN labelled USING (r, c) WHERE valid AND wc > 0 AND {_PRESENT}",
)
def usable_labels(spark, sf):
    both = learning.pair_features(scenes.clear_pair(spark, sf))
    return learning.usable_labels(both, scenes.label_map(spark, sf), classes.CODE_TO_CLASS, grid.Shape(100, 100))


@query(
    "forest_summary",
    f"{scenes.MAPS}, {_matrix_sql('true')}",
    "SELECT 'Random Forest' AS method, round(coalesce(100.0 * count_if(rf) / nullif(count_if(valid), 0), 0), 4) AS change_pct, count_if(rf) AS changed_pixels, count(*) AS total_pixels, CAST(NULL AS DOUBLE) AS threshold, "
    + ", ".join(f"(SELECT round(row_pct, 2) FROM matrix WHERE class_before = {k} AND class_after = {k}) AS \"rf_stable_{classes.CLASS_NAMES[k].lower().replace(' ', '_')}_pct\"" for k in range(1, 5))
    + ", 75e0 AS rf_accuracy_pct FROM maps",
)
def forest_summary(spark, sf):
    """The forest's row of the comparison, of stand-in classes."""
    maps = scenes.class_maps(spark, sf).withColumn("changed", F.col("rf"))
    return integrated.forest_row(learning.ForestResult(maps, None, 0.75, 0.0, 0.0))


# Forests as tables

_BASE = {"b02": (300, 1000), "b03": (400, 1200), "b04": (500, 1500), "b08": (2000, 2000)}
_PARTS_FOREST = f"""sums AS (SELECT CAST(p_partkey // 15 % 20 AS INT) AS tree, CAST(p_partkey % 15 AS INT) AS node, sum(p_size) AS s, sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS cents FROM part GROUP BY ALL),
nodes AS (SELECT tree, node, CAST(s % 4 AS INT) AS feature, 1 + s % 4 AS class, CASE s % 4 {' '.join(f'WHEN {k} THEN {low} + cents % {span}' for k, (low, span) in enumerate(_BASE.values()))} END AS split FROM sums QUALIFY count(*) OVER (PARTITION BY tree) = 15),
px AS (SELECT r, c, [b02_b, b03_b, b04_b, b08_b] AS x FROM clear WHERE valid),
at0 AS (SELECT r, c, x, tree, 0 AS node FROM px, (SELECT DISTINCT tree FROM nodes)),
{', '.join(f'at{k + 1} AS (SELECT r, c, x, tree, 2 * node + CASE WHEN x[feature + 1] <= split THEN 1 ELSE 2 END AS node FROM at{k} JOIN nodes USING (tree, node))' for k in range(3))},
voted AS (SELECT r, c, tree, class FROM at3 JOIN nodes USING (tree, node))"""
_TALLY = ", ".join(f"count_if(class = {k}) AS v{k}" for k in range(1, 5))
_FIRST = f"CASE {' '.join(f'WHEN v{k} = greatest(v1, v2, v3, v4) THEN {k}' for k in range(1, 5))} END"


def parts_forest(spark, sf) -> forests.Forest:
    """A forest whose nodes are sums over the parts: trees of three levels, a class at each leaf."""
    sums = scenes.table(spark, sf, "part").groupBy((F.expr("p_partkey div 15") % 20).cast("int").alias("tree"), (F.col("p_partkey") % 15).cast("int").alias("node")).agg(F.sum("p_size").alias("s"), F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).alias("cents"))
    whole = sums.groupBy("tree").agg(F.count("*").alias("n")).filter("n = 15").select("tree")
    k, leaf = F.col("s") % 4, F.col("node") >= 7
    split = F.lit(None)
    for i, (low, span) in enumerate(_BASE.values()):
        split = F.when(k == i, low + F.col("cents") % span).otherwise(split)
    side = lambda n: F.when(leaf, F.col("node")).otherwise(2 * F.col("node") + n).cast("int")
    shares = F.transform(F.array(*map(F.lit, range(4))), lambda j: (j == k).cast("double"))
    nodes = sums.join(whole, "tree").select((F.col("tree") % 5).alias("bag"), "tree", "node", k.cast("int").alias("feature"), split.cast("double").alias("split"), side(1).alias("left"), side(2).alias("right"), shares.alias("shares"))
    return forests.Forest(nodes, tuple(f"{b}_b" for b in _BASE), (1, 2, 3, 4))


@query(
    "rf_apply",
    f"{scenes.CLEAR}, {_PARTS_FOREST}, tally AS (SELECT r, c, {_TALLY} FROM voted GROUP BY r, c)",
    f"SELECT r, c, CAST(coalesce({_FIRST}, 0) AS INT) AS class, coalesce(round(greatest(v1, v2, v3, v4) / CAST(v1 + v2 + v3 + v4 AS DOUBLE), 6), 0) AS conf FROM clear LEFT JOIN tally USING (r, c)",
)
def rf_apply(spark, sf):
    """A stored forest over all pixels of the first date."""
    path = scratch(spark)
    forests.save_forest(parts_forest(spark, sf), path)
    found = forests.apply_forest(forests.load_forest(spark, path), scenes.clear_pair(spark, sf), present=F.col("valid"))
    return found.select("r", "c", "class", r6(F.col("conf"), "conf"))


_DRAWN = f"""drawn AS (SELECT r, c, bag, {' + '.join(f'CAST(u >= {limit!r} AS INT)' for limit in forests.draw_limits())} AS draws FROM (SELECT r, c, bag, CAST('0x' || substr(md5('42:' || bag || ':' || (r * 100 + c)), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM px, (SELECT unnest(range(5)) AS bag)))"""


@query(
    "rf_oob_votes",
    f"{scenes.CLEAR}, {_PARTS_FOREST}, {_DRAWN}, tally AS (SELECT v.r, v.c, {_TALLY} FROM voted v JOIN drawn d ON v.r = d.r AND v.c = d.c AND v.tree % 5 = d.bag WHERE draws = 0 GROUP BY v.r, v.c), bags AS (SELECT r, c, count_if(draws = 0) AS n_out, sum(draws) AS draws FROM drawn GROUP BY r, c)",
    f"SELECT r, c, CAST(n_out AS INT) AS n_out, CAST(draws AS INT) AS draws, coalesce(v1, 0) AS v1, coalesce(v2, 0) AS v2, coalesce(v3, 0) AS v3, coalesce(v4, 0) AS v4, CAST({_FIRST} AS INT) AS oob_class FROM bags LEFT JOIN tally USING (r, c)",
)
def rf_oob_votes(spark, sf):
    """Votes of the trees whose bag left a pixel out, and how often the bags have it."""
    pixels = scenes.clear_pair(spark, sf).filter("valid").withColumn("pixel_id", F.col("r").cast("long") * 100 + F.col("c"))
    found = forests.out_of_bag(parts_forest(spark, sf), pixels, 5, pixel=F.col("pixel_id"))
    whole = F.lit(0)
    for bag in range(5):
        whole = whole + forests.draws(bag, F.col("pixel_id"))
    return found.select("r", "c", "n_out", whole.alias("draws"), *(F.get("oob_votes", F.lit(k)).cast("long").alias(f"v{k + 1}") for k in range(4)), "oob_class")


# Images


@query("raster_file_window", scenes.DENSE, "SELECT r, c, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM dense WHERE r BETWEEN 5 AND 64 AND c BETWEEN 30 AND 79")
def raster_file_window(spark, sf):
    """A folder of deflated images that a job has written; a window of it reads the strips it needs."""
    cells, shape = _event_grid(spark, sf)
    folder = scratch(spark)
    made = tiff.to_tiff(tiling.in_tiles(cells, 100, shape.height, 3, max(1, shape.height // 100), 0), "x", (500000.0, 10.0, 0.0, 3900000.0, 0.0, -10.0), 32631, strip=5, deflate=True)
    images.write_images(made, folder)
    return images.read_images(spark, folder, {"x": 1}, window=(30, 5, 50, 60), origin=(500000.0, 3900000.0)).drop("file")


# Without SQL: trained models and files

_SMALL = learning.ForestSettings(trees=10, depth=6)


def _labels(spark, sf):
    return scenes.class_maps(spark, sf).select("r", "c", F.when(F.col("ndvi_b") > 0.5, 10).when(F.col("ndvi_b") > 0.4, 30).otherwise(60).alias("wc"))


@query("rf_classify")
def rf_classify(spark, sf):
    r = learning.random_forest(*_pair(spark, sf), _labels(spark, sf), 2000, _SMALL, cross_validate=False)
    return r.pixels


@query("rf_binary")
def rf_binary(spark, sf):
    r = learning.binary_forest(*_pair(spark, sf), _labels(spark, sf), 2000, _SMALL, cross_validate=False)
    return r.pixels


@query("seasonal_comparison")
def seasonal_comparison(spark, sf):
    """Two pairs, the second with its dates exchanged; forests of two trees on 400 samples."""
    pair, shape = _pair(spark, sf)
    swapped = pair.select("r", "c", *(F.col(f"{b}_{d}").alias(f"{b}_{o}") for b in indices.BANDS for d, o in ("ab", "ba")))
    few = learning.ForestSettings(trees=2, depth=3, blocks=(1, 2))
    return learning.seasonal_comparison({"forth": (pair, shape, _labels(spark, sf)), "back": (swapped, shape, _labels(spark, sf))}, few, 400)


@query("kmeans_labels")
def kmeans_labels(spark, sf):
    return learning.cluster_labels(learning.date_features(scenes.clear_pair(spark, sf), "b"), starts=2)


@query("tiff_round_trip", scenes.DENSE, "SELECT r, c, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM dense")
def tiff_round_trip(spark, sf):
    cells, shape = _event_grid(spark, sf)
    parts = tiling.in_tiles(cells, 100, shape.height, 3, 4, 0)
    images = tiff.to_tiff(parts, "x", (500000.0, 10.0, 0.0, 3900000.0, 0.0, -10.0))
    return tiff.pixels_of(images, ["tile_id"]).select("r", "c", F.col("value").alias("x"))


@query("tiled_function", scenes.DENSE, "SELECT r, c, round(x * 2 + 1, 6) AS x FROM dense")
def tiled_function(spark, sf):
    cells, shape = _event_grid(spark, sf)

    def double(frame):
        return frame.assign(x=(frame.x * 2 + 1).round(6))[["r", "c", "x", "tile_id"]]

    return tiling.tiled(cells, 100, shape.height, 3, 4, 5, double, "r int, c int, x double, tile_id int")


@query("tiled_pair_function", scenes.PAIR, "SELECT r, c, b04_a - b04_b AS x FROM pair")
def tiled_pair_function(spark, sf):
    """A function of two dates: both are columns of the frame that it gets for each tile."""

    def less(frame):
        return frame.assign(x=frame.b04_a - frame.b04_b)[["r", "c", "x", "tile_id"]]

    return tiling.tiled(scenes.pair(spark, sf).select("r", "c", "b04_b", "b04_a"), 100, 100, 3, 4, 5, less, "r int, c int, x double, tile_id int")
