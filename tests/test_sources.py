import json
import math

import pytest
from pyspark.sql import functions as F

from pixelweave.operators import grid
from pixelweave.plans import learning, methods
from pixelweave.sources import ascii_grid, tables, tiff
from pixelweave.streaming.scenes import change_stream

from .test_operators import pair_of, table


def test_ascii_grid(spark, tmp_path):
    lines = ["NCOLS 10", "NROWS 10", "XLLCENTER 5", "YLLCENTER 5", "DX 10", "DY 10", "NODATA_VALUE -9999", *[" ".join(map(str, range(10)))] * 9, "-9999 " + " ".join(map(str, range(1, 10))), "", "CRS", "NOTES"]
    (tmp_path / "g.asc").write_text("\n".join(lines))
    df = ascii_grid.read_ascii_grid(spark, str(tmp_path / "g.asc"))
    assert df.count() == 100 and df.filter("value is null").count() == 1
    full = df.withColumn("value", F.coalesce("value", F.lit(0.0)))
    info = grid.raster_info(full, "value").first()
    assert (info.width, info.height, info.min, info.max, info["mean"]) == (10, 10, 0, 9, 4.5)
    assert math.isclose(full.agg(F.stddev_pop("value")).first()[0], 2.872281323269, rel_tol=1e-9)


def test_tiff_files(spark, tmp_path):
    cells = table(spark, [[r * 7 + c if (r, c) != (2, 3) else None for c in range(7)] for r in range(5)]).withColumn("tile_id", F.when(F.col("c") < 4, 0).otherwise(1))
    images = tiff.to_tiff(cells, "x", (500000.0, 10.0, 0.0, 3900000.0, 0.0, -10.0))
    back = {(r.r, r.c): r.value for r in tiff.pixels_of(images, ["tile_id"]).collect()}
    assert back == {(r.r, r.c): r.x for r in cells.collect()}
    tiff.save_tiff_files(images, str(tmp_path / "t"))
    files = tiff.read_tiff(spark, str(tmp_path / "t"))
    assert files.count() == 35 and files.select("file").distinct().count() == 2
    _, place = tiff.decode((tmp_path / "t" / "tile_1.tif").read_bytes())
    assert place == (500040.0, 10.0, 0.0, 3900000.0, 0.0, -10.0)
    with pytest.raises(ValueError):
        tiff.decode(b"nothing of the kind")


def test_raster_window_and_csv(spark, tmp_path):
    cells = table(spark, [[r * 40 + c for c in range(40)] for r in range(30)])
    tables.write_raster(cells, str(tmp_path / "r"), tile=16)
    part = tables.read_raster(spark, str(tmp_path / "r"), (10, 5, 12, 20), tile=16)
    assert part.count() == 240 and part.agg(F.min("r"), F.max("c")).first() == (5, 21)
    tables.write_csv(cells.limit(3), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    with pytest.raises(ValueError):
        tables.write_csv(cells.limit(0), str(tmp_path / "c2"))


def test_labels_in_degrees_on_a_utm_grid(spark):
    target = table(spark, [[0] * 4] * 4).select("r", "c")
    utm = tables.Geotransform(500000.0, 1000.0, 4000000.0, -1000.0)
    source = tables.Geotransform(2.9, 0.01, 36.3, -0.01)
    labels = spark.range(100 * 100).select(F.expr("cast(id div 100 as int)").alias("r"), (F.col("id") % 100).cast("int").alias("c"), F.col("id").alias("wc"))
    got = tables.resample_nearest(target, utm, labels, source, "wc", zone=31)
    x, y = utm.centre(F.col("r"), F.col("c"))
    lon, lat = tables.utm_to_degrees(x, y, 31)
    for r in got.withColumns({"lon": lon, "lat": lat}).collect():
        assert r.wc == math.floor((36.3 - r.lat) / 0.01 + 1e-12) * 100 + math.floor((r.lon - 2.9) / 0.01 + 1e-12)


def test_paths_and_config(tmp_path, monkeypatch):
    images = tmp_path / "S.SAFE" / "GRANULE" / "L2A" / "IMG_DATA" / "R10m"
    images.mkdir(parents=True)
    (images / "T_20240615_B04_10m.jp2").write_bytes(b"")
    assert tables.band_file(str(tmp_path), "S.SAFE", "20240615", "B04").endswith("T_20240615_B04_10m.jp2")
    assert tables.band_file(str(tmp_path), "S.SAFE", "20240615", "B08").endswith("20240615_B08_10m.jp2")
    assert "???" in tables.band_file(str(tmp_path), "None.SAFE", "20240615", "B08")
    config = tables.PairConfig("p", {"b04": str(images / "T_20240615_B04_10m.jp2")}, {"b04": "/nowhere"})
    assert config.check_files() == (False, ["/nowhere"]) and config.scl_window == (2000, 2000, 1000, 1000) and "2000 x 2000" in config.summary()
    assert tables.data_root(str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.label_files(str(tmp_path))
    for name in ("a_label.tif", "b_label.tif"):
        (tmp_path / name).write_bytes(b"")
    assert len(tables.label_files(str(tmp_path))) == 2 and tables.label_files(str(tmp_path), ("b_label.tif", "none.tif")) == [str(tmp_path / "b_label.tif")]
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("RASTER_DATA_ROOT", raising=False)
    with pytest.raises(FileNotFoundError):
        tables.data_root("/nowhere")


SMALL = learning.ForestSettings(trees=5, depth=4, min_leaf=2)


@pytest.fixture(scope="module")
def field(spark):
    pair, shape = pair_of(spark, 30)
    pair = pair.cache()
    labels = pair.select("r", "c", F.when(indices_ndvi() > 0.45, 10).otherwise(60).alias("wc"))
    yield pair, shape, labels
    pair.unpersist()


def indices_ndvi():
    from pixelweave.functions.indices import ndvi

    return ndvi(F.col("b04_b"), F.col("b08_b"))


def test_supervised_forest_and_reports(spark, field, tmp_path):
    pair, shape, labels = field
    r = learning.random_forest(pair, shape, labels, 400, SMALL, cross_validate=False)
    assert r.accuracy > 0.6 and r.mode == "supervised" and r.pixels.count() == 900 and abs(sum(v for _, v in r.importances) - 1) < 1e-6
    whole, sure = learning.forest_report(r)
    assert whole.agg(F.sum("n")).first()[0] == 900 >= sure.agg(F.sum("n")).first()[0]
    learning.save_model(r.model, str(tmp_path / "m"))
    again = learning.classify(learning.load_model(str(tmp_path / "m")), learning.date_features(pair, "b"), "_b")
    assert again.join(r.pixels.select("r", "c", F.col("class_b").alias("k")), ["r", "c"]).filter("class_b != k").count() == 0
    with pytest.raises(ValueError):
        learning.random_forest(pair, shape, labels.withColumn("wc", F.lit(0)), 400, SMALL)


def test_binary_forest_smoothing_and_sweep(spark, field):
    from pixelweave.plans import consensus

    pair, shape, labels = field
    r = learning.binary_forest(pair, shape, labels, 400, SMALL, cross_validate=False, texture=True)
    assert r.mode == "supervised_binary" and dict(r.importances).keys() >= {"homogeneity", "contrast"}
    assert r.pixels.filter("changed and not (loss or gain)").count() == 0
    smooth = learning.smoothed(r, shape, 3)
    one = learning.majority_comparison(smooth.withColumn("ndvi", F.lit(True)), "ndvi").first()
    assert one.total_pixels == 900 and 0 <= one.change_pct_smoothed <= 100
    assert consensus.confidence_sweep(r.pixels.withColumn("ndvi", F.col("changed"))).filter("best").count() <= 1
    stand_in = learning.binary_forest(pair.withColumns({f"b08_{d}": F.col(f"b04_{d}") * (1 + (F.col("c") % 2) * 0.6) for d in "ba"}), shape, None, 400, SMALL, cross_validate=False)
    assert stand_in.mode == "ndvi_threshold_binary" and stand_in.accuracy > 0.8


def test_integrated_run(spark, field):
    from pixelweave.plans import integrated

    pair, shape, labels = field
    bd, nd, cv = (m(pair, shape) for m in (methods.band_differencing, methods.ndvi_differencing, methods.change_vectors))
    forest = learning.random_forest(pair, shape, labels, 300, SMALL, cross_validate=False)
    run = integrated.integrated(bd, nd, cv, forest)
    assert run.scored.count() == 900 and run.summary.first().valid_pixels == 900
    assert abs(run.severity.agg(F.sum("pct")).first()[0] - 100) < 0.01
    assert run.table.count() == 5 and run.transitions.count() == 16
    long = {r.metric: r.value for r in integrated.forest_statistics(forest).collect()}
    assert long["total_pixels"] == 900 and abs(long["rf_accuracy_pct"] - forest.accuracy * 100) < 0.01
    better = integrated.improvement_pipeline(pair, shape, nd, labels, SMALL, 300, texture=False, window=3, cross_validate=False)
    assert better.comparison.first().total_pixels == 900 and better.sweep.count() <= 9


def test_folds_clusters_and_ablation(spark, field):
    pair, shape, labels = field
    mean, deviation, scores = learning.spatial_cv(spark.createDataFrame([(float(k), k % 2 + 1, k % 3) for k in range(60)], "x double, label int, fold int").withColumn("x", F.col("x") % 2), ("x",), SMALL)
    assert len(scores) == 3 and mean == 1.0 and deviation == 0.0
    labelled = learning.cluster_labels(learning.date_features(pair, "b"), sample=500, starts=2)
    assert {r[0] for r in labelled.select("label").distinct().collect()} == {1, 2, 3, 4}
    few = {k: learning.EXPERIMENTS[k] for k in ("Baseline (all 10)", "Spectral bands only")}
    small_cv = learning.ForestSettings(trees=2, depth=2, min_leaf=2, blocks=(1, 2))
    ndvi = methods.ndvi_differencing(pair, shape).pixels
    rows = {r["name"]: r for r in learning.ablation(pair, shape, ndvi, labels, small_cv, few, 200).collect()}
    assert rows["Baseline (all 10)"].verdict == "BASELINE" and rows["Spectral bands only"].n_features == 4


def test_stream_of_scenes(spark, tmp_path):
    pair, shape = pair_of(spark, 12)
    source = str(tmp_path / "in")
    for k in (1, 2):
        pair.withColumn("scene_id", F.lit(k)).coalesce(1).write.mode("append").parquet(source)
    schema = pair.withColumn("scene_id", F.lit(1)).schema.simpleString()[7:-1].replace(":", " ")
    run = change_stream(spark, source, schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    want = methods.ndvi_differencing(pair, shape).summary.first()
    assert len(rows) == 2 and {r.changed_pixels for r in rows} == {want.changed_pixels}
    assert json.dumps([r.asDict() for r in rows], default=str)


def test_images_of_several_bands_name_their_projection(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.normal(size=(3, 4, 5)).astype("float32")
    data[1, 2, 3] = np.nan
    for epsg in (None, 32631):
        back, place, named = tiff.decode_bands(tiff.encode(data, (500000.0, 10.0, 0.0, 3900000.0, 0.0, -10.0), epsg))
        assert np.array_equal(back, data, equal_nan=True) and place == (500000.0, 10.0, 0.0, 3900000.0, 0.0, -10.0) and named == epsg
    rows = [(k % 2, k // 2, k % 2, float(k), None if k == 5 else k / 4) for k in range(8)]
    tiles = spark.createDataFrame(rows, "tile_id int, r int, c int, red double, nir double")
    images = tiff.to_tiff(tiles, ["red", "nir"], epsg=32631)
    got = {(r.tile_id, r.r, r.c, r.red, r.nir) for r in tiff.pixels_of(images, ["tile_id"], ["red", "nir"]).collect()}
    assert got == {tuple(r) for r in rows}


def test_exact_percentiles_of_ties_and_few_values(spark, monkeypatch):
    import random

    from pixelweave.operators import quantiles

    monkeypatch.setattr(quantiles, "RANGES", 8)
    monkeypatch.setattr(quantiles, "FEW", 5)
    rng = random.Random(2)
    for values in ([3.0], [1.0, 2.0], [5.0] * 40 + [1.0], [rng.gauss(0, 1) for _ in range(500)], [rng.choice([0.0, 1e-9, 1e9]) for _ in range(300)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        for q in (0.0, 0.5, 0.95, 1.0):
            assert math.isclose(quantiles.percentile(df, "v", q), df.agg(F.percentile("v", F.lit(q))).first()[0], rel_tol=1e-12, abs_tol=1e-15)
    assert quantiles.percentile(df.limit(0), "v", 0.5) is None


def test_hold_out_has_the_share_of_each_class(spark):
    samples = spark.range(230).select(F.col("id").alias("pixel_id"), F.when(F.col("id") < 30, 1).when(F.col("id") < 130, 2).otherwise(3).alias("label"), F.when(F.col("id") % 2 == 0, "before").otherwise("after").alias("date"))
    inside, outside = learning.holdout(samples)
    assert {r.label: r.n for r in outside.groupBy("label").agg(F.count("*").alias("n")).collect()} == {1: 6, 2: 20, 3: 20}
    assert inside.count() == 184 and inside.join(outside, ["pixel_id", "date"]).count() == 0


def test_grid_search_and_seasons(spark, field):
    pair, shape, labels = field
    tiny = learning.ForestSettings(trees=1, depth=2, blocks=(1, 2))
    rows = [(float(k % 2), k % 2 + 1, k % 2 * 0 + k // 30) for k in range(60)]
    samples = spark.createDataFrame(rows, "x double, label int, fold int")
    best = learning.grid_search(samples, ("x",), tiny, ("sqrt", "0.4"), (3,))
    assert (best.subset, best.min_leaf, best.trees) == ("sqrt", 3, 1)  # all are perfect, so the first
    seasons = learning.seasonal_comparison({"a": (pair, shape, labels), "b": (pair, shape, labels)}, tiny, 200)
    got = {r["pair"]: r for r in seasons.collect()}
    assert got["a"].rf_change_pct == got["b"].rf_change_pct and math.isclose(got["a"].rf_ndvi_ratio, got["a"].rf_change_pct / got["a"].ndvi_change_pct)
    shift = learning.importance_shift(seasons, "a", "b").collect()
    assert len(shift) == 10 and all(r.delta == 0 for r in shift) and [r.finding for r in shift if r.feature == "ndwi"] == ["INCONCLUSIVE"]
    assert {r["pair"]: r.n for r in learning.top_features(seasons).groupBy("pair").agg(F.count("*").alias("n")).collect()} == {"a": 5, "b": 5}


def test_stored_tables_can_be_cleared(spark):
    from pixelweave.operators import storage

    kept = storage.stored(spark.range(3))
    assert kept.count() == 3
    storage.clear(spark)
    storage.clear(spark)  # nothing is left to delete
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0])


@pytest.mark.parametrize("values", [[1.0, float("nan")] * 3 + [2.0, 5.0], [float("inf"), 1.0, 2.0, 3.0], [-float("inf"), 1.0, 2.0, 3.0, float("inf")], [float("inf")] * 3, [1e308, -1e308, 0.0, 3.0], [1e30, *range(200)], [float("nan")]])
def test_percentiles_and_thresholds_with_odd_values(spark, values):
    """NaN is a masked pixel, infinite values have their ranks; none of them moves a threshold."""
    from pixelweave.operators import otsu, quantiles

    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    real = df.filter(~F.isnan("v"))
    for q in (0.0, 0.3, 0.5, 0.95, 1.0):
        want = real.agg(F.percentile("v", F.lit(q))).first()[0]
        got = quantiles.percentile(df, "v", q)
        assert got == want or math.isclose(got, want, rel_tol=1e-9) or (math.isnan(got) and math.isnan(want))
    finite = real.filter(F.abs("v") < float("inf"))
    assert otsu.otsu(df, "v").first() == otsu.otsu(finite, "v").first()


def test_a_percentile_without_nan(spark):
    from pixelweave.operators import otsu, quantiles

    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v")).union(spark.createDataFrame([(float("nan"),)], "v double"))
    assert math.isclose(quantiles.percentile(df, "v", 0.95), 950.05)
    assert otsu.otsu(df, "v").first().threshold == otsu.otsu(df.filter("not isnan(v)"), "v").first().threshold > 400
