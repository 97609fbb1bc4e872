import math
import random

import pytest
from pyspark.sql import functions as F

from pixelweave.functions import change, classes, display, indices
from pixelweave.operators import crosstab, focal, grid, sampling, tiling
from pixelweave.operators.otsu import histogram, otsu
from pixelweave.plans import consensus, methods, reporting
from pixelweave.sources.tables import degrees_to_utm, utm_to_degrees


def table(spark, values):
    return spark.createDataFrame([(r, c, None if x is None else float(x)) for r, row in enumerate(values) for c, x in enumerate(row)], "r int, c int, x double")


def square(df, name="x"):
    rows = sorted((r.r, r.c, r[name]) for r in df.collect())
    out = {}
    for r, c, x in rows:
        out.setdefault(r, []).append(x)
    return [out[r] for r in sorted(out)]


def mirror(i, n):
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


@pytest.mark.parametrize("height,width,tile", [(3, 5, 256), (9, 11, 4), (1, 1, 256), (12, 2, 5)])
def test_gaussian_with_mirrored_borders(spark, height, width, tile):
    rng = random.Random(height)
    x = [[rng.choice([None, rng.random() * 10]) if rng.random() < 0.2 else rng.random() * 10 for _ in range(width)] for _ in range(height)]
    taps = focal.gaussian_taps()
    weight = lambda k: taps[abs(k)]
    got = square(focal.gaussian(table(spark, x), grid.Shape(height, width), "x", tile=tile))
    for r in range(height):
        for c in range(width):
            if x[r][c] is None:
                assert got[r][c] is None
                continue
            want = sum(weight(i) * weight(j) * (x[mirror(r + i, height)][mirror(c + j, width)] or 0) for i in range(-4, 5) for j in range(-4, 5))
            assert math.isclose(got[r][c], want, rel_tol=1e-9)
    assert math.isclose(taps[0] + 2 * sum(taps[1:]), 1)


def test_texture_and_majority_by_hand(spark):
    rng = random.Random(3)
    x = [[rng.randrange(0, 4) for _ in range(7)] for _ in range(6)]
    cells, shape = table(spark, x), grid.Shape(6, 7)
    texture = {(t.r, t.c): t for t in focal.box_texture(cells, shape, "x", tile=4).collect()}
    voted = square(focal.majority(cells.withColumn("k", F.col("x").cast("int")), shape, ["k"], [1, 2, 3], F.col("r") != 5, 3, tile=4), "k")
    for r in range(6):
        for c in range(7):
            near = [x[mirror(r + i, 6)][mirror(c + j, 7)] for i in range(-2, 3) for j in range(-2, 3)]
            mean = sum(near) / 25
            assert math.isclose(texture[r, c].homogeneity, 1 / (1 + max(sum(v * v for v in near) / 25 - mean * mean, 0)), rel_tol=1e-9)
            assert texture[r, c].contrast == max(near) - min(near)
            clamp = [x[min(max(r + i, 0), 5)][min(max(c + j, 0), 6)] for i in (-1, 0, 1) for j in (-1, 0, 1)]
            votes = {k: clamp.count(k) for k in (1, 2, 3)}
            best = min((k for k in votes if votes[k] == max(votes.values())), default=0) if max(votes.values()) else 0
            assert voted[r][c] == (best if r != 5 else 0)


def plain_otsu(values):
    x = [v for v in values if v is not None and v > 0]
    low, high = min(x), max(x)
    if low == high:
        return 0.0
    h = [0] * 256
    for v in x:
        h[min(int((v - low) / (high - low) * 256), 255)] += 1
    centre = [low + (k + 0.5) * (high - low) / 256 for k in range(256)]
    n, total = sum(h), sum(a * b for a, b in zip(h, centre))
    wb = sb = 0.0
    best, at = 0.0, 0.0
    for k in range(256):
        wb += h[k]
        sb += h[k] * centre[k]
        if wb == 0:
            continue
        if n - wb == 0:
            break
        spread = wb * (n - wb) * (sb / wb - (total - sb) / (n - wb)) ** 2
        if spread > best:
            best, at = spread, centre[k]
    return at


def test_threshold_by_groups_and_edge_cases(spark):
    rng = random.Random(9)
    groups = {1: [rng.gauss(2, 0.3) for _ in range(200)] + [rng.gauss(6, 0.5) for _ in range(90)], 2: [5.0] * 30, 3: [0.0, -1.0, None], 4: [1.0, 2.0, None, -3.0]}
    df = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x], "g int, x double")
    got = {r.g: r.threshold for r in otsu(df, "x", ("g",)).collect()}
    assert set(got) == {1, 2, 4}
    assert math.isclose(got[1], plain_otsu(groups[1]), rel_tol=1e-9) and got[2] == 0.0 and math.isclose(got[4], plain_otsu(groups[4]))
    assert otsu(df.filter("g = 3"), "x").collect()[0].threshold is None
    assert sum(r.n for r in histogram(df.filter("g = 1"), "x").collect()) == sum(v > 0 for v in groups[1])


def pair_of(spark, n=40, seed=42, gaps=0.0):
    rng = random.Random(seed)
    rows = []
    for r in range(n):
        for c in range(n):
            if rng.random() < gaps:
                rows.append((r, c, *([None] * 8)))
            else:
                rows.append((r, c, *(x for _ in range(2) for x in (rng.uniform(300, 1300), rng.uniform(400, 1600), rng.uniform(500, 2000), rng.uniform(2000, 4000)))))
    names = ", ".join(f"{b}_{d} double" for d in "ba" for b in indices.BANDS)
    return spark.createDataFrame(rows, f"r int, c int, {names}"), grid.Shape(n, n)


def test_masked_pixels_are_never_change(spark):
    pair, shape = pair_of(spark, 30, 99, 0.2)
    for method in (methods.ndvi_differencing, methods.band_differencing, methods.change_vectors):
        result = method(pair, shape)
        s = result.summary.first()
        assert 0 <= s.change_pct <= 100 and s.total_pixels == 900 and s.valid_pixels == pair.filter("b04_b is not null").count()
        assert result.pixels.join(pair.filter("b04_b is null"), ["r", "c"]).filter("changed").count() == 0


def test_fixed_threshold_without_smoothing(spark):
    pair = spark.createDataFrame([(0, 0, 100.0, 150.0), (0, 1, 100.0, 100.0), (1, 0, 100.0, 40.0)], "r int, c int, b04_b double, b04_a double")
    result = methods.band_differencing(pair, grid.Shape(2, 2), threshold=50, smooth=False)
    assert {(r.r, r.c): r.changed for r in result.pixels.collect()} == {(0, 0): False, (0, 1): False, (1, 0): True, (1, 1): False}
    s = result.summary.first()
    assert (s.valid_pixels, s.changed_pixels, s.total_pixels) == (3, 1, 4) and math.isclose(s.change_pct, 100 / 3)


def test_all_masked(spark):
    pair = spark.createDataFrame([(0, 0, None, None)], "r int, c int, b04_b double, b04_a double")
    s = methods.band_differencing(pair, grid.Shape(2, 3)).summary.first()
    assert (s.change_pct, s.valid_pixels, s.changed_pixels) == (0.0, 0, 0)


def test_direction_quadrants_and_vectors(spark):
    rows = [(1.0, 0.0, 0.0), (0.0, 1.0, 90.0), (-1.0, 0.0, 180.0), (0.0, -1.0, 270.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "red double, nir double, want double")
    got = df.select("want", change.direction(F.col("red"), F.col("nir")).alias("d")).collect()
    assert all(math.isclose(r.d, r.want) for r in got)
    kinds = df.select(change.direction_class(F.col("want"), F.lit(2.0), F.lit(1.0)).alias("k")).collect()
    assert [r.k for r in kinds] == [3, 2, 1, 4, 3]
    assert spark.range(1).select(change.direction_class(F.lit(None).cast("double"), F.lit(2.0), F.lit(1.0)).alias("k")).first().k == 0
    size = spark.createDataFrame([(3.0, 4.0), (None, 4.0), (None, None)], "a double, b double").select(change.magnitude([F.col("a"), F.col("b")]).alias("m")).collect()
    assert [r.m for r in size] == [5.0, 4.0, None]


def test_severity_borders(spark):
    rows = [(-0.21, 0.5, 0.3, True, False, 1), (-0.20, 0.5, 0.3, True, False, 2), (-0.10, 0.5, 0.4, True, False, 3), (0.3, 0.1, 0.4, False, True, 4), (0.0, 0.22, 0.18, False, False, 5), (0.0, 0.22, 0.17, False, False, 0), (0.0, 0.11, 0.1, False, False, 6), (0.0, 0.12, 0.1, False, False, 7), (None, 0.2, 0.2, False, False, 0), (-0.3, 0.5, 0.2, True, None, 1)]
    df = spark.createDataFrame(rows, "delta double, b double, a double, loss boolean, gain boolean, want int")
    got = df.select("want", change.severity(F.col("delta"), F.col("b"), F.col("a"), F.col("loss"), F.col("gain"), F.lit(True)).alias("s")).collect()
    assert all(r.s == r.want for r in got)


def test_zero_denominators_and_recodes(spark):
    one = spark.range(1).select(indices.ndvi(F.lit(0.0), F.lit(0.0)).alias("n"), indices.evi(F.lit(0.0), F.lit(0.0), F.lit(-1.0)).alias("e"), classes.recode(F.lit(95), classes.CODE_TO_CLASS).alias("k"), classes.recode(F.lit(7), classes.CODE_TO_BINARY).alias("z"))
    r = one.first()
    assert (r.n, r.e, r.k, r.z) == (None, None, 3, 0)


def test_transitions_and_credible(spark):
    df = spark.createDataFrame([(1, 1)] * 6 + [(1, 2)] * 4 + [(2, 1)] * 5 + [(2, 2)] * 5 + [(0, 1), (1, 9)], "b int, a int")
    m = crosstab.transitions(df, "b", "a", 3)
    got = {(r.class_before, r.class_after): (r.n, r.row_pct) for r in m.collect()}
    assert len(got) == 9 and got[1, 2] == (4, 40.0) and got[3, 3] == (0, 0.0)
    totals = spark.createDataFrame([(40.0, 80.0)], "n double, f double")
    credible = {(r.class_before, r.class_after): r for r in consensus.credible_transitions(m, F.col("n"), F.col("f"), totals).collect()}
    assert credible[1, 2].scaled_pct == 20 and credible[1, 1].scaled_pct == 80
    assert credible[2, 1].suspect and credible[2, 1].credible_pct == 0 and credible[2, 2].credible_pct == 100
    assert credible[3, 3].scaled_pct == 100


def test_consensus_boundaries_and_weights(spark):
    rows = [(0, 0, 0.2, True, True, True, True, True), (0, 1, 0.2, True, True, False, False, False), (0, 2, 0.2, True, False, True, False, True), (0, 3, None, True, True, True, True, True), (0, 4, 0.1, False, True, True, True, True)]
    df = spark.createDataFrame(rows, "r int, c int, delta double, valid boolean, ndvi boolean, rf boolean, cva boolean, bd boolean")
    got = {r.c: r for r in consensus.consensus(df).collect()}
    assert [got[c].consensus_class for c in range(5)] == [2, 1, 1, 0, 0] and [got[c].agreement for c in range(5)] == [4, 1, 2, 0, 0]
    assert math.isclose(sum(consensus.Weights().shares(False).values()), 1) and consensus.Weights().shares(False)["rf"] < 0.2
    s = consensus.consensus_summary(consensus.consensus(df)).first()
    assert s.valid_pixels == 3 and math.isclose(s.change_pct_any, 100) and math.isclose(s.jaccard_ndvi_rf, 1 / 3)


def test_tile_grid_takes_the_remainder(spark):
    tiles = {r.tile_id: r for r in tiling.tile_grid(spark, 10, 7, 3, 2, 1).collect()}
    assert len(tiles) == 6 and sum(t.x_size_inner * t.y_size_inner for t in tiles.values()) == 70
    last = tiles[5]
    assert (last.x_size_inner, last.y_size_inner, last.x_off, last.y_off, last.x_size, last.y_size) == (4, 4, 5, 2, 5, 5)
    cells = table(spark, [[r * 10 + c for c in range(10)] for r in range(7)])
    placed = tiling.in_tiles(cells, 10, 7, 3, 2, 1)
    for t in tiles.values():
        assert placed.filter(F.col("tile_id") == t.tile_id).count() == t.x_size * t.y_size
    assert placed.filter("inner").count() == 70
    assert tiling.stitch(placed.filter("tile_id != 5"), cells, "x", -1.0).filter("x = -1").count() == 16


def test_pair_sample_is_disjoint(spark):
    df = spark.range(1000).select(F.col("id").alias("pixel_id"), (F.col("id") % 3 + 1).cast("int").alias("label"))
    s = sampling.stratified_pair(df, "label", [1, 2, 3], 50)
    assert s.count() == 300 and s.select("pixel_id").distinct().count() == 300
    assert {(r.label, r.date): r.n for r in s.groupBy("label", "date").agg(F.count("*").alias("n")).collect()} == {(k, d): 50 for k in (1, 2, 3) for d in ("before", "after")}
    few = sampling.balanced_binary(df.filter("label = 1 or pixel_id < 30"), "label", 200)
    assert {r.label: r.n for r in few.groupBy("label").agg(F.count("*").alias("n")).collect()} == {1: 10, 2: 10}


def test_blocks_of_small_images(spark):
    cells = table(spark, [[0] * 3] * 2)
    got = {(r.r, r.c): r.b for r in cells.select("r", "c", sampling.spatial_block(grid.Shape(2, 3)).alias("b")).collect()}
    assert got == {(r, c): r * 4 + c for r in range(2) for c in range(3)}


def test_long_statistics_of_a_type_sum(spark):
    pair, shape = pair_of(spark, 20)
    result = methods.change_vectors(pair, shape)
    long = {r.metric: r.value for r in reporting.long_statistics(result).collect()}
    assert math.isclose(sum(v for k, v in long.items() if k.startswith("cva_") and k.endswith("_px")), long["changed_pixels"])
    wide = reporting.compare([result]).first()
    assert wide.change_pct == long["change_pct"]


def test_utm_round_trip_and_known_places(spark):
    df = spark.createDataFrame([(3.0, 0.0), (5.99, 35.6), (0.5, 48.0), (3.2, -20.0), (3.0, 83.9)], "lon double, lat double")
    for north in (True, False):
        x, y = degrees_to_utm(F.col("lon"), F.col("lat"), 31, north)
        lon, lat = utm_to_degrees(F.col("x"), F.col("y"), 31, north)
        for r in df.select("*", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
            assert abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8
            if r.lon == 3.0 and r.lat == 0.0:
                assert math.isclose(r.x, 500_000) and math.isclose(r.y, 0 if north else 10_000_000, abs_tol=1e-6)
    x, y = degrees_to_utm(F.lit(2.294497), F.lit(48.858222), 31)  # a tower in Paris
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 448_252) < 3 and abs(r.y - 5_411_943) < 12


def test_numbers_are_shown_as_printf_shows_them(spark):
    values = [k / 10000 for k in range(0, 60000, 25)] + [-0.0, -0.001, -0.005, -2.5, 1e15, math.nan, math.inf, -math.inf]
    df = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
    x = F.col("x")
    rows = df.select("x", display.fixed(x, 0).alias("n"), display.fixed(x, 4).alias("f"), display.percent(x).alias("p"), display.signed(x, 2).alias("s")).collect()
    for r in rows:
        assert (r.n, r.f, r.p, r.s) == ((None,) * 4 if r.x is None else ("%.0f" % r.x, "%.4f" % r.x, "%.2f%%" % r.x, "%+.2f" % r.x))


def test_summary_table_rounds_as_its_sql(spark):
    rows = [("Band Differencing", 0.625, 2.125), ("NDVI Differencing", 39.015, 0.10065), ("CVA", 1.125, 583.725), ("Random Forest", 0.015, None)]
    table = reporting.summary_table(spark.createDataFrame(rows, "method string, change_pct double, threshold double"))
    assert [tuple(r) for r in table.collect()] == [
        ("Band Differencing", "0.62%", "2 km²", "2.12"),
        ("NDVI Differencing", "%.2f%%" % 39.015, "156 km²", "±%.4f" % 0.10065),
        ("CVA", "1.12%", "4 km²", "%.2f" % 583.725),
        ("Random Forest", "0.01%", "0 km²", "N/A"),
    ]
