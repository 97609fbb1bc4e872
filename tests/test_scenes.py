"""Many scenes in one plan."""

import math

from pyspark.sql import functions as F

from pixelweave.operators import grid
from pixelweave.plans import methods

from .test_operators import pair_of


def batch(spark, sizes):
    """Pairs of different extents and seeds, one of them named null."""
    parts = []
    for k, n in enumerate(sizes):
        pair, _ = pair_of(spark, n, seed=k, gaps=0.1)
        parts.append(pair.withColumn("scene_id", F.lit(None if k == 1 else f"a/{k}").cast("string")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_each_scene_as_by_itself(spark):
    sizes = (12, 3, 30)
    results = methods.methods_by_scene(batch(spark, sizes))
    for k, n in enumerate(sizes):
        pair, _ = pair_of(spark, n, seed=k, gaps=0.1)
        shape = grid.shape_of(pair)
        for own, many in zip(methods.all_methods(pair, shape), results):
            name = F.lit(None if k == 1 else f"a/{k}").cast("string")
            want, got = own.summary.first(), many.summary.filter(F.col("scene_id").eqNullSafe(name)).first()
            assert own.method == many.method and (want.total_pixels, want.valid_pixels, want.changed_pixels) == (got.total_pixels, got.valid_pixels, got.changed_pixels)
            assert math.isclose(want.threshold, got.threshold, rel_tol=1e-12)
            pixels = many.pixels.filter(F.col("scene_id").eqNullSafe(name)).select("r", "c", "changed")
            assert sorted(map(tuple, pixels.collect())) == sorted(map(tuple, own.pixels.select("r", "c", "changed").collect()))


def test_jobs_do_not_grow_with_scenes(spark):
    def jobs(n):
        cells = spark.range(n * 30).select((F.col("id") % n).alias("scene_id"), F.expr("cast(id div " + str(n) + " div 6 as int)").alias("r"), (F.expr(f"id div {n}") % 6).cast("int").alias("c"), *((F.rand(k) * 1000 + 1).alias(f"{b}_{d}") for k, (b, d) in enumerate((b, d) for b in ("b02", "b03", "b04", "b08") for d in "ba")))
        spark.sparkContext.setJobGroup(f"scenes{n}", "count")
        rows = methods.methods_by_scene(cells)[1].summary.collect()
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"scenes{n}"))
        spark.sparkContext.setJobGroup("others", "none")
        assert len(rows) == n and all(r.total_pixels == 30 for r in rows)
        return found

    assert abs(jobs(400) - jobs(3)) <= 3


def test_nothing_to_do(spark):
    pair, _ = pair_of(spark, 4)
    none = pair.limit(0).withColumn("scene_id", F.lit("x"))
    assert all(m.summary.count() == 0 and m.pixels.count() == 0 for m in methods.methods_by_scene(none))
