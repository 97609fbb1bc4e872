"""Resumable runs, rectangles of any size, dates that arrive apart."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pixelweave.operators import tiling
from pixelweave.plans import tiled_run
from pixelweave.streaming.pairs import pair_dates

SCHEMA = "r int, c int, x double, tile_id int"


def counted(folder, stop_at=None):
    """A function that notes the tiles it does, and fails at one of them."""

    def run(frame):
        tile = int(frame.tile_id.iloc[0])
        if tile == stop_at:
            raise RuntimeError("killed half-way")
        with open(os.path.join(folder, f"{tile}"), "a") as f:
            f.write("x")
        smooth = frame.assign(x=frame.x.rolling(3, min_periods=1).mean() + tile)
        return smooth[["r", "c", "x", "tile_id"]]

    return run


def test_a_stopped_run_goes_on(spark, tmp_path):
    cells = spark.range(40 * 30).select(F.expr("cast(id div 30 as int)").alias("r"), (F.col("id") % 30).cast("int").alias("c"), (F.col("id") % 7).cast("double").alias("x")).repartition(1).sortWithinPartitions("r", "c")
    for name in ("whole", "parts", "ran"):
        (tmp_path / name).mkdir()
    args = (cells, 30, 40, 3, 4, 2)
    whole = tiled_run.tiled_run(*args, counted(str(tmp_path / "whole")), SCHEMA, str(tmp_path / "a"), tiles_at_once=5)
    target = str(tmp_path / "b")
    with pytest.raises(Exception, match="half-way"):
        tiled_run.tiled_run(*args, counted(str(tmp_path / "parts"), stop_at=7), SCHEMA, target, tiles_at_once=4)
    done = {r.tile_id for r in tiled_run.finished(spark, target).collect()}
    assert done == {0, 1, 2, 3}
    assert {r.tile_id for r in tiled_run.run_result(spark, target, SCHEMA).select("tile_id").distinct().collect()} == done
    again = tiled_run.tiled_run(*args, counted(str(tmp_path / "ran")), SCHEMA, target, tiles_at_once=4)
    assert {int(f) for f in os.listdir(tmp_path / "ran")} == set(range(4, 12))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 1200
    # nothing is left to do, and another layout is refused
    (tmp_path / "none").mkdir()
    tiled_run.tiled_run(*args, counted(str(tmp_path / "none")), SCHEMA, target)
    assert os.listdir(tmp_path / "none") == []
    with pytest.raises(ValueError, match="layout"):
        tiled_run.tiled_run(cells, 30, 40, 2, 2, 2, counted(str(tmp_path / "none")), SCHEMA, target)
    # pixels that were written without a row of the ledger do not count
    spark.createDataFrame([(0, 0, 99.0, 0, "lost")], f"{SCHEMA}, run string").write.mode("append").parquet(f"{target}/pixels")
    assert tiled_run.run_result(spark, target, SCHEMA).count() == 1200
    empty = tiled_run.tiled_run(cells.limit(0), 30, 40, 3, 4, 2, counted(str(tmp_path / "none")), SCHEMA, str(tmp_path / "c"))
    assert empty.count() == 0 and tiled_run.finished(spark, str(tmp_path / "c")).count() == 12


def test_rectangles_of_any_size(spark):
    rng = random.Random(3)
    shapes = [(k, rng.randrange(-5, 40), rng.randrange(-5, 40), rng.choice([0, 1, 3, 17, 60]), rng.choice([1, 2, 30, 80])) for k in range(60)] + [(60, None, 1, 2, 2), (61, 0, 0, 500, 500)]
    pixels = spark.range(900).select(F.expr("cast(id div 30 as int)").alias("r"), (F.col("id") % 30).cast("int").alias("c"))
    rects = spark.createDataFrame(shapes, "k int, r0 int, c0 int, height int, width int")
    want = sorted((k, r, c) for k, r0, c0, h, w in shapes if r0 is not None for r in range(30) for c in range(30) if r0 <= r < r0 + h and c0 <= c < c0 + w)
    for side in (1, 7, 64):
        found = tiling.in_footprints(pixels, rects, side)
        assert sorted(map(tuple, found.select("k", "r", "c").collect())) == want
    plan = tiling.in_footprints(pixels, rects)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_equal_rectangles_are_looked_up_once(spark, monkeypatch):
    rng = random.Random(5)
    kinds = [(rng.randrange(-5, 40), rng.randrange(-5, 40), rng.choice([0, 3, 17]), rng.choice([1, 2, 30])) for _ in range(12)] + [(None, 1, 2, 2)]
    shapes = [(rng.randrange(150), *rng.choice(kinds)) for _ in range(400)]
    x = {(r, c): None if (r + c) % 11 == 0 else float((r * 37 + c * 13) % 101) for r in range(30) for c in range(30) if (r, c) != (4, 4)}
    pixels = spark.createDataFrame([(*at, v) for at, v in x.items()], "r int, c int, v double")
    rects = spark.createDataFrame(shapes, "k int, r0 int, c0 int, height int, width int")
    want = {}
    for k, r0, c0, h, w in shapes:
        if r0 is not None:
            want.setdefault(k, []).extend(v for (r, c), v in x.items() if r0 <= r < r0 + h and c0 <= c < c0 + w)
    want = {k: (len(vs), min((v for v in vs if v is not None), default=None), max((v for v in vs if v is not None), default=None)) for k, vs in want.items() if vs}
    looked_up, plain = [], tiling.in_footprints
    monkeypatch.setattr(tiling, "in_footprints", lambda p, f, side: looked_up.append(f.count()) or plain(p, f, side))
    got = {r.k: (r.n, r.low, r.high) for r in tiling.footprint_statistics(pixels, rects, "k", "v", 7).collect()}
    assert got == want and looked_up[0] <= len(kinds)


def test_dates_that_arrive_apart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    begin = datetime(2024, 1, 1)
    schema = "scene string, tile string, side string, content binary, arrived timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def arrive(*rows):
        spark.createDataFrame([(s, t, side, text.encode(), begin + timedelta(minutes=m)) for s, t, side, text, m in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = pair_dates(spark.readStream.schema(schema).parquet(source), wait_seconds=3600, late="10 minutes")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(240)
        return sorted(((r.scene, r.tile, r.state, bytes(r.before or b"-").decode(), bytes(r.after or b"-").decode()) for r in spark.read.parquet(out).collect()), key=str)

    first = arrive(("s", "1", "before", "b1", 0), ("s", "2", "after", "a2", 1), ("s", "2", "before", "b2", 2), ("s", "3", "before", "b3", 3), ("s", "3", "before", "b3 again", 4), ("s", "4", "cloud", "x", 4))
    assert first == [("s", "2", "paired", "b2", "a2")]
    # started again: tile 1 was waiting, 2 comes twice, 3 still waits
    second = arrive(("s", "1", "after", "a1", 30), ("s", "2", "after", "a2 again", 31), ("t", "1", "after", "other scene", 32))
    assert second == sorted([*first, ("s", "1", "paired", "b1", "a1")])
    # the watermark passes tile 3's time and an hour; what is later than it is dropped
    arrive(("u", "9", "before", "b9", 200))
    third = arrive(("s", "3", "after", "too late", 5), ("u", "8", "before", "b8", 201))
    assert third == sorted([*second, ("s", "3", "no after", "b3", "-"), ("t", "1", "no before", "-", "other scene")])
