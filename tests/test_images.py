"""TIFF images as a data source and sink."""

import math
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from pixelweave.sources import images, tiff

PLACE = (500000.0, 10.0, 0.0, 3900000.0, 0.0, -10.0)


def tiled_image(data, tile, order="<", big=False, deflate=False, predictor=False, nodata=None):
    """An image of tiles whose bands share their pixels, written plainly by the format's description."""
    h, w, bands = data.shape
    parts = []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            cell = np.zeros((tile, tile, bands), dtype=data.dtype)
            own = data[y : y + tile, x : x + tile]
            cell[: own.shape[0], : own.shape[1]] = own
            if predictor:
                cell[:, 1:] = cell[:, 1:] - cell[:, :-1]
            raw = cell.astype(data.dtype.newbyteorder(order)).tobytes()
            parts.append(zlib.compress(raw) if deflate else raw)
    form = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    at = 16 if big else 8
    offsets = [at + sum(map(len, parts[:k])) for k in range(len(parts))]
    body = b"".join(parts)
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [data.dtype.itemsize * 8] * bands), (259, 3, [8 if deflate else 1]), (277, 3, [bands]), (284, 3, [1]), (317, 3, [2 if predictor else 1]), (322, 3, [tile]), (323, 3, [tile]), (324, 16 if big else 4, offsets), (325, 4, [len(p) for p in parts]), (339, 3, [form] * bands), (33550, 12, [10.0, 10.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 500000.0, 3900000.0, 0.0])]
    if nodata is not None:
        tags.append((42113, 2, str(nodata).encode() + b"\0"))
    codes = {2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8), 16: ("Q", 8)}
    start = at + len(body)
    step, inline = (20, 8) if big else (12, 4)
    after = start + (8 if big else 2) + step * len(tags) + (8 if big else 4)
    entries, extra = b"", b""
    for tag, kind, v in tags:
        raw = v if kind == 2 else struct.pack(f"{order}{len(v)}{codes[kind][0]}", *v)
        entries += struct.pack(f"{order}HH{'Q' if big else 'I'}", tag, kind, len(v))
        if len(raw) > inline:
            entries += struct.pack(f"{order}{'Q' if big else 'I'}", after + len(extra))
            extra += raw
        else:
            entries += raw.ljust(inline, b"\0")
    head = {"<": b"II", ">": b"MM"}[order] + (struct.pack(f"{order}HHHQ", 43, 8, 0, start) if big else struct.pack(f"{order}HI", 42, start))
    return head + body + struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + entries + struct.pack(f"{order}{'Q' if big else 'I'}", 0) + extra


def grid(pixels, bands, h, w):
    out = np.full((len(bands), h, w), np.nan)
    for row in pixels.collect():
        for k, b in enumerate(bands):
            out[k, row.r, row.c] = np.nan if row[b] is None else row[b]
    return out


@pytest.mark.parametrize("order, big, deflate, predictor, kind", [("<", False, False, False, "float32"), (">", False, True, False, "float64"), ("<", True, True, True, "uint16"), (">", True, False, True, "int32"), ("<", False, False, False, "uint8")])
def test_layouts_of_the_format(spark, tmp_path, order, big, deflate, predictor, kind):
    data = np.random.default_rng(3).integers(0, 200, (37, 53, 2)).astype(kind)
    (tmp_path / "a.tif").write_bytes(tiled_image(data, 16, order, big, deflate, predictor, nodata=7))
    want = np.where(data == 7, np.nan, data.astype("float64")).transpose(2, 0, 1)
    got = images.read_images(spark, str(tmp_path / "a.tif"), {"one": 1, "two": 2}, split=600)
    assert np.array_equal(grid(got, ["one", "two"], 37, 53), want, equal_nan=True)
    assert got.count() == 37 * 53 and got.rdd.getNumPartitions() > 1
    part = images.read_images(spark, str(tmp_path / "a.tif"), {"two": 2}, window=(20, 10, 9, 14))
    assert {(r.r, r.c, r.two) for r in part.collect()} == {(y, x, None if np.isnan(want[1, y, x]) else want[1, y, x]) for y in range(10, 24) for x in range(20, 29)}
    back, place, _ = tiff.decode_bands((tmp_path / "a.tif").read_bytes())
    assert np.array_equal(back, want, equal_nan=True) and place == PLACE


def test_a_window_reads_the_strips_it_needs(spark, tmp_path, monkeypatch):
    data = np.random.default_rng(1).normal(size=(3, 100, 40))
    path = str(tmp_path / "s.tif")
    with open(path, "wb") as f:
        f.write(tiff.encode(data, PLACE, strip=8))
    whole = images.ImageReader(path, {"x": 1}, None, 1)
    assert whole.bytes_wanted() == 100 * 40 * 4
    asked = images.ImageReader(path, {"x": 1}, None, 1)
    others = [EqualTo(("value",), 1.0)]
    left = list(asked.pushFilters([GreaterThanOrEqual(("r",), 17), LessThan(("r",), 33), In(("c",), (3, 5, None)), *others]))
    assert left == others
    assert asked.bytes_wanted() == 3 * 8 * 40 * 4 and [b.r0 for p in asked.partitions() for b in p.blocks] == [16, 24, 32]
    read, plain = [], images._ranges
    monkeypatch.setattr(images, "_ranges", lambda stream: lambda at, n: (read.append(n), plain(stream)(at, n))[1])
    rows = [(r, c) for p in asked.partitions() for batch in asked.read(p) for r, c in zip(batch["r"].to_pylist(), batch["c"].to_pylist())]
    assert rows == [(r, c) for r in range(17, 33) for c in (3, 5)]
    assert sum(n for n in read if n == 8 * 40 * 4) == asked.bytes_wanted()
    none = images.ImageReader(path, {"x": 0}, None, 1)
    list(none.pushFilters([GreaterThanOrEqual(("r",), 100)]))
    assert none.partitions() == []
    pushed = images.read_images(spark, path, {"x": 2}, window=(0, 90, 40, 5))
    assert pushed.rdd.getNumPartitions() == 1 and pushed.filter("r > 500").count() == 0
    assert pushed.filter("x > 0 or r = 91").count() == sum(1 for r in range(90, 95) for c in range(40) if np.float32(data[1, r, c]) > 0 or r == 91)


def test_a_folder_of_tiles_is_one_raster(spark, tmp_path):
    rows = [(k // 60, k % 60, float(k) if k % 17 else None, float(-k)) for k in range(50 * 60)]
    cells = spark.createDataFrame(rows, "r int, c int, red double, nir double").withColumn("tile_id", F.expr("cast((r div 20) * 3 + c div 20 as int)"))
    made = tiff.to_tiff(cells, ["red", "nir"], PLACE, 32631, strip=4, deflate=True)
    folder = str(tmp_path / "out")
    images.write_images(made, folder)
    assert sorted(os.listdir(folder)) == sorted(f"tile_{k}.tif" for k in range(9))
    back = images.read_images(spark, folder, {"red": 1, "nir": 2}, origin=(500000.0, 3900000.0))
    assert sorted(map(tuple, back.select("r", "c", "red", "nir").collect())) == rows
    part = images.read_images(spark, folder, {"red": 1}, window=(22, 21, 3, 2), origin=(500000.0, 3900000.0))
    assert {r.file.rsplit("/", 1)[1] for r in part.select("file").distinct().collect()} == {"tile_4.tif"} and part.count() == 6
    # what else the folder holds goes with a job that is done
    images.write_images(made.filter("tile_id < 2"), folder)
    assert sorted(os.listdir(folder)) == ["tile_0.tif", "tile_1.tif"]
    images.write_images(made.filter("tile_id = 5"), folder, overwrite=False)
    assert len(os.listdir(folder)) == 3


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    ok = spark.createDataFrame([(1, b"one")], "tile_id int, content binary")
    images.write_images(ok, folder)
    bad = spark.range(6).repartition(3).select(F.col("id").cast("int").alias("tile_id"), F.when(F.col("id") == 4, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.encode(F.lit("x"), "utf-8")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        images.write_images(bad, folder)
    assert os.listdir(folder) == ["tile_1.tif"] and (tmp_path / "out" / "tile_1.tif").read_bytes() == b"one"
    with pytest.raises(Exception, match="same name"):
        images.write_images(ok.unionByName(ok), folder)
    assert os.listdir(folder) == ["tile_1.tif"]
    images.write_images(ok.limit(0), folder)
    assert os.listdir(folder) == [] and images.read_images(spark, folder).count() == 0


def test_what_is_no_image(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"II*\0nothing of the kind")
    with pytest.raises(Exception):
        images.read_images(spark, str(tmp_path / "x.tif")).count()
    with pytest.raises(ValueError, match="TIFF"):
        tiff.decode(b"nothing of the kind")
    with pytest.raises(Exception, match="nowhere"):
        images.read_images(spark, str(tmp_path / "nowhere")).count()
    assert math.isnan(tiff.decode_bands(tiff.encode(np.array([[np.nan, 1.0]])))[0][0, 0, 0])
