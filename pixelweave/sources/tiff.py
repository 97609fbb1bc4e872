"""Float32 TIFF images of tiles as binary columns."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import images as image_files

#: Tag numbers of the image file directory: width, length, bits, compression, photometric, strips, samples, format, place, projection.
_WIDTH, _LENGTH, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _FORMAT, _SCALE, _TIE, _KEYS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339, 33550, 33922, 34735
#: Keys of the projection: a projected model, pixels as areas, and its EPSG number.
_MODEL, _RASTER, _PROJECTED = 1024, 1025, 3072
_SIZES = {3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}


def encode(values, geotransform: tuple[float, ...] | None = None, epsg: int | None = None, strip: int | None = None, deflate: bool = False) -> bytes:
    """A little-endian image of an array of rows and columns, or of bands, rows and columns; NaN is a masked pixel.

    Bands lie one after another, in strips of so many rows (one if None). With epsg the
    image names its projection.
    """
    import numpy as np

    data = np.ascontiguousarray(values, dtype="<f4")
    data = data[None] if data.ndim == 2 else data
    bands, height, width = data.shape
    strip = min(strip or height, height)
    strips = [band[k : k + strip].tobytes() for band in data for k in range(0, height, strip)]
    strips = [zlib.compress(x) for x in strips] if deflate else strips
    counts = [len(x) for x in strips]
    tags = [(_WIDTH, 4, [width]), (_LENGTH, 4, [height]), (_BITS, 3, [32] * bands), (_COMPRESSION, 3, [8 if deflate else 1]), (_PHOTOMETRIC, 3, [1]), (_OFFSETS, 4, [0] * len(strips)), (_SAMPLES, 3, [bands]), (_ROWS, 4, [strip]), (_COUNTS, 4, counts), (_PLANAR, 3, [2 if bands > 1 else 1]), (_FORMAT, 3, [3] * bands)]
    if geotransform:
        x, w, _, y, _, h = geotransform
        tags += [(_SCALE, 12, [w, -h, 0.0]), (_TIE, 12, [0.0, 0.0, 0.0, x, y, 0.0])]
    if epsg:
        tags += [(_KEYS, 3, [1, 1, 0, 3, _MODEL, 0, 1, 1, _RASTER, 0, 1, 1, _PROJECTED, 0, 1, epsg])]
    start = 8 + 2 + 12 * len(tags) + 4
    long = [(tag, struct.pack(f"<{len(v)}{_SIZES[kind][0]}", *v)) for tag, kind, v in tags if len(v) * _SIZES[kind][1] > 4]
    places, at = {}, start
    for tag, raw in long:
        places[tag] = at
        at += len(raw) + len(raw) % 2
    at += -at % 4
    ifd, extra = b"", b""
    for tag, kind, v in tags:
        v = [at + sum(counts[:k]) for k in range(len(strips))] if tag == _OFFSETS else v
        raw = struct.pack(f"<{len(v)}{_SIZES[kind][0]}", *v)
        ifd += struct.pack("<HHI", tag, kind, len(v)) + (struct.pack("<I", places[tag]) if tag in places else raw.ljust(4, b"\0"))
        extra += raw + b"\0" * (len(raw) % 2) if tag in places else b""
    return (struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + ifd + struct.pack("<I", 0) + extra).ljust(at, b"\0") + b"".join(strips)


def decode_bands(raw: bytes):
    """The array of bands, rows and columns, the geotransform and the EPSG number (or None) of an image's bytes."""
    import numpy as np

    read = lambda at, n: raw[at : at + n]
    image, blocks = image_files.layout(read)
    data = np.empty((image.bands, image.height, image.width))
    for b in blocks:
        data[:, b.r0 : b.r0 + b.height, b.c0 : b.c0 + b.width] = image_files.values(image, b, read, list(range(image.bands)))
    return data, image.geotransform, image.epsg


def decode(raw: bytes):
    """The array of the first band and the geotransform (or None) of an image."""
    data, place, _ = decode_bands(raw)
    return data[0], place


def to_tiff(tiles: DataFrame, value: str | list[str], geotransform: tuple[float, ...] | None = None, epsg: int | None = None, strip: int | None = None, deflate: bool = False) -> DataFrame:
    """(tile_id, r0, c0, content): the image of each tile's pixels (tile_id, r, c, values); gaps are NaN.

    Several values are the image's bands. The geotransform is the whole raster's; each
    image gets that of its own corner.
    """
    names = [value] if isinstance(value, str) else list(value)

    def image(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        r0, c0 = int(frame.r.min()), int(frame.c.min())
        data = np.full((len(names), int(frame.r.max()) - r0 + 1, int(frame.c.max()) - c0 + 1), np.nan)
        for k in range(len(names)):
            data[k, frame.r - r0, frame.c - c0] = frame[f"v{k}"].astype("float64")
        own = None
        if geotransform:
            x, w, a, y, b, h = geotransform
            own = (x + c0 * w, w, a, y + r0 * h, b, h)
        return pd.DataFrame({"tile_id": [int(frame.tile_id.iloc[0])], "r0": [r0], "c0": [c0], "content": [encode(data, own, epsg, strip, deflate)]})

    rows = tiles.select(*(F.col(c).cast("int").alias(c) for c in ("tile_id", "r", "c")), *(F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(names)))
    return rows.groupBy("tile_id").applyInPandas(image, "tile_id int, r0 int, c0 int, content binary")


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """(file, r, c, value) of the first band of image files; NaN is NULL."""
    return image_files.read_images(spark, path)


def pixels_of(images: DataFrame, keys: list[str], bands: list[str] | None = None) -> DataFrame:
    """Pixels of a content column, with r0 and c0 added to their places where present: keys, r, c and value, or a column a band."""
    names = bands or ["value"]
    offsets = [F.col(c).cast("int") if c in images.columns else F.lit(0) for c in ("r0", "c0")]
    rows = images.select(*keys, offsets[0].alias("r0"), offsets[1].alias("c0"), "content")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames):
        import numpy as np

        for frame in frames:
            for row in frame.itertuples(index=False):
                data, _, _ = decode_bands(bytes(row.content))
                r, c = np.indices(data.shape[1:])
                out = pd.DataFrame({k: [getattr(row, k)] * r.size for k in keys})
                out = out.assign(r=(r.ravel() + row.r0).astype("int32"), c=(c.ravel() + row.c0).astype("int32"))
                yield out.assign(**{name: data[k].ravel().astype("float64") for k, name in enumerate(names)})

    made = rows.mapInPandas(run, f"{kinds}, r int, c int, " + ", ".join(f"`{n}` double" for n in names))
    return made.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in names})


def save_tiff_files(images: DataFrame, folder: str) -> None:
    """Writes each image as tile_<id>.tif, all or none; the folder is shared by driver and executors."""
    image_files.write_images(images, folder)
