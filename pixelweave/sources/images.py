"""TIFF images as a data source: windows read the strips or tiles that they need; and as a sink that commits whole jobs."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# Tag numbers of the format's public specification, and the sizes of its field types.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_counts": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325, "format": 339, "scale": 33550, "tie": 33922, "keys": 34735, "nodata": 42113}
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8)}
NONE, DEFLATE = (1,), (8, 32946)
PROJECTED = 3072

#: Pixels that a task reads at least, if the image has as many, and images whose headers are read at a time.
SPLIT, HEADERS = 1 << 20, 16


@dataclass(frozen=True)
class Block:
    """A strip or tile: the pixels it covers (padding left out) and the bytes of each band's part of it."""

    r0: int
    c0: int
    height: int
    width: int
    parts: tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Layout:
    """What an image's header says, without its blocks' places."""

    width: int
    height: int
    bands: int
    kind: str
    compression: int
    predictor: int
    planar: int
    block_width: int
    block_height: int
    geotransform: tuple[float, ...] | None
    epsg: int | None
    nodata: float | None


Reader = Callable[[int, int], bytes]


def _entries(read: Reader) -> tuple[str, dict[int, tuple]]:
    """Byte order and the values of the first directory's tags, plain or with 64-bit places."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(f"{order}H", head, 2)[0] if order and len(head) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF image")
    big = version == 43
    at = struct.unpack_from(f"{order}{'Q' if big else 'I'}", head, 8 if big else 4)[0]
    size = 8 if big else 2
    (n,) = struct.unpack(f"{order}{'Q' if big else 'H'}", read(at, size))
    step, inline = (20, 8) if big else (12, 4)
    raw = read(at + size, n * step)
    found = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HH{'Q' if big else 'I'}", raw, k * step)
        if tag not in TAGS.values() or kind not in TYPES:
            continue
        code, width = TYPES[kind]
        value = raw[k * step + step - inline : (k + 1) * step]
        if count * width > inline:
            value = read(struct.unpack(f"{order}{'Q' if big else 'I'}", value)[0], count * width)
        found[tag] = (value[:count],) if code == "s" else struct.unpack_from(f"{order}{count}{code}", value)
    return order, found


def layout(read: Reader) -> tuple[Layout, list[Block]]:
    """Header and blocks of an image, from a function that reads bytes (place, number)."""
    order, tags = _entries(read)
    get = lambda name, otherwise=None: tags.get(TAGS[name], otherwise)
    width, height, bands = get("width")[0], get("height")[0], get("samples", (1,))[0]
    bits, form = set(get("bits", (1,))), set(get("format", (1,)))
    compression, planar, predictor = get("compression", NONE)[0], get("planar", (1,))[0], get("predictor", (1,))[0]
    letters = {1: "u", 2: "i", 3: "f"}
    if len(bits) != 1 or len(form) != 1 or not bits <= {8, 16, 32, 64} or not form <= letters.keys() or (form == {3} and bits == {8}):
        raise ValueError("samples must be whole numbers or floats of 8 to 64 bits, alike in all bands")
    if compression not in NONE + DEFLATE or predictor not in (1, 2) or predictor == 2 and form == {3}:
        raise ValueError("only plain and deflated images are read")
    tiled = get("tile_offsets") is not None
    across = get("tile_width")[0] if tiled else width
    down = get("tile_height")[0] if tiled else min(get("rows_per_strip", (height,))[0], height)
    n_x, n_y = -(-width // across), -(-height // max(down, 1))
    offsets, counts = (get(f"{'tile' if tiled else 'strip'}_{x}") for x in ("offsets", "counts"))
    places = list(zip(offsets, counts))
    of = lambda k: tuple(places[k + b * n_x * n_y] for b in range(bands)) if planar == 2 else (places[k],)
    blocks = [Block(y * down, x * across, min(down, height - y * down), min(across, width - x * across), of(y * n_x + x)) for y in range(n_y) for x in range(n_x)]
    place = epsg = None
    if get("scale") and get("tie"):
        (w, h, _), (i, j, _, x, y, _) = get("scale"), get("tie")
        place = (x - i * w, w, 0.0, y + j * h, 0.0, -h)
    if keys := get("keys"):
        epsg = next((keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] == PROJECTED), None)
    nodata = get("nodata")
    kind = f"{order}{letters[form.pop()]}{bits.pop() // 8}"
    return Layout(width, height, bands, kind, compression, predictor, planar, across, down, place, epsg, float(nodata[0].rstrip(b"\0 ")) if nodata else None), blocks


def values(image: Layout, block: Block, read: Reader, bands: list[int]):
    """Array of the wanted bands (from 0), rows and columns of a block, as doubles; NaN where there is no data.

    Of an image with its bands one after another only the wanted ones are read.
    """
    import numpy as np

    shared = image.planar == 1
    tiled = image.block_width < image.width or len({block.width, image.block_width}) > 1
    rows, cols = (image.block_height if tiled else block.height), image.block_width
    each = image.bands if shared else 1
    out = []
    for part in [0] if shared else bands:
        raw = read(*block.parts[part])
        if image.compression in DEFLATE:
            raw = zlib.decompress(raw)
        size = np.dtype(image.kind).itemsize * cols * each
        data = np.frombuffer(raw, dtype=image.kind, count=min(rows, len(raw) // size) * cols * each).reshape(-1, cols, each)
        if image.predictor == 2:
            data = np.cumsum(data, axis=1, dtype=data.dtype.newbyteorder("="))
        data = data[: block.height, : block.width].astype(np.float64)
        out += [data[:, :, b] for b in bands] if shared else [data[:, :, 0]]
    made = np.stack(out)
    return np.where(made == image.nodata, np.nan, made) if image.nodata is not None else made


def opened(path: str):
    """A file of a path or URI for reading, through the file system that Arrow knows for it."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return files.open_input_file(name)


def _ranges(stream) -> Reader:
    return lambda at, n: stream.read_at(n, at)


@dataclass
class Piece(InputPartition):
    path: str
    image: Layout
    r0: int
    c0: int
    blocks: list[Block] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)

    @property
    def pixels(self) -> int:
        return sum(b.height * b.width for b in self.blocks)


class ImageReader(DataSourceReader):
    """Filters on r and c choose blocks before any pixel is read, and rows of a block before they go to Spark."""

    def __init__(self, path: str, bands: dict[str, int], origin: tuple[float, float] | None, split: int):
        self.path, self.names, self.bands, self.origin, self.split = path, list(bands), list(bands.values()), origin, split
        self.low, self.high = {"r": -(1 << 62), "c": -(1 << 62)}, {"r": 1 << 62, "c": 1 << 62}
        self.among: dict[str, list[tuple]] = {"r": [], "c": []}

    def pushFilters(self, filters):
        for f in filters:
            axis = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if axis not in self.low or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)):
                yield f
            elif isinstance(f, In):
                self.among[axis].append(tuple(v for v in f.value if v is not None))
            elif not isinstance(value, int):
                yield f
            else:
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low[axis] = max(self.low[axis], value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high[axis] = min(self.high[axis], value - isinstance(f, LessThan))

    def _paths(self) -> list[str]:
        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = files.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        scheme = f"{self.path.split('://')[0]}://" if "://" in self.path else "file://"
        host = self.path.split("://")[1].split("/")[0] if "://" in self.path and files.type_name in ("hdfs",) else ""
        if info.is_file:
            return [f"{scheme}{host}{name}"]
        found = files.get_file_info(fs.FileSelector(name, recursive=False))
        return sorted(f"{scheme}{host}{x.path}" for x in found if x.is_file and x.base_name.lower().endswith((".tif", ".tiff")) and x.base_name[0] not in "._")

    def _wanted(self, axis: str, first: int, n: int) -> bool:
        low, high = max(first, self.low[axis]), min(first + n - 1, self.high[axis])
        return low <= high and all(any(low <= v <= high for v in some) for some in self.among[axis])

    def _pieces(self, path: str) -> list[Piece]:
        with opened(path) as stream:
            image, blocks = layout(_ranges(stream))
        r0 = c0 = 0
        if self.origin:
            if not image.geotransform:
                raise ValueError(f"{path} has no place")
            x, w, _, y, _, h = image.geotransform
            r0, c0 = round((y - self.origin[1]) / h), round((x - self.origin[0]) / w)
        pieces: list[Piece] = []
        for b in blocks:
            if self._wanted("r", r0 + b.r0, b.height) and self._wanted("c", c0 + b.c0, b.width):
                if not pieces or pieces[-1].pixels >= self.split:
                    pieces.append(Piece(path, image, r0, c0))
                pieces[-1].blocks.append(b)
        return pieces

    def partitions(self):
        """Runs of the blocks that the filters leave in; of each image only the header is read here."""
        with ThreadPoolExecutor(HEADERS) as pool:
            return [p for pieces in pool.map(self._pieces, self._paths()) for p in pieces]

    def bytes_wanted(self) -> int:
        """Bytes of pixels that a scan with the pushed filters reads."""
        return sum(b.parts[0][1] if p.image.planar == 1 else sum(b.parts[k][1] for k in self.bands) for p in self.partitions() for b in p.blocks)

    def read(self, partition: Piece) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if partition is None or not isinstance(partition, Piece):
            return
        with opened(partition.path) as stream:
            for block in partition.blocks:
                data = values(partition.image, block, _ranges(stream), self.bands)
                r, c = (np.arange(n, dtype=np.int32) + first for n, first in ((block.height, partition.r0 + block.r0), (block.width, partition.c0 + block.c0)))
                rows, cols = (self._inside(axis, at) for axis, at in (("r", r), ("c", c)))
                data, r, c = data[:, rows][:, :, cols], r[rows], c[cols]
                columns = [pa.array(np.repeat(r, len(c))), pa.array(np.tile(c, len(r))), *(pa.array(x.ravel(), from_pandas=True) for x in data)]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(columns[0]), pa.string()), *columns], names=["file", "r", "c", *self.names])

    def _inside(self, axis: str, at):
        import numpy as np

        kept = (at >= self.low[axis]) & (at <= self.high[axis])
        for some in self.among[axis]:
            kept &= np.isin(at, some)
        return np.flatnonzero(kept)


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class ImageWriter(DataSourceWriter):
    """Tasks write under names of their own in a folder beside the images; commit gives them their names, abort deletes them."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, rows) -> Written:
        files, folder = self._place()
        staged = f"{folder}/_staged-{self.job}"
        files.create_dir(staged, recursive=True)
        names = []
        for name, content in rows:
            mine = f"{staged}/{uuid.uuid4().hex}"
            with files.open_output_stream(mine) as out:
                out.write(bytes(content))
            names.append((mine, name))
        return Written(names)

    def commit(self, messages) -> None:
        files, folder = self._place()
        made = {name: mine for m in messages if m is not None for mine, name in m.names}
        if sum(len(m.names) for m in messages if m is not None) != len(made):
            self.abort(messages)
            raise ValueError("two images have the same name")
        files.create_dir(folder, recursive=True)
        from pyarrow import fs

        there = [x for x in files.get_file_info(fs.FileSelector(folder)) if x.is_file and x.base_name[0] not in "._"]
        for name, mine in made.items():
            files.move(mine, f"{folder}/{name}")
        for old in there if self.overwrite else []:
            if old.base_name not in made:
                files.delete_file(old.path)
        self._drop(files, folder)

    def abort(self, messages) -> None:
        self._drop(*self._place())

    def _drop(self, files, folder: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{folder}/_staged-{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{folder}/_staged-{self.job}")


class Images(DataSource):
    """format("images"): file, r, c and a double for each band that is named.

    Options: path (a file or folder), bands ("red=1,nir=4"; by default value=1), origin
    ("x,y" of the corner of the whole raster's first pixel: places are then counted from there
    and not from each image's own corner), split (pixels of a task at least).
    """

    @classmethod
    def name(cls) -> str:
        return "images"

    def _bands(self) -> dict[str, int]:
        listed = self.options.get("bands", "value=1").split(",")
        return {name.strip(): int(number) - 1 for name, number in (b.split("=") for b in listed)}

    def schema(self) -> str:
        return "file string, r int, c int, " + ", ".join(f"`{b}` double" for b in self._bands())

    def reader(self, schema) -> ImageReader:
        origin = self.options.get("origin")
        return ImageReader(self.options["path"], self._bands(), tuple(map(float, origin.split(","))) if origin else None, int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["path"], overwrite)


def read_images(spark: SparkSession, path: str, bands: dict[str, int] | None = None, window: tuple[int, int, int, int] | None = None, origin: tuple[float, float] | None = None, split: int = SPLIT) -> DataFrame:
    """(file, r, c, a column a band) of a TIFF image or of a folder of them, or of a window (x_off, y_off, x_size, y_size).

    bands are numbers from 1 by name; of images with their bands one after another the
    others are not read. NaN and the image's no-data value are NULL. Images are plain or
    deflated, in strips or tiles, of whole numbers or floats. The window, and any filter
    on r and c, is pushed down: a task gets a run of strips or tiles of about `split` pixels that
    the window touches, and reads their bytes alone. An empty folder gives no rows.
    """
    spark.dataSource.register(Images)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = spark.read.format("images").option("path", path).option("split", split).option("bands", ",".join(f"{n}={k}" for n, k in (bands or {"value": 1}).items()))
    if origin:
        source = source.option("origin", f"{origin[0]!r},{origin[1]!r}")
    pixels = source.load()
    if window:
        x, y, w, h = window
        pixels = pixels.filter((F.col("r") >= y) & (F.col("r") < y + h) & (F.col("c") >= x) & (F.col("c") < x + w))
    return pixels


def write_images(images: DataFrame, path: str, overwrite: bool = True, name: str = "tile_") -> None:
    """Writes images (tile_id, content) as <name><tile_id>.tif into a folder or URI that driver and executors share.

    Nothing is to be seen before all tasks are done, and nothing is left of a job that
    fails; overwrite deletes what else the folder holds only then. Two images of one
    tile_id are an error.
    """
    images.sparkSession.dataSource.register(Images)
    named = images.select(F.concat(F.lit(name), F.col("tile_id").cast("string"), F.lit(".tif")).alias("name"), "content")
    named.write.format("images").mode("overwrite" if overwrite else "append").option("path", path).save()
