"""WARC derivatives: metadata and plain-text conversion records of response records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as references
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .arrowtext import text_column
from .htmlblocks import parse

_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.I | re.S)
_LINK = re.compile(r"""<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_BREAKS = re.compile(r"[\r\n]+")
_SPACE = re.compile(r"\s+")
SOFTWARE = "warc-derivatives/1"
#: Record fields in the order of a WARC header.
HEADER = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Concurrent-To", "WARC-Block-Digest", "WARC-Payload-Digest", "Content-Type", "Content-Length")
_OUT = "key string, record_type string, record_id string, refers_to string, target_uri string, date string, source_headers string, source_digest string, content_type string, block_digest string, content_length long, header string, block string"


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A name-based id, the same whenever and wherever the record is built."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def _one_line(text: str) -> str:
    return _BREAKS.sub(" ", text).strip()


def _header(fields: dict[str, str | None]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {_one_line(fields[k])}\r\n" for k in HEADER if fields.get(k))


def derivatives(key: str | None, url: str | None, html: str | None, date: str, source: str, headers: str, digest: str) -> list[tuple]:
    """The metadata record and the conversion record of one response."""
    html = html or ""
    title = _TITLE.search(html)
    fields = [("software", SOFTWARE), ("source-payload-digest", digest), ("source-length", str(len(html.encode())))]
    fields += [(f"source-{name.strip().lower()}", value.strip()) for name, _, value in (line.partition(":") for line in headers.splitlines()) if value]
    if title:
        fields.append(("title", _SPACE.sub(" ", references.unescape(title[1])).strip()))
    fields += [("outlink", f"{_one_line(m.strip(chr(34) + chr(39)))} L a/@href") for m in _LINK.findall(html)]
    bodies = {"metadata": ("application/warc-fields", "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields)), "conversion": ("text/plain; charset=utf-8", "\n".join(parse(html).blocks))}
    ids = {kind: record_id(source, kind) for kind in bodies}
    out = []
    for kind, (content, body) in bodies.items():
        data = body.encode("utf-8", "replace")
        block = {
            "WARC-Type": kind, "WARC-Record-ID": ids[kind], "WARC-Date": date, "WARC-Target-URI": url, "WARC-Refers-To": source, "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Date": date,
            "WARC-Concurrent-To": ids["conversion"] if kind == "metadata" else None, "WARC-Block-Digest": sha1_base32(data), "WARC-Payload-Digest": digest if kind == "metadata" else None, "Content-Type": content, "Content-Length": str(len(data)),
        }
        out.append((key, kind, ids[kind], source, url, date, headers, digest, content, block["WARC-Block-Digest"], len(data), _header(block), body))
    return out


def build_derivatives(responses: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: Column | None = None, source_id: Column | None = None, headers: Column | None = None, digest: Column | None = None) -> DataFrame:
    """Two records for each response: metadata and plain-text conversion, in one narrow pass.

    date, source_id, headers and digest are those of the response record and are
    kept: both records refer to source_id, carry its date and target URI, and the
    metadata record lists its header fields and payload digest. Where a column is
    not given, the date is 1970-01-01T00:00:00Z, the id is made from key and URL,
    there are no headers and the digest is computed. Ids are name-based, so a task
    that is run again builds the same records.

    Returns the columns of _OUT with key of its own type. Null HTML counts as empty
    (an empty conversion record), a null URL leaves the target URI out; repeated
    rows give equal records; an empty table gives none.
    """
    given = lambda c, other: F.coalesce(c.cast("string"), F.lit(other)) if c is not None else F.lit(other)
    rows = responses.select(
        F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"),
        given(date, "1970-01-01T00:00:00Z").alias("date"), given(source_id, "").alias("source"), given(headers, "").alias("headers"), given(digest, "").alias("digest"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _OUT.split(", ")]
        kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in _OUT.split(", ")]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = []
                for own, address, source, when, whose, head, have in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                    whose = whose or record_id("response", own or "", address or "")
                    out += derivatives(own, address, source, when, whose, head, have or sha1_base32((source or "").encode()))
                columns = list(zip(*out)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    made = rows.mapInArrow(run, _OUT)
    rest = [x.split()[0] for x in _OUT.split(", ")][1:]
    return made.select(F.col("key").cast(responses.schema[key].dataType).alias(key), *rest)


class WarcSink(DataSource):
    """Files of WARC records, one for each task; the path is on storage that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def writer(self, schema, overwrite: bool):
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip"), overwrite)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Writes header and block columns; each record is a gzip member of its own, so that a reader can start at any.

    A task writes a file of its own name beside the others; the driver gives the files of the
    attempts that count their last names, and the others go.
    """

    def __init__(self, path: str, compression: str, overwrite: bool):
        self.path, self.compression, self.overwrite = path, compression, overwrite

    def write(self, iterator):
        context = TaskContext.get()
        files, folder = fs.FileSystem.from_uri(self.path)
        files.create_dir(folder, recursive=True)
        name = f"part-{context.partitionId():05d}-{uuid.uuid4().hex}.warc" + ".gz" * (self.compression == "gzip")
        wrote = False
        with files.open_output_stream(f"{folder}/_{name}", compression=None) as out:
            for batch in iterator:
                for header, block in zip(text_column(batch, "header"), text_column(batch, "block")):
                    record = header.as_py().encode() + b"\r\n" + (block.as_py() or "").encode("utf-8", "replace") + b"\r\n\r\n"
                    out.write(gzip.compress(record, 6, mtime=0) if self.compression == "gzip" else record)
                    wrote = True
        if not wrote:
            files.delete_file(f"{folder}/_{name}")
        return Written(name if wrote else None)

    def commit(self, messages):
        files, folder = fs.FileSystem.from_uri(self.path)
        files.create_dir(folder, recursive=True)
        there = [x.base_name for x in files.get_file_info(fs.FileSelector(folder)) if x.is_file]
        names = [m.name for m in messages if m is not None and m.name]
        for name in names:
            files.move(f"{folder}/_{name}", f"{folder}/{name}")
        for old in there:
            if old.startswith("_part-") and old[1:] not in names or self.overwrite and old.startswith("part-"):
                files.delete_file(f"{folder}/{old}")

    def abort(self, messages):
        files, folder = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                files.delete_file(f"{folder}/_{m.name}")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes records (header and block columns) as WARC files in place of what the folder holds, gzip or none.

    A record is its header, an empty line and its block, and ends with two line
    ends; compressed, it is a member of its own. A null block is empty. The folder is a path or URI
    that driver and executors share. An empty table leaves no file.
    """
    records.sparkSession.dataSource.register(WarcSink)
    uri = path if "://" in path else f"file://{path}"
    records.select("header", "block").write.format("warc").mode("overwrite").option("compression", compression).save(uri)


#: Compressed bytes that a task reads records from.
SPLIT = 64 << 20
CHUNK = 1 << 20


class _Bytes:
    """A file's bytes from some place on, read as they are asked for and unpacked member by member."""

    def __init__(self, stream, packed: bool):
        self.stream, self.packed = stream, packed
        self.raw, self.unzip, self.plain = b"", zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Adds to plain; False at the end of the file."""
        if not self.packed:
            data = self.stream.read(CHUNK)
            self.plain += data
            return bool(data)
        if self.unzip.eof:
            self.raw, self.unzip = self.unzip.unused_data or self.raw, zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
            if not self.raw:
                return False
        data, self.raw = self.raw, b""
        self.plain += self.unzip.decompress(data)
        return True


def _first_member(stream, begin: int, end: int) -> int:
    """Place of the first gzip member of a WARC record from begin on and before end; end if there is none."""
    stream.seek(begin)
    held, base = b"", begin
    while base < end:
        data = stream.read(CHUNK)
        held += data
        at = held.find(b"\x1f\x8b\x08")
        while 0 <= at < end - base and (len(held) - at >= 4096 or not data):
            try:
                if zlib.decompressobj(31).decompress(held[at:], 8)[:7] == b"WARC/1.":
                    return base + at
            except zlib.error:
                pass
            at = held.find(b"\x1f\x8b\x08", at + 1)
        if not data:
            return end
        keep = len(held) - at if at >= 0 else 2
        base, held = base + len(held) - keep, held[len(held) - keep :]
    return end


def records_of(path: str, begin: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of the records that start within a range of a file, one at a time."""
    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as stream:
        packed = stream.read(2) == b"\x1f\x8b"
        if not packed and begin:
            return  # records that are not compressed cannot be told from what blocks hold
        at = _first_member(stream, begin, end) if packed and begin else begin
        if at >= end:
            return
        last = _first_member(stream, end, stream.size()) if packed and end < stream.size() else stream.size()
        stream.seek(at)
        source = _Bytes(_Until(stream, last - at), packed)
        while True:
            while (cut := source.plain.find(b"\r\n\r\n")) < 0 or not source.plain.strip(b"\r\n"):
                if not source.more():
                    return
            lines = bytes(source.plain[:cut]).decode("utf-8", "replace").split("\r\n")
            head = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}
            size = int(head.get("Content-Length", "0"))
            while len(source.plain) < cut + 4 + size and source.more():
                pass
            yield head, bytes(source.plain[cut + 4 : cut + 4 + size])
            del source.plain[: cut + 4 + size]
            while source.plain[:2] == b"\r\n" or len(source.plain) < 2 and source.more():
                if source.plain[:2] == b"\r\n":
                    del source.plain[:2]


class _Until:
    def __init__(self, stream, left: int):
        self.stream, self.left = stream, left

    def read(self, n: int) -> bytes:
        data = self.stream.read(min(n, self.left))
        self.left -= len(data)
        return data


def read_warc(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Records of WARC files: headers as a map, and the block.

    Files of a gzip member a record are read in ranges of split bytes, each task from the first
    member in its range; others from begin to end by one task. A task holds one record and a chunk of its file at a time,
    whatever the file's size. An empty folder gives no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                for head, block in records_of(where, begin, end):
                    yield pa.RecordBatch.from_arrays([pa.array([list(head.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], names=["headers", "block"])

    found = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length").filter("length > 0")
    ranges = found.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {split}L)")).alias("begin"))
    ranges = ranges.select("path", "begin", F.least(F.col("begin") + split, F.col("length")).alias("end"))
    return ranges.repartition("path", "begin").mapInArrow(run, "headers map<string,string>, block binary")
