"""Main text of web pages after site templates have been removed."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import row_struct, unpack_row
from .htmlblocks import hash_of, parse
from .shared import distinct_hash

#: A subtree is a template if so many different pages of its host have it,
MIN_PAGES = 5
#: and at least this share of the host's different pages;
MIN_SHARE = 0.25
#: or, on hosts of any size, if it has so many characters and so many pages have it.
LONG_CHARS, MANY_PAGES = 40, 1000
#: In an article or main element, which says that it is content, so many pages and this share have to have it.
INSIDE_PAGES, INSIDE_SHARE = 10, 0.5

_SPAN = pa.struct([("h", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def _lists(of: list[list], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in of])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([y for x in of for y in x], kind))


def _spans(pages: list) -> pa.Array:
    """Subtrees as lists of structs; the last bit of a hash says whether the subtree is long."""
    rows = []
    for p in pages:
        upto = [0, *accumulate(map(len, p.blocks))]
        rows += [(h | (upto[end] - upto[first] >= LONG_CHARS), first, end) for h, first, end in p.spans]
    columns = list(zip(*rows)) or [(), (), ()]
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPAN)], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p.spans) for p in pages])]), pa.int32()), flat)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the marks leave in, the length of every block (negative if left out), and the subtrees of each page.

    Different pages differ in a block that is left in.
    """
    for batch in batches:
        step = 256
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            pages = [parse(source.as_py()) for source in part.column(3)]
            joined = ["\n".join(b for b, kept in zip(p.blocks, p.kept) if kept) for p in pages]  # blocks have no line ends
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in range(3)),
                    pa.array([hash_of(x) for x in joined], pa.int64()),
                    # compressed, as this is most of what is dealt out
                    pa.array([zlib.compress(x.encode("utf-8", "replace"), 6) for x in joined], pa.binary()),
                    _lists([[len(b) if kept else -len(b) for b, kept in zip(p.blocks, p.kept)] for p in pages], pa.int32()),
                    _spans(pages),
                ],
                names=["rid", "host", "row", "ident", "blocks", "sizes", "spans"],
            )


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page and different subtree of it; subtree 0 stands for the page."""
    for batch in batches:
        spans = batch.column(6)
        count = spans.value_lengths().to_numpy()
        page = np.concatenate([np.arange(batch.num_rows), np.repeat(np.arange(batch.num_rows), count)])
        h = np.concatenate([np.zeros(batch.num_rows, dtype=np.int64), spans.flatten().field(0).to_numpy()])
        with_host = (batch.column(1).to_numpy(zero_copy_only=False) != "")[page]
        page, h = page[with_host], h[with_host]
        order = np.lexsort((h, page))
        page, h = page[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (page[1:] != page[:-1]) | (h[1:] != h[:-1])
        at = pa.array(page[new])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at), pa.array(h[new])], names=["rid", "host", "ident", "h"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, figures = [], []
        for blocks, sizes, spans, dropped in zip(*(batch.column(c).to_pylist() for c in (4, 5, 6, 7))):
            gone, out = set(dropped or ()), [0] * (len(sizes) + 1)
            for s in spans if gone else ():
                if s["h"] in gone:
                    out[s["first"]] += 1
                    out[s["end"]] -= 1
            out = {k for k, depth in enumerate(accumulate(out)) if depth}
            lines = iter(zlib.decompress(blocks).decode().split("\n"))
            kept = [(k, next(lines)) for k, size in enumerate(sizes) if size > 0]
            texts.append(" ".join(b for k, b in kept if k not in out))
            figures.append((len(out), sum(abs(sizes[k]) for k in out), -sum(size for k, size in enumerate(sizes) if size < 0 and k not in out)))
        columns = list(zip(*figures)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["row", "text", "n_template_blocks", "n_template_chars", "n_marked_chars"])


def main_text(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES, carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns, text, n_chars (code points), and what was removed how, of each page.

    The subtree of every block element of the whole page is hashed. One that at
    least min_pages different pages and min_share of all different pages of a host
    have is part of the site's template and is cut out of that host's pages, as is
    one of LONG_CHARS or more that many_pages have. What is in an article (or main) element takes
    more: INSIDE_PAGES and INSIDE_SHARE, as articles also share lines. Pages that are equal in all that
    marks leave in count once, so that copies of an article don't make its paragraphs
    a template.
    Of what is then left, blocks go that element names, roles or, more warily, class
    words mark as not the article (see parse), for what no other page has: menus that vary,
    adverts, hosts of few pages. n_template_blocks and n_template_chars are what
    the templates took, n_marked_chars what the marks took of the rest.

    The pages are parsed once and dealt out by a hash of the page; the counts, the
    join and the texts read that exchange. A host's subtrees are counted in part on
    the map side and joined on a hash of (host, subtree), dealt out for the join
    alone, so that Spark can split the templates of a host with very many pages.

    Null or empty HTML gives an empty text; a null or relative URL has no host and
    no templates. Repeated rows give equal rows; an empty table an empty result.
    """
    rid = distinct_hash(pages, *(x for c in (url, html, *carry) for x in (F.col(c).isNull(), F.col(c)))).alias("rid")
    rows = pages.select(rid, host_of(F.col(url)).alias("host"), row_struct(carry), F.col(html).cast("string").alias("html"))
    kind = rows.schema["row"].dataType.simpleString()
    parsed = rows.mapInArrow(_parsed, f"rid long, host string, row {kind}, ident long, blocks binary, sizes array<int>, spans array<struct<h: long, first: int, end: int>>").repartition("rid")
    subtrees = parsed.mapInArrow(_subtrees, "rid long, host string, ident long, h long")
    counts = subtrees.groupBy("host", "h", "ident").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    hosts = counts.filter("h = 0").select("host", F.col("n").alias("pages"))
    inside, long = F.col("h").bitwiseAND(2) != 0, F.col("h").bitwiseAND(1) != 0
    outside = (F.col("n") >= min_share * F.col("pages")) | (F.col("n") >= many_pages) & long
    enough = F.when(inside, (F.col("n") >= INSIDE_PAGES) & (F.col("n") >= INSIDE_SHARE * F.col("pages"))).otherwise(outside)
    templates = counts.filter("h != 0").join(hosts, "host").filter(enough).select(F.xxhash64("host", "h").alias("k"))
    dropped = subtrees.select(F.xxhash64("host", "h").alias("k"), "rid", "h").join(templates, "k").groupBy("rid").agg(F.collect_set("h").alias("dropped"))
    made = parsed.join(dropped, "rid", "left").mapInArrow(_texts, f"row {kind}, text string, n_template_blocks long, n_template_chars long, n_marked_chars long")
    return unpack_row(made, carry, F.col("text"), F.length("text").cast("long").alias("n_chars"), F.col("n_template_blocks"), F.col("n_template_chars"), F.col("n_marked_chars"))
