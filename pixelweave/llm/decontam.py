"""Benchmark decontamination by winnowed fingerprints, joined and extended to whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import ALNUM, RollingHash, Words, blocks, covered, mix, sliding, window_is_inside
from .shared import BROADCAST_ROWS, PAIR, pair_hash, stored

#: Fingerprints of the benchmark that are broadcast at most, as 8 bytes each; more are joined by a shuffle.
BROADCAST_FINGERPRINTS = 2_000_000

_U = np.uint64


def winnow(hashes: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Places of the least gram hashes of each window; ties all stay.

    Equal windows keep equal grams at equal places, so any shared span of at
    least `window` words shares a fingerprint.
    """
    width = window - gram + 1
    grams = RollingHash(hashes).all(gram)
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64), grams
    least = sliding(np.minimum, grams, width)
    least = np.where(window_is_inside(bounds, window)[: len(least)], least, 0)
    edge = np.zeros(width - 1, dtype=np.uint64)
    return np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), width) == grams), grams


def _short(h: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of a whole window of fewer words than others."""
    return mix(h ^ _U(length * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _fingerprints(words: Words, h1: np.ndarray, window: int, gram: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, place and length of window of the grams that winnowing keeps and of all windows of the shorter lengths."""
    places, grams = winnow(h1, words.bounds, window, gram)
    found = [(grams[places], places, np.full(len(places), window))]
    for length in lengths:
        at = np.flatnonzero(window_is_inside(words.bounds, length))
        found.append((_short(RollingHash(h1).at(at, at + length), length), at, np.full(len(at), length)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _of_items(window: int, gram: int):
    """Windows and fingerprints of items: rows (id, k, a, b, f), either of a window or of a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                words = block.words(ALNUM, lower=True)
                h1, h2 = words.hashes(2)
                counts, text = words.counts(), words.text_of()
                size = np.minimum(counts, window)
                at = np.flatnonzero(np.arange(len(h1)) + np.repeat(size, counts) <= np.repeat(words.bounds[1:], counts))
                k = np.repeat(size, counts)[at]
                a, b = (RollingHash(h).at(at, at + k) for h in (h1, h2))
                places, grams = winnow(h1, words.bounds, window, gram)
                short = k < window
                f = np.unique(np.concatenate([grams[places], *(_short(a[short & (k == n)], int(n)) for n in np.unique(k[short]))]))
                ids = batch.column(0).slice(block.first, block.last - block.first).take(pa.array(text[at]))
                n, m = len(at), len(f)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([ids, pa.nulls(m, ids.type)]), pa.concat_arrays([pa.array(k, pa.int32()), pa.nulls(m, pa.int32())]),
                        *(pa.concat_arrays([pa.array(x.view(np.int64)), pa.nulls(m, pa.int64())]) for x in (a, b)), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(f.view(np.int64))]),
                    ],
                    names=["id", "k", "a", "b", "f"],
                )

    return run


def _of_docs(window: int, gram: int, lengths: list[int]):
    """Fingerprints of documents: rows (rid, f, p, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                words = block.words(ALNUM, lower=True)
                (h1,) = words.hashes()
                f, p, k = _fingerprints(words, h1, window, gram, lengths)
                text = words.text_of()[p]
                rids = batch.column(0).slice(block.first, block.last - block.first).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([rids, pa.array(f.view(np.int64)), pa.array((p - words.bounds[text]).astype(np.int32)), pa.array(k.astype(np.int32))], names=["rid", "f", "p", "k"])

    return run


def _windows_around(words: Words, places: np.ndarray, k: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, place, length and hashes of the windows that hold a fingerprint found."""
    h1, h2 = words.hashes(2)
    hit = places[k == window]
    full = np.flatnonzero(covered(len(h1), np.maximum(hit - (window - gram), 0), hit + 1) & window_is_inside(words.bounds, window))
    at = np.concatenate([full, places[k < window]])
    k = np.concatenate([np.full(len(full), window), k[k < window]])
    text = words.text_of()[at]
    return text, at - words.bounds[text], k, RollingHash(h1).at(at, at + k), RollingHash(h2).at(at, at + k)


def _windows_batch(rids: pa.Array, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    text, p, k, a, b = found
    return pa.RecordBatch.from_arrays([rids.take(pa.array(text)), pa.array(p.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["rid", "p", "k", "a", "b"])


def _candidates(shared, window: int, gram: int, lengths: list[int]):
    """Windows of documents around the fingerprints that the benchmark has as well, which are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                words = block.words(ALNUM, lower=True)
                (h1,) = words.hashes()
                f, p, k = _fingerprints(words, h1, window, gram, lengths)
                hit = known[np.minimum(np.searchsorted(known, f), len(known) - 1)] == f
                if hit.any():
                    yield _windows_batch(batch.column(0).slice(block.first, block.last - block.first), _windows_around(words, p[hit], k[hit], window, gram))

    return run


def _candidates_at(window: int, gram: int):
    """The same for fingerprints that a join has found; column 2 holds places and lengths in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                words = block.words(ALNUM, lower=True)
                part = batch.column(2).slice(block.first, block.last - block.first)
                flat = part.flatten()
                p = flat.field(0).to_numpy() + np.repeat(words.bounds[:-1], part.value_lengths().to_numpy())
                yield _windows_batch(batch.column(0).slice(block.first, block.last - block.first), _windows_around(words, p, flat.field(1).to_numpy(), window, gram))

    return run


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of words and hit ranges of each text, from the windows found in it."""
    for batch in batches:
        for block in blocks(batch.column(1)):
            words = block.words(ALNUM, lower=True)
            own = slice(block.first, block.last)
            part = batch.column(2)[own]
            flat = part.flatten()
            begin = flat.field(0).to_numpy() + np.repeat(words.bounds[:-1], part.value_lengths().fill_null(0).to_numpy())
            spans = _spans(words, begin, begin + flat.field(1).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0)[own], pa.array(words.counts(), pa.int64()), spans, batch.column(3)[own]], names=["row", "n_words", "spans", "items"])


def _spans(words, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Disjoint hit ranges of each text as begin, end, begin, end, ... in its own words."""
    total = int(words.bounds[-1])
    hit = np.zeros(total + 2, dtype=bool)
    hit[1:-1] = covered(total, begins, ends)
    cut = np.zeros(total + 1, dtype=bool)
    cut[words.bounds] = True
    first = np.flatnonzero(hit[1:-1] & (~hit[:-2] | cut[:-1]))
    last = np.flatnonzero(hit[1:-1] & (~hit[2:] | cut[1:])) + 1
    text = np.searchsorted(words.bounds, first, side="right") - 1
    flat = np.stack([first, last], axis=1) - words.bounds[text][:, None]
    offsets = np.zeros(len(words.bounds), dtype=np.int32)
    offsets[1:] = np.cumsum(np.bincount(text, minlength=len(words.bounds) - 1)) * 2
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1).astype(np.int32)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 5, broadcast: int = BROADCAST_FINGERPRINTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Finds the words of each document that lie in a window of a benchmark item.

    Words are runs of digits, letters and non-ASCII characters of the lower-cased
    (A-Z) text. A window is `window` consecutive words of an item; an item of fewer
    words is one window. Both sides keep the least hash of each run of
    window - gram + 1 word grams, so any shared window shares a fingerprint. Fingerprints
    of documents are joined with those of the benchmark, and those found are
    extended to all windows around them, which are joined by 128 bits with the items' windows.
    Returns key, n_words, n_hit, n_items, items (ids as strings, sorted), spans
    (hit word ranges), contaminated, then the carried columns; one row per input row.

    Fingerprints and windows of the benchmark are tables in the shared folder. Up to `broadcast`
    fingerprints, as counted, are broadcast as a sorted array, so that only windows
    around a hit leave the documents' tasks; more are joined by a shuffle of the
    documents' fingerprints. What was found is broadcast to the documents where it is
    counted to be small, else joined by row; rows are told apart by 128 bits of key and text. The lists of items that
    windows have are broadcast by the summed number of their ids. A window that very many documents have is
    a single row on the benchmark's side, so Spark can split that key.

    Null or empty texts have no words and no hits; items without words or without
    an id match nothing; rows that repeat a key are judged each by itself; an
    empty benchmark leaves every document clean.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_key).cast("string").alias("id"), F.col(item_text).alias("text")).filter("id is not null and text is not null").distinct()
    both = stored(items.mapInArrow(_of_items(window, gram), "id string, k int, a long, b long, f long"))
    windows = both.filter("f is null").groupBy("k", "a", "b").agg(F.array_sort(F.collect_set("id")).alias("items"))
    windows = stored(windows.withColumn("set", F.xxhash64("items")))
    sets = windows.groupBy("set").agg(F.first("items").alias("items"))
    prints = stored(both.filter("f is not null").select("f").distinct())
    n_prints = prints.count()
    per_set = windows.groupBy("set").agg(F.first(F.size("items")).alias("items"), F.count("*").alias("n"), F.collect_set("k").alias("k"))
    n_windows, n_listed, sizes = per_set.agg(F.sum("n"), F.sum("items"), F.flatten(F.collect_set("k"))).first()
    lengths = sorted({k for k in sizes if k < window})

    body = F.coalesce(F.col(text), F.lit(""))
    rid = pair_hash(F.col(key).isNull(), F.col(key), body).alias("rid")
    texts = docs.select(rid, body.alias("text"))
    schema = f"rid {PAIR}, p int, k int, a long, b long"
    if n_prints <= broadcast:
        known = np.sort(prints.toArrow().column("f").to_numpy().view(np.uint64))
        around = texts.mapInArrow(_candidates(spark.sparkContext.broadcast(known), window, gram, lengths), schema) if n_prints else spark.createDataFrame([], schema)
    else:
        met = texts.mapInArrow(_of_docs(window, gram, lengths), f"rid {PAIR}, f long, p int, k int").join(prints, "f")
        places = met.groupBy("rid").agg(F.collect_set(F.struct("p", "k")).alias("places"))
        around = texts.dropDuplicates(["rid"]).join(places, "rid").mapInArrow(_candidates_at(window, gram), schema)
    table = windows.select("k", "a", "b", "set")
    hits = around.distinct().join(F.broadcast(table) if (n_windows or 0) <= BROADCAST_ROWS else table, ["k", "a", "b"])
    hits = stored(hits.select("rid", "p", "k", "set"))
    named = hits.select("rid", "set").distinct().join(F.broadcast(sets) if (n_listed or 0) <= BROADCAST_ROWS else sets, "set").select("rid", F.explode("items").alias("item"))
    named = named.groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # windows that overlap or touch are one range
    by_row = Window.partitionBy("rid").orderBy("p", "end")
    upto = F.max("end").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    ranges = hits.select("rid", "p", (F.col("p") + F.col("k")).alias("end")).distinct().withColumn("new", (F.coalesce(upto, F.lit(-1)) < F.col("p")).cast("int"))
    ranges = ranges.withColumn("range", F.sum("new").over(by_row)).groupBy("rid", "range").agg(F.min("p").alias("p"), (F.max("end") - F.min("p")).alias("k"))
    found = stored(ranges.groupBy("rid").agg(F.collect_list(F.struct("p", "k")).alias("hits")).join(named, "rid"))

    row = F.struct(F.col(key).alias("key"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))
    small = found.agg(F.coalesce(F.sum(F.size("hits") + F.size("items")), F.lit(0))).first()[0] <= BROADCAST_ROWS
    out = docs.select(rid, row.alias("row"), body.alias("text")).join(F.broadcast(found) if small else found, "rid", "left")
    kind = out.schema["row"].dataType.simpleString()
    out = out.select("row", "text", "hits", F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")).mapInArrow(_judged, f"row {kind}, n_words long, spans array<int>, items array<string>")
    ranged = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 1), F.lit(0).cast("long"), lambda a, i: a + F.when(i % 2 == 1, F.get("spans", i)).otherwise(-F.get("spans", i)))
    return out.select(
        F.col("row.key").alias(key),
        "n_words",
        F.when(F.size("spans") > 0, ranged).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
        (F.size("spans") > 0).alias("contaminated"),
        *(F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)),
    )
