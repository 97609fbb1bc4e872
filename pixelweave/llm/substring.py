"""Substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .arrowtext import NON_SPACE, RollingHash, blocks, covered, mix, row_struct, sliding, unpack_row, window_is_inside
from .shared import distinct_hash, stored

_LAST = (1 << 63) - 1


def _anchors(window: int, gram: int, below: int = 0):
    """For every window, its least gram; rows (gram, text, row, position).

    Equal windows have equal least grams, so a window can only repeat if the gram
    chosen for it repeats as well. With below, places of surviving grams of that
    length are given and only grams in a window with one are kept: a window that
    repeats has one that was chosen for it at the level before.
    """
    width = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in blocks(batch.column(3)):
                words = block.words(NON_SPACE)
                (hashes,) = words.hashes()
                if len(hashes) < window:
                    continue
                grams = RollingHash(hashes).all(gram)
                least = sliding(np.minimum, grams, width)
                least = np.where(window_is_inside(words.bounds, window)[: len(least)], least, 0)
                edge = np.zeros(width - 1, dtype=np.uint64)
                chosen = sliding(np.maximum, np.concatenate([edge, least, edge]), width) == grams
                if below:
                    at = _places(batch.column(5), block, words)
                    chosen &= covered(len(grams), np.clip(at - (window - below), 0, len(grams)), np.minimum(at + (window - gram) + 1, len(grams)))
                chosen = np.flatnonzero(chosen)
                text = words.text_of()[chosen]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[chosen].view(np.int64)), pa.array(texts[block.first + text]), pa.array(rids[block.first + text]), pa.array((chosen - words.bounds[text]).astype(np.int32))],
                    names=["gram", "t", "rid", "p"],
                )

    return run


def _places(column: pa.Array, block, words) -> np.ndarray:
    """Places in the block's words of the lists of places in its texts."""
    part = column.slice(block.first, block.last - block.first)
    return part.flatten().to_numpy() + np.repeat(words.bounds[:-1], part.value_lengths().fill_null(0).to_numpy())


def _windows(window: int, half: int, every: bool = False):
    """Hashes of the windows that hold a surviving half-window, one row per text and hash, or every one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, order = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for block in blocks(batch.column(3)):
                words = block.words(NON_SPACE)
                hashes = words.hashes(2)
                if len(hashes[0]) < window:
                    continue
                at = _places(batch.column(5), block, words)
                n = len(hashes[0]) - window + 1
                wanted = covered(n, np.clip(at - (window - half), 0, n), np.minimum(at + 1, n))
                starts = np.flatnonzero(wanted & window_is_inside(words.bounds, window)[:n])
                text = words.text_of()[starts]
                h1, h2 = (RollingHash(h).at(starts, starts + window) for h in hashes)
                by = np.lexsort((starts, h1, text))
                new = np.ones(len(by), dtype=bool)
                new[1:] = every | (h1[by][1:] != h1[by][:-1]) | (text[by][1:] != text[by][:-1])
                keep = by[new]
                text = text[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1[keep].view(np.int64)),
                        pa.array((h2[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        pa.array(order[block.first + text]),
                        pa.array(rids[block.first + text]),
                        pa.array((starts[keep] - words.bounds[text]).astype(np.int32)),
                    ],
                    names=["h1", "h2", "ord", "rid", "s"],
                )

    return run


def _removal(window: int, with_text: bool):
    """Marks and removes words; late holds one place of every window to remove, or -1 for all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(5)
            for block in blocks(batch.column(3)):
                words = block.words(NON_SPACE)
                total = len(words.starts)
                gone = np.zeros(total, dtype=bool)
                counts = words.counts()
                part = places.slice(block.first, block.last - block.first)
                lengths = part.value_lengths().fill_null(0).to_numpy()
                whole = np.zeros(len(counts), dtype=bool)
                if lengths.any():
                    (hashes,) = words.hashes()
                    rolling = RollingHash(hashes)
                    at, owner = part.flatten().to_numpy(), np.repeat(np.arange(len(counts)), lengths)
                    whole[owner[at < 0]] = True
                    owner, at = owner[at >= 0], at[at >= 0]
                    lengths = np.bincount(owner, minlength=len(counts))
                    at = at + words.bounds[owner]
                    texts = np.flatnonzero(lengths)
                    inside = np.flatnonzero(window_is_inside(words.bounds, window) & np.repeat(lengths > 0, counts))
                    salt = mix(np.arange(len(counts), dtype=np.uint64))
                    text = words.text_of()
                    bad = rolling.at(at, at + window) ^ np.repeat(salt[texts], lengths[texts])
                    every = rolling.at(inside, inside + window) ^ salt[text[inside]]
                    hit = inside[np.isin(every, bad)]
                    gone = covered(total, hit, hit + window)
                gone |= np.repeat(whole & (counts >= window), counts)
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.bounds[:-1]) * (counts > 0) if len(counts) else counts
                raw, kept = block.data.tobytes(), []
                for k in range(len(counts)):
                    low, high = words.bounds[k], words.bounds[k + 1]
                    left = np.arange(low, high) if not removed[k] else low + np.flatnonzero(~gone[low:high])
                    begins, ends = words.starts[left].tolist(), words.ends[left].tolist()
                    kept.append(b" ".join([raw[b:e] for b, e in zip(begins, ends)]))
                texts = [x if removed[k] else raw[block.offsets[k] : block.offsets[k + 1]] for k, x in enumerate(kept)] if with_text else []
                out = [batch.column(4).slice(block.first, block.last - block.first), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                if with_text:
                    out.append(pa.array([x.decode() for x in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["row", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(out)])

    return run


def _levels(window: int) -> list[int]:
    """Lengths that lead to the window: halves of it, rounded up, down to some ten words."""
    lengths = [window]
    while lengths[0] > 20:
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths if len(lengths) > 1 else [max(1, window // 2), window]


def _ordered(docs: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """The rows and a long that orders them by key, null last.

    Keys that are no whole numbers are sorted by ranges and numbered: numbers of later
    partitions are larger.
    """
    if isinstance(docs.schema[key].dataType, IntegralType):
        return docs, F.coalesce(F.col(key).cast("long"), F.lit(_LAST))
    at, of = f"_order_of_{key}", f"_ordered_{key}"
    ranks = stored(docs.select(F.col(key).alias(of)).distinct().orderBy(of).select(of, F.monotonically_increasing_id().alias(at)))
    ranked = docs.join(ranks, F.col(key).eqNullSafe(F.col(of)), "left").drop(of)
    return ranked, F.when(F.col(key).isNull(), _LAST).otherwise(F.col(at))


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes word windows that also start in a document of a smaller key.

    Words are runs of anything but ASCII white space, unchanged. A window is
    `window` consecutive words of one document; each word covered by a window
    whose word sequence also starts in a document with a smaller key is removed,
    judged on the input. Returns key, n_words, n_removed, kept_sha256 (of the kept
    words joined by one space), with_text also kept_text (the text itself if nothing
    was removed, else the kept words joined by one space), then the carried columns.

    The text is dealt out once, by row, and all passes read that one exchange.
    Levels double from 13 words over 25 to 50: at each, of the grams of its length the
    least of each window is kept if the window has a gram that survived the level before, and
    survives if it is found in more than one text. Whole windows are compared by 96 bits
    and the least key of each is found. A document whose whole text is in a smaller
    key's is known by its text's hash and loses all windows.
    The tables of grams, windows and texts hold a row for each key of theirs and
    are joined on a hash of it, so that both sides of a join are dealt out for it
    alone and Spark can split a passage that is in very many documents.

    No level over the window is needed to remove words, as a longer repeat is a run of
    repeated windows; repeat_levels goes on to the end.

    Null texts have no words. Keys are of any type that has an order; those that are no
    whole numbers are numbered in that order first. A null key counts as larger than any other. Rows that
    repeat a key are one document for the comparison: they take nothing from each
    other; each row is returned. Rows of one key and text are alike. An empty table gives an empty result.
    """
    lengths = _levels(window)
    half = lengths[-2]
    docs, order = _ordered(docs, key)
    body = F.coalesce(F.col(text), F.lit(""))
    t, rid = distinct_hash(docs, body).alias("t"), distinct_hash(docs, F.col(key).isNull(), F.col(key), body).alias("rid")
    base = docs.select(rid, t, order.alias("ord"), body.alias("text"), row_struct((key, *carry))).repartition("rid")

    def survivors(anchors: DataFrame) -> DataFrame:
        """Places of the grams that are in more than one text, as a list for each row."""
        repeated = anchors.groupBy("gram").agg(F.min("t").alias("low"), F.max("t").alias("high")).filter("low < high").select(F.xxhash64("gram").alias("k"))
        return anchors.select(F.xxhash64("gram").alias("k"), "rid", "p").join(repeated, "k").groupBy("rid").agg(F.collect_set("p").alias("places"))

    def level(span: int, gram: int, below: int, places: DataFrame | None) -> DataFrame:
        rows = base.join(places, "rid") if places is not None else base
        return survivors(rows.mapInArrow(_anchors(span, gram, below), "gram long, t long, rid long, p int"))

    places = None
    for below, gram in zip([0, *lengths], lengths[:-1]):
        places = level(window, gram, below, places)

    windows = base.join(places, "rid").mapInArrow(_windows(window, half), "h1 long, h2 int, ord long, rid long, s int")
    least = windows.groupBy("h1", "h2").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).filter("least < most").select(F.xxhash64("h1").alias("k"), "h2", "least")
    late = windows.select(F.xxhash64("h1").alias("k"), "h2", "ord", "rid", "s").join(least, ["k", "h2"]).filter("ord > least").select("rid", "s")

    # only t, ord and rid are wanted here, so this is read from the input and not from the exchange of texts
    own = docs.select(t, order.alias("ord"), rid)
    firsts = own.groupBy("t").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first < last").select(F.xxhash64("t").alias("k"), "first")
    copies = own.select(F.xxhash64("t").alias("k"), "ord", "rid").join(firsts, "k").filter("ord > first").select("rid", F.lit(-1).alias("s"))

    gone = late.unionByName(copies).groupBy("rid").agg(F.collect_set("s").alias("late"))
    kind = base.schema["row"].dataType.simpleString()
    done = base.join(gone, "rid", "left").mapInArrow(_removal(window, with_text), f"row {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    made = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    return unpack_row(done, (key, *carry), *map(F.col, made)).select(key, *made, *carry)


def _doubled(length: int):
    """Hashes of the windows of a length whose two halves both survived."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places = batch.column(5)
            for block in blocks(batch.column(3)):
                words = block.words(NON_SPACE)
                hashes = words.hashes(2)
                part = places.slice(block.first, block.last - block.first)
                owner = np.repeat(np.arange(block.last - block.first), part.value_lengths().to_numpy())
                at = part.flatten().to_numpy() + words.bounds[owner]
                survived = np.zeros(len(words.starts) + length, dtype=bool)
                survived[at] = True
                fits = (at + length <= words.bounds[owner + 1]) & survived[at + length // 2]
                owner, at = owner[fits], at[fits]
                h1, h2 = (RollingHash(h).at(at, at + length) for h in hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(texts[block.first + owner]), pa.array(rids[block.first + owner]), pa.array((at - words.bounds[owner]).astype(np.int32))],
                    names=["h1", "h2", "t", "rid", "p"],
                )

    return run


def repeat_levels(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """How far repeats go: (key, place, length) of every window that is also in another text.

    From half-windows to windows as in substring_dedup; then windows whose both
    halves are also in another text are extended to twice the length, and so on
    until no candidate survives. length is the last at which the words from a place
    on are also in another text. Each level is kept in the shared folder; its size
    bounds the next.

    Null and short texts have no rows; equal texts are one text; rows that repeat a
    key each have theirs.
    """
    half = window // 2
    docs, order = _ordered(docs, key)
    body = F.coalesce(F.col(text), F.lit(""))
    t, rid = distinct_hash(docs, body).alias("t"), distinct_hash(docs, F.col(key).isNull(), F.col(key), body).alias("rid")
    base = docs.select(rid, t, order.alias("ord"), body.alias("text"), row_struct((key,))).repartition("rid")

    def repeated(found: DataFrame, *by: str) -> DataFrame:
        shared = found.groupBy(*by).agg(F.min("t").alias("low"), F.max("t").alias("high")).filter("low < high").select(F.xxhash64(*by).alias("k"))
        return found.select(F.xxhash64(*by).alias("k"), "rid", "p").join(shared, "k").select("rid", "p").distinct()

    def with_places(left: DataFrame) -> DataFrame:
        return base.join(left.groupBy("rid").agg(F.collect_set("p").alias("places")), "rid")

    anchors = repeated(base.mapInArrow(_anchors(window, half), "gram long, t long, rid long, p int"), "gram")
    windows = with_places(anchors).mapInArrow(_windows(window, half, every=True), "h1 long, h2 int, ord long, rid long, s int")
    windows = windows.join(base.select("rid", "t").distinct(), "rid").select("h1", "h2", "t", "rid", F.col("s").alias("p"))
    length, levels = window, [stored(repeated(windows, "h1", "h2").withColumn("length", F.lit(window)))]
    while not levels[-1].isEmpty():
        length *= 2
        found = with_places(levels[-1]).mapInArrow(_doubled(length), "h1 long, h2 long, t long, rid long, p int")
        levels.append(stored(repeated(found, "h1", "h2").withColumn("length", F.lit(length))))
    longest = reduce(DataFrame.unionByName, levels).groupBy("rid", "p").agg(F.max("length").alias("length"))
    named = base.select("rid", F.col("row.c0").alias("key"))
    return named.join(longest, "rid").select(F.col("key").alias(key), F.col("p").alias("place"), "length")
