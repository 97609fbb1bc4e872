"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import ALNUM, RollingHash, blocks, mix
from .components import components
from .shared import distinct_hash, small_side, stored

SHINGLE = 5
THRESHOLD = 0.8
#: Samples are compared in bands of so many rows; a pair of likeness 0.8 meets in
#: none of them with a probability of 0.59 ** 20 = 3e-5.
BANDS, ROWS = 20, 4
#: Shingles of at least this share of the documents weigh less the more have them.
COMMON_SHARE = 1 / 1024
IDF_WEIGHT = 0.5
#: Draws of the sampling variables are looked up in a table of so many. Elements that
#: share a draw are still told apart by their hash, so what the table costs is the
#: resolution of a: the least of n elements is among the lowest of the 65,536 values
#: and ties, taken by the hash, come up for sets of thousands of elements. Estimates
#: stay within sampling error for sets of up to 20,000 (see the tests).
DRAWS = 1 << 16
SLICE = 256

_U = np.uint64


def raw_shingles(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and hash of each word shingle, by row, for blocks of whole texts.

    Words are runs of lower-cased letters and digits; a text of fewer words than a
    shingle has one of all of them.
    """
    for block in blocks(column):
        words = block.words(ALNUM, lower=True, accents=True)
        (h,) = words.hashes()
        if not len(h):
            continue
        rolling = RollingHash(h)
        n, text = words.counts(), words.text_of()
        at = np.flatnonzero(np.arange(len(h)) + size <= np.repeat(words.bounds[1:], n))
        gram, owner = rolling.all(size)[at] if len(h) >= size else np.zeros(0, dtype=np.uint64), text[at]
        short = np.flatnonzero((n > 0) & (n < size))
        if short.size:
            gram = np.concatenate([gram, rolling.at(words.bounds[short], words.bounds[short + 1])])
            owner = np.concatenate([owner, short])
        yield owner + block.first, gram


def _distinct(owner: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different shingles and their counts, by text, in one sort of text and shingle."""
    base = owner.min() if len(owner) else 0
    if len(owner) and int(owner.max() - base) < 1 << 20:
        order = np.argsort((owner - base).astype(np.uint64) << _U(44) | gram >> _U(20))
    else:
        order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], gram[first], np.diff(np.append(first, len(gram)))


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each text's different shingles, by row."""
    found = [_distinct(*raw) for raw in raw_shingles(column, size)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


@dataclass
class Weights:
    """TF-IDF weights: of rare shingles alike, of common ones by their document count."""

    common: np.ndarray
    df: np.ndarray
    n_docs: int
    share: float = COMMON_SHARE

    def __post_init__(self):
        rare = max(self.n_docs * self.share, 1e-9)
        self.rarest = 1 + IDF_WEIGHT
        self.idf = 1 + IDF_WEIGHT * np.log(self.n_docs / np.maximum(self.df, rare)) / np.log(1 / self.share) if len(self.df) else np.zeros(0)

    def of(self, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = np.full(len(gram), self.rarest)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, gram), len(self.common) - 1)
            hit = self.common[at] == gram
            w[hit] = self.idf[at[hit]]
        return w * count


def _sortable(x: np.ndarray) -> np.ndarray:
    """32-bit floats as integers of the same order, in the upper half of 64 bits."""
    bits = x.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << _U(32)


class Sampler:
    """Improved consistent weighted samples: of each weighted set the element of the least a.

    r and c are gamma(2, 1) and b uniform, drawn for each element and sample; with t =
    floor(ln w / r + b) and ln y = r (t - b), ln a = ln c - ln y - r. Two sets share a
    sample (element and t) with the probability of their weighted Jaccard likeness.
    The draws are looked up in a table by a hash of the element and sample. a gives t
    away, so the pair (a, hash of the element) is the sample.
    """

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, DRAWS)
        self.ln_c = np.log(rng.gamma(2, 1, DRAWS))
        self.b = rng.random(DRAWS)
        self.odd = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * _U(2) + _U(1)
        self.flip = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
        self.tables: dict[float, np.ndarray] = {}

    def _ln_a(self, draw, ln_w):
        r, b = self.r[draw], self.b[draw]
        return self.ln_c[draw] - r * (np.floor(ln_w / r + b) - b) - r

    def __call__(self, gram: np.ndarray, weight: np.ndarray, starts: np.ndarray, usual: float) -> np.ndarray:
        """Samples (sets x samples) of the sets that begin at starts; usual is the weight of most elements."""
        if usual not in self.tables:
            self.tables[usual] = _sortable(self._ln_a(np.arange(DRAWS), np.log(usual)))
        table = self.tables[usual]
        odd_ones = np.flatnonzero(weight != usual)
        ln_w = np.log(weight[odd_ones])
        out = np.empty((len(starts), len(self.odd)), dtype=np.uint64)
        for k, (odd, flip) in enumerate(zip(self.odd, self.flip)):
            x = (gram ^ flip) * odd
            draw = x >> _U(48)
            key = table[draw]
            if odd_ones.size:
                key[odd_ones] = _sortable(self._ln_a(draw[odd_ones], ln_w))
            key |= (x >> _U(16)) & _U(0xFFFFFFFF)
            out[:, k] = np.minimum.reduceat(key, starts)
        return out


def band_hashes(samples: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = samples.shape[1] // bands
    cut = samples.reshape(len(samples), bands, rows)
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(samples), 1))
    for k in range(rows):
        h = mix(h * _U(0x9E3779B97F4A7C15) + cut[:, :, k])
    return h


def likeness(left: pa.Array, right: pa.Array, weights: Weights) -> np.ndarray:
    """Weighted Jaccard likeness of the texts of each row; 0 if both have no words."""
    n = len(left)
    (ra, ga, ca), (rb, gb, cb) = shingles(left), shingles(right)
    wa, wb = weights.of(ga, ca), weights.of(gb, cb)
    row, gram, w = np.concatenate([ra, rb]), np.concatenate([ga, gb]), np.concatenate([wa, wb])
    order = np.lexsort((gram, row))
    row, gram, w = row[order], gram[order], w[order]
    same = np.flatnonzero((row[1:] == row[:-1]) & (gram[1:] == gram[:-1]))
    both = np.bincount(row[same], np.minimum(w[same], w[same + 1]), minlength=n)
    whole = np.bincount(row, w, minlength=n) - both
    return np.divide(both, whole, out=np.zeros(n), where=whole > 0)


#: Slots of the tables that sort out shingles before they are looked at one by one.
SLOTS = 1 << 22
_SHIFT = _U(64 - 22)
#: Shingles of batches that are counted together.
HELD = 1 << 23


def _maybe_common(share: float):
    """Shingles that are at least half as common in some batches as asked for, and how often they are there at most.

    Batches are taken together until a shingle has to be there more than once, or
    their shingles are as many as may be held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rows, size = [], 0, 0

        def common() -> pa.RecordBatch:
            gram, least = np.concatenate(grams), rows * share / 2
            slot = (gram >> _SHIFT).astype(np.int64)
            gram, n = np.unique(gram[(np.bincount(slot, minlength=SLOTS) >= least)[slot]], return_counts=True)
            keep = n >= least
            return pa.RecordBatch.from_arrays([pa.array(gram[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            for _, gram in raw_shingles(batch.column(0)):
                grams.append(gram)
                size += len(gram)
            rows += batch.num_rows
            if grams and (rows * share >= 4 or size >= HELD):
                yield common()
                grams, rows, size = [], 0, 0
        if grams:
            yield common()

    return run


def _counted(shared):
    """Document counts, within each batch, of the shingles asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        slots = np.zeros(SLOTS, dtype=bool)
        slots[(common >> _SHIFT).astype(np.int64)] = True
        for batch in batches:
            found = []
            for owner, gram in raw_shingles(batch.column(0)):
                at = np.flatnonzero(slots[(gram >> _SHIFT).astype(np.int64)])
                owner, gram = owner[at], gram[at]
                hit = common[np.minimum(np.searchsorted(common, gram), len(common) - 1)] == gram
                found.append(_distinct(owner[hit], gram[hit])[1])
            if found:
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return run


def fit_weights(docs: DataFrame, text: str, n_docs: int, share: float = COMMON_SHARE) -> Weights:
    """Document counts, over all documents, of the shingles that at least `share` of them have.

    Over the batches where such a shingle is at least half as common it has at least
    half of its share of all documents. There are at most 2 / share shingles of that
    kind for each shingle of a mean text, whatever the number of documents; they are
    counted exactly in a second pass.
    """
    none = np.zeros(0, dtype=np.uint64)
    if not n_docs:
        return Weights(none, np.zeros(0), 0, share)
    # tasks of enough rows that what is there once in one is not taken to be common
    texts = docs.select(F.col(text).alias("text")).coalesce(max(1, int(n_docs * share / 8)))
    total = lambda function: texts.mapInArrow(function, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    maybe = np.sort(total(_maybe_common(share)).filter(F.col("n") >= n_docs * share / 2).toArrow().column("gram").to_numpy().view(np.uint64))
    if not len(maybe):
        return Weights(none, np.zeros(0), n_docs, share)
    exact = total(_counted(docs.sparkSession.sparkContext.broadcast(maybe))).filter(F.col("n") >= n_docs * share).toArrow()
    gram = exact.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(gram)
    return Weights(gram[order], exact.column("n").to_numpy()[order], n_docs, share)


def _samples(column: pa.Array, weights: Weights, sampler: Sampler) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have words, their samples and their whole weights."""
    row, gram, count = shingles(column)
    if not len(row):
        return row, np.zeros((0, len(sampler.odd)), dtype=np.uint64), np.zeros(0)
    which, starts = np.unique(row, return_index=True)
    w = weights.of(gram, count)
    return which, sampler(gram, w, starts, weights.rarest), np.add.reduceat(w, starts)


def _bands(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                which, samples, _ = _samples(part.column(1), shared.value, sampler)
                t = part.column(0).to_numpy()[which]
                yield pa.RecordBatch.from_arrays([pa.array(band_hashes(samples).reshape(-1).view(np.int64)), pa.array(np.repeat(t, BANDS))], names=["bh", "t"])

    return run


def _verified(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(likeness(part.column(2), part.column(3), shared.value))], names=["a", "b", "likeness"])

    return run


def _links(shared, threshold: float):
    """Links between members of a bucket's part that are in different classes, one for each member and class.

    A member outside of the main class is compared with all others at once: its
    weights are laid out by shingle and every other member's are gathered from there.
    """

    def run(table: pa.Table) -> pa.Table:
        t, label, main = (table.column(c).to_numpy() for c in ("t", "label", "main"))
        row, gram, count = shingles(table.column("text").combine_chunks())
        w = shared.value.of(gram, count)
        _, place = np.unique(gram, return_inverse=True)
        starts = np.searchsorted(row, np.arange(len(t) + 1))
        whole = np.bincount(row, w, minlength=len(t))
        laid = np.zeros(len(gram))
        once = table.column("once")[0].as_py()
        a, b = [], []
        for i in np.flatnonzero(~main):
            own = slice(starts[i], starts[i + 1])
            other = (label != label[i]) & (main | (once & (t > t[i]))) & (np.minimum(whole, whole[i]) >= threshold * np.maximum(whole, whole[i]) * (1 - 1e-9))
            if not other.any():
                continue
            laid[place[own]] = w[own]
            both = np.bincount(row, np.minimum(w, laid[place]), minlength=len(t))
            laid[place[own]] = 0
            at = np.flatnonzero(other & (both >= threshold * (whole + whole[i] - both) * (1 - 1e-12)) & (both > 0))
            _, first = np.unique(label[at], return_index=True)
            a.append(np.full(len(first), t[i]))
            b.append(t[at[first]])
        none = [np.zeros(0, dtype=np.int64)]
        return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})

    return run


#: Members of a bucket's main class, and as many of its others, that are compared in one task.
PART = 256
#: Buckets of more members are compared with several hubs, and narrowed if that leaves more unlike ones.
LARGE = 2048
#: Rounds in which large buckets are compared with a hub.
STARS = 6


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Classes of near duplicates: key and class_id (the least key of the class), one row per input row.

    Two texts are linked if the weighted Jaccard likeness of their five-word
    shingles is at least the threshold; a class is what links connect. Weights are
    counts times an idf from 1 to 1 + IDF_WEIGHT, by the exact document count; it is
    flat for shingles that less than COMMON_SHARE of the documents have.

    Equal texts are one text. Those that share a band of weighted samples with
    another are kept in the shared folder. In each bucket (texts of one band value)
    all are compared with one of them, the hub, which then leaves the bucket; large
    buckets go on with other hubs. Then the members outside of a bucket's main class
    are compared with all members of other classes, in parts of the bucket; if they
    are many, only with those that share one of their rarest shingles, as all that
    are linked do. Every comparison is by the likeness of whole texts. Links within a class are not
    looked for, and no bucket is cut off.

    Texts without words (null, empty) are equal to those of the same text only, null
    being empty. A null key comes after all others and its class_id is null only in
    a class of null keys. Repeated rows are equal texts. An empty table gives none.
    """
    named = _named(docs, key, text, threshold)
    classes = named.groupBy("c").agg(F.min("key").alias("class_id")).select(F.xxhash64("c").alias("k"), "class_id")
    return named.withColumn("k", F.xxhash64("c")).join(classes, "k").select(F.col("key").alias(key), "class_id")


def row_id(key: str = "doc_id", text: str = "text") -> Column:
    """128 bits of key and text that tell rows apart; a null text is empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))
    return F.unhex(F.md5(F.concat(F.md5(body), named)))


def row_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """rid (row_id) of each row and the rid that its class keeps: that of the least key (null last), then the least hash of the text."""
    named = stored(_named(docs, key, text, threshold, row_id(key, text)))
    least = named.groupBy("c").agg(F.min(F.struct(F.col("key").isNull(), "key", "t", "rid")).alias("least")).select(F.xxhash64("c").alias("k"), F.col("least.rid").alias("kept"))
    return named.withColumn("k", F.xxhash64("c")).join(least, "k").select("rid", "kept")


def _named(docs: DataFrame, key: str, text: str, threshold: float, *more: Column) -> DataFrame:
    """key, t (hash of the text), c (class) and rid, if asked for, of each row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).alias("text")
    t = distinct_hash(docs, body).alias("t")
    texts = docs.select(t, body)
    n_docs = docs.count()
    weights = spark.sparkContext.broadcast(fit_weights(texts, "text", n_docs))

    banded = stored(texts.mapInArrow(_bands(weights), "bh long, t long"))
    buckets = banded.groupBy("bh").agg(F.min("t").alias("hub"), F.max("t").alias("top")).filter("hub < top").select(F.xxhash64("bh").alias("k"), "hub")
    members = stored(banded.select(F.xxhash64("bh").alias("k"), "t").join(buckets, "k").distinct())
    # one row of each text that is in a bucket; the rows of a copied text are told apart by their key
    rid = F.xxhash64(F.col(key), body).alias("rid")
    first = docs.select(t, rid).groupBy("t").agg(F.min("rid").alias("rid")).join(members.select("t").distinct(), "t").select("rid")
    first = small_side(stored(first))
    kept = docs.select(rid, t, body).join(first, "rid").dropDuplicates(["t"])
    kept = stored(kept.select("t", "text"))

    def verified(pairs: DataFrame) -> DataFrame:
        one = pairs.withColumn("k", F.xxhash64("a")).join(kept.select(F.xxhash64("t").alias("k"), F.col("text").alias("x")), "k")
        two = one.select("a", "b", "x").withColumn("k", F.xxhash64("b")).join(kept.select(F.xxhash64("t").alias("k"), F.col("text").alias("y")), "k")
        found = two.select("a", "b", "x", "y").mapInArrow(_verified(weights), "a long, b long, likeness double")
        return stored(found.filter(F.col("likeness") >= threshold).select("a", "b"))

    links = verified(members.filter("t != hub").select(F.col("hub").alias("a"), F.col("t").alias("b")).distinct())
    left = members.filter("t != hub").select("k", "t")
    for star in range(1, STARS + 1):
        labels = components(links)
        known = _mixed(left, labels)
        if star == STARS or known.filter(F.col("n") > LARGE).isEmpty():
            break
        hubs = known.filter(F.col("n") > LARGE).groupBy("k").agg(F.min(F.struct(F.xxhash64("t", F.lit(star)).alias("o"), "t", "label")).alias("hub"))
        met = stored(known.join(hubs, "k").select("k", "t", (F.col("label") != F.col("hub.label")).alias("new"), F.col("hub.t").alias("hub")))
        links = links.unionByName(verified(met.filter("new").select(F.least("t", "hub").alias("a"), F.greatest("t", "hub").alias("b")).distinct()))
        left = known.filter(F.col("n") <= LARGE).select("k", "t").unionByName(met.filter("t != hub").select("k", "t"))
    links = links.unionByName(_rest(known, kept, labels, weights, threshold))
    labels = components(links)

    rows = docs.select(F.col(key).alias("key"), t, *(m.alias("rid") for m in more))
    return rows.withColumn("k", F.xxhash64("t")).join(labels.select(F.xxhash64("v").alias("k"), "label"), "k", "left").select("key", "t", F.coalesce("label", "t").alias("c"), *(["rid"] if more else []))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, t, label, n, n_top, top) of the buckets whose members are in more than one class.

    Buckets of the same members, as told by their number and 128 bits over all of
    them, are taken once: those of a group of near copies are alike in many bands.
    """
    known = members.withColumn("v", F.xxhash64("t")).join(labels.select(F.xxhash64("v").alias("v"), "label"), "v", "left").select("k", "t", F.coalesce("label", "t").alias("label"))
    bits = {f"bits{i}": F.xxhash64(F.lit(i), "t") for i in (1, 2)}
    sizes = known.groupBy("k", "label").agg(F.count("*").alias("n"), *(F.bit_xor(b).alias(i) for i, b in bits.items()))
    mixed = sizes.groupBy("k").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), *(F.bit_xor(i).alias(i) for i in bits), F.max("n").alias("n_top"), F.max_by("label", F.struct("n", "label")).alias("top")).filter("classes > 1")
    mixed = mixed.groupBy("n", *bits).agg(F.min(F.struct("k", "n_top", "top")).alias("x")).select(F.col("x.k").alias("k"), "n", F.col("x.n_top").alias("n_top"), F.col("x.top").alias("top"))
    return stored(known.join(mixed, "k"))


def _weighted(shared):
    """A row for each different shingle of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                row, gram, count = shingles(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(gram.view(np.int64)), pa.array(shared.value.of(gram, count))], names=["t", "gram", "w"])

    return run


def _narrowed(known: DataFrame, kept: DataFrame, labels: DataFrame, weights, threshold: float) -> DataFrame:
    """The members of buckets with many members outside of the main class, in buckets of one shingle each.

    A text's shingles are ordered by how many of these texts have them, the rarest
    first; what comes after its prefix weighs less than the threshold's share of it.
    Two texts that are linked share a shingle of both prefixes, so no link is lost,
    and what many of the texts have in common is in no prefix unless a text is
    mostly that.
    """
    texts = known.select("t").distinct().withColumn("h", F.xxhash64("t")).join(kept.select(F.xxhash64("t").alias("h"), "text"), "h").select("t", "text")
    grams = stored(texts.mapInArrow(_weighted(weights), "t long, gram long, w double"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often")).select(F.xxhash64("gram").alias("k"), "often")
    ranked = grams.withColumn("k", F.xxhash64("gram")).join(often, "k").select("t", "gram", "w", "often")
    own = Window.partitionBy("t")
    rest = F.sum("w").over(own.orderBy(F.desc("often"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prefix = ranked.select("t", "gram", rest.alias("rest"), F.sum("w").over(own).alias("whole")).filter(F.col("rest") >= threshold * (1 - 1e-9) * F.col("whole"))
    return _mixed(prefix.select(F.xxhash64("gram").alias("k"), "t"), labels)


def _dealt(known: DataFrame) -> DataFrame:
    """(k, part, once, t, label, main): each bucket in parts of at most about twice PART members.

    The main class and the others are cut into slots of about PART members. Each
    slot of the one meets each of the other, and slots of the others meet in pairs,
    the later one in the place of the main class.
    """
    slots = lambda n: F.greatest(F.ceil(n / PART), F.lit(1)).cast("int")
    mains, others = slots(F.col("n_top")), slots(F.col("n") - F.col("n_top"))
    main = F.col("label") == F.col("top")
    slot = F.pmod(F.xxhash64("t", "k"), F.when(main, mains).otherwise(others)).cast("int")
    part = lambda i, j, pair, as_main: F.struct(i.alias("i"), j.alias("j"), F.lit(pair).alias("pair"), as_main.alias("main"))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    of_main = F.transform(each(others), lambda j: part(F.col("slot"), j, False, F.lit(True)))
    of_other = F.transform(each(mains), lambda i: part(i, F.col("slot"), False, F.lit(False)))
    pairs = F.transform(F.filter(each(others), lambda j: j != F.col("slot")), lambda j: part(F.least(j, "slot"), F.greatest(j, "slot"), True, j < F.col("slot")))
    parts = known.withColumn("slot", slot).select("k", "t", "label", F.explode(F.when(main, of_main).otherwise(F.concat(of_other, pairs))).alias("x"))
    return parts.select("k", F.struct("x.i", "x.j", "x.pair").alias("part"), (~F.col("x.pair") & (F.col("x.i") == 0)).alias("once"), "t", "label", F.col("x.main").alias("main"))


def _rest(known: DataFrame, kept: DataFrame, labels: DataFrame, weights, threshold: float) -> DataFrame:
    """Links between classes within the buckets, in parts of at most about twice PART texts.

    With up to LARGE members outside of a bucket's main class its members are in few
    parts each; a bucket with more of them is narrowed first.
    """
    wide = F.col("n") - F.col("n_top") > LARGE
    if not (many := known.filter(wide)).isEmpty():
        known = known.filter(~wide).unionByName(_narrowed(many, kept, labels, weights, threshold))
    dealt = _dealt(known).withColumn("h", F.xxhash64("t")).join(kept.select(F.xxhash64("t").alias("h"), "text"), "h").select("k", "part", "once", "t", "label", "main", "text")
    return stored(dealt.groupBy("k", "part").applyInArrow(_links(weights, threshold), "a long, b long"))
