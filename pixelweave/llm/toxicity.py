"""Toxicity scores from subword-bag embeddings, averaged into a linear softmax.

A word is the bag of its character n-grams (bytes of the lower-cased word between
two marks) and itself, hashed into buckets; its vector is the mean of its buckets'
vectors. The vectors of all words of a text are averaged and a linear softmax gives
the probability. The average is weighted by attention, the exponential of the product
of a word's vector and one learnt vector, so that a few telling words of a long text are not
drowned. Vectors, attention and softmax are trained jointly in numpy. A misspelling
that was never seen shares n-grams, and so vectors, with the words that were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import ALNUM, Block, blocks, mix, row_struct, unpack_row
from .shared import stored

#: At most so many labelled rows are brought to the driver for training, as counts of
#: words and of n-grams,
SAMPLE_ROWS = 6000
#: and at most so many rows that these have so many different words each, summed up.
SAMPLE_WORDS = 600_000
#: A row gives at most one part in so many of them.
ROW_SHARE = 8
BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5, 6)
EPOCHS = 40
#: A labelled row counts so many times a clean one, so that texts of few telling words are found.
TOXIC_WEIGHT = 2.0
#: Words of the sample whose bags are summed at once.
SLICE = 1 << 14
#: Attention is kept within plus and minus this much before the exponential.
REACH = 20.0

_U = np.uint64


def word_bags(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams and, for each word, where its bag begins (one more)."""
    length = ends - starts + 2
    offsets = np.concatenate([[0], np.cumsum(length)])
    total = int(offsets[-1])
    marked = np.zeros(total + 8, dtype=np.uint8)
    source = np.arange(total) - np.repeat(offsets[:-1] - starts + 1, length)
    inner = np.ones(total, dtype=bool)
    inner[offsets[:-1]] = False
    inner[offsets[1:] - 1] = False
    marked[:total][inner] = data[source[inner]]
    marked[offsets[:-1]] = 0x3C
    marked[offsets[1:] - 1] = 0x3E
    view = np.ndarray((total + 1,), dtype="<u8", buffer=marked, strides=(1,))
    left = np.repeat(offsets[1:], length) - np.arange(total)
    word = np.repeat(np.arange(len(starts)), length)
    owner, bucket = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        bucket.append(mix((view[at] & _U((1 << (8 * n)) - 1)) ^ _U(n << 56)))
        owner.append(word[at])
    acc = np.zeros(len(starts), dtype=np.uint64)
    if total:
        weights = mix(np.arange(1, total + 1, dtype=np.uint64) - offsets[:-1].astype(np.uint64)[word])
        acc = np.add.reduceat(mix(marked[:total].astype(np.uint64) + _U(1)) * (weights | _U(1)), offsets[:-1])
    bucket.append(mix(acc))
    owner.append(np.arange(len(starts)))
    owner, bucket = np.concatenate(owner), (np.concatenate(bucket) % _U(BUCKETS)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(starts)))])


def distinct_words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a block's distinct words; of all words, which it is and in which text."""
    words = block.words(ALNUM, lower=True, accents=True)
    (h,) = words.hashes()
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    return words.data, words.starts[first], words.ends[first], which, words.text_of()


@dataclass
class Model:
    """What scoring needs: for each bucket the softmax's log-odds and the attention of its vector, and the bias."""

    odds: np.ndarray
    attention: np.ndarray
    bias: float

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds and weight of each word."""
        if not len(starts):
            return np.zeros(0), np.zeros(0)
        bucket, bounds = word_bags(data, starts, ends)
        mean = lambda x: np.add.reduceat(x[bucket], bounds[:-1]) / np.diff(bounds)
        return mean(self.odds), np.exp(np.clip(mean(self.attention), -REACH, REACH))

    def scores(self, block: Block) -> np.ndarray:
        data, starts, ends, which, text = distinct_words(block)
        n = block.last - block.first
        odds, weight = self.word_scores(data, starts, ends)
        whole = np.bincount(text, weight[which], minlength=n)
        pull = np.bincount(text, (weight * odds)[which], minlength=n)
        logit = np.divide(pull, whole, out=np.zeros(n), where=whole > 0) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def no_model(share: float = 0.0) -> Model:
    """The same score for every text, about the share given."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), float(np.log(share / (1 - share))))


@dataclass
class Sample:
    """Different words of texts: of each use the text, the word and how often; of each word its bag."""

    text: np.ndarray
    word: np.ndarray
    count: np.ndarray
    bag: np.ndarray
    sizes: np.ndarray


def word_counts(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Hashes and numbers of each text's different words, as lists."""
    hashes, counts, ends = [], [], [0]
    for block in blocks(column):
        words = block.words(ALNUM, lower=True, accents=True)
        (h,) = words.hashes()
        text = words.text_of()
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        hashes.append(h[first].view(np.int64))
        counts.append(np.diff(np.append(first, len(h))).astype(np.int32))
        ends += (ends[-1] + np.cumsum(np.bincount(text[first], minlength=block.last - block.first))).tolist()
    none = [np.zeros(0, dtype=np.int64)]
    offsets = pa.array(ends, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(hashes or none), pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts or none), pa.int32()))


def bags(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Hash and bag of buckets of the different words of some texts."""
    hashes, buckets, sizes = [], [], []
    for block in blocks(column):
        data, starts, ends, _, _ = distinct_words(block)
        words = block.words(ALNUM, lower=True, accents=True)
        (h,) = words.hashes()
        bucket, bounds = word_bags(data, starts, ends)
        hashes.append(np.unique(h).view(np.int64))
        buckets.append(bucket.astype(np.int32))
        sizes.append(np.diff(bounds))
    none = [np.zeros(0, dtype=np.int64)]
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes or none))])
    return pa.array(np.concatenate(hashes or none), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(buckets or none), pa.int32()))


def gathered(words: pa.Array, counts: pa.Array, known: pa.Array, bag: pa.Array) -> Sample:
    """The sample from what the executors have counted; a word may be known several times."""
    own, first = np.unique(known.to_numpy(), return_index=True)
    bag = bag.take(pa.array(first))
    text = np.repeat(np.arange(len(words), dtype=np.int32), words.value_lengths().to_numpy())
    return Sample(text, np.searchsorted(own, words.flatten().to_numpy()).astype(np.int32), counts.flatten().to_numpy(), bag.flatten().to_numpy(), bag.value_lengths().to_numpy())


def fit(sample: Sample, labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, seed: int = 7, toxic_weight: float = TOXIC_WEIGHT) -> Model:
    """Trains embeddings, attention and softmax together by Adam on the cross entropy.

    A word's log-odds and attention are means over its buckets of the products of
    their vectors with the softmax's difference and the attention vector, so all
    gradients go by one number a bucket for each of the two.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float64)
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    if y.sum() in (0, n) or not len(sample.text):
        return no_model(y.sum() / max(n, 1))
    stress = np.where(y == 1, toxic_weight, 1.0) / n
    text, word, count, bag, sizes = sample.text, sample.word, sample.count, sample.bag, sample.sizes
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    slices = [slice(k, k + SLICE) for k in range(0, len(sizes), SLICE)]

    def mean(x: np.ndarray) -> np.ndarray:
        """Of each word, over its buckets."""
        return np.concatenate([np.add.reduceat(x[bag[bounds[p][0] : bounds[p.start + len(sizes[p])]]], bounds[p][: len(sizes[p])] - bounds[p][0]) for p in slices]) / sizes

    def spread(x: np.ndarray) -> np.ndarray:
        """To each bucket, from the words that have it."""
        return sum(np.bincount(bag[bounds[p][0] : bounds[p.start + len(sizes[p])]], np.repeat(x[p] / sizes[p], sizes[p]), minlength=BUCKETS) for p in slices)

    vectors = rng.normal(0, 1 / dim, (BUCKETS, dim))
    params = [vectors, rng.normal(0, 1, (2, dim)), np.array([0.0, np.log(share / (1 - share))]), rng.normal(0, 1, dim)]
    moments = None
    for epoch in range(1, epochs + 1):
        vectors, softmax, base, look = params
        lean = softmax[1] - softmax[0]
        odds, heed = mean(vectors @ lean), mean(vectors @ look)
        weight = np.exp(np.clip(heed, -REACH, REACH))
        own = count * weight[word]
        whole = np.bincount(text, own, minlength=n)
        level = np.divide(np.bincount(text, own * odds[word], minlength=n), whole, out=np.zeros(n), where=whole > 0)
        logit = level + base[1] - base[0]
        gap = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y) * stress
        own *= np.divide(gap, whole, out=np.zeros(n), where=whole > 0)[text]
        d_odds = np.bincount(word, own, minlength=len(sizes))
        d_heed = d_odds * odds - np.bincount(word, own * level[text], minlength=len(sizes))
        d_heed[np.abs(heed) >= REACH] = 0
        by_odds, by_heed = spread(d_odds), spread(d_heed)
        d_lean = by_odds @ vectors
        grads = [np.outer(by_odds, lean) + np.outer(by_heed, look) + decay * vectors, np.stack([-d_lean, d_lean]) + decay * softmax, np.array([-gap.sum(), gap.sum()]), by_heed @ vectors + decay * look]
        moments = moments or [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for (m, v), p, g in zip(moments, params, grads):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (1 - (epoch - 1) / epochs) * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    vectors, softmax, base, look = params
    return Model(vectors @ (softmax[1] - softmax[0]), vectors @ look, float(base[1] - base[0]))


def _counted(most: int):
    """Different words of each text and how often it has them: of more than `most`, those of the least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = word_counts(batch.column(2))
            if (pc.max(words.value_lengths()).as_py() or 0) > most:
                words, counts = _least(words, counts, most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), words, counts, words.value_lengths().cast(pa.int64())], names=["k", "y", "t", "words", "counts", "size"])

    return run


def _least(words: pa.ListArray, counts: pa.ListArray, most: int) -> tuple[pa.ListArray, pa.ListArray]:
    sizes = words.value_lengths().to_numpy()
    row, flat, n = np.repeat(np.arange(len(sizes)), sizes), words.flatten().to_numpy(), counts.flatten().to_numpy()
    order = np.lexsort((flat, row))
    kept = order[np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < most]
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.minimum(sizes, most))]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat[kept])), pa.ListArray.from_arrays(offsets, pa.array(n[kept]))


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known, bag = bags(batch.column(0))
        yield pa.RecordBatch.from_arrays([known, bag], names=["h", "bag"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS, **options) -> Model:
    """Fits on at most sample_rows labelled rows of at most sample_words different words in all, the first by a hash of the key.

    Rows whose crc32(key as text) mod 4 is 2 are held out. Keys of the sample are
    chosen from the labels alone; a key that repeats has the text of the least hash.
    A row with more than sample_words / ROW_SHARE different words is known by those of the least
    hashes, so that no row takes the sample for itself. The words are counted, and
    their n-grams hashed, on the executors: the driver gets numbers of bounded size and
    no texts.
    """
    usable = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)").filter(~held_out(F.col("k")))
    usable = usable.groupBy("k").agg(F.max("y").alias("y"))
    chosen = usable.orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "k")
    rows = rows.groupBy("k").agg(F.first("y").alias("y"), F.min_by("t", F.xxhash64("t")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    counted = stored(rows.select("k", "y", "t").mapInArrow(_counted(max(1, sample_words // ROW_SHARE)), f"k {kind}, y int, t string, words array<long>, counts array<int>, size long"))
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("k"), "k"))  # over sample_rows rows at most
    taken = counted.select("k", "size").select("k", upto.alias("upto")).filter(F.col("upto") <= sample_words).select("k")
    sample = counted.join(F.broadcast(taken), "k")
    found = sample.select("k", "y", "words", "counts").orderBy(F.xxhash64("k"), "k").toArrow()
    if not found.num_rows:
        return no_model()
    wanted = sample.select(F.explode("words").alias("h")).distinct()
    known = sample.select("t").mapInArrow(_bagged, "h long, bag array<int>").groupBy("h").agg(F.first("bag").alias("bag")).join(wanted, "h", "left_semi").toArrow()
    column = lambda table, name: table.column(name).combine_chunks()
    return fit(gathered(column(found, "words"), column(found, "counts"), column(known, "h"), column(known, "bag")), found.column("y").to_numpy(), **options)


def held_out(key):
    return F.crc32(key.cast("string")) % 4 == 2


def score(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """The carried columns and the probability of the label for each whole text.

    One row per input row. Null and empty texts have no words and get the bias's
    probability. Texts are worked off in blocks, so memory is bounded by a block or
    the longest text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), 1 << 19):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.last - block.first), pa.array(shared.value.scores(block))], names=["row", "score"])

    rows = docs.select(row_struct(carry), F.col(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return unpack_row(rows.mapInArrow(run, f"row {kind}, score double"), carry, F.col("score").alias(out))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Scores every document: key, held_out, score, predicted (1 if score >= threshold).

    A null key is never held out. Labels of a key that differ count as toxic; labels
    that are neither 0 nor 1 are left out. Labels of one kind alone give every text
    about that score, no usable labels about 0: nothing is known to be toxic. Repeated rows are scored each by itself and equal texts alike.
    """
    model = train(docs, labels, key, text, label, sample_rows)
    scored = score(docs, model, text, (key,))
    return scored.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
