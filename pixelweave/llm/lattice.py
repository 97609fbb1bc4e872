"""Document probability from the lattice of all subword segmentations.

The units are the pieces of an existing vocabulary, all single bytes and the end
of a text. A text is its words, each after a space, and the end; a segmentation is
a sequence of units that spells it, and its probability the product of the units'.
The probability of the text is the sum over all segmentations. No piece goes over
a space, so that sum is a product of sums over words, each found by a forward
recursion in log space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import NON_SPACE, Block, Words, blocks, mix, row_struct, unpack_row
from .shared import PAIR, checkpointed, pair_hash, stored

#: Rounds of expectation and maximisation that fit the pieces' probabilities.
ROUNDS = 3
#: Words with at least this share of all training tokens are looked up on the map
#: side; there are at most 1 / share of them, whatever the input.
HEAD_SHARE = 1 / (1 << 20)
#: Text of a block whose distinct words are scored together.
BLOCK = 1 << 22
#: Words whose lattices are held at once.
SLICE = 1 << 14
#: and their bytes: a lattice takes some 12 bytes for each byte of a word and length of piece.
SLICE_BYTES = 1 << 18

_U = np.uint64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_SLOTS = 1 << 20
NEVER = -1e30


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hash(view: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the bytes at each place; view reads eight bytes from any place."""
    h = mix((view[at] & _MASK[min(length, 8)]) ^ _U(length << 56))
    for k in range(8, length, 8):
        h = mix(h * _U(0x9E3779B97F4A7C15) + (view[at + k] & _MASK[min(length - k, 8)]))
    return h


def _view(data: np.ndarray) -> np.ndarray:
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


@dataclass
class Units:
    """Byte strings of the vocabulary (a space marks a word's begin) with log probabilities."""

    spelled: list[bytes]
    logp: np.ndarray
    end_logp: float

    def __post_init__(self):
        self.table = np.full(_SLOTS, -1, dtype=np.int32)
        self.hashes = np.zeros(len(self.spelled) + 1, dtype=np.uint64)
        self.lengths = np.array([len(s) for s in self.spelled])
        self.longest = int(self.lengths.max())
        for k, s in enumerate(self.spelled):
            own = np.frombuffer(s + bytes(8 + -len(s) % 8), dtype=np.uint8)
            self.hashes[k] = _hash(_view(own), np.array([0]), len(s))[0]
        for k in np.argsort(self.lengths, kind="stable"):
            at = int(self.hashes[k] & _U(_SLOTS - 1))
            while self.table[at] >= 0:
                at = (at + 1) % _SLOTS
            self.table[at] = k

    def find(self, view: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """Unit spelled by the bytes at each place, or -1."""
        h = _hash(view, at, length)
        slot = (h & _U(_SLOTS - 1)).astype(np.int64)
        unit = self.table[slot]
        open_ = np.flatnonzero((unit >= 0) & (self.hashes[unit] != h))
        while open_.size:
            slot[open_] = (slot[open_] + 1) % _SLOTS
            unit[open_] = self.table[slot[open_]]
            open_ = open_[(unit[open_] >= 0) & (self.hashes[unit[open_]] != h[open_])]
        return unit


def load_units(path: str | None = None) -> Units:
    """Units from a vocabulary file, with first probabilities from its scores; no piece is left out for its length.

    The scores of a unigram vocabulary are log probabilities and are taken as they are. Those of a BPE
    vocabulary are whole numbers, the merges' ranks: the piece of rank r has, by Zipf's law, a weight of
    1 / (r + 10). Single bytes come after all pieces. Pieces with capitals are not needed, as texts are lower-cased.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    score: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k):
            continue
        spelled = model.id_to_piece(k).replace("▁", " ").encode()
        if b" " not in spelled[1:] and spelled == spelled.lower():
            score.setdefault(spelled, model.get_score(k))
    order = sorted(score, key=lambda s: (-score[s], s))
    single = [b for b in (bytes([k]) for k in range(256)) if b not in score and b.lower() == b]
    if all(float(x).is_integer() for x in score.values()):
        weight = 1 / (np.arange(len(order) + len(single)) + 10.0)
    else:
        weight = np.exp(np.array([score[s] for s in order] + [min(score.values()) - 1] * len(single)))
    p = weight / weight.sum() * 0.99
    return Units(order + single, np.log(p), float(np.log(0.01)))


class Lattice:
    """Arcs of the lattices of a batch of distinct words."""

    def __init__(self, units: Units, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts + 1
        self.by_size = np.argsort(-size, kind="stable")
        size = size[self.by_size]
        self.size = size
        self.first = np.cumsum(size) - size
        total = int(size.sum())
        spelled = np.zeros(total + units.longest + 16, dtype=np.uint8)
        source = np.arange(total) + np.repeat(starts[self.by_size] - 1 - self.first, size)
        spelled[:total] = data[np.maximum(source, 0)]
        spelled[self.first] = 0x20
        view = _view(spelled)
        left = np.repeat(self.first + size, size) - np.arange(total)
        self.unit = []
        for length in range(1, units.longest + 1):
            at = np.flatnonzero(left >= length)
            arc = np.full(total, -1, dtype=np.int32)
            arc[at] = units.find(view, at, length)
            self.unit.append(arc)
        #: Lengths of the pieces that these words have.
        self.steps = [k for k, arc in enumerate(self.unit, start=1) if (arc >= 0).any()]
        self.units = units
        self.total = total
        logp = np.append(units.logp, NEVER)
        self.arc = [logp[u] for u in self.unit]
        #: How many words have at least so many bytes.
        self.active = np.searchsorted(-size, -np.arange(1, (int(size[0]) if len(size) else 0) + 1), side="right")

    def forward(self) -> np.ndarray:
        """log of the summed probability of all ways from the word's begin to each place (size + 1 places a word)."""
        words = len(self.size)
        node = self.first + np.arange(words)
        alpha = np.full(self.total + words, NEVER)
        alpha[node] = 0
        for j, n in enumerate(self.active, start=1):
            ways = np.stack([alpha[node[:n] + (j - k)] + self.arc[k - 1][self.first[:n] + (j - k)] for k in self.steps if k <= j])
            best = ways.max(axis=0)
            alpha[node[:n] + j] = best + np.log(np.exp(ways - best).sum(axis=0))
        return alpha

    def backward(self) -> np.ndarray:
        words = len(self.size)
        node = self.first + np.arange(words)
        beta = np.full(self.total + words, NEVER)
        beta[node + self.size] = 0
        for j in range(len(self.active) - 1, -1, -1):
            n = self.active[j]
            reach = []
            for k in (k for k in self.steps if k <= len(self.active) - j):
                fits = self.active[j + k - 1]
                way = np.full(n, NEVER)
                way[:fits] = self.arc[k - 1][self.first[:fits] + j] + beta[node[:fits] + j + k]
                reach.append(way)
            ways = np.stack(reach)
            best = ways.max(axis=0)
            beta[node[:n] + j] = best + np.log(np.exp(ways - best).sum(axis=0))
        return beta

    def word_logp(self) -> np.ndarray:
        alpha = self.forward()
        out = np.empty(len(self.size))
        out[self.by_size] = alpha[self.first + np.arange(len(self.size)) + self.size]
        return out

    def expected(self, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each unit over all segmentations of the words, so many times each."""
        alpha, beta = self.forward(), self.backward()
        node = self.first + np.arange(len(self.size))
        whole = alpha[node + self.size]
        place = np.arange(self.total) + np.repeat(np.arange(len(self.size)), self.size)
        base = np.repeat(np.log(counts[self.by_size]) - whole, self.size) + alpha[place]
        out = np.zeros(len(self.units.spelled))
        for k in self.steps:
            at = np.flatnonzero(self.unit[k - 1] >= 0)
            use = np.exp(base[at] + self.arc[k - 1][at] + beta[place[at] + k])
            out += np.bincount(self.unit[k - 1][at], use, minlength=len(out))
        return out


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words whose lattices are held at once: at most SLICE words and SLICE_BYTES bytes, or one longer word."""
    upto = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = int(np.searchsorted(upto, upto[first] - sizes[first] + SLICE_BYTES, side="right"))
        last = min(max(last, first + 1), first + SLICE, len(sizes))
        yield first, last
        first = last


def word_logp(units: Units, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log probability of each word; words of like sizes are taken together."""
    out = np.empty(len(starts))
    order = np.argsort(ends - starts, kind="stable")
    for first, last in slices((ends - starts)[order]):
        part = order[first:last]
        out[part] = Lattice(units, data, starts[part], ends[part]).word_logp()
    return out


def distinct_words(block: Block):
    """Words of a block, the first place of each different one, which one each is, and their hashes."""
    words = block.words(NON_SPACE, lower=True)
    (h,) = words.hashes()
    known, first, which = np.unique(h, return_index=True, return_inverse=True)
    return words, first, which, known.view(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0), BLOCK):
            words, first, which, known = distinct_words(block)
            spelled = _strings(words.data, words.starts[first], words.ends[first])
            yield pa.RecordBatch.from_arrays([spelled, pa.array(np.bincount(which, minlength=len(first)).astype(np.int64))], names=["word", "n"])


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    raw = data[np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], size)]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(raw))


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (block,) = list(blocks(column, 1 << 62)) or [None]
    return block.data, block.offsets[:-1], block.offsets[1:]


def fit(counts: DataFrame, units: Units, n_texts: int, rounds: int = ROUNDS) -> Units:
    """Probabilities of the units by expectation maximisation over all training words.

    counts: word, n. A round is a pass over the distinct words; only one row for
    each unit of the vocabulary comes back. The first probabilities stay in the sum
    with the weight of one unit in all, so that none is lost.
    """
    spark = counts.sparkSession
    prior = np.exp(units.logp)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(units)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for first, last in slices(pc.binary_length(batch.column(0)).to_numpy()):
                    part = batch.slice(first, last - first)
                    got = Lattice(shared.value, *_joined(part.column(0))).expected(part.column(1).to_numpy().astype(np.float64))
                    total = got if total is None else total + got
            if total is not None:
                at = np.flatnonzero(total > 0)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["unit", "uses"])

        uses = counts.select("word", "n").mapInArrow(expect, "unit int, uses double").groupBy("unit").agg(F.sum("uses").alias("uses")).toArrow()
        weight = prior.copy()
        weight[uses.column("unit").to_numpy()] += uses.column("uses").to_numpy()
        whole = weight.sum() + n_texts + 0.01
        units = Units(units.spelled, np.log(weight / whole), float(np.log((n_texts + 0.01) / whole)))
        shared.unpersist()
    return units


def held_out(key):
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))


def lattice_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Probability of each text, learnt from the texts that are not held out.

    Held out are keys whose crc32 (as text) mod 7 is 2. A-Z are lower-cased; tokens
    are the words (runs of anything but ASCII white space) and one end. Returns key,
    held_out, n_tokens, n_known (tokens whose training count c > 0), train_tokens
    (N), base_score (sum of log10((c+1)/(N+V+1)), V distinct training tokens) and
    score (log10 of the summed probability of all segmentations of the whole text).

    The training words are counted by a shuffle and kept in the shared folder; their
    number is not bounded, so they are never broadcast whole. Words with at least
    HEAD_SHARE of all tokens, at most 1 / HEAD_SHARE of them, are; the others'
    counts come by a join on the word's hash in which no word has more than that
    share of the tokens, and are summed by document. The pieces' probabilities are
    as many as the vocabulary has.

    A null or empty text is its end alone; a null key is not held out; repeated rows
    count and are scored each; with nothing to learn from, N is 0 and the first
    probabilities stay. With rounds=0 they stay in any case: the vocabulary's own
    scores weigh all segmentations. A row is told apart by 128 bits of key and text, a word known by its 64-bit hash.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    training = docs.filter(~held_out(F.col(key)))
    words = training.select(body.alias("text")).mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = checkpointed(words)
    n_words, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_texts = training.count()
    tokens, kinds = n_words + n_texts, n_kinds + (n_texts > 0)
    units = fit(words, load_units(vocabulary), n_texts, rounds)

    keyed = words.mapInArrow(_keyed, "h long, n long")
    head = keyed.filter(F.col("n") >= HEAD_SHARE * tokens).toArrow()
    order = np.argsort(head.column("h").to_numpy())
    shared = spark.sparkContext.broadcast((units, head.column("h").to_numpy()[order], head.column("n").to_numpy()[order], tokens, kinds, n_texts))

    rows = docs.select(row_struct((key,)), pair_hash(F.col(key).isNull(), F.col(key), body).alias("rid"), body.alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    made = rows.mapInArrow(_score(shared), f"row {kind}, rid {PAIR}, n_tokens long, n_known long, base double, score double, h long, times int")
    made = stored(made)
    # a row without h is a document's own; the others are words that were not looked up yet
    tail = made.filter("h is not null").select("rid", "h", "times")
    found = tail.join(keyed.filter(F.col("n") < HEAD_SHARE * tokens).select("h", "n"), "h", "left")
    log_base = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(tokens + kinds + 1)))
    rest = found.groupBy("rid").agg(F.sum(F.col("times") * log_base).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("known"))
    own = made.filter("h is null").drop("h", "times")
    rest = rest.join(own.groupBy("rid").agg(F.count("*").alias("m")), "rid").select("rid", (F.col("more") / F.col("m")).alias("more"), F.expr("known div m").alias("known"))  # of rows that are all alike
    own = own.join(rest, "rid", "left")
    known = F.col("n_known") + F.coalesce("known", F.lit(0))
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    return unpack_row(own, (key,), held_out(F.col("row.c0")).alias("held_out"), F.col("n_tokens"), known.alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("score"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            data, starts, ends = _joined(batch.column(0))
            block = Block(0, 1, np.append(data, np.zeros(8, dtype=np.uint8)), np.array([0, len(data)]))
            (h,) = Words(block.data, starts, ends, np.array([0, len(starts)])).hashes()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(1)], names=["h", "n"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, head, head_n, tokens, kinds, n_texts = shared.value
        lower = float(tokens + kinds + 1)
        end_base = np.log10((n_texts + 1) / lower)
        for batch in batches:
            for block in blocks(batch.column(2), BLOCK):
                words, first, which, known = distinct_words(block)
                count = words.counts()
                text = words.text_of()
                logp = word_logp(units, words.data, words.starts[first], words.ends[first]) / np.log(10)
                at = np.minimum(np.searchsorted(head, known), max(len(head) - 1, 0))
                in_head = (head[at] == known) if len(head) else np.zeros(len(known), dtype=bool)
                base = np.where(in_head, np.log10(((head_n[at] if len(head) else 0) + 1) / lower), 0.0)
                n = len(count)
                own = block.last - block.first
                score = np.bincount(text, logp[which], minlength=n) + units.end_logp / np.log(10)
                based = np.bincount(text, base[which], minlength=n) + end_base
                hit = np.bincount(text, in_head[which], minlength=n).astype(np.int64) + (n_texts > 0)
                rest = np.flatnonzero(~in_head[which])
                pair, times = np.unique(text[rest].astype(np.int64) * len(first) + which[rest], return_counts=True)
                owner, kind = pair // max(1, len(first)), pair % max(1, len(first))
                rid = batch.column(1).slice(block.first, own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, own), rid, pa.array(count + 1, pa.int64()), pa.array(hit), pa.array(based), pa.array(score), pa.nulls(own, pa.int64()), pa.nulls(own, pa.int32())],
                    names=["row", "rid", "n_tokens", "n_known", "base", "score", "h", "times"],
                )
                for k in range(0, len(owner), 1 << 18):
                    part = owner[k : k + (1 << 18)]
                    m = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(m, batch.schema.field(0).type), rid.take(pa.array(part)), *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(known[kind[k : k + (1 << 18)]]), pa.array(times[k : k + (1 << 18)].astype(np.int32))],
                        names=["row", "rid", "n_tokens", "n_known", "base", "score", "h", "times"],
                    )

    return run
