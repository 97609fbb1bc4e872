"""Near duplicates by SimHash and a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored

SHINGLE = 4
SEED = 42
#: Bits in which linked fingerprints differ at most.
BUDGET = 4
#: One trie for each: the bits it begins with, as (first, number), and the errors it
#: allows within them. Two words that differ in more bits than that at the beginning
#: of all three differ in 2 + 2 + 1 bits.
TRIES = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
#: A node with more words is split before its pairs are given to tasks, by so many bits.
LEAF, STEP = 2048, 5
#: Node pairs of so few word pairs are compared word by word.
FEW = 64
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 16

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def simhash(text: bytes) -> int:
    """64 bits, the first being the highest: 1 where over half of the shingles' hashes have it."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    ends = ends[size - 1 :]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), SHINGLES):
        hashes = [digest(plain[i:j], SEED) for i, j in zip(starts[k : k + SHINGLES].tolist(), ends[k : k + SHINGLES].tolist())]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the 64 bits as a signed long) of each row; one text at a time is held."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash((t.as_py() or "").encode()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp long")


def _rotated(word: Column, by: int) -> Column:
    by %= 64
    return F.shiftleft(word, by).bitwiseOR(F.shiftrightunsigned(word, 64 - by)) if by else word


def _allowed(trie: int, depth: int) -> int:
    """Errors that trie allows two prefixes of that depth."""
    _, width, budget = TRIES[trie]
    return budget if depth <= width else BUDGET


def _split(words: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where the nodes low..high-1 of that depth go on with a 1."""
    prefix = words[low] >> np.uint64(63 - depth)
    return np.clip(np.searchsorted(words, (prefix | np.uint64(1)) << np.uint64(63 - depth)), low, high)


def trie_pairs(x: np.ndarray, y: np.ndarray | None, trie: int, depth: int, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the linked words under a pair of nodes of that depth; y is None for a node with itself.

    The words, sorted, are the trie: a node is a range of them. Pairs of nodes go down
    together, level by level, with the bits in which they differ so far; those over
    the budget are dropped with all that is under them.
    """
    same = y is None
    y = x if same else y
    one = lambda n: np.array([n], dtype=np.int64)
    xl, xh, yl, yh, e = one(0), one(len(x)), one(0), one(len(y)), one(errors)
    while len(e):
        few = ((xh - xl) * (yh - yl) <= FEW) | (depth == 64)
        if few.any():
            n = (xh - xl)[few] * (yh - yl)[few]
            pair = np.repeat(np.flatnonzero(few), n)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            wide = (yh - yl)[pair]
            i, j = xl[pair] + nth // wide, yl[pair] + nth % wide
            if same:
                i, j = i[i < j], j[i < j]
            near = np.bitwise_count(x[i] ^ y[j]) <= BUDGET
            yield i[near], j[near]
            xl, xh, yl, yh, e = xl[~few], xh[~few], yl[~few], yh[~few], e[~few]
            if not len(e):
                return
        xm, ym = _split(x, xl, xh, depth), _split(y, yl, yh, depth)
        depth += 1
        mirrored = (xl == yl) & (xh == yh) if same else np.zeros(len(e), dtype=bool)
        ways = ((xl, xm, yl, ym, e), (xm, xh, ym, yh, e), (xl, xm, ym, yh, e + 1), *[tuple(v[~mirrored] for v in (xm, xh, yl, ym, e + 1))])
        xl, xh, yl, yh, e = (np.concatenate(v) for v in zip(*ways))
        left = (xl < xh) & (yl < yh) & (e <= _allowed(trie, depth))
        xl, xh, yl, yh, e = xl[left], xh[left], yl[left], yh[left], e[left]


def forest(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least number that each of n is connected to."""
    label = np.arange(n)
    for i, j in found:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (label[label] != label).any():
                label = label[label]
    return label


def _linked(table: pa.Table) -> pa.Table:
    """A tree of links (rotated words a, b) for what is connected under a pair of nodes."""
    trie, depth, errors = (table.column(c)[0].as_py() for c in ("trie", "depth", "errors"))
    side = table.column("side").to_numpy()
    words = table.column("word").to_numpy().view(np.uint64)
    x, y = np.sort(words[side == 0]), np.sort(words[side == 1])
    if len(y):
        both = np.concatenate([x, y])
        label = forest(len(both), ((i, j + len(x)) for i, j in trie_pairs(x, y, trie, depth, errors)))
    else:
        both = x
        label = forest(len(x), trie_pairs(x, None, trie, depth, errors))
    at = np.flatnonzero(label != np.arange(len(label)))
    kind = np.full(len(at), trie, dtype=np.int32)
    return pa.table({"trie": kind, "a": both[at].view(np.int64), "b": both[label[at]].view(np.int64)})


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("word", 64 - depth) if depth else F.lit(0).cast("long")


def _children(pairs: DataFrame, nodes: DataFrame, depth: int, step: int) -> DataFrame:
    """The pairs of nodes `step` bits further down that are within their trie's budget."""
    masks = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("more")) for m in sorted(range(1 << step), key=int.bit_count)))
    below = reduce(lambda rest, t: F.when(F.col("trie") == t, _allowed(t, depth)).otherwise(rest), range(len(TRIES)), F.lit(BUDGET))
    first = pairs.withColumnRenamed("u", "up").join(nodes.select("trie", F.shiftrightunsigned("node", step).alias("up"), F.col("node").alias("u"), F.col("n").alias("n_u")), ["trie", "up"])
    ways = F.filter(masks, lambda m: F.col("errors") + m["more"] <= below)
    met = first.select("trie", "u", "n_u", F.col("up").alias("up_u"), F.col("v").alias("up_v"), "errors", F.explode(ways).alias("way"))
    v = F.shiftleft("up_v", step).bitwiseOR(F.col("u").bitwiseAND((1 << step) - 1).bitwiseXOR(F.col("way.mask")))
    met = met.select("trie", "u", "n_u", v.alias("v"), (F.col("errors") + F.col("way.more")).alias("errors"), (F.col("up_u") == F.col("up_v")).alias("mirrored"))
    found = met.filter("not mirrored or u <= v").join(nodes.select("trie", F.col("node").alias("v"), F.col("n").alias("n_v")), ["trie", "v"])
    return found.select("trie", "u", "v", "errors", "n_u", "n_v")


def hamming_links(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(a, b): links between different 64-bit words (column fp, distinct) that connect what differs in BUDGET bits or fewer.

    Each of three tries, of the words rotated, is joined with itself. The top of the
    joins is done on tables: pairs of nodes with their errors go down some bits at a
    time, are dropped over the budget, and are split on while a node has more than
    `leaf` words, so a crowd of like words is spread over pairs of small nodes. The
    rest of a pair is one task's, and ends in a tree of links for what is connected.
    Nothing is cut off. Words that crowd within a few bits are compared in pairs of
    nodes, in number the square of the crowd over `leaf`.
    """
    spark = words.sparkSession
    words = stored(words.select("fp"))
    n = words.count()
    tries = F.array(*(F.struct(F.lit(t).alias("trie"), _rotated(F.col("fp"), first).alias("word")) for t, (first, _, _) in enumerate(TRIES)))
    words = words.select(F.explode(tries).alias("x")).select("x.trie", "x.word")
    depth = max(0, ceil(log2(n / leaf))) if n > leaf else 0
    nodes = lambda at: words.groupBy("trie", _prefix(at).alias("node")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    pairs = spark.range(len(TRIES)).select(F.col("id").cast("int").alias("trie"), zero.alias("u"), zero.alias("v"), F.lit(0).alias("errors"), F.lit(n).alias("n_u"), F.lit(n).alias("n_v"))
    at, done = 0, []
    while True:
        wide, more = F.greatest("n_u", "n_v") > leaf, pairs
        if at >= depth:
            done.append((at, pairs.filter(~wide)))
            more = pairs.filter(wide)
            if at == 64 or more.isEmpty():
                break
        step = min(STEP, (depth if at < depth else 64) - at)
        at += step
        pairs = stored(_children(more.drop("n_u", "n_v"), nodes(at), at, step))
    dealt = []
    for at, ready in done:
        side = lambda mine, k: ready.select("trie", F.col(mine).alias("node"), "u", "v", "errors", F.lit(k).alias("side"))
        members = side("u", 0).unionByName(side("v", 1).filter("u != v"))
        dealt.append(words.withColumn("node", _prefix(at)).join(members, ["trie", "node"]).select("trie", F.lit(at).alias("depth"), "u", "v", "errors", "side", "word"))
    grouped = reduce(DataFrame.unionByName, dealt).groupBy("trie", "depth", "u", "v")
    links = grouped.applyInArrow(_linked, "trie int, a long, b long")
    back = lambda c: reduce(lambda rest, t: F.when(F.col("trie") == t, _rotated(F.col(c), -TRIES[t][0])).otherwise(rest), range(len(TRIES)), F.col(c)).alias(c)
    return links.select(back("a"), back("b")).distinct()


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (the least key reachable by links), one row for each row.

    A fingerprint bit is 1 if over half of the XXH64 hashes (seed 42) of a text's
    four-word shingles have it; fewer words are one shingle, none (null, empty) give
    zero, which is linked like any other. Fingerprints link if they differ in four
    bits or fewer, equal ones included. Null keys are passed over for the least key; a
    component of nothing else has null. Repeated rows are equal texts. Other columns
    are left out, whatever their names. An empty table gives none.
    """
    rows = stored(fingerprints(docs, key, text))
    least = stored(rows.groupBy("fp").agg(F.min("key").alias("least")))
    labels = components(hamming_links(least, leaf))
    known = least.join(labels.select(F.col("v").alias("fp"), "label"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    known = stored(known)
    whole = known.groupBy("label").agg(F.min("least").alias("component_id"))
    # keyed by a hash that only this join uses, so that Spark can split a fingerprint that very many rows have
    named = known.withColumn("l", F.xxhash64("label")).join(whole.select(F.xxhash64("label").alias("l"), "component_id"), "l").select(F.xxhash64("fp").alias("k"), "component_id")
    found = rows.withColumn("k", F.xxhash64("fp")).join(named, "k")
    return found.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
