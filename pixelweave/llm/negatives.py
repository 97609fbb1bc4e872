"""Hard negatives by branch and bound over ball trees."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

POSITIVES, NEGATIVES = 5, 3
#: A negative scores from this share of its positive's score to that one, in hundredths.
FLOOR, CEILING = 50, 95
#: Rows of a tree, anchors that search it at once, rows of a tree's leaf.
ROWS, ANCHORS, LEAF = 16384, 4096, 128
#: Vectors are scaled by SCALE and rounded down; scores of those shorter than this fit a long.
SCALE, LONGEST = 256, float(1 << 31)


class BallTree:
    """Rows in balls within balls; a leaf's rows are neighbours in `rows`.

    Rows of several labels are parted by label first, then by distance from two far
    points. Each node has its centre, radius and least and greatest label.
    """

    def __init__(self, rows: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(rows))
        self._rows, self._labels, self._leaf = rows, labels, leaf
        self.centre, self.radius, self.span, self.labels, self.children = [], [], [], [], []
        stack = [(0, len(rows), None)]
        while stack:
            low, high, parent = stack.pop()
            me = len(self.radius)
            if parent is not None:
                self.children[parent].append(me)
            own = rows[self.order[low:high]]
            centre = own.mean(axis=0)
            self.centre.append(centre)
            self.radius.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
            kinds = labels[self.order[low:high]]
            self.labels.append((int(kinds.min()), int(kinds.max())))
            self.span.append((low, high))
            self.children.append([])
            cut = self._cut(low, high, own, centre, kinds)
            if cut:
                stack += [(low, low + cut, me), (low + cut, high, me)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.length = np.sqrt((self.centre**2).sum(axis=1))

    def _cut(self, low: int, high: int, own: np.ndarray, centre: np.ndarray, kinds: np.ndarray) -> int:
        """Puts low..high-1 in order and says how many go to the first child; 0 for a leaf."""
        n = high - low
        if n <= self._leaf:
            return 0
        if kinds.min() != kinds.max():
            order = np.argsort(kinds, kind="stable")
            borders = np.flatnonzero(np.diff(kinds[order])) + 1
            cut = int(borders[np.abs(borders - n // 2).argmin()])
        elif self.radius[-1] == 0:
            return 0
        else:
            one = own[((own - centre) ** 2).sum(axis=1).argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            order, cut = np.argsort(own @ (other - one), kind="stable"), n // 2
        self.order[low:high] = self.order[low:high][order]
        return cut

    def bounds(self, node: int, query: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What inner products with the node's rows are not under and not over, with room for rounding."""
        middle = query @ self.centre[node]
        room = length * self.radius[node]
        room = room + 1e-9 * (length * (self.length[node] + self.radius[node]) + 1)
        return middle - room, middle + room


def best(tree: BallTree, rows: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, labels: np.ndarray, want: str, rid: np.ndarray, own: np.ndarray):
    """(search, score, row) of each search's first k rows by score, then id, among those with low <= score <= high.

    want is "same" or "other": the label of the rows against the search's. A search
    finds no row whose rid is its own. All searches go down the tree together; a node
    is left by those whose window it is outside of, and by those that have k rows that
    are all better than any under it.
    """
    n = len(query)
    length = np.sqrt((query**2).sum(axis=1))
    kth = low.astype(np.float64)
    held = [np.zeros(0, dtype=np.int64)] * 3  # search, score, row
    exact = np.float64 if rows.shape[1] * float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) < 2**53 else np.int64
    whole, asked = rows.astype(exact), query.astype(exact)

    stack = [(0, np.arange(n))]
    while stack:
        node, who = stack.pop()
        first, last = tree.labels[node]
        who = who[(first <= labels[who]) & (labels[who] <= last)] if want == "same" else who[(first != labels[who]) | (last != labels[who])]
        if not len(who):
            continue
        under, over = tree.bounds(node, query[who], length[who])
        who = who[(over >= kth[who]) & (under <= high[who])]
        if not len(who):
            continue
        if tree.children[node]:
            # the child that promises more comes first
            mean = query[who].mean(axis=0)
            stack += [(child, who) for child in sorted(tree.children[node], key=lambda c: mean @ tree.centre[c])]
            continue
        at = tree.order[slice(*tree.span[node])]
        score = asked[who] @ whole[at].T
        fits = (score >= kth[who, None]) & (score <= high[who, None]) & (rid[at][None, :] != own[who, None])
        fits &= (tree._labels[at][None, :] == labels[who, None]) == (want == "same")
        i, j = np.nonzero(fits)
        if not len(i):
            continue
        met = np.isin(held[0], who[i])
        s, v, r = (np.concatenate([h[met], x]) for h, x in zip(held, (who[i], score[i, j].astype(np.int64), at[j])))
        order = np.lexsort((rid[r], ids[r], -v, s))
        s, v, r = s[order], v[order], r[order]
        start = np.flatnonzero(np.diff(s, prepend=-1))
        nth = np.arange(len(s)) - np.repeat(start, np.diff(start, append=len(s)))
        full = nth == k - 1
        kth[s[full]] = np.maximum(kth[s[full]], v[full])
        held = [np.concatenate([h[~met], x[nth < k]]) for h, x in zip(held, (s, v, r))]
    return held


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of whole numbers as rows; those that are shorter than the longest end in zeros."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    made = np.zeros((len(lists), int(sizes.max(initial=0))), dtype=np.float64)
    made[np.arange(made.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return made


def _fitted(rows: pa.Table, anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    a, b = _matrix(rows.column("q")), _matrix(anchors.column("q"))
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (a, b))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _positives(k: int, leaf: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found, at = [np.zeros(0, dtype=np.int64)] * 3, _column(anchors, "rid")
        if rows.num_rows and anchors.num_rows:
            x, query = _fitted(rows, anchors)
            labels, rid, ids = _column(rows, "label"), _column(rows, "rid"), _column(rows, "id")
            none, any_ = np.full(len(query), -np.inf), np.full(len(query), np.inf)
            found = best(BallTree(x, labels, leaf), x, ids, query, k, none, any_, _column(anchors, "label"), "same", rid, at)
        search, score, row = found
        return pa.table({"anchor": at[search], "score": score, "id": _column(rows, "id")[row], "rid": _column(rows, "rid")[row]})

    return run


def _negatives(k: int, leaf: int, floor: int, ceiling: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found, whose, nth = [np.zeros(0, dtype=np.int64)] * 3, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if rows.num_rows and anchors.num_rows:
            x, query = _fitted(rows, anchors)
            labels, rid, ids = _column(rows, "label"), _column(rows, "rid"), _column(rows, "id")
            lists = anchors.column("scores").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            whose = np.repeat(np.arange(len(query)), sizes)
            nth = np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            goal = lists.flatten().to_numpy()
            # whole numbers: the least score of 100 * score >= floor * goal, the greatest of 100 * score <= ceiling * goal
            low, high = -((-floor * goal) // 100), (ceiling * goal) // 100
            found = best(BallTree(x, labels, leaf), x, ids, query[whose], k, low, high, _column(anchors, "label")[whose], "other", rid, np.full(len(whose), -1))
        search, score, row = found
        return pa.table({"anchor": _column(anchors, "rid")[whose[search]], "positive": nth[search].astype(np.int32), "score": score, "id": _column(rows, "id")[row], "rid": _column(rows, "rid")[row]})

    return run


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = SCALE) -> DataFrame:
    """rid, id, label, q (floor(scale * x) of each component) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    q = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    short = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) < (LONGEST / scale) ** 2 / 4
    named = F.col(label) if isinstance(label, str) else label
    kept = vectors.filter(F.col(key).isNotNull() & named.isNotNull() & F.col(vector).isNotNull() & whole & short)
    return kept.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("id"), named.cast("long").alias("label"), q.alias("q"))


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, tree: int, block: int, group):
    """group() on each part of the rows with each block of the anchors."""
    parts, blocks = max(1, ceil(n_rows / tree)), max(1, ceil(n_anchors / block))
    of = lambda n, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("part", of(parts, 1)).withColumn("block", all_of(blocks))
    right = anchors.withColumn("block", of(blocks, 2)).withColumn("part", all_of(parts))
    left, right = (df.repartition(parts * blocks, "part", "block") for df in (left, right))
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(*group)


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, floor: int = FLOOR, ceiling: int = CEILING, tree: int = ROWS, block: int = ANCHORS, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of the vectors times scale, rounded down. The rows for
    which `anchor` (a column over key) holds are anchors. An anchor's positives are its
    first rows of the same label, without itself, by score, then key. For each of them
    come the first rows of other labels with floor * positive <= 100 * score <=
    ceiling * positive.

    All rows are dealt to parts of about `tree` rows by a hash, so labels and like
    vectors spread; each part grows a ball tree and each block of anchors searches
    it, first for positives, then for negatives. Parts give k rows for each search, of
    which the k best are kept.

    Rows with a null key, label or vector, or with a component that is null or not
    finite, take no part; nor do vectors of a length of 2**30 or more when scaled, whose scores
    might not fit a long. Vectors that are shorter than others end in zeros. Rows that
    share a key are rows of their own, also against each other. An anchor without
    positives or negatives has no rows, so an empty table gives none. Other columns
    are left out, whatever their names.
    """
    rows = stored(whole_vectors(vectors, key, vector, label, scale))
    asked = rows.filter(anchor)
    n, n_asked = rows.count(), asked.count()
    near = _cells(rows, asked, n, n_asked, tree, block, (_positives(positives, leaf), "anchor long, score long, id long, rid long"))
    near = stored(_ranked(near, positives, "anchor").withColumn("positive", F.col("rank") - 1))
    goals = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("positive", "score"))).alias("x"))
    goals = asked.join(goals.select(F.col("anchor").alias("rid"), F.col("x.score").alias("scores")), "rid")
    far = _cells(rows, stored(goals), n, n_asked, tree, block, (_negatives(negatives, leaf, floor, ceiling), "anchor long, positive int, score long, id long, rid long"))
    far = _ranked(far, negatives, "anchor", "positive")
    named = near.join(asked.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor", "anchor_id", "positive", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = far.select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "positive"])
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
