import math
import random

from pyspark.sql import functions as F

from pixelweave.llm import negatives

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, anchor, scale=256, n_pos=5, n_neg=3):
    fit = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v) and sum(x * x for x in v) * scale**2 < 2**60]
    out = []
    for a, (i, lab, v) in enumerate(fit):
        if not anchor(i):
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), j, other) for b, (j, other, w) in enumerate(fit) if a != b]
        for s, p, _ in sorted(t for t in scores if t[2] == lab)[:n_pos]:
            near = sorted(t for t in scores if t[2] != lab and 50 * -s <= 100 * -t[0] <= 95 * -s)[:n_neg]
            out += [(i, p, k, j, -s, -t) for k, (t, j, _) in enumerate(near, 1)]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r[c] for c in NAMES) for r in negatives.hard_negatives(df, F.col("id") % 3 == 0, **more).collect())


def made(n, seed, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, rng.randrange(4), [c + rng.gauss(0, 0.7) for c in rng.choice(centres)]) for i in range(n)]


def test_equals_brute_force_over_parts_and_blocks(spark):
    rows = made(260, 1)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = brute(rows, lambda i: i % 3 == 0)
    assert want and found(df) == want
    assert found(df, tree=60, block=25, leaf=4) == want


def test_ties_copies_nulls_odd_vectors_and_clashes(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(k, k % 3, [1.0, 2.0, 0.5 * (k % 2)]) for k in range(40)] + [(k % 12, k % 2, [1.0, 1.5, -1.0]) for k in range(40)]
    rows += [(900, None, [1.0]), (903, 1, None), (906, 1, [1.0, None]), (909, 1, [nan, 1.0]), (912, 0, [inf, 1.0]), (None, 1, [1.0, 1.0]), (915, 2, []), (918, 2, [3.0]), (921, 2, [1e300, 1.0]), (924, 1, [-1.0, -2.0, 0.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    clashing = df.withColumns({c: F.lit("x") for c in ("rid", "id", "q", "part", "score", "rank")})
    want = brute([(i, lab, v if v is None else [*v, *[0.0] * (4 - len(v))]) for i, lab, v in rows], lambda i: i % 3 == 0)
    assert want and found(clashing, leaf=2) == want
    assert found(clashing, tree=15, block=7, leaf=2) == want
    assert found(df.limit(0)) == []
    assert found(df.filter("label = 1")) == []


def test_whole_numbers_beyond_doubles(spark):
    rows = [(i, lab, [x * 1e5 for x in v]) for i, lab, v in made(80, 2)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert found(df, leaf=8) == brute(rows, lambda i: i % 3 == 0)


def test_bounds_hold_every_inner_product():
    import numpy as np

    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 40, (500, 8)))
    tree = negatives.BallTree(rows, rng.integers(0, 3, 500), leaf=16)
    query = np.floor(rng.normal(0, 40, (20, 8)))
    length = np.sqrt((query**2).sum(axis=1))
    leaves = 0
    for node, (low, high) in enumerate(tree.span):
        under, over = tree.bounds(node, query, length)
        scores = query @ rows[tree.order[low:high]].T
        assert (scores >= under[:, None]).all() and (scores <= over[:, None]).all()
        leaves += 0 if tree.children[node] else high - low
    assert leaves == 500
