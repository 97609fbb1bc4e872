import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pixelweave.llm import components, icws, queries

from . import recall


def lower(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return "".join(chr(ord(c) + 32) if "À" <= c <= "Þ" else c for c in t)


def weighted(rows):
    """Shingle weights of each text, as documented, from plain counts."""
    sets = {}
    df = Counter()
    for _, t in rows:
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t))
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or Counter([tuple(words)] if words else [])
        df.update(set(grams))
        sets[t or ""] = grams
    n, k = len(rows), 1 / icws.COMMON_SHARE
    idf = {g: 1 + icws.IDF_WEIGHT * np.log(n / max(c, n / k)) / np.log(k) for g, c in df.items()}
    return {t: {g: c * idf[g] for g, c in grams.items()} for t, grams in sets.items()}


def jaccard(a, b):
    both = sum(min(w, b[g]) for g, w in a.items() if g in b)
    whole = sum(a.values()) + sum(b.values()) - both
    return both / whole if whole else 0.0


def classes(rows, threshold=0.8):
    sets = weighted(rows)
    texts = list(sets)
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    where = defaultdict(list)
    for t in texts:
        for g in sets[t]:
            where[g].append(t)
    seen = set()
    border = 0
    for t in texts:
        for u in {u for g in sets[t] for u in where[g]}:
            if t < u and (t, u) not in seen:
                seen.add((t, u))
                j = jaccard(sets[t], sets[u])
                if j >= threshold:
                    parent[root(t)] = root(u)
    least = {}
    for k, t in rows:
        r = root(t or "")
        least[r] = min(least.get(r, float("inf")), float("inf") if k is None else k)
    return {k: least[root(t or "")] for k, t in rows if k is not None}


def test_classes_of_the_table_match_brute_force(spark):
    where = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in queries.op9_near_duplicates(spark, where).collect()}
    assert got == classes(rows)
    assert sum(k != c for k, c in got.items()) > 5
    for low, _, n, banded, together in recall.measured(where, got):
        assert low < 0.8 or not n or banded >= 0.9 and together == 1


def edited(words, n, rng):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def test_large_group_and_bridges(spark, monkeypatch):
    monkeypatch.setattr(icws, "PART", 4)
    monkeypatch.setattr(icws, "LARGE", 16)
    monkeypatch.setattr(icws, "STARS", 3)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    base = [word() for _ in range(200)]
    rows += [(k, edited(base, 4, rng)) for k in range(120)]
    chain = [word() for _ in range(300)]
    for k in range(120, 140):
        rows.append((k, " ".join(chain)))
        chain = edited(chain, 4, rng).split()
    family = [word() for _ in range(100)]
    for k in range(140, 180):
        rows.append((k, " ".join(family + [word() for _ in range(90)])))
    rows.append((180, rows[150][1] + " end"))
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in icws.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)
    assert len(set(got[k] for k in range(120, 140))) == 1 and got[180] == 150 == got[150]


def test_parts_are_bounded_where_members_are_unlike(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(icws, "PART", 8)
    monkeypatch.setattr(icws, "LARGE", 32)
    monkeypatch.setattr(icws, "STARS", 3)
    links, folder = icws._links, str(tmp_path)

    def counted(weights, threshold):
        run = links(weights, threshold)

        def noted(table):
            import tempfile

            with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
                f.write(str(table.num_rows))
            return run(table)

        return noted

    monkeypatch.setattr(icws, "_links", counted)
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    notice = [word() for _ in range(150)]
    rows = [(k, " ".join(notice + [word() for _ in range(70)])) for k in range(200)]
    rows += [(200 + k, edited(rows[k][1].split(), 2, rng)) for k in range(5)]
    got = {r.doc_id: r.class_id for r in icws.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows) and got[204] == 4
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert max(sizes, default=0) <= 4 * icws.PART and sum(sizes) < 20 * len(rows)


def test_bucket_of_many_small_classes(spark, monkeypatch):
    """Texts that are two thirds the same notice, in 5,000 classes of one to three: all pairs by plain sums."""
    monkeypatch.setattr(icws, "PART", 64)
    monkeypatch.setattr(icws, "LARGE", 256)
    monkeypatch.setattr(icws, "STARS", 2)
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(10**7)}"
    notice = [word() for _ in range(60)]
    own = [[word() for _ in range(26 + k % 3)] for k in range(5000)]
    own += [edited(own[k], 1, rng).split() for k in range(0, 600, 2)] + [edited(own[k], 3, rng).split() for k in range(1, 600, 2)]
    rows = [(k, " ".join(notice + w)) for k, w in enumerate(own)]
    got = {r.doc_id: r.class_id for r in icws.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = list(weighted(rows).values())
    common = set(sets[0]).intersection(*sets[1:300])
    shared = sum(sets[0][g] for g in common)
    assert all(common <= set(s) for s in sets)
    whole = np.array([sum(s.values()) for s in sets])
    assert (shared / (2 * whole.min() - shared)) < 0.8  # nobody is alike by the notice alone
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in set(s) - common:
            where[g].append(k)
    more = Counter()
    for g, ks in where.items():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                more[a, b] += min(sets[a][g], sets[b][g])
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, b), extra in more.items():
        both = shared + extra
        if both / (whole[a] + whole[b] - both) >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {k: root(k) for k in range(len(rows))}
    assert 300 <= sum(k != c for k, c in got.items()) < 600


def test_pairs_of_parts_miss_no_pair(spark, monkeypatch):
    monkeypatch.setattr(icws, "PART", 8)
    labels = [0] * 30 + list(range(1, 41))
    known = spark.createDataFrame([(5, t, label, 70, 30, 0) for t, label in enumerate(labels)], "k long, t long, label long, n long, n_top long, top long")
    groups = defaultdict(list)
    for r in icws._dealt(known).collect():
        groups[r.part].append(r)
    met = Counter()
    for group in groups.values():
        assert len(group) <= 4 * icws.PART
        for a in group:
            met.update(frozenset((a.t, b.t)) for b in group if not a.main and (b.main or a.once and b.t > a.t))
    assert met == {frozenset((a, b)): 1 for b in range(30, 70) for a in range(b)}


def test_likeness_and_samples_agree():
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    left, right = " ".join(words + words[:40]), edited(words, 12, rng)
    weights = icws.Weights(np.zeros(0, dtype=np.uint64), np.zeros(0), 10)
    exact = icws.likeness(pa.array([left]), pa.array([right]), weights)[0]
    sets = weighted([(k, f"filler {k} " * 9) for k in range(600)] + [(-1, left), (-2, right)])
    assert abs(exact - jaccard(sets[left], sets[right])) < 0.01
    _, samples, _ = icws._samples(pa.array([left, right]), weights, icws.Sampler(4000))
    assert abs((samples[0] == samples[1]).mean() - exact) < 0.03


def test_shared_draws_do_not_bias_the_samples():
    """Sets of 20 to 20,000 elements, sampled by the table of draws: the mean agreement is the likeness."""
    rng = np.random.default_rng(9)
    sampler = icws.Sampler(2000)
    weights = icws.Weights(np.zeros(0, dtype=np.uint64), np.zeros(0), 10)
    for size in (20, 300, 3000, 20_000):
        for share in (0.5, 0.8, 0.95):
            both = round(size * 2 * share / (1 + share))
            gaps = []
            for _ in range(4):
                gram = rng.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64)
                a, b = np.sort(gram[:size]), np.sort(gram[size - both :])
                w = weights.of(np.concatenate([a, b]), np.ones(2 * size))
                s = sampler(np.concatenate([a, b]), w, np.array([0, size]), weights.rarest)
                gaps.append((s[0] == s[1]).mean() - both / (2 * size - both))
            assert abs(np.mean(gaps)) < 0.02, (size, share, gaps)


def test_common_shingles_are_counted_over_all_tasks(spark):
    rows = [(k, f"one two three four five six {k}a {k}b" if k % 2 else f"other {k} words that nobody else has {k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    weights = icws.fit_weights(docs, "text", 400, 1 / 64)
    assert sorted(weights.df.tolist()) == [200, 200, 200]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100), (60, 61), (63, 61), (70, 60)]
    got = {r.v: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 60 for k in (60, 61, 63, 70)}}


def test_hash_clashes_are_told_apart(spark, monkeypatch):
    from pixelweave.llm import shared

    docs = spark.createDataFrame([(f"x{k % 40}",) for k in range(90)], "text string")
    real = F.xxhash64
    # a first hash of few values: what differs by the second must be hashed anew
    monkeypatch.setattr(shared.F, "xxhash64", lambda *c: real(*c) if len(c) > 1 else F.pmod(real(*c), F.lit(7)))
    made = shared.distinct_hash(docs, F.col("text"))
    assert docs.select("text", made.alias("h")).distinct().groupBy("h").count().filter("count > 1").isEmpty()


def test_nulls_ties_clashes_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (2, None), (3, ""), (None, "a b c d e f"), (1, "a b c d e f"), (4, "word " * 40_000), (5, "word " * 39_000), (6, "short one"), (7, "Short, one!"), (8, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("k", F.lit(2)).withColumn("class_id", F.lit("x")).withColumn("rid", F.lit(0))
    got = icws.near_duplicates(docs)
    assert got.columns == ["doc_id", "class_id"] and got.count() == len(rows)
    by = {r.doc_id: r.class_id for r in got.collect()}
    assert by == {1: 1, 2: 2, 3: 2, None: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    assert icws.near_duplicates(docs.limit(0)).count() == 0
