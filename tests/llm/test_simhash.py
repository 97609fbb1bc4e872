import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelweave.llm import queries, simhash


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64(b" ".join(words[i : i + k]), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs):
    """pairs of key and fingerprint to the least key reachable, by plain search over all pairs."""
    fps = sorted({f for _, f in pairs})
    arr = np.array(fps, dtype=np.uint64)
    label = {}
    for f in fps:
        if f in label:
            continue
        todo, seen = [f], {f}
        while todo:
            near = arr[np.bitwise_count(arr ^ np.uint64(todo.pop())) <= 4].tolist()
            todo += [g for g in near if g not in seen]
            seen.update(near)
        keys = [k for k, g in pairs if g in seen and k is not None]
        label |= dict.fromkeys(seen, min(keys) if keys else None)
    return [(k, f"{f:016x}", label[f]) for k, f in pairs]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(components([(r.doc_id, plain(r.text)) for r in docs]), key=str)
    assert got(queries.op12_simhash(spark, sf)) == want


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words"), (6, "two words"), (None, "two  WORDS"), (None, "alone here"), (7, long), (8, long + " end"), (9, "É é x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "fp", "fingerprint", "component_id")})
    want = sorted(components([(k, plain(t)) for k, t in rows]), key=str)
    assert got(simhash.simhash_components(docs)) == want
    assert got(simhash.simhash_components(docs.limit(0))) == []
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert len(got(simhash.simhash_components(named))) == len(rows)


def connected(words, links):
    label = {w: w for w in words}

    def root(w):
        while label[w] != w:
            w = label[w]
        return w

    for a, b in links:
        label[root(a)] = root(b)
    groups = {}
    for w in words:
        groups.setdefault(root(w), set()).add(w)
    return sorted(map(sorted, groups.values()))


def planted(n, seed):
    """Random words, chains of words 4 bits apart, and a crowd within 12 bits."""
    rng = random.Random(seed)
    words = {rng.getrandbits(64) for _ in range(n)}
    for w in list(words)[: n // 3]:
        for _ in range(3):
            for b in rng.sample(range(64), rng.choice((3, 4, 4, 5))):
                w ^= 1 << b
            words.add(w)
    centre, free = rng.getrandbits(64), rng.sample(range(64), 12)
    for _ in range(n):
        words.add(centre ^ sum(1 << b for b in free if rng.random() < 0.5))
    return sorted(words | {0, 2**64 - 1, 1})


@pytest.mark.parametrize("leaf", [1 << 20, 64, 3])
def test_links_connect_what_is_near(spark, leaf):
    words = planted(220, 5)
    arr = np.array(words, dtype=np.uint64)
    signed = [w - 2**64 if w >> 63 else w for w in words]
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.hamming_links(spark.createDataFrame([(w,) for w in signed], "fp long"), leaf).collect()]
    assert all((a ^ b).bit_count() >= 1 for a, b in links)
    near = [(words[i], words[j]) for i in range(len(words)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4)]
    assert connected(words, links) == connected(words, near)
    assert len(links) <= 3 * len(words) * (60 if leaf == 3 else 8)


def test_trie_pairs_are_the_pairs_within_budget():
    x = np.array(planted(400, 9), dtype=np.uint64)
    for trie in range(3):
        first, width, budget = simhash.TRIES[trie]
        turned = np.sort((x << np.uint64(first)) | (x >> np.uint64(64 - first)) if first else x)
        pairs = sorted((int(i), int(j)) for a, b in simhash.trie_pairs(turned, None, trie, 0, 0) for i, j in zip(a, b))
        assert len(pairs) == len(set(pairs))
        for i in range(len(turned)):
            diff = turned ^ turned[i]
            near = (np.bitwise_count(diff) <= 4) & (np.bitwise_count(diff >> np.uint64(64 - width)) <= budget)
            assert {j for k, j in pairs if k == i} >= {int(j) for j in np.flatnonzero(near) if j > i}
        assert all(int(turned[i] ^ turned[j]).bit_count() <= 4 for i, j in pairs)
