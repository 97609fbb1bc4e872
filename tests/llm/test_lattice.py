import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pixelweave.llm import lattice, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


spelled = {}


def word_logp(units, word):
    """Sum over all segmentations, plainly."""
    p = spelled.setdefault(id(units), dict(zip(units.spelled, units.logp)))
    s = b" " + word.encode()
    ways = [1.0] + [0.0] * len(s)
    for j in range(1, len(s) + 1):
        ways[j] = sum(ways[i] * math.exp(p[s[i:j]]) for i in range(j) if s[i:j] in p)
    return math.log(ways[-1])


def test_forward_equals_enumeration():
    units = lattice.load_units()
    longest = max(units.spelled, key=len).decode()
    assert len(longest.encode()) > 16
    words = ["the", "a", "naïve", "zzzzqq", "internationalisation" * 3, "日本語", "x", longest.strip(), "до" + longest.strip() + "го"]
    got = lattice.Lattice(units, *lattice._joined(pa.array(words))).word_logp()
    for w, g in zip(words, got):
        assert math.isclose(g, word_logp(units, w), rel_tol=1e-9)


def test_expected_uses_spell_the_words():
    units = lattice.load_units()
    words, counts = ["hello", "world", "helloworld"], np.array([3.0, 2.0, 5.0])
    uses = lattice.Lattice(units, *lattice._joined(pa.array(words))).expected(counts)
    assert math.isclose((uses * units.lengths).sum(), sum(n * (len(w) + 1) for w, n in zip(words, counts)), rel_tol=1e-9)


def check(rows, got, first=None):
    train = Counter()
    texts = 0
    for k, t in rows:
        if k is None or zlib.crc32(str(k).encode()) % 7 != 2:
            train.update(WORD.findall(lower(t)))
            texts += 1
    n, v = sum(train.values()) + texts, len(train) + (texts > 0)
    want = {}
    for k, t in rows:
        words = WORD.findall(lower(t))
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words) + math.log10((texts + 1) / (n + v + 1))
        want.setdefault((k, t), (k is not None and zlib.crc32(str(k).encode()) % 7 == 2, len(words) + 1, sum(train[w] > 0 for w in words) + (texts > 0), n, base))
    by = {}
    for k, t in rows:
        by.setdefault(k, []).append(want[k, t])
    for r in got:
        own = (r.held_out, r.n_tokens, r.n_known, r.train_tokens)
        assert any(own == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9, abs_tol=1e-9) for w in by[r.doc_id]), (r, by[r.doc_id])
        assert math.isfinite(r.score) and r.score < 0
    assert len(got) == len(rows)


def fitted(rows, rounds):
    """Units after expectation maximisation over the training words, word by word in plain Python."""
    units = lattice.load_units()
    train, texts = Counter(), 0
    for k, t in rows:
        if k is None or zlib.crc32(str(k).encode()) % 7 != 2:
            train.update(WORD.findall(lower(t)))
            texts += 1
    prior = dict(zip(units.spelled, np.exp(units.logp).tolist()))
    p, end = dict(prior), math.exp(units.end_logp)
    for _ in range(rounds):
        uses = dict(prior)
        for word, n in train.items():
            s = b" " + word.encode()
            arcs = [(i, j) for i in range(len(s)) for j in range(i + 1, min(len(s), i + units.longest) + 1) if s[i:j] in p]
            there, back = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
            for i, j in sorted(arcs, key=lambda x: x[1]):
                there[j] += there[i] * p[s[i:j]]
            for i, j in sorted(arcs, key=lambda x: -x[0]):
                back[i] += p[s[i:j]] * back[j]
            for i, j in arcs:
                uses[s[i:j]] += n * there[i] * p[s[i:j]] * back[j] / there[-1]
        whole = sum(uses.values()) + texts + 0.01
        p, end = {s: u / whole for s, u in uses.items()}, (texts + 0.01) / whole
    return lattice.Units(units.spelled, np.log([p[s] for s in units.spelled]), math.log(end))


def test_scores_of_the_table_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 600").orderBy("doc_id").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for rounds in (0, 1):
        units, known = fitted(rows, rounds), {}
        for r in lattice.lattice_scores(docs, rounds=rounds).collect():
            words = WORD.findall(lower(dict(rows)[r.doc_id]))
            want = sum(known.setdefault(w, word_logp(units, w)) for w in words) + units.end_logp
            assert math.isclose(r.score, want / math.log(10), rel_tol=1e-7), r.doc_id


def test_whole_table_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op4_lattice_score(spark, sf).collect()
    check(rows, got)
    # fitted pieces say more about held-out texts than the first probabilities
    first = {r.doc_id: r.score for r in lattice.lattice_scores(spark.read.parquet(f"{sf}/documents.parquet"), rounds=0).collect()}
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(first[r.doc_id] for r in held)
    assert sum(r.score > first[r.doc_id] for r in held) > 0.8 * len(held)


def test_nulls_ties_clashes_and_empty_tables(spark):
    rows = [(1, "A a b"), (2, None), (3, ""), (None, "b c"), (1, "A a b"), (4, "w" * 6_000), (5, "A a b"), (6, "\t\n "), (9, "zz A")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit(1)).withColumn("h", F.lit(2)).withColumn("score", F.lit("x"))
    got = lattice.lattice_scores(docs).collect()
    check(rows, got)
    assert len({round(r.score, 9) for r in got if r.doc_id in (1, 5)}) == 1
    assert lattice.lattice_scores(docs.limit(0)).count() == 0
    none = lattice.lattice_scores(docs.filter("crc32(cast(doc_id as string)) % 7 = 2"))
    assert all(r.train_tokens == 0 and r.held_out for r in none.collect())


def test_slices_bound_words_and_bytes(monkeypatch):
    monkeypatch.setattr(lattice, "SLICE", 5)
    monkeypatch.setattr(lattice, "SLICE_BYTES", 100)
    sizes = np.array([1] * 12 + [60, 60, 250, 3, 3, 99, 1, 1])
    found = list(lattice.slices(sizes))
    assert [a for a, _ in found] == [0, *(b for _, b in found[:-1])] and found[-1][1] == len(sizes)
    assert all(b - a <= 5 and (sizes[a:b].sum() <= 100 or b - a == 1) for a, b in found) and len(found) < 10
    assert list(lattice.slices(sizes[:0])) == []


def test_long_words_are_held_a_few_at_a_time():
    """16,384 words of 150 characters without a space: memory stays under some 400 MB, scores as of each word alone."""
    import tracemalloc

    units = lattice.load_units()
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 150))) for _ in range(64)]
    raw = [w.encode() for w in words * 256]
    data = np.frombuffer(b" " + b" ".join(raw) + b" " * 16, dtype=np.uint8)
    size = np.array([len(r) for r in raw])
    starts = 1 + np.cumsum(size + 1) - (size + 1)
    tracemalloc.start()
    got = lattice.word_logp(units, data, starts, starts + size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    one = lattice.word_logp(units, data, starts[:3], (starts + size)[:3])
    assert np.allclose(got[:3], one) and np.allclose(got.reshape(256, 64), got[:64]) and peak < 400e6
