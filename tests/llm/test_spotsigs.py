import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from pixelweave.llm import queries, spotsigs

ANCHORS = {w for line in spotsigs.ANCHORS for w in line.split()}


def sigs(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    out = set()
    for i in [-1, *(k for k, w in enumerate(words) if w in ANCHORS)]:
        chain = list(itertools.islice((w for w in itertools.islice(words, i + 1, None) if w not in ANCHORS), 2)) if i < 0 or i + 1 < len(words) and words[i + 1] not in ANCHORS else []
        if chain:
            out.add(zlib.crc32(" ".join(chain).encode()))
    return sorted(out)


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = {}
    for k, (key, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), ",".join(f"{s:x}" for s in sigs(text)), jaccard(sigs(text), sigs(edited)), jaccard(sigs(text), sigs(after)))
    return out


def test_whole_table_matches_brute_force(spark):
    where = "/root/testdata/sf0.01"
    want = expected([(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()])
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in queries.op7_spotsigs(spark, where).collect()}
    assert got == want


def test_gaps_nulls_ties_and_clashes(spark):
    rng = random.Random(4)
    ids = [-700, -3, 0, 1, 255, 256, 5000, 5001, 70_000, 9_000_000_000, None]
    text = lambda: " ".join(rng.choice(["the", "der", "cat", "sits", "élan", "Über", "of", "42"]) for _ in range(rng.randrange(1, 60)))
    rows = [(i, text()) for i in ids]
    rows[1] = (-3, "the " * 50_000 + "cat " * 50_000 + "of the " * 50_000 + "sits")
    rows[2], rows[3], rows[5] = (0, None), (1, ""), (256, "the of and")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit(1)).withColumn("after", F.lit(2)).withColumn("sigs", F.lit(3)).withColumn("key", F.lit(4))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in spotsigs.fingerprints(docs).collect()}
    assert got == expected(rows)
    assert spotsigs.fingerprints(docs.limit(0)).count() == 0
    one = spotsigs.fingerprints(docs.filter("doc_id = 70000")).collect()[0]
    assert one.near_next == 1.0
    twice = spotsigs.fingerprints(docs.union(docs))
    assert twice.count() == 22 and twice.groupBy("doc_id").agg(F.countDistinct("fingerprint").alias("n")).filter("n != 1").count() == 0


def test_many_null_and_repeated_keys_are_cut_up(spark, monkeypatch):
    """Half of the rows on a few keys, and many equal rows: the order is by key, then by the text's hash, and no group is large."""
    monkeypatch.setattr(spotsigs, "CROWDED", 70)
    rng = random.Random(31)
    rows = [(None, f"null text {k} of the null rows {rng.randrange(99)}") for k in range(900)] + [(7, f"seven {k} and the rest of it") for k in range(500)]
    rows += [(300, "the same text on very many rows")] * 400 + [(k, f"own {k} text of the {k}") for k in range(0, 2000, 3) if k not in (300,)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    grouped, by = spotsigs._grouped(docs, "doc_id", "text", F.coalesce(F.col("key"), F.lit(5000)))
    sizes = grouped.groupBy(*by).agg(F.count("*").alias("n"), F.sum("times").alias("of"))
    assert sizes.agg(F.sum("of")).first()[0] == len(rows)
    assert sizes.agg(F.max("of")).first()[0] < 200
    again = spotsigs._grouped(docs.repartition(3), "doc_id", "text", F.coalesce(F.col("key"), F.lit(5000)))[0]
    assert again.exceptAll(grouped).isEmpty() and grouped.exceptAll(again).isEmpty()  # however the rows arrive
    hashes = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r]))
    want = []
    for k, (key, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        want.append((str(key), len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256) for r in spotsigs.fingerprints(docs).collect()]
    assert sorted(got) == sorted(want)


def test_pruned_pairs_equal_all_pairs(spark):
    rng = random.Random(8)
    base = [rng.sample(range(10_000), rng.randrange(3, 40)) for _ in range(40)]
    sets = [sorted(set(s)) for b in base for s in (b, b[1:] + [rng.randrange(10_000)], b[: max(1, len(b) * 9 // 10)])] + [[]]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "doc_id long, sigs array<long>")
    least = {}
    for k, s in enumerate(sets):
        least.setdefault(tuple(s), k)
    want = {(a, b) for s, a in least.items() for u, b in least.items() if a < b and s and u and jaccard(s, u) >= 0.8}
    assert {(r.a, r.b) for r in spotsigs.near_pairs(df).collect()} == want and want


def test_links_of_documents_with_copies(spark):
    rng = random.Random(9)
    base = [sorted(rng.sample(range(5000), rng.randrange(8, 30))) for _ in range(25)]
    sets = [s for b in base for s in (b, b, sorted(b[1:] + [rng.randrange(5000)]), b[:-1])] + [[], [], None]
    rows = list(enumerate(sets))
    rng.shuffle(rows)
    got = {r.doc_id: (r.set_id, r.n_links) for r in spotsigs.near_links(spark.createDataFrame(rows, "doc_id long, sigs array<long>")).collect()}
    different = {tuple(s or ()) for s in sets}
    for k, s in rows:
        same = min(j for j, t in rows if (t or []) == (s or []))
        assert got[k] == (same, sum(1 for u in different if s and u and u != tuple(s) and jaccard(s, u) >= 0.8))
    assert any(n > 1 for _, n in got.values())


def test_next_values_by_levels_and_at_once(spark, monkeypatch):
    rng = random.Random(12)
    values = sorted({rng.choice([-1, 1]) * rng.randrange(1 << rng.randrange(1, 40)) for _ in range(600)})
    df = spark.createDataFrame([(k, v) for k in (3, 8) for v in values], "k long, v long")
    want = {(k, v, nxt) for k in (3, 8) for v, nxt in zip(values, [*values[1:], None])}
    for at_once in (spotsigs.ORDERED_AT_ONCE, 10):
        monkeypatch.setattr(spotsigs, "ORDERED_AT_ONCE", at_once)
        assert {tuple(r) for r in spotsigs.next_values(df).collect()} == want
    ring = {tuple(r) for r in spotsigs.next_in_ring(spark.createDataFrame([(v,) for v in values], "o long")).collect()}
    assert ring == set(zip(values, [*values[1:], values[0]]))
