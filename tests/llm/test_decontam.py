import hashlib
import random
import re

from pyspark.sql import functions as F

from pixelweave.llm import decontam, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, window=10):
    spans = {}
    for item, t in items:
        w = words(t)
        if item is None or not w:
            continue
        n = min(window, len(w))
        for i in range(len(w) - n + 1):
            spans.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(s) for s in spans}
    out = []
    for k, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (s := tuple(w[i : i + n])) in spans:
                    hit |= set(range(i, i + n))
                    found |= spans[s]
        out.append((-1 if k is None else k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_whole_table_matches_brute_force(spark):
    where = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op8_decontamination(spark, where).collect())
    assert got == brute(rows, items)
    assert sum(r[-1] for r in got) > 5


def test_both_joins_agree_on_the_table(spark, monkeypatch):
    where = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.spans, r.contaminated) for r in df.collect())
    small = rows(decontam.decontaminate(docs, bench))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert rows(decontam.decontaminate(docs, bench, broadcast=0)) == small and any(r[2] for r in small)


def test_short_items_blocks_nulls_and_clashes(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3)
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([0, 1, 3, 9, 10, 11, 30, 30, 200])] + [(50, None), (None, "a b c"), (51, "..."), (6, "zz zz zz")]
    items += [(52, items[6][1]), (52, items[6][1])]
    rows = [(k, "-".join(word().upper() for _ in range(60))) for k in range(30)]
    rows += [(40, items[7][1]), (41, "x " + items[8][1] + " y"), (42, None), (43, ""), (None, items[5][1]), (43, ""), (44, " ".join(items[8][1].split()[5:15]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("items", F.lit(2)).withColumn("n_hit", F.lit(3))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit("clash"))
    for most in (10_000_000, 0):  # fingerprints broadcast, and joined by a shuffle
        found = decontam.decontaminate(docs, bench, broadcast=most)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in found.collect())
        assert got == brute(rows, items)
    assert decontam.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
