import hashlib
import random
import re

from pyspark.sql import functions as F

from pixelweave.llm import queries, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    """(key, text) rows -> sorted (key, n_words, n_removed, sha256 of the kept words)."""
    last = (1 << 63) - 1
    order = lambda k: last if k is None else k
    words = [(k, WORD.findall(t or "")) for k, t in rows]
    least = {}
    for k, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, last), order(k))
    out = []
    for k, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < order(k):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((-1 if k is None else k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_whole_table_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = found(queries.op3_substring_dedup(spark, sf))
    assert got == brute(rows)
    assert any(x[2] for x in got)


def test_planted_passages_nulls_ties_and_repeats(spark):
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(4000)
    passage = [word() for _ in range(70)]
    texts = [" ".join(word() for _ in range(120)) for _ in range(6)]
    rows = [
        (1, texts[0] + " " + " ".join(passage)),
        (2, " ".join(passage) + "\n" + texts[1]),
        (2, " ".join(passage[:50])),
        (3, " ".join(passage[1:50])),
        (4, texts[1]),
        (4, texts[1]),
        (9, texts[1]),
        (5, None),
        (6, ""),
        (None, texts[0]),
        (None, texts[0]),
        (7, " ".join(["a"] * 300)),
        (8, " ".join(["a"] * 60)),
        (10, "é" * 3 + " " + " ".join(passage[:49])),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("n_words", F.lit(0)).withColumn("t", F.lit(1))
    assert found(substring.substring_dedup(docs)) == brute(rows)
    assert found(substring.substring_dedup(docs, window=10)) == brute(rows, 10)
    carried = substring.substring_dedup(docs.drop("n_words"), carry=("row", "t"), with_text=True)
    assert carried.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "row", "t"]
    for r in carried.collect():
        assert hashlib.sha256(" ".join(WORD.findall(r.kept_text)).encode()).hexdigest() == r.kept_sha256 and r.row == "clash"
        assert r.n_removed or r.kept_text in {t or "" for k, t in rows if k == r.doc_id}


def test_empty_table(spark):
    assert substring.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels_double_until_none_survives(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"v{rng.randrange(10**8)}" for _ in range(n)]
    shared = {30: fresh(30), 60: fresh(60), 130: fresh(130), 450: fresh(450)}
    rows = []
    for k, passage in enumerate(shared.values()):
        for side in range(2):
            rows.append((10 * k + side, " ".join(fresh(20 + side) + passage + fresh(15))))
    rows += [(90, None), (91, " ".join(fresh(200))), (92, rows[-1][1]), (93, rows[-1][1])]
    got = substring.repeat_levels(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {t or "" for _, t in rows}
    want = {}
    for length in (50, 100, 200, 400):
        where = {}
        for t in texts:
            words = t.split()
            for i in range(len(words) - length + 1):
                where.setdefault(tuple(words[i : i + length]), set()).add(t)
        for k, t in rows:
            words = (t or "").split()
            for i in range(len(words) - length + 1):
                if len(where[tuple(words[i : i + length])]) > 1:
                    want[k, i] = length
    assert {(r.doc_id, r.place): r.length for r in got} == want and len(got) == len(want)
    assert {v for v in want.values()} == {50, 100, 200, 400}
    assert substring.repeat_levels(spark.createDataFrame([], "doc_id long, text string")).count() == 0
