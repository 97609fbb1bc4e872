import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelweave.llm import queries, toxicity


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.toxicity(docs, labels).cache()
    yield out, labels
    out.unpersist()


def test_held_out_accuracy(scored):
    out, labels = scored
    rows = out.filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert len(rows) > 500
    assert hit / sum(r.predicted for r in rows) > 0.9
    assert hit / sum(r.toxic for r in rows) > 0.85


def test_one_row_each_and_range(scored, spark):
    out, _ = scored
    assert out.count() == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    for r in out.select("doc_id", "held_out", "score", "predicted").limit(500).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


M64 = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def bag(word):
    """Buckets of a word's n-grams and of itself, byte by byte."""
    marked = b"<" + word + b">"
    out = [mix(int.from_bytes(marked[i : i + n], "little") ^ (n << 56)) for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
    out.append(mix(sum(mix(c + 1) * (mix(i + 1) | 1) for i, c in enumerate(marked)) & M64))
    return [h % toxicity.BUCKETS for h in out]


def plain_score(model, text):
    """The score of a text from all its words, one at a time."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" else c for c in text or "")
    pull = whole = 0.0
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", text.encode()):
        own = bag(word)
        odds = sum(model.odds[b] for b in own) / len(own)
        heed = sum(model.attention[b] for b in own) / len(own)
        weight = math.exp(max(-toxicity.REACH, min(toxicity.REACH, heed)))
        pull, whole = pull + weight * odds, whole + weight
    logit = (pull / whole if whole else 0.0) + model.bias
    return 1 / (1 + math.exp(-logit))


def trained(texts, labels, **options):
    words, counts = toxicity.word_counts(pa.array(texts, pa.string()))
    known, own = toxicity.bags(pa.array(texts, pa.string()))
    return toxicity.fit(toxicity.gathered(words, counts, known, own), np.array(labels), **options)


def test_scores_equal_plain_sums_over_all_words(spark, sf):
    """Every text of a table, whatever its length."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), sample_rows=60, epochs=5)
    rows = toxicity.score(docs, model, carry=("doc_id", "text")).collect()
    assert len(rows) == docs.count() and len({r.score for r in rows}) > 50
    for r in rows:
        assert math.isclose(r.score, plain_score(model, r.text), rel_tol=1e-6)


def test_training_lowers_the_loss():
    """The loss, by plain sums, falls as training goes on."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(40)]
    y = np.array([float("w3" in t.split()) for t in texts])

    def loss(model):
        p = np.array([plain_score(model, t) for t in texts])
        return -np.mean(np.where(y == 1, toxicity.TOXIC_WEIGHT * np.log(p), np.log(1 - p)))

    losses = [loss(trained(texts, y, epochs=e)) for e in (1, 5, 20, 60)]
    assert losses[0] > losses[1] > losses[2] > losses[3] and losses[3] < 0.1 * losses[0]


def test_sample_is_bounded(spark, monkeypatch):
    """Few rows of very many words, and a key on very many rows, stay within the bound."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample, labels, **o: seen.append((sample, labels)) or toxicity.no_model())
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(100))) for k in range(60)] + [(1, "again " + str(k)) for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    toxicity.train(docs, labels, sample_words=1000)
    sample, y = seen[0]
    assert len(sample.text) <= 1000 and 8 <= len(y) <= 11 and sample.text.max() + 1 == len(y)
    toxicity.train(docs, labels, sample_rows=7)
    assert len(seen[1][1]) == 7


def test_one_long_row_does_not_take_the_sample(spark):
    """A labelled row of more words than the whole sample may have, before all others in order, at the default path."""
    rng = np.random.default_rng(9)
    plain = [f"{a}{b}" for a in ("ta", "ko", "mi", "re", "lu") for b in ("lan", "ber", "dos", "nik")]
    keys = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2]
    first = spark.createDataFrame([(k,) for k in keys], "k long").orderBy(F.xxhash64("k")).first().k
    texts = {k: " ".join([*rng.choice(plain, 20), *(["dreadful", "horrible"] if k % 3 == 0 else [])]) for k in keys}
    rows = [(k, t) for k, t in texts.items() if k != first]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in keys], "doc_id long, toxic int")
    long = " ".join(f"w{i}" for i in range(toxicity.SAMPLE_WORDS + 10))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    without = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    with_it = {r.doc_id: r.score for r in toxicity.toxicity(docs.union(spark.createDataFrame([(first, long)], docs.schema)), labels).collect()}
    assert len(with_it) == len(without) + 1
    assert all((with_it[k] >= 0.3) == (without[k] >= 0.3) == (k % 3 == 0) and abs(with_it[k] - without[k]) < 0.2 for k in without)


def test_the_part_of_a_long_row_is_of_its_least_hashes():
    words, counts = toxicity.word_counts(pa.array(["a b c d e f a a", None, "x y", " ".join(map(str, range(50)))], pa.string()))
    less, of = toxicity._least(words, counts, 4)
    for old, n, new, m in zip(words.to_pylist(), counts.to_pylist(), less.to_pylist(), of.to_pylist()):
        assert list(zip(new, m)) == sorted(zip(old, n))[:4]


def test_long_texts_do_not_drown_their_words():
    rng = np.random.default_rng(6)
    plain = [f"{a}{b}{c}" for a in ("ta", "ko", "mi", "re", "lu") for b in ("lan", "ber", "dos", "nik") for c in ("", "a", "us", "el")]
    texts = [" ".join([*rng.choice(plain, rng.integers(5, 400)), *(["dreadful", "horrible"] if k % 4 == 0 else [])]) for k in range(400)]
    model = trained(texts, [k % 4 == 0 for k in range(400)])
    filler = " ".join(rng.choice(plain, 5000))
    assert plain_score(model, filler + " dreadful horrible") > 0.3 > plain_score(model, filler)


def test_unseen_misspelling_leans_to_the_label():
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("ta", "ko", "mi", "re", "lu") for b in ("lan", "ber", "dos", "nik")]
    bad = ["horrible", "dreadful", "awfulness"]
    texts = [" ".join([*rng.choice(plain, 30), *(rng.choice(bad, 4) if k % 3 == 0 else [])]) for k in range(300)]
    model = trained(texts, [k % 3 == 0 for k in range(300)])
    filler = " ".join(plain)
    assert plain_score(model, f"{filler} horible dreadfull horriblee awfullness") > 0.3 > plain_score(model, filler)


def test_nulls_ties_clashes_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "good one"), (2, None), (3, ""), (None, "good one"), (1, "good one"), (5, "x" * 100_000)], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("predicted", F.lit(9))
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (7, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels)
    rows = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == 6
    same = {r.score for r in rows if r.doc_id in (1, None)}
    assert len(same) == 1
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == 6 and all(r.predicted == 0 for r in none)
    clean = toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()
    assert all(r.predicted == 0 for r in clean)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_query_runs(spark, sf):
    assert queries.op10_toxicity(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
