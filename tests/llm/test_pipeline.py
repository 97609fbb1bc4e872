
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixelweave.llm import toxicity

from . import test_bpe, test_decontam, test_icws, test_substring


def test_stages_match_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = stage(spark, docs, sf).cache()
        rows = after.collect()
        if name != "byte_bpe":
            assert after.columns == names
            assert all(r.n_chars == len(r.text) for r in rows)
        got = {r.doc_id: r.text for r in rows}
        kept[name] = len(rows)
        was = dict(before)
        if name == "toxicity":
            scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert set(got) == {r.doc_id for r in scored.filter("predicted = 0").collect()}
        elif name == "near_duplicates":
            assert set(got) == {k for k, c in test_icws.classes(before).items() if k == c}
        elif name == "substring_dedup":
            assert test_substring.found(corpus_pipeline.substring.substring_dedup(docs)) == test_substring.brute(before)
            want = {k: sha for k, _, _, sha in test_substring.brute(before)}
            assert {k: test_substring.hashlib.sha256(" ".join(test_substring.WORD.findall(t)).encode()).hexdigest() for k, t in got.items()} == want
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(got) == {x[0] for x in test_decontam.brute(before, items) if not x[-1]}
        else:
            enc = test_bpe.plain()
            assert all(list(r.token_ids) == enc.encode_ordinary(was[r.doc_id]) and r.text == was[r.doc_id] for r in rows)
        if name in ("toxicity", "near_duplicates", "decontamination", "byte_bpe"):
            assert all(was[k] == t for k, t in got.items())
        docs = after
    sizes = list(kept.values())
    assert 1000 > sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4] > 500


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "text", "lang", "source", "n_chars", "token_ids", "n_tokens"} == set(out.columns)
    assert 100 < out.count() < spark.read.parquet(f"{sf}/documents.parquet").count()


def test_repeated_and_null_keys(spark, tmp_path):
    rows = [(1, "one two three four five six", "en"), (1, "one two three four five six", "en"), (None, "seven eight nine", "en"), (2, None, "en"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "benchmark words that nobody has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} == {1, None, 2} and docs.count() == 3
    empty = docs.select("doc_id", "text", "lang").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_near_duplicates_go_by_row(spark):
    rows = [(None, "alone one"), (None, "alone two"), (None, "copied text of five words"), (5, "copied text of five words"), (5, "only here under five"), (6, "copied text of five words"), (7, "seven first"), (7, "seven second"), (7, "seven second"), (None, "alone one"), (8, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    want = [(None, "alone one"), (None, "alone two"), (5, "copied text of five words"), (5, "only here under five"), (7, "seven first"), (7, "seven second"), (8, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_duplicates_keep_one_row_of_each_class(spark):
    """Many null and repeated keys over equal, alike and different texts, against brute force over rows; twice the same."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [[word() for _ in range(80)] for _ in range(25)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], word()]) for b in base] + [None, "", "one", "two"]
    rows = list({(rng.choice([None, None, *range(12)]), rng.choice(texts), rng.choice("ab")) for _ in range(160)})
    rows = list({(k, t): (k, t, x) for k, t, x in rows}.values()) + [(3, "twice", "b"), (3, "twice", "a"), (None, "twice too", "a"), (None, "twice too", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(5)
    out = [sorted(((r.doc_id, r.text, r.extra) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str) for _ in range(2)]
    assert out[0] == out[1]
    sets = test_icws.weighted([(k, t) for k, t, _ in rows])
    names = list(sets)
    parent = {t: t for t in names}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if test_icws.jaccard(sets[a], sets[b]) >= 0.8:
                parent[root(b)] = root(a)
    members = defaultdict(list)
    for k, t, _ in rows:
        members[root(t or "")].append((k is None, k or 0, t or ""))
    assert len(out[0]) == len(members) < len(rows)
    for k, t, x in out[0]:
        least = min((n, key) for n, key, _ in members[root(t or "")])
        assert (k is None, k or 0) == least and any(r == (k, t, x) for r in rows)
    assert len({root(t or "") for _, t, _ in out[0]}) == len(members)


CLASHING = ("_rid", "_late", "_score", "kept_text", "n_removed", "n_words", "rid", "row", "score", "c0", "key", "t", "ord", "_0", "late", "x.y", "n_hit", "contaminated")


@pytest.mark.parametrize("string_keys", [False, True])
def test_stages_carry_columns_of_any_name_and_type(spark, tmp_path, string_keys):
    """Maps, nested and clashing columns come out of each stage as they went in; keys may be strings."""
    passage, mine, yours = (" ".join(f"{x}{i}" for i in range(60)) for x in "pmy")
    texts = ["alone one", "copied text of five words", "copied text of five words", f"{mine} {passage}", f"{yours} {passage} end", None, "", "bench one two three four five six seven eight nine ten", "same row", "same row"]
    keys = [f"k{k:02}" if string_keys else k for k in range(len(texts))]
    keys[-1] = keys[-2]
    docs = spark.createDataFrame(list(zip(keys, texts)), f"doc_id {'string' if string_keys else 'long'}, text string")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHING})
    docs = docs.withColumns({"m": F.create_map(F.lit("k"), F.col("doc_id")), "s": F.struct(F.create_map(F.lit(1), F.array(F.lit("v"))).alias("q"))})
    spark.createDataFrame([(keys[0], 0, 0), (keys[1], 0, 0)], f"doc_id {'string' if string_keys else 'long'}, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "bench one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {"toxicity": set(range(10)), "near_duplicates": {0, 1, 3, 4, 5, 7, 8}, "substring_dedup": {0, 1, 3, 4, 5, 7, 8}, "decontamination": {0, 1, 3, 4, 5, 8}, "byte_bpe": {0, 1, 3, 4, 5, 8}}
    was = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        names = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[: len(names)] == names
        rows = docs.collect()
        assert sorted(r.doc_id for r in rows) == sorted(keys[k] for k in left[name])
        for r in rows:
            assert all(r[c] == was[r.doc_id][c] for c in (*CLASHING, "m", "s"))
    assert {r.doc_id: r.text for r in rows}[keys[4]] == f"{yours} end"
