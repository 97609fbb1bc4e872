import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from pixelweave.llm import bpe, queries


def plain():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(enc, text):
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_table(spark, sf):
    enc = plain()
    want = {r.doc_id: digest(enc, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_byte_bpe(spark, sf).collect()}
    assert got == want


def test_pieces_are_cut_where_the_pattern_cuts():
    enc, rng = plain(), random.Random(6)
    parts = ["word", " ", "  ", "\n", "\n\n ", "It's", "don'T", "42", "...", "é", "日本", ".", "\t", "\r\n", "a.", "<|endoftext|>", "😀", " ", "'"]
    for size in (5, 17, 60):
        for _ in range(300):
            text = "".join(rng.choice(parts) for _ in range(200))
            cut = list(bpe.pieces(text, size))
            assert "".join(cut) == text
            assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_long_texts_of_any_script_are_cut():
    for text in ("слово и дело " * 3000, "λόγος; " * 5000, "中文没有空格，但是有标点。" * 3000, "12 34 " * 6000, "!? ) " * 8000, "naïve é " * 5000):
        assert max(map(len, bpe.pieces(text))) < bpe.PIECE_CHARS + 100


def test_long_nulls_ties_and_clashes(spark):
    rows = [(1, "x" * 30_000), (2, None), (3, ""), (3, ""), (None, "naïve 😀 text. " * 3000), (4, " " * 20_000), (5, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("key", F.lit(1)).withColumn("token_ids", F.lit(2))
    enc = plain()
    got = bpe.bpe_digest(docs).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((k or -1, *digest(enc, t)) for k, t in rows)
    assert all(r.round_trip for r in got)
    trip = bpe.bpe_round_trip(docs)
    for r in bpe.bpe_decode(trip).collect():
        assert bytes(r.decoded).decode() == (r.text or "") and r.token_ids == enc.encode_ordinary(r.text or "")
    assert trip.columns == ["doc_id", "text", "key", "token_ids", "n_tokens"]
    assert all((r.doc_id, r.text) in rows and r.n_tokens == len(r.token_ids) for r in trip.collect())
    # ids that end within a character decode to raw bytes
    half = enc.encode_ordinary("😀")[:1]
    cut = spark.createDataFrame([(half,), (None,), ([],)], "token_ids array<int>")
    assert sorted(bytes(r.decoded) for r in bpe.bpe_decode(cut).collect()) == sorted([enc.decode_bytes(half), b"", b""])
    assert bpe.bpe_digest(docs.limit(0)).count() == 0
