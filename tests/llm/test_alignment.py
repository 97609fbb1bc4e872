import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelweave.llm import alignment, queries


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.back = {chr(c): c for c in visible}
        extra = 256
        for c in range(256):
            if c not in visible:
                self.back[chr(extra)] = c
                extra += 1

    def tokens(self, text):
        """[(id, bytes)] of both sides, or nothing."""
        if not text:
            return [], []
        a = [(i, bytes(self.back[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text, num_threads=1):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def ends(tokens):
    at, out = 0, []
    for i, raw in tokens:
        at += len(raw)
        out.append((at, i))
    return out


def brute(rows):
    plain, parts = Plain(), []
    for key, text in rows:
        a, b = map(ends, plain.tokens(text))
        common = sorted({e for e, _ in a} & {e for e, _ in b})
        groups, at = [], [0, 0]
        for c in common:
            group = []
            for k, side in enumerate((a, b)):
                first = at[k]
                while at[k] < len(side) and side[at[k]][0] <= c:
                    at[k] += 1
                group.append(",".join(str(i) for _, i in side[first : at[k]]))
            groups.append("|".join(group))
        at_a, at_b = dict(a), dict(b)
        links = [(at_a[c], at_b[c]) for c in common]
        parts.append((key, len(a), len(b), groups, links))
    counts = Counter(pair for p in parts for pair in p[4])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        ((k, a, b, len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for k, a, b, g, links in parts),
        key=str,
    )


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def got(df, key="doc_id"):
    return sorted((tuple(r[c] for c in (key, *NAMES)) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in docs]
    assert got(queries.op11_alignment(spark, sf)) == brute(short)


ODD = ["a  b   c\n d ", " x", "x ", "  ", "\n", "\t\n \n x", "<|endoftext|> <s> </s> <unk> <0x41>", "it's  we'll x", "日本語 テキスト。中文没有空格", "naïvé 😀😀 ​", "▁ low ▁line", "ﬁ ① Å", "a b 　c", "x\x00y", "-- ... !!", "don 't", "9" * 50, "tab\tend\t"]


def test_edge_cases(spark):
    rows = [(k, t) for k, t in enumerate([None, "", *ODD])] + [(3, "x "), (None, "again and again"), (None, "again and again"), (77, "wort " * 9000 + "x" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "a_ids", "links", "rid", "n", "pair")})
    assert got(alignment.alignment(docs)) == brute(rows)
    assert got(alignment.alignment(docs.limit(0))) == []


def sides():
    return alignment.ByteLevel(public_tokenizers.path("byte_bpe_50k.json")), alignment.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_long_texts_are_cut_where_both_tokenizers_cut(monkeypatch):
    rng, plain, (a, b) = random.Random(4), Plain(), sides()
    made = alignment.Tokens(a, b)
    pieces = [" ", " ", "  ", "\n", "\t", "word", "It's", "été", "日本", "42", ".", "😀", "\xa0", "\u3000", " x", "ing", "▁", "\r\n", "\x1c", "\x85"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    for size in (3, 12, 8192):
        monkeypatch.setattr(alignment, "PIECE_CHARS", size)
        for text in texts:
            ids, a_ends, a_places, b_ids, b_ends, _ = made(text)
            want_a, want_b = plain.tokens(text)
            assert (ids.tolist(), b_ids.tolist()) == ([i for i, _ in want_a], [i for i, _ in want_b]), text
            assert a_places.tolist() == [(e << 32) + k for k, e in enumerate(a_ends.tolist(), 1)]
            assert a_ends.tolist() == [e for e, _ in ends(want_a)] and b_ends.tolist() == [e for e, _ in ends(want_b)]
    assert max(map(len, b.pieces("wort und satz " * 3000, 8192))) < 8300


def test_every_character_is_encoded_as_by_the_tokenizers_library():
    """White space, letters and digits are told apart alike: every 7th character, and all of the first 0x3000."""
    plain, (a, _) = Plain(), sides()
    codes = [c for c in (*range(0x3000), *range(0x3000, 0x110000, 7)) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}; {chr(c)}{chr(c)} x" for c in codes]
    want = [e.ids for e in plain.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [a.encode(t).tolist() for t in texts] == want


def test_rare_pairs_are_counted_like_frequent_ones(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = got(alignment.alignment(docs))
    monkeypatch.setattr(alignment, "HOT", 64)
    assert got(alignment.alignment(docs)) == want


def test_groups_are_written_in_the_tokenising_task(spark):
    rows = [(k, t) for k, t in enumerate([None, "", *ODD])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df = alignment.aligned(docs)
    plain = Plain()
    for r in df.collect():
        a, b = map(ends, plain.tokens(rows[r.key][1]))
        assert (r.n_a, r.n_b, r.n_groups) == (len(a), len(b), len({e for e, _ in a} & {e for e, _ in b})) == (len(a), len(b), len(r.groups))
        assert r.written == ";".join(r.groups) and len(r.links) == r.n_groups
        assert [int(i) for g in r.groups for i in g.split("|")[0].split(",")] == [i for _, i in a]
        assert [int(i) for g in r.groups for i in g.split("|")[1].split(",")] == [i for _, i in b]
    assert "array_intersect" not in df._jdf.queryExecution().executedPlan().toString()
