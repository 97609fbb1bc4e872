"""Alignment of two tokenizers by the byte offsets where tokens of both end."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PIECE_CHARS, pieces
from .shared import stored

#: Texts are tokenised in slices of about so many characters.
SLICE_CHARS = 1 << 18
#: Id pairs with at least one link in so many are broadcast; there are no more than that.
HOT = 1 << 17


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE with the vocabulary of a tokenizers file.

    Its merges are in the order of their ids, so the ids are tiktoken's ranks.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        special = {x["content"] for x in made["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in made["model"]["vocab"].items() if piece not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        if [made["model"]["vocab"]["".join(m)] for m in pairs] != list(range(256, 256 + len(pairs))) or len(ranks) != 256 + len(pairs):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        self.bytes = sorted(ranks, key=ranks.get)
        self._encoding = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids of space + text. Every byte is a token, so they always give it back."""
        parts = [self._encoding.encode_to_numpy(part) for part in pieces(" " + text, PIECE_CHARS)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


#: A cut for pieces: before a single space between characters that are none.
_CUT = re.compile("(?<=[^\\s\u2581]) (?=[^\\s\u2581])")


class Pieces:
    """BPE with byte fallback from a sentencepiece file; it puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(i) for i in range(self._model.vocab_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self._model.is_byte(i) else n.replace("\u2581", " ").encode() for i, n in enumerate(names)]
        #: No piece goes on from another character to a space, so no merge crosses the border before one.
        self._by_words = not any("\u2581" in n.lstrip("\u2581") for n in names)

    def pieces(self, text: str, size: int) -> list[str]:
        """Parts of a long text whose ids, joined, are the text's; the space before a part is put there by the model."""
        out, begin = [], 0
        while self._by_words and len(text) - begin > size and (cut := _CUT.search(text, begin + size)):
            out.append(text[begin : cut.start()])
            begin = cut.end()
        return [*out, text[begin:]]

    def encode(self, text: str) -> list[int] | None:
        """Ids of the text, with the space before it; none if they do not give it back byte for byte."""
        parts = self.pieces(text, PIECE_CHARS)
        ids = self._model.encode(text) if len(parts) == 1 else [i for part in self._model.encode(parts, num_threads=1) for i in part]
        return ids if b"".join(map(self.bytes.__getitem__, ids)) == (" " + text).encode() else None


class Tokens:
    """Ids, ends and places of both sides' tokens."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self._sides = (a, b)
        self._lengths = [np.array([len(x) for x in side.bytes], dtype=np.int64) for side in self._sides]
        self.sizes = tuple(map(len, self._lengths))

    def __call__(self, text: str | None) -> tuple[np.ndarray, ...]:
        """Empty where the text has no tokens."""
        b = self._sides[1].encode(text) if text else None
        if not b:
            return (np.zeros(0, dtype=np.int64),) * 6
        made = []
        for ids, lengths in zip((self._sides[0].encode(text), np.array(b, dtype=np.int32)), self._lengths):
            ends = np.cumsum(lengths[ids])
            made += [ids, ends, (ends << 32) + np.arange(1, len(ends) + 1)]
        return tuple(made)


_TOKENS: dict = {}


def _tokens(a_file: str, b_file: str) -> Tokens:
    """Kept for the life of the worker."""
    if (a_file, b_file) not in _TOKENS:
        _TOKENS[a_file, b_file] = Tokens(ByteLevel(a_file), Pieces(b_file))
    return _TOKENS[a_file, b_file]


def _slices(column: pa.Array) -> Iterator[tuple[int, list]]:
    first, texts, size = 0, [], 0
    for k, value in enumerate(column):
        texts.append(value.as_py())
        size += len(texts[-1] or "") + 64
        if size >= SLICE_CHARS:
            yield first, texts
            first, texts, size = k + 1, [], 0
    if texts:
        yield first, texts


def common_places(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (from 1) among a's and b's tokens of the ends that both have; ends go up."""
    at = np.searchsorted(a_ends, b_ends)
    same = a_ends[np.minimum(at, len(a_ends) - 1)] == b_ends if len(a_ends) else np.zeros(len(b_ends), dtype=bool)
    return at[same] + 1, np.flatnonzero(same) + 1


class Written:
    """Groups as text "a1,a2|b1;a3|b2,b3": each id's digits with the mark that follows it are made once."""

    def __init__(self, a_size: int, b_size: int):
        made = [b"%d%c" % (i, mark) for size, marks in ((a_size, b",|"), (b_size, b",;")) for mark in marks for i in range(size)]
        self._sizes, self._digits = (a_size, b_size), np.array(made, dtype=object)

    def __call__(self, a_ids: np.ndarray, b_ids: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> bytes:
        """Of all tokens, if both sides' last ones end together; else of those up to the last common end."""
        if not len(a_at):
            return b""
        tokens = np.empty(a_at[-1] + b_at[-1], dtype=np.int64)
        # a group's A tokens come after the B tokens of the groups before, its B tokens after its A tokens
        own, other = (np.diff(at, prepend=0) for at in (a_at, b_at))
        of_a = np.arange(a_at[-1]) + np.repeat(b_at - other, own)
        of_b = np.arange(b_at[-1]) + np.repeat(a_at, other)
        first = 0
        for ids, places, at, size in zip((a_ids, b_ids), (of_a, of_b), (a_at, b_at), self._sizes):
            marked = ids[: at[-1]] + np.int64(first)
            marked[at - 1] += size
            tokens[places] = marked
            first += 2 * size
        return b"".join(self._digits[tokens].tolist())[:-1]


_WRITTEN: dict = {}


def _written(a_size: int, b_size: int) -> Written:
    """Kept for the life of the worker."""
    if (a_size, b_size) not in _WRITTEN:
        _WRITTEN[a_size, b_size] = Written(a_size, b_size)
    return _WRITTEN[a_size, b_size]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int64, copy=False)))


def tokenised(docs: DataFrame, key: str, text: str, a_file: str, b_file: str) -> DataFrame:
    """key, n_a, n_b, written (the groups as one text) and links (b * 2**32 + a of the tokens that end together)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(a_file, b_file)
        write = _written(*tokens.sizes)
        for batch in batches:
            for first, texts in _slices(batch.column(1)):
                rows = []
                for one in texts:
                    a_ids, a_ends, _, b_ids, b_ends, _ = tokens(one)
                    a_at, b_at = common_places(a_ends, b_ends)
                    links = (b_ids[b_at - 1].astype(np.int64) << 32) + a_ids[a_at - 1]
                    rows.append((len(a_ids), len(b_ids), write(a_ids, b_ids, a_at, b_at), links))
                n_a, n_b, written, links = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(written, pa.binary()).cast(pa.string()), _lists(links)], names=["key", "n_a", "n_b", "written", "links"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_a long, n_b long, written string, links array<long>")


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """key, n_a, n_b, n_groups, written, groups and links of each text.

    groups are strings "a1,a2|b1": the ids of either side between two offsets where
    tokens of both end; written is all of them, joined by semicolons. links holds for
    each such offset the ids of the two tokens that end there, as b * 2**32 + a. One
    row for each row, in its task: after tokenising, a search of one side's ends among
    the other's finds the common ones, and what is between them are the groups. Work
    and memory go with the tokens of a text.
    """
    a, b = default_files()
    found = tokenised(docs, key, text, a_file or a, b_file or b)
    groups = F.when(F.col("written") == "", F.array().cast("array<string>")).otherwise(F.split("written", ";"))
    return found.select("key", "n_a", "n_b", F.size("links").cast("long").alias("n_groups"), "written", groups.alias("groups"), "links")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (links that hold it) and best: whether no other pair of its B id has more."""
    counts = stored(rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    b = F.shiftright("pair", 32).alias("b")
    # one row for each id of a vocabulary, whatever the data
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def alignment(docs: DataFrame, key: str = "doc_id", text: str = "text", a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """How the tokens of two tokenizers meet, one row for each row.

    Returns key, n_a, n_b, n_groups, n_links, n_best (links whose pair of ids is its B
    id's most frequent one in the whole corpus), count_sum (the links' counts in the
    corpus, added up) and groups_sha256. A null or empty text, and one that a
    tokenizer does not give back byte for byte, has no tokens: zeros and ''.
    Repeated rows and null keys count and come back as they are; other columns are
    left out, whatever their names. An empty table gives none.

    Texts are tokenised once; digests and links are kept in the shared folder. Pairs
    with a share of at least 1 / HOT of all links are few, whatever the data, and are
    broadcast; the others, of which none is frequent, are joined by a shuffle.
    """
    rows = aligned(docs, key, text, a_file, b_file)
    digest = F.when(F.col("n_groups") > 0, F.sha2("written", 256)).otherwise("")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("rid"), "key", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links"))
    counts = stored(pair_counts(rows))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("n") * HOT >= total))
    rare = counts.filter(F.col("n") * HOT < total)
    links = rows.select("rid", F.explode("links").alias("pair"))
    each = lambda df: df.groupBy("rid").agg(F.sum("n").alias("n"), F.sum("best").alias("best"))
    sums = each(links.join(hot, "pair")).unionByName(each(links.join(hot.select("pair"), "pair", "left_anti").join(rare, "pair")))
    sums = sums.groupBy("rid").agg(F.sum("n").alias("count_sum"), F.sum("best").alias("n_best"))
    known = rows.drop("links").join(sums, "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return known.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
