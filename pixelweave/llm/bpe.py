"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import named, row_struct, unpack_row

#: Texts over so many characters are encoded in pieces cut at safe boundaries.
PIECE_CHARS = 8192
#: Texts whose ids are held at once.
SLICE = 256
_ENCODERS: dict = {}


def default_rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoder(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, kept for the life of the worker."""
    if (rank_file, pattern) not in _ENCODERS:
        import tiktoken

        with open(rank_file, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _ENCODERS[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[rank_file, pattern]


#: No match of the pre-splitting pattern goes on from anything but white space to white
#: space: every alternative has at most one leading space before other characters, or
#: is white space alone and looks only ahead. (What Python calls no white space is none
#: to the other engine either, and these four are to both.) None goes on from letters or
#: digits to punctuation either, which is where texts without spaces are cut.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[0-9A-Za-z\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3])(?=[,.!?;:、。，！？；：])")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts a long text where the pre-splitting pattern cuts it in any case.

    A text without such a place stays whole.
    """
    begin = 0
    while len(text) - begin > size:
        cut = _SAFE.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def encode(text: str, enc) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        ids += enc.encode_ordinary(piece)
    return ids


def bpe_decode(docs: DataFrame, ids: str = "token_ids", out: str = "decoded", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the raw bytes of token ids (binary: ids need not end at a character)."""
    rank_file, pattern = rank_file or default_rank_file(), pattern or default_pattern()

    @F.pandas_udf("binary")
    def decoded(column):
        enc = encoder(rank_file, pattern)
        return column.map(lambda x: enc.decode_bytes([int(i) for i in x]) if x is not None else b"")

    return docs.withColumn(out, decoded(F.col(ids)))


def bpe_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes and decodes each text in one pass and keeps digests in place of the ids.

    Returns key, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded bytes), n_bytes and round_trip (the decoded
    bytes are the text's). One row per input row, repeated rows and null keys
    included; a null text counts as empty; other columns are left out, whatever
    their names. Batches are worked off one text at a time, so memory is bounded
    by the longest text.
    """
    rank_file, pattern = rank_file or default_rank_file(), pattern or default_pattern()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        decimal = [str(i).encode() for i in range(enc.n_vocab)]
        for batch in batches:
            rows = []
            for value in batch.column(1):
                whole = value.as_py() or ""
                ids = encode(whole, enc)
                back = enc.decode_bytes(ids)
                rows.append((len(ids), hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(back).hexdigest(), len(back), back == whole.encode()))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["key", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "round_trip"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(digest, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, round_trip boolean")
    return out.withColumnRenamed("key", key)


def bpe_round_trip(docs: DataFrame, text: str = "text", ids: str = "token_ids", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the token ids and their number (n_tokens) and puts the ids' decoded bytes in the text's place.

    All other columns stay; columns of the added names are replaced. A null text
    stays null and has no ids.
    """
    rank_file, pattern = rank_file or default_rank_file(), pattern or default_pattern()

    names = [c for c in docs.columns if c not in (ids, "n_tokens")]
    carry = tuple(c for c in names if c != text)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                texts = part.column(1).to_pylist()
                found = [encode(t, enc) if t else [] for t in texts]
                back = [None if t is None else enc.decode_bytes(x).decode() for t, x in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(back, pa.string()), pa.array(found, pa.list_(pa.int32()))], names=["row", "text", "ids"])

    rows = docs.select(row_struct(carry), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(both, f"row {rows.schema['row'].dataType.simpleString()}, text string, ids array<int>")
    done = unpack_row(made, carry, F.col("text").alias(text), F.col("ids").alias(ids), F.size("ids").cast("long").alias("n_tokens"))
    return done.select(*map(named, names), named(ids), "n_tokens")
