"""Vectorised word handling over Arrow text columns (used inside mapInArrow).

A batch is cut into blocks of whole texts of about a megabyte; within a block the
words of all texts are found and hashed with a few numpy passes over the UTF-8
bytes, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20

_U = np.uint64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_C1, _C2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LANE1, _LANE2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Bytes that belong to words: everything but ASCII white space.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes that belong to lower-cased words of digits, a-z and non-ASCII letters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


@dataclass
class Block:
    """Whole texts of rows first..last-1 of a batch, as bytes, with eight spare bytes."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def words(self, table: np.ndarray, lower: bool = False, accents: bool = False) -> "Words":
        """lower takes A-Z down, accents also the letters of the Latin-1 block."""
        n = int(self.offsets[-1])
        data = LOWER[self.data] if lower else self.data
        if accents:
            data = data.copy()
            upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
            data[upper] += 0x20
        inside = table[data[:n]]
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        firsts = self.offsets[:-1]
        before[firsts[firsts < n]] = False
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        lasts = self.offsets[1:]
        after[lasts[lasts > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return Words(data, starts, ends, np.searchsorted(starts, self.offsets))


@dataclass
class Words:
    """Words of a block: byte ranges, and for each text its first word (bounds has one more)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self, lanes: int = 1) -> list[np.ndarray]:
        """One or two independent 64-bit hashes of each word's bytes."""
        view = np.ndarray((len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        length = self.ends - self.starts
        x = view[self.starts] & _MASK[np.minimum(length, 8)]
        seed = x ^ (length.astype(np.uint64) << _U(56))
        out = [mix(seed + lane) for lane in (_LANE1, _LANE2)[:lanes]]
        rest = np.flatnonzero(length > 8)
        at = self.starts[rest] + 8
        while rest.size:
            left = self.ends[rest] - at
            x = view[at] & _MASK[np.minimum(left, 8)]
            for h, lane in zip(out, (_LANE1, _LANE2)):
                h[rest] = mix(h[rest] * lane + x)
            more = left > 8
            rest, at = rest[more], at[more] + 8
        return out


_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(18, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


class RollingHash:
    """Hashes of word windows of any length over one block, from one prefix sum."""

    def __init__(self, word_hashes: np.ndarray):
        n = len(word_hashes)
        up, self._down = _powers(n + 1)
        self._prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(word_hashes * up[:n], out=self._prefix[1:])
        self._n = n

    def all(self, length: int) -> np.ndarray:
        """Hash of words [i, i+length) for every i; windows may span texts."""
        n = self._n - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self._prefix[length:] - self._prefix[:n]) * self._down[:n])

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._prefix[end] - self._prefix[begin]) * self._down[begin])


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op (minimum or maximum) over every run of width values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def window_is_inside(bounds: np.ndarray, length: int) -> np.ndarray:
    """For every word: whether a window of that length from it ends in the same text."""
    n = int(bounds[-1])
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(n) + length <= ends


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the n positions that lie in any of the half-open ranges."""
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, begin, 1)
    np.add.at(marks, end, -1)
    return np.cumsum(marks[:n]) > 0


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts; a null is an empty text; a text over the size is a block alone."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        low, high = int(offsets[first]), int(offsets[last])
        own = np.zeros(high - low + 8, dtype=np.uint8)
        own[: high - low] = data[low:high]
        yield Block(first, last, own, offsets[first : last + 1] - low)
        first = last


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def named(column: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_struct(carry: tuple[str, ...]) -> Column:
    """The carried columns as one struct of own names, so that no name can clash."""
    return F.struct(*(named(c).alias(f"c{k}") for k, c in enumerate(carry)), F.lit(0).alias("_")).alias("row")


def unpack_row(made: DataFrame, carry: tuple[str, ...], *more: Column) -> DataFrame:
    return made.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)), *more)
