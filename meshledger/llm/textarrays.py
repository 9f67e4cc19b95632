"""Words of a whole Arrow batch as arrays.

A batch's string column is one byte buffer; words, their hashes and hashes of runs of words come from a few
vectorised passes over it, whatever the number or the length of the texts. Words are runs of bytes outside
0x20 and 0x09-0x0D, so UTF-8 is never cut inside a character. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
BLOCK = 1 << 20
_WORD = np.ones(256, np.uint8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0
#: Letters, digits and bytes of longer characters are one kind, other signs another.
SIGNS = np.full(256, 2, np.uint8)
SIGNS[[9, 10, 11, 12, 13, 32]] = 0
SIGNS[np.r_[48:58, 65:91, 97:123, 128:256]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, a bijection of 64-bit values."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """The first n values of the splitmix64 sequence of a seed."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15))


@dataclass
class Words:
    """Words of a batch: byte spans in ``data``, and ``first[d]:first[d + 1]`` for the words of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """One 64-bit hash per word: sum of byte value times a random odd factor of its place, then mixed."""
        if not len(self.start):
            return np.empty(0, _U)
        length = self.end - self.start
        factor = stream(seed, int(length.max())) | _U(1)
        letter = stream(seed + 77, 256)
        out = np.empty(len(length), _U)
        through = np.cumsum(length)
        i = 0
        while i < len(length):  # blocks of words, so that temporary arrays stay small
            upto = np.searchsorted(through, through[i] - length[i] + BLOCK, "right")
            j = max(i + 1, int(upto))
            size = length[i:j]
            begin = np.cumsum(size) - size
            at = np.arange(int(size.sum())) - np.repeat(begin, size)
            value = letter[self.data[np.repeat(self.start[i:j], size) + at]] * factor[at]
            out[i:j] = np.add.reduceat(value, begin)
            i = j
        return mix(out + length.astype(_U) * _U(0x9E3779B97F4A7C15))


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in turn, about ``size`` bytes of the column at a time and one row at least."""
    text = batch.column(column)
    length = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(length) // size
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)] if len(part) else [0, 0]
    for i, j in zip(edges[:-1], edges[1:]):
        yield batch.slice(int(i), int(j - i))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def words_of(column: pa.Array, lower: bool = False, kinds: np.ndarray = _WORD) -> Words:
    """The words of every text of a string column; ``lower`` folds A-Z. ``kinds`` has a kind for every byte,
    0 for white space: words are the longest runs of one kind."""
    data, offsets = string_buffer(column)
    if not len(data):
        return Words(data, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64))
    kind = kinds[data]
    turn = np.empty(len(data) + 1, bool)
    turn[0] = turn[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=turn[1:-1])
    turn[offsets] = True
    start = np.flatnonzero(turn[:-1] & (kind != 0))
    end = np.flatnonzero(turn[1:] & (kind != 0)) + 1
    return Words(_LOWER[data] if lower else data, start, end, np.searchsorted(start, offsets))


def run_hashes(words: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Hash of words i .. i+n-1 for every i of the flat array (across texts: mask with ``inside``)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, _U)
    factor = stream(seed, n) | _U(1)
    total = np.zeros(count, _U)
    for i in range(n):
        total += words[i : i + count] * factor[i]
    return mix(total)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which runs of n words starting at each word lie within one text."""
    count = total - n + 1
    if count <= 0:
        return np.empty(0, bool)
    left = np.repeat(first[1:], np.diff(first))
    return left[:count] - np.arange(count) >= n


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that are the smallest of some run of ``width`` neighbours (leftmost if equal)."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.int64)
    best = np.lib.stride_tricks.sliding_window_view(hashes, width)
    return np.unique(np.arange(count) + best.argmin(axis=1))
