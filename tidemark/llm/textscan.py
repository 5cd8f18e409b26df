"""Vectorised scanning of Arrow string columns: words, word hashes and n-gram hashes.

Everything works on the UTF-8 bytes of a whole run of rows at once, so that the Python
operators of this package spend their time in numpy. All hashes are 64-bit and depend on
content alone (never on the process, the row or the partition), hence equal on every executor.

Bytes above 0x7F belong to words: the separators of every word definition used here are ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = U(0xD6E8FEB86659FD93)
#: Bytes whose words are hashed at once.
BLOCK = 1 << 18
#: Words that are joined at once.
PIECE = 1 << 13

#: Word definitions: which bytes separate words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and lower-case letters (for text that lower() has seen).
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            a, b = np.full(size, _BASE), np.full(size, _INVERSE)
            a[0] = b[0] = 1
            self.up, self.down = np.multiply.accumulate(a), np.multiply.accumulate(b)
        return self.up[:n], self.down[:n]


_powers = _Powers()


@dataclass
class Words:
    """Words of consecutive rows. Word i is data[start[i]:end[i]]; row r has words first[r]:first[r+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; worked out over runs of words of BLOCK bytes, so
        that a very long row takes no more memory than a short one (a longer word is its own run)."""
        out, a, n = np.empty(len(self.start), U), 0, len(self.start)
        while a < n:
            low = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, low + BLOCK, "right")))
            start, end = self.start[a:b] - low, self.end[a:b] - low
            size = int(end[-1])
            up, down = _powers.to(size + 1)
            total = np.zeros(size + 1, U)
            np.cumsum((self.data[low : low + size].astype(U) + U(1)) * up[:size], out=total[1:])
            out[a:b] = mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * _GRAM)
            a = b
        return out

    def pieces(self, at: np.ndarray) -> Iterator[bytes]:
        """What the words of those numbers make when they are joined by one space, piece by piece."""
        for a in range(0, len(at), PIECE):
            part, data = at[a : a + PIECE], self.data
            words = [data[s:e].tobytes() for s, e in zip(self.start[part].tolist(), self.end[part].tolist(), strict=True)]
            yield b" ".join(words if a == 0 else [b"", *words])

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive), joined by one space."""
        data = self.data
        return b" ".join([data[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)])


def chunks(column: pa.Array | pa.ChunkedArray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `size` bytes of text; a longer row stands alone."""
    lengths = column.offsets_np
    a, n = 0, len(lengths) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(lengths, lengths[a] + size, "right")) - 1)
        yield a, b
        a = b


@dataclass
class Column:
    """A string column as bytes and offsets; nulls are empty rows."""

    data: np.ndarray
    offsets_np: np.ndarray

    @classmethod
    def of(cls, array: pa.Array) -> Column:
        if array.null_count:
            array = array.fill_null("")
        wide = pa.types.is_large_string(array.type)
        buffers = array.buffers()
        offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int32)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
        return cls(data, offsets.astype(np.int64))

    def words(self, a: int, b: int, separators: np.ndarray = WHITE, lower: bool = False) -> Words:
        """The words of rows [a, b)."""
        offsets = self.offsets_np[a : b + 1]
        data = self.data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if lower:
            data = _LOWER[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        return Words(data, start, end, np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, len(hashes) - k + 1 of them; the caller masks those that cross rows."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= _GRAM
        total += hashes[j : j + n]
    return mix(total)


def inside_rows(words: Words, k: int) -> np.ndarray:
    """Starts i (word indexes) for which the k words from i on lie in one row."""
    n = len(words.start) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(words.first) == 2:  # one long row
        return np.arange(n)
    last = np.repeat(words.first[1:], words.counts)
    return np.flatnonzero(np.arange(n) + k <= last[:n])


def sliding(op: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """op (minimum or maximum) over every w consecutive elements, in O(log w) passes."""
    if len(x) < w:
        return x[:0]
    span, out = 1, x
    while span * 2 <= w:
        out = op(out[: len(out) - span], out[span:])
        span *= 2
    return op(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1]) if span < w else out
