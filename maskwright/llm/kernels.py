"""Vectorised byte kernels over Arrow string columns.

Texts are handled as the UTF-8 bytes Arrow already holds, many documents at a time, so that finding words and
hashing them costs a few numpy passes instead of a Python call per word. Words are separated by ASCII bytes only,
hence byte classes are enough. Hashes are 64 bits wide: polynomial over a table of random byte values, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  #: bytes handled at once; a longer document is one chunk of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes that belong to words: everything but 0x20 and 0x09-0x0D
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: bytes that belong to words: digits, a-z (after lowering), everything from 0x80
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, p, np.uint64))), dtype=np.uint64) for p in (_P, inverse)]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes, one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of documents i..j-1: byte places from the first document's start, hashes, and their documents."""

    __slots__ = ("doc", "ends", "first", "hashes", "inverse", "low", "starts", "total")

    def __init__(self, data: np.ndarray, off: np.ndarray, i: int, j: int, inside: np.ndarray, hashed: bool = True):
        base = int(off[i])
        low = LOWER[data[base : int(off[j])]]
        at = off[i : j + 1] - base
        word = inside[low]
        begins, stops = word.copy(), word.copy()
        if len(low):
            begins[1:] &= ~word[:-1]
            stops[:-1] &= ~word[1:]
            heads = at[:-1][at[:-1] < len(low)]
            begins[heads] = word[heads]
            tails = at[1:][at[1:] > 0] - 1
            stops[tails] = word[tails]
        self.low = low
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.doc = np.searchsorted(at, self.starts, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(j - i + 1))  #: index of each document's first word, and the end
        if hashed:
            power, self.inverse = _powers(len(low) + 1)
            self.total = np.zeros(len(low) + 1, np.uint64)
            np.cumsum(_RANDOM[low] * power[: len(low)], out=self.total[1:])
            self.hashes = self._hashed(self.ends)

    def _hashed(self, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[self.starts]) * self.inverse[self.starts])

    def heads(self, n: int) -> np.ndarray:
        """Hashes of the words' first n bytes."""
        return self._hashed(np.minimum(self.ends, self.starts + n))

    def __len__(self) -> int:
        return len(self.starts)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, over document borders too."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, p = hashes[:m].copy(), 1
    for k in range(1, n):
        p = p * int(_P) & 0xFFFFFFFFFFFFFFFF
        out += hashes[k : k + m] * np.uint64(p)
    return mix(out)
