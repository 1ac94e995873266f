"""Vectorised work on UTF-8 columns: word spans, span hashes and word shingles, whole Arrow batches at a time.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A null text counts as empty.
Hashes are 64-bit: a polynomial over the bytes of the span, its length, and a finalising mix.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass takes; a longer text is one pass of its own.
SLICE_BYTES = 1 << 18

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _power(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base ("up") or of its inverse modulo 2**64 ("down")."""
    if len(_powers[kind]) < n:
        step = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _INVERSE, _U)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(32)
    return x


@cache
def _libc():  # noqa: ANN202
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: its allocator keeps what it keeps
        return None


def trim() -> None:
    """Give memory that was freed since the last batch back to the system: workers live through many stages beside the heap."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def column(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts in them; null becomes empty. Freed memory is trimmed first."""
    if len(values) >= 1000:
        trim()
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = pc.fill_null(values.cast(pa.large_string()), "")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    if data is None or not len(values):
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``most`` bytes, or of one longer row."""
    most, n, i = most or SLICE_BYTES, len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for every text the index of its first word (n + 1 numbers)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    full = at[1:] > at[:-1]
    heads, tails = at[:-1][full], at[1:][full] - 1
    first[heads] = word[heads]
    last[tails] = word[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span's bytes."""
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _power("up", len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * _power("down", len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``k`` words of one text; of all its words, if it has fewer; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.full(n - k + 1, _U(k), _U)
    for j in range(k):
        h = h * _U(0x9E6C63D0876A9A47) + words[j : n - k + 1 + j]
    return np.unique(mix(h))


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """``shingles`` of every text, with A-Z in lower case."""
    for i, j in slices(at):
        part = LOWER[data[at[i] : at[j]]]
        starts, ends, first = spans(part, at[i : j + 1] - at[i])
        words = span_hash(part, starts, ends)
        for d in range(j - i):
            yield shingles(words[first[d] : first[d + 1]], k)
