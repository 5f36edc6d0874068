"""Vectorised text primitives over Arrow string columns.

A batch's texts are looked at as one byte array with offsets; words, their hashes and
shingles come from whole-array numpy operations, so no Python string is made per word.
Work is cut into blocks of about ``BLOCK`` bytes (a longer text is a block of its own), which
bounds memory by the block, not by the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []

#: Byte tables: lower-casing of A-Z only, and which bytes belong to a word.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[9, 10, 11, 12, 13, 32]] = False
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[48:58] = ALNUM_WORD[65:91] = ALNUM_WORD[97:123] = ALNUM_WORD[128:] = True

_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _RANDOM[LOWER]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` with its memory given back at the end of a task, since Python workers live on and many share a machine."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not the GNU library
                pass

    return task


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK)
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        made = []
        for p in (_PRIME, inverse):
            a = np.full(size, p, dtype=np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def blocks(col: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into the bytes) of consecutive rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a word never crosses two rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    full = off[1:] > off[:-1]
    before[off[:-1][full]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[off[1:][full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each lower-cased byte span, from prefix sums of one polynomial."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_FOLDED[data] * up[: len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word index of every run of k words inside one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= np.uint64(0xFF51AFD7ED558CCD)
        g += h[j : j + n]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(g[at]), at


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows' items begin in the sorted array ``row``; n + 1 entries."""
    return np.searchsorted(row, np.arange(n + 1))
