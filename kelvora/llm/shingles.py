"""Word shingles of whole texts, vectorised over the UTF-8 bytes of a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

WORDS = 5
#: Documents are taken together up to so many bytes and rows; a longer one is taken alone. Work space is some 60 bytes a byte.
SLICE_BYTES = 1 << 18
SLICE_ROWS = 1024
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


@cache
def _kept(base: int) -> np.ndarray:
    return _series(np.uint64(base), SLICE_BYTES + 1)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**i, or base**-i, modulo 2**64, for i up to n at least. What a longer text needs is made for it and not kept."""
    base = pow(int(_BASE), -1, 2**64) if inverse else int(_BASE)
    return _kept(base) if n <= SLICE_BYTES + 1 else _series(np.uint64(base), n)


def trimmed(make):
    """make, a function of an iterator of batches, that hands freed memory back when its input ends: Python workers are
    reused, and a later stage finds what an earlier one has kept."""

    def run(batches):
        yield from make(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def slices(column: pa.Array, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows) of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1)
        end = min(end, row + most_rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, first word of each row and the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = solid[edges]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    # Bytes of words, one after another: a byte's weight is its value's number times a power for its place in its word.
    own = np.flatnonzero(solid)
    low = data[own]
    low = np.where((low >= 65) & (low <= 90), low + 32, low)
    first = np.searchsorted(own, start)
    size = np.diff(first, append=len(own))
    place = np.arange(len(own)) - np.repeat(first, size)
    hashes = mix64(np.add.reduceat(_BYTE[low] * powers(int(size.max()))[place], first) + size.astype(np.uint64))
    return hashes, np.searchsorted(start, offsets, side="left")


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct shingles of each row in ascending order, first shingle of each row and the end)."""
    words, first = word_hashes(data, offsets)
    counts = np.diff(first)
    n = np.where(counts >= WORDS, counts - WORDS + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    at = np.arange(len(row)) - begin[row] + first[row]
    short = counts[row] < WORDS
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    h = np.zeros(len(row), np.uint64)
    for k in range(WORDS):
        here = padded[at + k]
        here = np.where(short & (k >= counts[row]), np.uint64(0), here) if short.any() else here
        h += here * _PLACE[k]
    h = mix64(h + np.where(short, counts[row] + 1, 0).astype(np.uint64))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    return h, np.searchsorted(row, np.arange(len(n) + 1))
