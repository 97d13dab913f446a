"""Vectorised word and shingle hashing over Arrow string buffers (numpy only)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SLICE_BYTES = 2 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: is it white space; a random value, the same for A-Z and a-z."""
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    lower = np.arange(256)
    lower[65:91] += 32
    values = np.random.default_rng(20_25).integers(1, 2**63, 256, dtype=np.uint64)
    return space, values[lower]


_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(SLICE_BYTES + 1, n)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them) of runs of rows of about `most` bytes.

    Null counts as empty; one row longer than `most` makes a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each row's first word, with the total at the end).

    A word is a run of bytes other than white space within one row, with A-Z lower-cased."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space, values = _byte_tables()
    up, down = _power_tables(n + 1)
    ink = ~space[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(ink & (first[:n] | ~np.concatenate(([False], ink[:-1]))))
    ends = np.flatnonzero(ink & (first[1:] | ~np.concatenate((ink[1:], [False])))) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return words, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle of `width` words, bounds of each row's shingles).

    A row with words but fewer than `width` gives one shingle, its whole sequence."""
    counts = np.diff(bounds)
    odd = np.random.default_rng(width).integers(1, 2**63, width, dtype=np.uint64) | _U(1)
    grams = np.zeros(len(words), np.uint64)
    for k in range(width):
        grams[: len(words) - k if k else None] += words[k:] * odd[k]
    grams = mix(grams)
    out_counts = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    within = np.arange(len(words)) - np.repeat(bounds[:-1], counts)
    keep = within < np.repeat(out_counts, counts)
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[bounds[i] : bounds[i + 1]]
        grams[bounds[i]] = mix((own * odd[: len(own)]).sum(dtype=np.uint64, keepdims=True) + _U(len(own)))[0]
    return grams[keep], np.concatenate(([0], np.cumsum(out_counts)))


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row, in order."""
    for _, _, data, offsets in text_slices(column):
        grams, bounds = shingle_hashes(*word_hashes(data, offsets), width)
        for i in range(len(offsets) - 1):
            own = grams[bounds[i] : bounds[i + 1]]
            own.sort()
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own
