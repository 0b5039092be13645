"""Texts of an Arrow batch as bytes, words and their hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

# Texts worked on together; every array below is a small multiple of this.
BLOCK_BYTES = 1 << 20

_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of `x`."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX_1
    x ^= x >> np.uint64(33)
    x *= _MIX_2
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about `limit` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: np.uint64) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(_BASE_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Letters, digits and every byte of a character beyond ASCII.
_LETTER = np.zeros(256, bool)
for _first, _last in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _LETTER[_first : _last + 1] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the accented capitals of Latin-1 (U+00C0 to U+00DE) in lower case."""
    low = _LOWER[data]
    accented = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[accented]
    low[accented[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 32
    return low


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, in order: runs of letters and digits, lowered as by `lowered`."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _LETTER[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((lowered(data).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def gram_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of every run of `k` words that stays in its row."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total *= _STEP
        total += words[j : j + n]
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mixed(total[at]), at


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is executed inside hands Python at most `rows` rows at once; for rows that are long lists or texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
