"""Words and shingles of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once. A longer text is worked on alone, whole.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20250101)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Free memory returns to the system; else idle workers hold what their largest batch needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidy(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; memory is given back at the end of the task."""
    try:
        yield from parts
    finally:
        give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield row, end, data[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


def spans(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that lie within one text."""
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.zeros(len(solid), bool), np.zeros(len(solid), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    cut = offsets[(offsets > 0) & (offsets < len(solid))]
    before[cut] = False
    after[cut - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each (non-empty) span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    longest = int(size.max())
    factors = _PLACE if longest <= 64 else np.concatenate([_PLACE, mix64(np.arange(64, longest, dtype=np.uint64) * _STEP) | np.uint64(1)])
    value = _BYTE[data[np.repeat(starts, size) + place]]
    value *= factors[place]
    return mix64(np.add.reduceat(value, first) ^ (size.astype(np.uint64) * _STEP))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of each text's first word, with the total last) of the words `[^\\x20\\x09-\\x0D]+`."""
    starts, ends = spans(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def sequence_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` items: as many as items, less width - 1."""
    n = max(0, len(items) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += items[j : j + n] * (_PLACE[j % 64] + np.uint64(j // 64 * 2))
    return mix64(out ^ np.uint64(width * int(_STEP) % 2**64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    runs = sequence_hashes(hashes, width)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield sequence_hashes(hashes[a:b], int(b - a))
        else:
            yield runs[:0]
