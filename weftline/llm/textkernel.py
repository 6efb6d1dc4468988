"""Vectorised words and hashes over the UTF-8 bytes of Arrow string columns.

Everything here works on a chunk: the concatenated bytes of some rows and the rows' offsets. Chunks are cut
between rows at about ``CHUNK`` bytes, so memory is bounded by that or by one row's own size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
U = np.uint64

#: Separators: space and U+0009 to U+000D; or every ASCII character but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


class Chunk(NamedTuple):
    rows: slice
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # of each row, its first word's index; one more entry at the end
    hashes: np.ndarray


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[Chunk]:
    """Byte chunks of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield Chunk(slice(row, stop), data[at[row] : at[stop]], at[row : stop + 1] - at[row])
        row = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 4096), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes and lengths wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_P, len(data)), out=sums[1:])
    inverse = _power(_P_INVERSE, len(data) + 1)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    """Words (runs of bytes that are not separators, cut at row ends) with their hashes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]  # a word runs over a row's end
    begins[both] = ends[both] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, row, first, span_hashes(data, start, end))


_C = [U(x) for x in np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | U(1)]


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that lie in one row, and the index of each one's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += hashes[i : i + n] * _C[i % 64]
    fits = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(fits, np.minimum(first[:-1], len(hashes)), 1)
    row = np.cumsum(fits)[: len(hashes)]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(total[at] + U(k)), at


def distinct_shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set of k-word shingles; the whole sequence is one where there are fewer words.

    Returns the hashes, sorted within each row, and the rows' offsets into them.
    """
    rows = len(w.first) - 1
    hashes, at = windows(w.hashes, w.first, k)
    row = w.row[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = count[short] > i
            extra[has] += w.hashes[w.first[short[has]] + i] * _C[i % 64]
        hashes, row = np.concatenate([hashes, mix(extra + count[short].astype(np.uint64))]), np.concatenate([row, short])
    order = np.lexsort((hashes, row)) if len(short) else _sort_within(hashes, row)
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[keep], row[keep]
    return hashes, np.searchsorted(row, np.arange(rows + 1))


def _sort_within(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """An order by (row, value) for rows that are already ascending."""
    by_value = np.argsort(values)
    return by_value[np.argsort(row[by_value], kind="stable")]


def sums_by_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]], modulo 2**64 for unsigned integers."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
