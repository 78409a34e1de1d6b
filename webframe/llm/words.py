"""Vectorised word and shingle hashes over Arrow string columns, for use inside tasks.

Words are hashed from prefix sums of a polynomial over the bytes of a chunk, so
there is no Python loop over words. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, bytes, offsets of rows in them) of about ``size`` bytes; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words, in order; a word ends with its row."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = space[data]
    inside = ~gap
    starts, ends = inside[1:-1] & gap[:-2], inside[1:-1] & gap[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts[cut] |= inside[1:-1][cut]
    ends[cut - 1] |= inside[1:-1][cut - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle of ``size`` words; a row with fewer words has its whole sequence as one."""
    data = LOWER[data]
    starts, ends, rows = words(data, offsets)
    hashed = word_hashes(data, starts, ends)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    n = len(hashed) - size + 1
    if n > 0:
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += hashed[k : k + n] * _MIX[k]
        whole = rows[:n] == rows[size - 1 :]
        out, of = mixed(total[whole]), rows[:n][whole]
    else:
        out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.array([(hashed[a : a + c] * _MIX[:c]).sum(dtype=np.uint64) for a, c in zip(first, count[short])], np.uint64)
        extra += _MIX[size + count[short]]
        out, of = np.concatenate([out, mixed(extra)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of
