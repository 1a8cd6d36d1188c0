"""Hashing of words in Arrow string batches, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (one-to-one)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts (one more at the end); null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]] if len(at) else data, at - at[0] if len(at) else np.zeros(1, np.int64)


def runs(at: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes each, one long row at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that end words: space, and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that end words of letters, digits and all beyond ASCII.
BREAK = np.zeros(256, bool)
BREAK[:48] = BREAK[58:97] = BREAK[123:128] = True


def words(data: np.ndarray, at: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of the lower-cased rows."""
    data = _LOWER[data]
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    where = np.flatnonzero(starts)
    if not len(where):
        return np.zeros(0, U), np.zeros(0, np.int64)
    local = np.arange(len(data)) - where[np.maximum(np.cumsum(starts) - 1, 0)]
    local = np.where(inside, local, 0)
    powers = np.full(int(local.max()) + 1, _STEP | 1, U)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    value = np.where(inside, data.astype(U) + U(1), U(0)) * powers[local]
    row = np.searchsorted(at, where, "right") - 1
    return mix(np.add.reduceat(value, where)), row


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``k``-word shingles; a row of fewer words is one shingle."""
    ends = np.searchsorted(row, np.arange(rows + 1))
    out = []
    with np.errstate(over="ignore"):
        ways = [U((_STEP * (2 * j + 3)) & (2**64 - 1)) for j in range(k)]
        n = max(len(hashes) - k + 1, 0)
        full = np.full(n, U(k), U)
        for j in range(k):
            full += mix(hashes[j : j + n] + ways[j])  if n else 0
        full = mix(full)
        for r in range(rows):
            a, b = int(ends[r]), int(ends[r + 1])
            if b - a >= k:
                out.append(np.unique(full[a : b - k + 1]))
            elif b > a:
                short = U(b - a)
                for j in range(b - a):
                    short = short + mix(hashes[a + j : a + j + 1] + ways[j])
                out.append(mix(short))
            else:
                out.append(np.zeros(0, U))
    return out
