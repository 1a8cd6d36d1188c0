"""Which 64-bit hashes occur in at least so many places, as bitmaps of bounded size.

Tasks send the distinct top 40 bits of their hashes with how often each has been seen, cut into slices and packed as
differences; a slice's task adds them up. A hash that a third of all rows hold is one entry for each ``FLUSH`` hashes that
a task reads, not one for each row. The answer is a bitmap over the top ``bits`` bits, at most ``2**MOST_BITS`` bits
however much there is, so it can always be broadcast. Hashes that share those bits share an answer: a set bit may mean
another hash, a clear bit is certain. Callers use it only where a falsely set bit costs time, never rows.

A map of what occurs twice fills up as tables grow; then callers write and drop keys that occur once, a cost in
proportion to the input. A map of frequent hashes does not fill up: of a ladder of limits the lowest is taken that sets
at most one bit in ``SPARSE``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

U = np.uint64
MOST_BITS, SPARSE = 27, 16
PACKED = "slice int, data binary"
_PACKED = pa.schema([("slice", pa.int32()), ("data", pa.binary())])
FLUSH = 1 << 20


def sizes(rows: int, each: int) -> tuple[int, int]:
    """Bits of the map and of the slice number for ``rows`` rows of about ``each`` hashes."""
    total = max(1, rows * each)
    return min(MOST_BITS, max(16, math.ceil(math.log2(total)))), max(4, math.ceil(math.log2(total)) - 19)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal sorted keys start, and how long they are."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))


class Packer:
    """Gathers hashes; ``add`` and ``flush`` yield batches of packed slices."""

    def __init__(self, slice_bits: int):
        self.bits, self.held, self.n = slice_bits, [], 0
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def add(self, hashes: np.ndarray):
        self.held.append(hashes >> U(24))
        self.n += len(hashes)
        if self.n >= FLUSH:
            yield from self.flush()

    def _cell(self, i: int, keys: np.ndarray, times: np.ndarray) -> bytes:
        """Five bytes of each difference by significance, then four of each count (nearly all 1, so they pack to nothing)."""
        steps = np.diff(keys, prepend=U(i) << U(40 - self.bits)).view(np.uint8).reshape(-1, 8).T[:5]
        return self.pack(steps.tobytes() + times.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())

    def flush(self):
        if self.n:
            keys = np.sort(np.concatenate(self.held))
            starts, times = _runs(keys)
            keys = keys[starts]
            ends = np.searchsorted(keys, np.arange((1 << self.bits) + 1).astype(U) << U(40 - self.bits))
            found = [(i, a, b) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
            data = [self._cell(i, keys[a:b], times[a:b]) for i, a, b in found]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in found], pa.int32()), pa.array(data, pa.binary())], schema=_PACKED)
        self.held, self.n = [], 0


def _unpack(i: int, data: bytes, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of one cell."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(9, -1)
    wide = np.zeros((raw.shape[1], 8), np.uint8)
    wide[:, :5] = raw[:5].T
    times = np.ascontiguousarray(raw[5:].T).view(np.uint32).ravel()
    return np.cumsum(wide.view(U).ravel(), dtype=U) + (U(i) << U(40 - slice_bits)), times.astype(np.int64)


def _counter(bits: int, slice_bits: int, least: list[int]):
    own = max(bits - slice_bits, 3)

    def count(key: tuple[pa.Scalar, ...], packed: pa.Table) -> pa.Table:
        i = key[0].as_py()
        cells = [_unpack(i, x.as_py(), slice_bits) for x in packed.column("data")]
        keys, times = np.concatenate([k for k, _ in cells]), np.concatenate([t for _, t in cells])
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        starts, _ = _runs(keys)
        times = np.add.reduceat(times, starts)
        place = ((keys[starts] << U(slice_bits)) & U(2**40 - 1)) >> U(40 - own)
        out = {"slice": pa.array([i], pa.int32())}
        for j, n in enumerate(least):
            flags = np.zeros(1 << own, bool)
            flags[place[times >= n]] = True
            map_ = zstandard.ZstdCompressor(level=1).compress(np.packbits(flags, bitorder="little").tobytes())
            out |= {f"n{j}": pa.array([int(flags.sum())]), f"m{j}": pa.array([map_])}
        return pa.table(out)

    return count


def _gather(rows: DataFrame, j: int, bits: int, slice_bits: int) -> np.ndarray:
    own = max(bits - slice_bits, 3)
    total = np.zeros(1 << (own + slice_bits - 3), np.uint8)
    for row in rows.select("slice", f"m{j}").toLocalIterator():
        one = np.frombuffer(zstandard.ZstdDecompressor().decompress(row[1]), np.uint8)
        total[row[0] * len(one) : (row[0] + 1) * len(one)] = one
    return total


def count_bitmaps(packed: DataFrame, bits: int, slice_bits: int, twice: int, ladder: list[int] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Bitmaps (uint8, 8 bits each) of the hashes that occur ``twice`` times at least, and of those that occur as often
    as the lowest limit of ``ladder`` that leaves the map sparse. The driver gets these bitmaps alone."""
    least = [twice, *(ladder or [])]
    schema = "slice int" + "".join(f", n{j} bigint, m{j} binary" for j in range(len(least)))
    rows = materialize(packed.groupBy("slice").applyInArrow(_counter(bits, slice_bits, least), schema))
    filled = rows.agg(*[F.coalesce(F.sum(f"n{j}"), F.lit(0)) for j in range(len(least))]).first()
    step = next((j for j in range(1, len(least)) if filled[j] * SPARSE <= 1 << bits), len(least) - 1)
    out = _gather(rows, 0, bits, slice_bits), _gather(rows, step, bits, slice_bits) if ladder else None
    discard(rows)
    return out


def member(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> U(64 - int(math.log2(len(bitmap) * 8)))
    return (bitmap[place >> U(3)] >> (place & U(7)).astype(np.uint8)) & np.uint8(1) == 1
