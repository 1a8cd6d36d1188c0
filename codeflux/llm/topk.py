"""Exact top-k inner-product search over a pivot-distance index.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, and queries a zero there: the largest inner
product is then the smallest Euclidean distance, and the triangle inequality holds. Each vector is keyed by its nearest
pivot (its cell) and its distance to it, and sorted by both; consecutive vectors of a cell form annuli of at most
``BLOCK`` vectors, so a crowded cell, or any number of equal vectors, is many annuli. Pivots are half the square root of
the number of vectors, at most ``MOST_PIVOTS``: any pivots give exact results, they only steer how much is skipped.

Queries, in chunks of neighbours (at most ``CHUNK``), expand over annuli by growing gap, that is by how near an annulus could be:
first the nearest ``STEPS[0]``, then more and more. After each step the k-th best score so far bounds what can still
matter; a chunk stops when no annulus is left within the bound of any of its queries. The gap is the larger of two
bounds: by the distance to the annulus' pivot, |d(q, p) - d(x, p)| <= d(q, x), and by the plane between that pivot and the
query's nearest. Only pairs of numbers (chunk, annulus) are planned; vectors travel once for each pair, packed in as few
bytes as the largest component needs.

Defined results: vectors that are null or empty, or hold null or non-finite components, and rows without an id take no
part; rows that repeat whole count once, and a row with the query's id is never its candidate; vectors of different
length are never compared; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, small

MOST_PIVOTS, BLOCK, CHUNK, FEWEST = 4096, 1024, 512, 64
#: Annuli that a chunk takes in each step; the last step takes all that are left within its bounds.
STEPS = (4, 24)
#: Summaries of annuli that a task holds at once.
SLICE = 1 << 16


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """vec_id, v (array of long), dim, norm2 of the rows that take part."""
    vec = F.col(vec_col)
    fit = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size(vec) > 0)
    v = F.transform(vec, lambda x: F.floor(x.cast("double") * scale))
    ints = rows.where(F.col(id_col).isNotNull() & vec.isNotNull() & fit).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return ints.distinct().select("vec_id", "v", F.size("v").alias("dim"), norm2.alias("norm2"))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in floats only where every partial sum is a whole number that they hold."""
    most = math.sqrt(float((a.astype(float) ** 2).sum(1).max(initial=0))) * math.sqrt(float((b.astype(float) ** 2).sum(1).max(initial=0)))
    if most < 2**22:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**51:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _apart(v: np.ndarray, rest: np.ndarray, pivots: np.ndarray, pivot_rest: np.ndarray) -> np.ndarray:
    """Distances of rows (v with the added component ``rest``) to pivots."""
    d2 = (v**2).sum(1)[:, None] + rest[:, None] ** 2 + (pivots**2).sum(1) + pivot_rest**2 - 2 * (v @ pivots.T + np.outer(rest, pivot_rest))
    return np.sqrt(np.maximum(d2, 0))


class _Space:
    """Pivots by dimension, the squared largest norm, and how components are packed."""

    def __init__(self, pivots: dict[int, tuple[np.ndarray, np.ndarray]], most2: float, largest: int):
        self.pivots, self.most2 = pivots, most2
        self.type = np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64
        # the float error of a distance is below a quarter of a millionth of the largest norm
        self.slack = 1e-3 + 1e-6 * math.sqrt(most2)

    def unpack(self, cell: bytes, dim: int) -> np.ndarray:
        return np.frombuffer(cell, self.type).reshape(-1, dim)


def _assign(space: _Space):
    """vec_id, dim, cell, dist, packed vector and whether it is a query, from batches of vec_id, v, dim, norm2, is_query."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                v = part.column("v").flatten().to_numpy().reshape(-1, dim)
                rest = np.sqrt(np.maximum(space.most2 - part.column("norm2").to_numpy(), 0))
                cells, dist = [], []
                for i in range(0, len(v), 1024):
                    d = _apart(v[i : i + 1024].astype(float), rest[i : i + 1024], *space.pivots[dim])
                    cells.append(d.argmin(1))
                    dist.append(d[np.arange(len(d)), cells[-1]])
                packed = pa.array([r.tobytes() for r in v.astype(space.type)], pa.binary())
                columns = [part.column("vec_id"), part.column("dim"), pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(dist)), packed, part.column("is_query")]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "cell", "dist", "vec", "is_query"])

    return run


INDEX = "vec_id bigint, dim int, cell int, dist double, vec binary, is_query boolean"
PIECE = "dim int, cell int, low double, high double, ids binary, vecs binary"


def _cut(most: int, whole: bool):
    """Runs of at most ``most`` rows, of one cell (or of one dimension, if not ``whole``), from rows in order of both."""

    def piece(rows: pa.Table) -> pa.RecordBatch:
        dist = rows.column("dist").to_numpy()
        cells = [rows.column("dim")[0].as_py(), rows.column("cell")[0].as_py(), dist.min(), dist.max(), rows.column("vec_id").to_numpy().tobytes(), b"".join(rows.column("vec").to_pylist())]
        types = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], ["dim", "cell", "low", "high", "ids", "vecs"])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            key = rows.column("dim").to_numpy().astype(np.int64) << 32 | (rows.column("cell").to_numpy() if whole else 0)
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            start = 0
            for end in ends.tolist():
                last = end == len(key)
                while start < end and (not last or end - start > most):
                    yield piece(rows.slice(start, min(most, end - start)))
                    start = min(end, start + most)
            held = rows.slice(start) if start < len(key) else None
        if held is not None and held.num_rows:
            yield piece(held)

    return run


def _plan(space: _Space, step: int):
    """Pairs (chunk, block) of a step, from chunks with their floors and all blocks' summaries of their dimension."""

    def gaps(q: np.ndarray, dim: int, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        pivots, rest = space.pivots[dim]
        d = _apart(q, np.zeros(len(q)), pivots, rest)
        near, inverse = np.unique(d.argmin(1), return_inverse=True)
        between = _apart(pivots[near], rest[near], pivots, rest)[inverse]
        mine = d[np.arange(len(q)), near[inverse]]
        plane = (d**2 - mine[:, None] ** 2) / np.maximum(2 * between, 1e-9)
        plane[np.arange(len(q)), near[inverse]] = 0
        return np.maximum(np.maximum(low - d[:, cell], d[:, cell] - high), np.maximum(plane[:, cell] - space.slack, 0))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("chunk", "dim", "vecs", "floors", "taken")}
                blocks, cells, low, high = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("blocks", np.int64), ("cells", np.int32), ("lows", np.float64), ("highs", np.float64)))
                q = space.unpack(row["vecs"], row["dim"]).astype(float)
                floors = np.full(len(q), -np.inf)
                for f in row["floors"] or ():
                    floors[f["at"]] = f["floor"]
                radius = np.sqrt(np.maximum((q**2).sum(1) + space.most2 - 2 * floors, 0)) + space.slack
                gap = gaps(q, row["dim"], cells, low, high)
                done = set(row["taken"] or ())
                live = [b for b in np.lexsort((blocks, gap.min(0))).tolist() if (gap[:, b] <= radius).any() and int(blocks[b]) not in done]
                if step < len(STEPS):
                    live = live[: STEPS[step]]
                out = blocks[live]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), row["chunk"])), pa.array(out)], ["chunk", "block"])

    return run


def _scan(space: _Space, k: int):
    """The k best of each block for each query of a chunk, with scores at or above the query's floor."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                qid, xid = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("q_ids", "ids"))
                q, x = (space.unpack(batch.column(c)[i].as_py(), dim) for c in ("q_vecs", "vecs"))
                order = np.argsort(xid, kind="stable")
                xid = xid[order]
                score = _products(q, x)[:, order]
                floor = np.full(len(qid), np.iinfo(np.int64).min)
                for f in batch.column("floors")[i].as_py() or ():
                    floor[f["at"]] = f["floor"]
                ok = (score >= floor[:, None]) & (qid[:, None] != xid)
                for j in np.flatnonzero(ok.any(1)):
                    at = np.flatnonzero(ok[j])
                    if len(at) > k:
                        s = score[j, at]
                        least = np.partition(s, -k)[-k]
                        above = at[s > least]
                        at = np.concatenate([above, at[s == least][: k - len(above)]])
                    out.append((np.full(len(at), qid[j]), xid[at], score[j, at]))
            columns = [np.concatenate(c) for c in zip(*out)] or [np.array([], np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


FOUND = "query_id bigint, vec_id bigint, score bigint"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build_index(vectors: DataFrame, is_query, n_pivots: int | None = None) -> tuple[DataFrame, _Space]:
    """The index (one row per vector) and its space. Pivots are the vectors of the smallest hashes of each dimension."""
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("most2"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).collect()
    most2 = max((r.most2 for r in sizes), default=0.0)
    pivots = {}
    for r in sizes:  # a row for each length of vectors
        want = n_pivots or min(MOST_PIVOTS, max(24, math.isqrt(r.n) // 2))
        hashed = vectors.where(F.col("dim") == r.dim).withColumn("h", F.xxhash64("vec_id", "v"))
        if r.n > 4 * want:  # the smallest hashes are surely among those below this
            hashed = hashed.where(F.col("h") < int(-(2**63) + 2**64 * min(1.0, (3 * want + 50) / r.n)))
        rows = hashed.orderBy("h", "vec_id").limit(want).select("v", "norm2").collect()
        pivots[r.dim] = np.array([x.v for x in rows], float), np.sqrt(np.maximum(most2 - np.array([x.norm2 for x in rows]), 0))
    space = _Space(pivots, most2, max((r.largest for r in sizes), default=0))
    return materialize(vectors.withColumn("is_query", is_query).mapInArrow(_assign(space), INDEX)), space


def _pieces(index: DataFrame, most: int, whole: bool = True) -> DataFrame:
    order = ["dim", "cell", "dist", "vec_id"]
    runs = index.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(runs.mapInArrow(_cut(most, whole), PIECE).withColumn("piece", F.monotonically_increasing_id()), "none")


def top_k(vectors: DataFrame, is_query, k: int = 20, n_pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for each row where ``is_query``.

    ``vectors`` comes from ``integer_vectors``."""
    index, space = build_index(materialize(vectors), is_query, n_pivots)
    blocks = _pieces(index, BLOCK).withColumnRenamed("piece", "block")
    queries = index.where("is_query")
    chunks = _pieces(queries, min(CHUNK, max(FEWEST, queries.count() // 100)), False).select(F.col("piece").alias("chunk"), "dim", "ids", "vecs")
    spots = materialize(chunks.select("chunk", "ids").mapInArrow(_spots, "chunk bigint, at int, query_id bigint"))
    one = F.struct("block", "cell", "low", "high")
    slices = -(-blocks.count() // SLICE) or 1
    lists = blocks.select("dim", one.alias("b"), F.pmod(F.xxhash64("block"), F.lit(slices)).alias("slice")).groupBy("dim", "slice").agg(F.collect_list("b").alias("bs"))
    lists = materialize(lists.select("dim", "bs").mapInArrow(_columns, "dim int, blocks binary, cells binary, lows binary, highs binary"))
    lists = maybe_broadcast(lists)
    few_blocks, few_chunks = small(blocks), small(chunks)
    hint = lambda df, few: F.broadcast(df) if few else df

    best = taken = None
    for step in range(len(STEPS) + 1):
        if best is None:
            state = chunks.withColumns({"floors": F.lit(None).cast("array<struct<at:int,floor:bigint>>"), "taken": F.lit(None).cast("array<bigint>")})
        else:
            kth = best.where(F.col("rank") == k).join(spots, "query_id").groupBy("chunk").agg(F.collect_list(F.struct("at", F.col("score").alias("floor"))).alias("floors"))
            state = chunks.join(kth, "chunk", "left").join(taken.groupBy("chunk").agg(F.collect_list("block").alias("taken")), "chunk", "left")
        pairs = materialize(state.select("chunk", "dim", "vecs", "floors", "taken").join(lists, "dim").mapInArrow(_plan(space, step), "chunk bigint, block bigint"))
        if pairs.isEmpty():
            break
        left = state.select("chunk", F.col("vecs").alias("q_vecs"), "floors", F.col("ids").alias("q_ids"))
        met = pairs.repartition(F.xxhash64("chunk", "block")).join(hint(left, few_chunks), "chunk").join(hint(blocks.select("block", "dim", "ids", "vecs"), few_blocks), "block")
        found = met.select("dim", "q_ids", "q_vecs", "floors", "ids", "vecs").mapInArrow(_scan(space, k), FOUND)
        found = found if best is None else best.select("query_id", "vec_id", "score").unionByName(found)
        best = materialize(_best(found, k))
        taken = pairs if taken is None else taken.unionByName(pairs)
    if best is None:
        return spots.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _spots(batches):
    """chunk, place in the chunk and id of each query."""
    for batch in batches:
        for chunk, ids in zip(batch.column("chunk").to_pylist(), batch.column("ids")):
            ids = np.frombuffer(ids.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), chunk)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["chunk", "at", "query_id"])


def _columns(batches):
    """Lists of summaries as packed columns."""
    for batch in batches:
        for dim, bs in zip(batch.column("dim").to_pylist(), batch.column("bs")):
            inner = bs.values
            cells = [np.asarray(inner.field(n)).astype(t).tobytes() for n, t in (("block", np.int64), ("cell", np.int32), ("low", np.float64), ("high", np.float64))]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["dim", "blocks", "cells", "lows", "highs"])
