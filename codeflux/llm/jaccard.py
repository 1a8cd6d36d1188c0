"""Exact Jaccard similarity join on word n-grams by token-combination prefixes.

Texts that are equal are one node. Every node is a set of hashed word n-grams. Two bitmaps over all sets (see
``bitmaps``) part the tokens into those met once, rare ones and frequent ones (``FREQUENT`` sets or more); tokens are
ordered rare first, then by hash. A set of n tokens that is to share ceil(t n) with another has p = n - ceil(t n) + 1
prefix tokens, one of which is shared, and extended by g, g + 1 of its first p + g tokens are shared. So either the first
shared token is rare, and each rare token of the prefix is a key of its own; or all shared tokens are frequent, and of g
groups of tokens one holds two of those in the extended prefix, so that pairs of frequent tokens of one group are keys. With g in proportion to p (a power of two, that of the
smaller set) a set has keys in proportion to its size; tokens that many texts hold meet only where two of them meet in a
prefix, and texts with enough rare tokens index no frequent ones at all.

Each posting says how many tokens of its set, before the key's last one, a pair that meets there first cannot share
(``skip``). The pair's sizes and skips bound what it can share, which is a condition of every comparison, and rules out
whole postings by the smallest set of their list. In each key's list a hub (the set with the fewest rare tokens: of near
copies, the likely original) meets those of other components; what is still apart is compared pair by pair within
classes of size, unless the two sets are already in one component. Candidate pairs first compare parity sketches, half a
byte a token, whose differing bits are a lower bound of the differing tokens; the rest are verified on the sets
themselves, with whole numbers. Shingles are compared by 64-bit hashes.

The number of links is not given: inside a family of near copies it takes every pair, the square of the family.
``similar_groups`` gives membership, and ``spanning_links`` verified links that connect each class.

Defined results: a null text is empty; without words a document's set is empty and links with nothing; fewer than k words
are one shingle; rows that repeat, and equal texts, share a component; a null doc_id takes no part and has no component;
an empty table gives an empty result; other columns are ignored. ``pct`` is above 50.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import PACKED, Packer, count_bitmaps, member, sizes
from .common import components, discard, free_name, materialize, maybe_broadcast, release
from .tokens import SPACE, U, runs, shingles, utf8, words

FREQUENT, PER_GROUP, STARS = 24, 2, 2
#: Higher limits of frequency, tried in turn where the map of frequent tokens would not be sparse.
STEPS = 9
TOP = U(1) << U(63)


def _sets(batches, k: int):
    """(column of ids, list of sets) for runs of rows of batches (node, text)."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for i, j in runs(at, 1 << 18):
            part = at[i : j + 1] - at[i]
            hashes, row = words(data[at[i] : at[j]], part, SPACE)
            yield batch.column("node").slice(i, j - i), shingles(hashes, row, j - i, k)


def _pack(k: int, slice_bits: int):
    def run(batches):
        packer = Packer(slice_bits)
        for _, sets in _sets(batches, k):
            yield from packer.add(np.concatenate(sets))
        yield from packer.flush()

    return run


def _prefix(n: int, pct: int) -> int:
    return n - (pct * n + 99) // 100 + 1


def _groups(n: int, pct: int) -> int:
    """Groups of frequent tokens for sets of n tokens: a power of two, about one for PER_GROUP prefix tokens."""
    return 1 << max(_prefix(n, pct) // PER_GROUP, 1).bit_length() - 1


def _combinations(head: np.ndarray, at: int, g: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs of ``head[at:]`` that are in one of g groups, and their skips."""
    group = head[at:] & U(g - 1)
    order = np.argsort(group, kind="stable")
    group, token, place = group[order], head[at:][order], order + at
    keys, skips = [], []
    for d in range(1, len(token)):
        same = np.flatnonzero(group[d:] == group[:-d])
        if not len(same):
            break
        keys.append(((token[same] * U(0x9E3779B97F4A7C15) + token[same + d]) ^ (U(g) << U(40))) | TOP)
        # before the second token of its group that is shared, the other groups share one each at most
        skips.append(at + np.maximum(place[same + d] - at - g, 0))
    return (np.concatenate(keys), np.concatenate(skips)) if keys else (head[:0], order[:0])


def _prefixes(k: int, pct: int, maps):
    """node, n, the number of rare tokens, the keys with their skips and the sketch of each set."""

    def keys(s: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        n = len(s)
        often, known = maps.value
        order = np.sort((s >> U(1)) | np.where(member(often, s), TOP, U(0)))
        scarce = int(np.searchsorted(order, TOP))
        if n <= 1:
            return scarce, order, np.zeros(n, np.int64)
        p = _prefix(n, pct)
        levels = sorted({_groups(m, pct) for m in (max(1, (pct * n + 99) // 100), n)})
        levels = [g for g in (1 << i for i in range(32)) if levels[0] <= g <= levels[-1]]
        head = order[: p + levels[-1]]
        rare = min(scarce, p)
        seen = np.flatnonzero(member(known, head[:rare] << U(1)) | member(known, (head[:rare] << U(1)) | U(1)))
        found = [(head[seen], seen)] + [_combinations(head[: p + g], scarce, g) for g in levels if p + g > scarce + 1]
        return scarce, np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def sketch(s: np.ndarray) -> bytes:
        bits = 1 << max(8, (4 * len(s) - 1).bit_length())
        return np.packbits(np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()

    def run(batches):
        for node, sets in _sets(batches, k):
            counts, found, skips = zip(*map(keys, sets))
            lens = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    node,
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(counts, pa.int32()),
                    pa.ListArray.from_arrays(lens, pa.StructArray.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(skips).astype(np.int32))], ["key", "skip"])),
                    pa.array([sketch(s) for s in sets], pa.binary()),
                ],
                ["node", "n", "rare", "keys", "sketch"],
            )

    return run


def _fold(a: bytes, size: int) -> np.ndarray:
    bits = np.frombuffer(a, np.uint8)
    return np.bitwise_xor.reduce(bits.reshape(-1, size), 0)


def _possible(pct: int):
    """The pairs whose sketches do not rule them out."""

    def run(batches):
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "x", "y"))):
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
                # apart <= |x ^ y| = na + nb - 2 shared, and (100 + pct) shared >= pct (na + nb)
                keep.append((100 + pct) * (na + nb - apart) >= 2 * pct * (na + nb))
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    return run


def _packed_sets(k: int):
    """node and its set, eight bytes a token."""

    def run(batches):
        for node, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([node, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "tokens"])

    return run


def _overlaps(batches):
    for batch in batches:
        same = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            both = np.sort(np.concatenate([np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)]))
            same.append(int((both[1:] == both[:-1]).sum()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(same, pa.int64())], ["a", "b", "na", "nb", "shared"])


def _both(pairs: DataFrame, cells: DataFrame, cell: str) -> DataFrame:
    left = pairs.join(cells.select(F.col("node").alias("a"), F.col(cell).alias("x")), "a")
    return left.join(cells.select(F.col("node").alias("b"), F.col(cell).alias("y")), "b").select("a", "b", "na", "nb", "x", "y")


def _links(pairs: DataFrame, texts: DataFrame, index: DataFrame, k: int, pct: int) -> DataFrame:
    """The pairs (a, b, na, nb) that are similar."""
    close = materialize(_both(pairs, index, "sketch").mapInArrow(_possible(pct), "a bigint, b bigint, na int, nb int").distinct())
    ids = materialize(close.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    chosen = texts.join(maybe_broadcast(ids), "node", "left_semi").select("node", "text")
    sets = materialize(chosen.mapInArrow(_packed_sets(k), "node bigint, tokens binary"), "none")
    found = _both(close, sets, "tokens").mapInArrow(_overlaps, "a bigint, b bigint, na int, nb int, shared bigint")
    links = materialize(found.where(f"100 * shared >= {pct} * (na + nb - shared)").select("a", "b").distinct())
    discard(close, ids, sets)
    release(texts.sparkSession)
    return links


def _meetings(here: DataFrame, pct: int) -> DataFrame:
    """Pairs of a list whose components differ, by classes of size: similar sets are of one class or of neighbours."""
    step = math.log(100 / pct) * 1.001  # a little wide, so that no rounding puts similar sets two classes apart
    classed = here.withColumn("class", F.floor(F.log("n") / step).cast("int"))
    one = classed.selectExpr("key", "class", "node as a", "n as na", "skip as sa", "c as ca")
    two = classed.selectExpr("key", "class as cb_", "explode(array(class, class - 1)) as class", "node as b", "n as nb", "skip as sb", "c as cb")
    # a set that could be similar to none of its list, whatever that holds, is not compared
    low_a, low_b = (x.groupBy("key", "class").agg(F.min(n).alias("low"), F.min(c).alias("c0"), F.max(c).alias("c1")) for x, n, c in ((one, "na", "ca"), (two, "nb", "cb")))
    fits = lambda x: f"{100 + pct} * (n{x} - s{x}) >= {pct} * (n{x} + greatest(low, {pct} * n{x} / 100)) and not (c0 = c1 and c0 = c{x})"
    one = one.join(low_b, ["key", "class"]).where(fits("a")).drop("low", "c0", "c1")
    two = two.join(low_a, ["key", "class"]).where(fits("b")).drop("low", "c0", "c1")
    return one.join(two, ["key", "class"]).where(f"(a < b or cb_ > class) and a <> b and ca <> cb and {_near(pct)}")


def _near(pct: int) -> str:
    """Whether sets of sizes na and nb that first meet after skips of sa and sb can be similar."""
    return f"100 * least(na, nb) >= {pct} * greatest(na, nb) and {100 + pct} * least(na - sa, nb - sb) >= {pct} * (na + nb)"


def _join(docs: DataFrame, k: int, pct: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The rows (doc_id, text_md5), the nodes with n, component and its smallest doc_id, and links that connect classes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text")).withColumn("text_md5", F.md5(F.col("text").cast("binary")))
    slim = materialize(own.select("doc_id", "text_md5"))
    groups = slim.groupBy("text_md5").agg(F.min("doc_id").alias("first"))
    groups = materialize(groups.withColumn("node", F.monotonically_increasing_id()))
    ids = groups.select("node", "text_md5", F.col("first").alias("doc_id"))
    known = maybe_broadcast(ids.where("doc_id is not null"))
    texts = own.join(known, ["text_md5", "doc_id"]).select("node", "text")
    lone = own.where("doc_id is null").join(maybe_broadcast(ids.where("doc_id is null").drop("doc_id")), "text_md5")
    every = texts.unionByName(lone.select("node", "text"))

    bits, slice_bits = sizes(groups.count(), 256)
    packed = every.mapInArrow(_pack(k, slice_bits), PACKED)
    twice, often = count_bitmaps(packed, bits, slice_bits, 2, [FREQUENT << (2 * i) for i in range(STEPS)])
    maps = docs.sparkSession.sparkContext.broadcast((often, twice))
    index = materialize(every.mapInArrow(_prefixes(k, pct, maps), "node bigint, n int, rare int, keys array<struct<key:bigint,skip:int>>, sketch binary"))
    release(docs.sparkSession)
    sizes_of = index.groupBy("node").agg(F.max("n").alias("n"))

    posts = index.join(maybe_broadcast(lone.select("node").distinct()), "node", "left_anti")
    posts = posts.select("node", "n", "rare", F.inline("keys"))
    lists = posts.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    # of keys that two pairs of tokens share by chance, the one that skips less counts
    posts = materialize(posts.join(lists, "key").groupBy("key", "node").agg(F.first("n").alias("n"), F.first("rare").alias("rare"), F.min("skip").alias("skip")))
    comp = found = tried = None
    for turn in range(STARS + 1):
        here = posts.withColumn("c", F.col("node")) if comp is None else posts.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        if turn:
            split = here.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key", "c0")
            here = materialize(here.join(split, "key"))
            posts = here.select("key", "node", "n", "rare", "skip")
        if turn < STARS:  # later stars are for the lists of frequent tokens only; those of rare ones are short
            out = F.struct("rare", "node", "n", "skip", "c")
            hub = here.groupBy("key").agg(F.min(out if not turn else F.when(F.col("c") > F.col("c0"), out)).alias("h"))
            met = here.join(hub.where("key < 0") if turn else hub, "key").where("c <> h.c")
            met = met.selectExpr("key", "h.node as a", "node as b", "h.n as na", "n as nb", "h.skip as sa", "skip as sb").where(_near(pct))
        else:
            met = _meetings(here, pct)
        met = met.selectExpr("least(a, b) as a", "greatest(a, b) as b", "if(a > b, nb, na) as na", "if(a > b, na, nb) as nb").distinct()
        if tried is not None:
            met = met.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        met = materialize(met)
        if met.isEmpty():
            continue
        tried = met if tried is None else tried.unionByName(met)
        new = _links(met, every, index, k, pct)
        found = new if found is None else found.unionByName(new)
        comp = components(found)

    named = groups.join(sizes_of, "node", "left")
    named = named.withColumn("component", F.lit(None).cast("bigint")) if comp is None else named.join(comp, "node", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "node")))
    named = materialize(named.join(named.groupBy("component").agg(F.min("first").alias("least")), "component"))
    return slim, named, found


def similar_groups(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """doc_id, text_md5, n_shingles, component_id for every row of ``docs``."""
    slim, named, _ = _join(docs, k, pct)
    joined = slim.join(maybe_broadcast(named), "text_md5", "left")
    # Without words there is nothing to share: equal empty sets do not link.
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", "text_md5", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def spanning_links(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """a, b: doc_ids (the smallest of each text) of verified links between different texts that connect every class."""
    _, named, found = _join(docs, k, pct)
    ids = named.select("node", "first")
    if found is None:
        return ids.select(F.col("first").alias("a"), F.col("first").alias("b")).limit(0)
    ends = found.join(ids.select(F.col("node").alias("a"), F.col("first").alias("x")), "a").join(ids.select(F.col("node").alias("b"), F.col("first").alias("y")), "b")
    return ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def keep_one(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, and of equal ones an arbitrary whole row.

    Rows without words or without an id are all kept."""
    groups = similar_groups(docs, k, pct).where("n_shingles > 0 and doc_id <> component_id")
    gone = materialize(groups.select("doc_id", "text_md5").distinct())
    md5 = free_name(docs, "own_md5")
    own = docs.withColumn(md5, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    on = (F.col("d.doc_id") == F.col("g.doc_id")) & (F.col(f"d.{md5}") == F.col("g.text_md5"))
    kept = own.alias("d").join(maybe_broadcast(gone).alias("g"), on, "left_anti")
    again = kept.groupBy("doc_id", md5).agg(F.count("*").alias("times")).where("times > 1 and doc_id is not null").drop("times")
    if not again.isEmpty():
        again = maybe_broadcast(materialize(again))
        single = kept.join(again, ["doc_id", md5], "left_semi").dropDuplicates(["doc_id", md5])
        rest = kept.join(again, ["doc_id", md5], "left_anti")
        kept = rest.unionByName(single.select(*[f"`{c}`" for c in rest.columns]))
    return kept.select(*[f"`{c}`" for c in docs.columns])
