"""Removal of long byte strings that occur more than once, by sorted suffixes (deep-shallow sorting).

A window is a string of ``length`` bytes. Each window has one anchor: the leftmost of its ``GRAM``-byte grams with the
smallest hash, so equal windows have equal anchors at equal places, and only windows around anchors that occur twice can
repeat. Runs of windows with one anchor form a context. Equal contexts are one class, of which one is sorted; they are
told by two 64-bit hashes, of the anchor and of the whole. Where contexts of an anchor differ, their windows are suffixes
to sort: a multikey quicksort over eight-byte symbols goes to a shallow depth, and the groups that are still together,
with their long common prefixes, are ordered by blind tries, which compare each suffix with one leaf. Windows next to
each other in the order that agree over ``length`` bytes repeat.

A crowded anchor's windows are dealt to parts of about ``WINDOWS``: by their place relative to the anchor, and where one
place alone has more, by their first bytes. Only equal windows stay together whatever their number.

Texts that are equal are sorted once; a text of ``length`` bytes or more that several rows hold repeats as a whole.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; rows that repeat are documents of
their own, so they repeat each other; a null doc_id is an id like any other; an empty table gives an empty result; other
columns are ignored. Matches never cross rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import PACKED, Packer, count_bitmaps, member, sizes
from .common import materialize, maybe_broadcast
from .tokens import U, mix, runs, utf8

LENGTH, GRAM, SHALLOW = 200, 32, 40
SEGMENT = 1 << 20
#: About how many windows of an anchor are sorted at once; beyond it they are dealt to parts.
WINDOWS = 1 << 21
#: Suffixes of a group that are ordered at once by plain sorting, in place of further partitions.
FEW = 32
_PLACE = U((1 << 22) - 1)
_STEP = 0x9E3779B97F4A7C15 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n, 1 << 12).bit_length()
    if size not in _tables:
        up, down = np.full(size, _STEP, U), np.full(size, pow(_STEP, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _tables.clear()
        _tables[size] = np.cumprod(up, out=up), np.cumprod(down, out=down)
    return _tables[size]


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows held in ``data`` (row i starts at at[i]): hash and place of each anchor, first and last window it has."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, U), none, none, none
    up, down = _powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:n], out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=U)
    w = length - GRAM + 1
    rows = -(-len(key) // w)
    wide = np.full(rows * w, U(2**64 - 1))
    wide[: len(key)] = key
    wide = wide.reshape(rows, w)
    left = np.minimum.accumulate(wide, 1).ravel()
    right = np.minimum.accumulate(wide[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(right[: n - length + 1], left[w - 1 : w + n - length])
    fits = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(at) >= length)
    fits[at[long]] += 1
    np.subtract.at(fits, at[long + 1] - length + 1, 1)
    start = np.flatnonzero(np.cumsum(fits)[: n - length + 1] > 0)
    place = (low[start] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else none
    last = np.append(new[1:], len(place)) - 1 if len(place) else none
    return grams[place[new]], place[new], start[new], start[last]


def _pieces(batches, length: int):
    """node column, and the bytes, row starts and offsets in their texts of runs of rows; long rows come in segments."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        nodes = batch.column("node").to_numpy(zero_copy_only=False)
        for i, j in runs(at, SEGMENT // 2):
            if j == i + 1 and at[j] - at[i] > SEGMENT:
                for o in range(0, int(at[j] - at[i]) - length + 1, SEGMENT):
                    piece = data[at[i] + o : min(at[j], at[i] + o + SEGMENT + length - 1)]
                    yield nodes[i:j], piece, np.array([0, len(piece)]), o
            else:
                yield nodes[i:j], data[at[i] : at[j]], at[i : j + 1] - at[i], 0


def _pack(length: int, slice_bits: int):
    def run(batches):
        packer = Packer(slice_bits)
        for _, data, at, _ in _pieces(batches, length):
            yield from packer.add(anchors(data, at, length)[0])
        yield from packer.flush()

    return run


ROWS = "node bigint, gram bigint, whole bigint, low int, windows int, off int"


def _contexts(length: int, twice):
    """The contexts of anchors that may occur twice: where they are, and a hash of the whole."""

    def run(batches):
        for nodes, data, at, o in _pieces(batches, length):
            gram, place, low, high = anchors(data, at, length)
            hit = np.flatnonzero(member(twice.value, gram))
            gram, place, low, high = gram[hit], place[hit], low[hit], high[hit]
            raw, off = data.tobytes(), place - low
            whole = np.array([xxhash.xxh3_64_intdigest(raw[a : b + length], seed=s) for a, b, s in zip(low.tolist(), high.tolist(), off.tolist())], U)
            row = np.searchsorted(at, low, "right") - 1
            columns = [nodes[row], gram.view(np.int64), whole.view(np.int64), (low - at[row] + o).astype(np.int32), (high - low + 1).astype(np.int32), off.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "gram", "whole", "low", "windows", "off"])

    return run


CUT = "gram bigint, part int, node bigint, once boolean, low int, bytes binary"


def _cut(length: int):
    """Bytes of contexts; a crowded anchor's windows are dealt to parts by place, then by the first bytes."""

    def run(batches):
        for batch in batches:
            out = {"gram": [], "part": [], "node": [], "once": [], "low": [], "bytes": []}
            places = length - GRAM + 1
            for text, spots in zip(batch.column("text"), batch.column("spots")):
                raw = (text.as_py() or "").encode()
                for s in spots.as_py():
                    width, finer = -(-places // min(s["parts"], places)), -(-s["parts"] // places)
                    t = 0
                    while t < s["windows"]:
                        part = (length - GRAM - s["off"] + t) // width
                        stop = min(s["windows"], (part + 1) * width - (length - GRAM - s["off"]))
                        low = s["low"] + t
                        if finer > 1:  # one window each
                            part = part * finer + xxhash.xxh3_64_intdigest(raw[low : low + 16]) % finer
                        for name, x in (("gram", s["gram"]), ("part", part), ("node", s["node"]), ("once", s["once"]), ("low", low), ("bytes", raw[low : s["low"] + stop - 1 + length])):
                            out[name].append(x)
                        t = stop
            types = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    return run


def blind_trie(suffixes: list[tuple[int, bytes]], depth: int) -> list[list[int]]:
    """The numbers of (number, text), in order of their texts, equal ones together; texts agree on ``depth`` bytes.

    An inner node is (symbol number, {symbol: child}), a leaf [text, numbers]. A search looks at the nodes' symbols alone,
    compares with the one leaf it meets, and branches off where the two first differ. At the end children are visited by
    their symbols."""
    top: tuple | list = [suffixes[0][1], [suffixes[0][0]]]
    for number, mine in suffixes[1:]:
        node = top
        while type(node) is tuple:
            at, children = node
            node = children.get(mine[at : at + 8])
            if node is None:
                node = next(iter(children.values()))
        other = node[0]
        if mine == other:
            node[1].append(number)
            continue
        low, high = depth, len(mine)
        while high - low > 8:
            middle = low + (high - low) // 16 * 8
            if mine[low:middle] == other[low:middle]:
                low = middle
            else:
                high = middle
        leaf = [mine, [number]]
        node, parent, step = top, None, b""
        while type(node) is tuple and node[0] < low:
            parent, step = node, mine[node[0] : node[0] + 8]
            node = node[1][step]
        if type(node) is tuple and node[0] == low:
            node[1][mine[low : low + 8]] = leaf
        else:
            new = (low, {other[low : low + 8]: node, mine[low : low + 8]: leaf})
            if parent is None:
                top = new
            else:
                parent[1][step] = new
    ordered, todo = [], [top]
    while todo:
        node = todo.pop()
        if type(node) is tuple:
            todo += [node[1][symbol] for symbol in sorted(node[1], reverse=True)]
        else:
            ordered.append(node[1])
    return ordered


def multikey_quicksort(symbols: np.ndarray, starts: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of group and first ``shallow`` bytes, and the segment of each: equal ones share it.

    All segments take their steps together: each is parted by its middle member's symbol into smaller, equal and larger
    ones; the equal ones go on with the next symbol. Segments of a few suffixes are sorted by symbol at once. A suffix that
    is alone is in place."""
    order = np.argsort(group, kind="stable").astype(np.int32)
    live = np.arange(len(order), dtype=np.int32)
    segment = live.copy()  # the place where each one's segment begins

    def part(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Begins a segment of the live ones wherever a key changes; which segment each is in, and of how many."""
        new = np.ones(len(live), bool)
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        which = np.cumsum(new, dtype=np.int32) - 1
        segment[live] = live[first][which]
        return which, np.diff(np.append(first, len(live)))

    which, size = part((group[order],)) if len(order) else (live, live)
    depth = np.zeros(len(order), np.int16)
    while len(live):
        keep = (size[which] > 1) & (depth[live] < shallow)
        live = live[keep]
        if not len(live):
            break
        own = segment[live]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        size = np.diff(np.append(first, len(live)))
        which = np.repeat(np.arange(len(first), dtype=np.int32), size)
        symbol = symbols[starts[order[live]] + depth[live]].copy().view(">u8").ravel().astype(U)
        pivot = symbol[first + size // 2][which]
        few = (size <= FEW)[which]
        side = np.where(few, symbol, (symbol > pivot).astype(np.uint8) + (symbol >= pivot))  # 0 smaller, 1 equal, 2 larger
        by = np.lexsort((side, which))
        order[live], depth[live] = order[live[by]], depth[live[by]] + np.where(few[by] | (side[by] == 1), 8, 0)
        which, size = part((which[by], side[by]))
    return order, segment


def sort_windows(data: bytes, starts: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The windows at ``starts`` in order of group and bytes, and whether each equals the one before it."""
    symbols = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(8), np.uint8), 8)
    shallow = min(shallow, length // 8 * 8)
    order, segment = multikey_quicksort(symbols, starts, group, shallow)
    same = np.zeros(len(order), bool)
    edges = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]])) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist()):
        numbers = order[a:b].tolist()
        at = a
        for leaf in blind_trie([(i, data[p : p + length]) for i, p in zip(numbers, starts[order[a:b]].tolist())], shallow):
            order[at : at + len(leaf)] = leaf
            same[at + 1 : at + len(leaf)] = True
            at += len(leaf)
    return order, same


def repeated(data: bytes, starts: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """Which windows at ``starts`` occur at another of them in their group too: those equal to a neighbour in the order.
    ``data`` holds ``length`` bytes from each start."""
    order, same = sort_windows(data, starts, group, length, shallow)
    twice = np.zeros(len(starts), bool)
    twice[order] = same | np.append(same[1:], False)[: len(same)]
    return twice


SPANS = "node bigint, low int, high int"
#: Bytes of contexts that a task sorts at once; a larger group is one such lot by itself.
LOT = 1 << 20


def _sort_groups(length: int):
    """Over rows in order of (gram, part): spans of the repeated windows of contexts that are there once."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        _, _, nodes, once, low, cut = (list(c) for c in zip(*rows))
        keys = [r[:2] for r in rows]
        lengths = np.array([len(x) for x in cut])
        begin = np.cumsum(lengths) - lengths
        windows = lengths - length + 1
        which = np.repeat(np.arange(len(rows)), windows)
        local = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        group = np.cumsum([0, *(x != y for x, y in zip(keys[1:], keys[:-1]))])
        twice = repeated(b"".join(cut), begin[which] + local, group[which], length)
        at = np.flatnonzero(twice & np.array(once)[which])
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(which[at]) != 0)]) if len(at) else np.zeros(0, bool)
        first, last = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at
        low = np.array(low)
        out = [np.array(nodes, np.int64)[which[first]], (low[which[first]] + local[first]).astype(np.int32), (low[which[last]] + local[last] + length).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["node", "low", "high"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "part", "node", "once", "low", "bytes"))):
                if size >= LOT and row[:2] != held[-1][:2]:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield spans(held)

    return run


DONE = "node bigint, n_removed bigint, spans array<struct<low:int,high:int>>, kept_sha256 string"


def _remove(batches):
    for batch in batches:
        out = []
        for node, text, spans in zip(*(batch.column(c).to_pylist() for c in ("node", "text", "ranges"))):
            raw, merged = (text or "").encode(), []
            for s in sorted(spans, key=lambda s: (s["low"], s["high"])):
                if merged and s["low"] <= merged[-1]["high"]:
                    merged[-1]["high"] = max(merged[-1]["high"], s["high"])
                else:
                    merged.append(dict(s))
            kept, at = hashlib.sha256(), 0
            for s in merged:
                kept.update(raw[at : s["low"]])
                at = s["high"]
            kept.update(raw[at:])
            out.append({"node": node, "n_removed": sum(s["high"] - s["low"] for s in merged), "spans": merged, "kept_sha256": kept.hexdigest()})
        spans_type = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        yield pa.RecordBatch.from_pylist(out, pa.schema([("node", pa.int64()), ("n_removed", pa.int64()), ("spans", spans_type), ("kept_sha256", pa.string())]))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte ranges to remove, apart from each other), kept_sha256 for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text")).withColumn("text_md5", F.md5(F.col("text").cast("binary")))
    slim = materialize(own.select("doc_id", "text_md5", F.octet_length("text").cast("long").alias("n_bytes")))
    groups = slim.groupBy("text_md5", "n_bytes").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    groups = materialize(groups.withColumn("node", F.monotonically_increasing_id()))
    keys = maybe_broadcast(groups.where(f"n_bytes >= {length}").select(F.col("text_md5").alias("m"), "first", "node"))
    texts = own.join(keys, (F.col("text_md5") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "text")

    bits, slice_bits = sizes(groups.count(), 64)
    twice, _ = count_bitmaps(texts.mapInArrow(_pack(length, slice_bits), PACKED), bits, slice_bits, 2)
    twice = docs.sparkSession.sparkContext.broadcast(twice)
    rows = materialize(texts.mapInArrow(_contexts(length, twice), ROWS))
    one = F.struct("node", "low", "windows", "off")
    classes = materialize(rows.groupBy("gram", "whole").agg(F.count("*").alias("times"), F.min(one).alias("one")))
    often = classes.where("times > 1").select("gram", "whole")
    wholly = rows.join(often, ["gram", "whole"]).select("node", "low", (F.col("low") + F.col("windows") - 1 + length).alias("high"))

    mixed = classes.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1")
    parts = F.ceil(F.col("kinds") * (length - GRAM + 1) / WINDOWS).cast("int").alias("parts")
    spots = classes.join(mixed.select("gram", parts), "gram").select("gram", (F.col("times") == 1).alias("once"), "one.*", "parts")
    by_node = materialize(spots.groupBy("node").agg(F.collect_list(F.struct("gram", "node", "once", "low", "windows", "off", "parts")).alias("spots")))
    chosen = texts.join(maybe_broadcast(by_node.select("node")), "node", "left_semi")
    cut = chosen.join(by_node, "node").select("text", "spots").mapInArrow(_cut(length), CUT)
    lots = cut.repartition("gram", "part").sortWithinPartitions("gram", "part")
    partly = lots.select("gram", "part", "node", "once", "low", "bytes").mapInArrow(_sort_groups(length), SPANS)

    ranges = materialize(wholly.unionByName(partly)).groupBy("node").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    ranges = materialize(ranges)
    some = texts.join(maybe_broadcast(ranges.select("node")), "node", "left_semi").join(ranges, "node")
    done = materialize(some.select("node", "text", "ranges").mapInArrow(_remove, DONE)).dropDuplicates(["node"])

    whole = (F.col("rows") > 1) & (F.col("n_bytes") >= length)
    full = F.array(F.struct(F.lit(0).alias("low"), F.col("n_bytes").cast("int").alias("high")))
    none = F.array().cast("array<struct<low:int,high:int>>")
    named = groups.join(done, "node", "left").select(
        "text_md5",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, full).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
    named = materialize(named)
    out = own.select("doc_id", "text_md5", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    found = out.join(maybe_broadcast(named), "text_md5", "left")
    return found.select("doc_id", "n_bytes", "n_removed", "spans", F.coalesce("kept_sha256", "own").alias("kept_sha256"))
