"""Fixpoints over relations that span functions: breadth-first closure, strongly connected components, layers.

Graphs of at most ``SMALL_EDGES`` edges, counted first, are walked by one task, or sent to all that search from roots of
their own; larger ones are walked in distributed rounds.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it again, so a round does not carry all rounds before."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="codeflux-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = os.path.join(base, "codeflux-" + uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most edges of a graph that one task may hold.
SMALL_EDGES = 500_000


def in_one_task(edges: DataFrame, use, ddl: str) -> DataFrame:
    """The rows that ``use`` makes of all (src, dst), which have been counted, in one task."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches):
        held = [(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches]
        rows = use([pair for src, dst in held for pair in zip(src, dst)])
        columns = list(zip(*rows)) or [()] * len(arrow)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return edges.select("src", "dst").repartition(1).mapInArrow(run, schema)


def rings(pairs: list[tuple]) -> list[tuple]:
    """(node, smallest node of its component) for components of two nodes or more, by two depth-first passes."""
    out: dict = {}
    back: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    order, seen = [], set()
    for start in out:
        todo = [] if start in seen else [(start, iter(out[start]))]
        seen.add(start)
        while todo:
            node, after = todo[-1]
            step = next((n for n in after if n not in seen), None)
            if step is None:
                order.append(todo.pop()[0])
            else:
                seen.add(step)
                todo.append((step, iter(out.get(step, ()))))
    found, done = [], set()
    for start in reversed(order):
        if start in done:
            continue
        done.add(start)
        group, todo = [], [start]
        while todo:
            node = todo.pop()
            group.append(node)
            fresh = [n for n in back.get(node, ()) if n not in done]
            done.update(fresh)
            todo += dict.fromkeys(fresh)
        if len(group) > 1:
            low = min(group)
            found += [(n, low) for n in group]
    return found


def heights(pairs: list[tuple]) -> list[tuple]:
    """(node, longest way down) over edges without cycles."""
    below: dict = {}
    left: dict = {}
    above: dict = {}
    for a, b in pairs:
        below.setdefault(a, 0)
        below.setdefault(b, 0)
        left[a] = left.get(a, 0) + 1
        above.setdefault(b, []).append(a)
    todo = [n for n in below if n not in left]
    while todo:
        node = todo.pop()
        for a in above.get(node, ()):
            below[a] = max(below[a], below[node] + 1)
            left[a] -= 1
            if not left[a]:
                todo.append(a)
    return list(below.items())


def distances(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(root, node, depth): the fewest edges from each root, at most ``most``; edges are (src, dst)."""
    edges = cut(edges.select("src", "dst").distinct())
    if edges.count() <= SMALL_EDGES:
        return _from_each_root(edges, roots, most)
    front = cut(roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = front, 0
    while most is None or depth < most:
        depth += 1
        step = front.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _from_each_root(edges: DataFrame, roots: DataFrame, most: int | None) -> DataFrame:
    """``distances`` where all edges, which have been counted, fit every task: each root is searched from where it lies."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, kind = edges.sparkSession, roots.schema["node"].dataType.simpleString()
    table = edges.toArrow()
    src, dst = (table.column(c).to_pylist() for c in ("src", "dst"))
    place = {n: i for i, n in enumerate(dict.fromkeys([*src, *dst]))}
    heads = np.array([place[n] for n in src], np.int64)
    order = np.argsort(heads, kind="stable")
    after = np.array([place[n] for n in dst], np.int64)[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(heads, minlength=len(place)))]).astype(np.int64)
    shared = spark.sparkContext.broadcast((place, list(place), begin, after))
    schema = spark.createDataFrame([], f"root {kind}, node {kind}, depth int").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        place, names, begin, after = shared.value
        every = pa.array(names, arrow.field("node").type)
        for batch in batches:
            for root in batch.column(0).to_pylist():
                if root not in place:
                    yield pa.RecordBatch.from_arrays([pa.array([root], arrow.field(0).type), pa.array([root], arrow.field(1).type), pa.array([0], pa.int32())], schema=arrow)
                    continue
                depth, level = np.full(len(names), -1, np.int32), 0
                front = np.array([place[root]])
                depth[front] = 0
                while len(front) and (most is None or level < most):
                    level += 1
                    n = begin[front + 1] - begin[front]
                    met = after[np.repeat(begin[front] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                    fresh = np.zeros(len(names), bool)
                    fresh[met] = True
                    front = np.flatnonzero(fresh & (depth < 0))
                    depth[front] = level
                found = np.flatnonzero(depth >= 0)
                yield pa.RecordBatch.from_arrays([pa.array([root] * len(found), arrow.field(0).type), every.take(pa.array(found)), pa.array(depth[found])], schema=arrow)

    tasks = 2 * spark.sparkContext.defaultParallelism
    return cut(roots.select("node").distinct().repartition(tasks, "node").mapInArrow(run, schema))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) over one edge or more, by doubling: each round joins what is known with itself."""
    known = cut(edges.select("src", "dst").distinct())
    n = known.count()
    while True:
        two = known.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        known = cut(known.unionByName(two).distinct())
        if (m := known.count()) == n:
            return known
        n = m


def _ends(edges: DataFrame) -> DataFrame:
    """node, leaves, enters: whether an edge begins there, and whether one ends there."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.lit(True).alias("leaves"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.lit(True).alias("enters"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("leaves", F.lit(False)).alias("leaves"), F.coalesce("enters", F.lit(False)).alias("enters"))


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components: (node, scc), scc being the smallest node; nodes on no cycle are left out.

    Nodes without a way in or out are trimmed in rounds; the rest is coloured by its smallest ancestor, and nodes that
    reach their colour's root backwards within the colour are its component."""
    live = cut(edges.select("src", "dst").where("src <> dst").distinct())
    kind = live.schema["src"].dataType.simpleString()
    if live.count() <= SMALL_EDGES:
        return cut(in_one_task(live, rings, f"node {kind}, scc {kind}"))
    found = None
    while not live.isEmpty():
        while True:  # trim
            ends = cut(_ends(live))
            if ends.where("not (leaves and enters)").isEmpty():
                break
            both = ends.where("leaves and enters").select("node")
            live = cut(live.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
        if live.isEmpty():
            break
        colour = cut(live.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node")))
        while True:  # smallest ancestor
            near = live.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            new = cut(colour.join(near, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old")))
            if new.where("c < old").isEmpty():
                break
            colour = new.drop("old")
        same = live.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        roots = colour.where("node = c").select("node")
        back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        own = cut(distances(back, roots).select("node", F.col("root").alias("scc")))
        found = own if found is None else found.unionByName(own)
        live = cut(live.join(own.select(F.col("node").alias("src")), "src", "left_anti").join(own.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0)
    many = found.groupBy("scc").count().where("count > 1").select("scc")
    return found.join(many, "scc", "left_semi").select("node", "scc")


def closure_by_components(edges: DataFrame) -> DataFrame:
    """As ``closure``, for dense graphs: only the graph between components is doubled, and members are paired at the end."""
    edges = cut(edges.select("src", "dst").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    member = cut(nodes.join(components(edges), "node", "left").select("node", F.coalesce("scc", "node").alias("g")))
    a, b = (member.select(F.col("node").alias(n), F.col("g").alias(g)) for n, g in (("src", "a"), ("dst", "b")))
    between = edges.join(a, "src").join(b, "dst").select("a", "b").distinct()
    far = closure(between.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    # a component of several nodes, or a node that calls itself, reaches all of itself
    groups = far.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(between.where("a = b"))
    return _paired(cut(groups.join(a, "a").select("src", "b")), b)


#: Most pairs that one task makes, and most nodes that are sent to every task.
PAIRS, SENT = 4_000_000, 2_000_000


def _paired(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst) of (src, b) and members (dst, b): as many tasks as the pairs need, also where one group holds all nodes."""
    sizes = members.groupBy("b").agg(F.count("*").alias("n"))
    total = pairs.join(sizes, "b").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(2 * members.sparkSession.sparkContext.defaultParallelism, min(20_000, total // PAIRS))
    small = members.count() <= SENT
    return pairs.repartition(tasks, "src", "b").join(F.broadcast(members) if small else members, "b").select("src", "dst")
