"""Per-function analysis: graph relations, data flow, metrics, findings and walks, each one Arrow pass over functions.

A pass reads the columns it needs, computes of a function's facts only those its answer rests on (``Facts`` derives each
at most once), and yields plain rows. ``fns`` is a table of functions or a ``Program``, which lowers them in the same pass
and asks once for each distinct text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codeflux.operators import kernels as K
from codeflux.operators import passes, straight
from codeflux.sources.facts import Program

GRAPH = ("fq", "entry", "exits", "blocks", "edges")
FLOW = (*GRAPH, "params", "nonlocals", "ops")
EVERYTHING = (*FLOW, "locals", "globals", "own_nonlocals", "annotations", "kwarg", "proven", "doubted")
FINDING = "pass_name string, kind string, title string, op_id int, block_id int, line int, modality string, soundness string, detail string"
STEP = "step int, depth int, kind string, id int, name string, line int, block_id int, via string, parent int, frontier boolean"
#: Functions whose rows are held at once.
SLICE = 64


class Facts:
    """What one function's row gives; every fact is derived when first asked for. ``x["dom"]`` is ``x.dom``."""

    def __init__(self, row: dict):
        self.f = row

    def __getitem__(self, name: str):
        return getattr(self, name)

    @cached_property
    def blocks(self) -> list[int]:
        return [b["block_id"] for b in sorted(self.f["blocks"], key=lambda b: b["pos"])]

    @cached_property
    def g(self) -> K.Graph:
        return K.Graph(self.blocks, self.f["entry"], self.f["exits"], [(e["src"], e["dst"], e["kind"]) for e in sorted(self.f["edges"], key=lambda e: e["ord"])])

    @cached_property
    def dom(self) -> dict[int, int]:
        return self.g.dominators()

    @cached_property
    def pdom(self) -> dict[int, int]:
        return self.g.post_dominators()

    @cached_property
    def near(self) -> dict[int, int]:
        return self.g.nearest_post_dominator(self.pdom)

    @cached_property
    def control(self) -> set[tuple[int, int]]:
        return self.g.control_dependence(self.pdom, self.near)

    @cached_property
    def reach(self) -> set[int]:
        return self.g.reach(self.g.entry)

    @cached_property
    def ops(self) -> list[dict]:
        return sorted(self.f["ops"], key=lambda o: o["op_id"])

    @cached_property
    def _numbered(self) -> tuple[list[dict], list[dict]]:
        return K.number(self.ops, self.blocks)

    @property
    def defs(self) -> list[dict]:
        return self._numbered[0]

    @property
    def uses(self) -> list[dict]:
        return self._numbered[1]

    @cached_property
    def _reaching(self) -> tuple[dict[int, int], dict[int, list[int]]]:
        return K.reaching(self.g, self.defs, self.uses)

    @property
    def into(self) -> dict[int, int]:
        return self._reaching[0]

    @property
    def seen(self) -> dict[int, list[int]]:
        return self._reaching[1]

    @cached_property
    def _live(self) -> tuple[dict[int, set[str]], dict[int, set[str]]]:
        return K.liveness(self.g, self.ops)

    @property
    def live_in(self) -> dict[int, set[str]]:
        return self._live[0]

    @property
    def live_out(self) -> dict[int, set[str]]:
        return self._live[1]

    @cached_property
    def held(self) -> dict[int, set[str]]:
        return K.assigned(self.g, self.ops, set(self.f["params"] or ()))

    @cached_property
    def const(self) -> dict[tuple[int, str], str]:
        return K.constants(self.g, self.defs, self.into, set(self.f["nonlocals"] or ()))

    @cached_property
    def needs(self) -> dict[int, set[int]]:
        return K.op_dependences(self.g, self.ops, self.defs, self.uses, self.seen, self.control)

    @cached_property
    def branch_blocks(self) -> list[int]:
        return sorted({o["block_id"] for o in self.ops if o["kind"] == "branch" and o["sub"] not in ("break", "continue") and self.g.flow.get(o["block_id"])})

    @cached_property
    def nesting(self) -> dict[int, int]:
        return self.g.nesting(self.dom, self.near, {b: self.g.flow[b][0] for b in self.branch_blocks})

    @cached_property
    def readers(self) -> dict[int, list[dict]]:
        out: dict[int, list[dict]] = {}
        for u in self.uses:
            for d in self.seen[u["id"]]:
                out.setdefault(d, []).append(u)
        return out

    @cached_property
    def metrics(self) -> dict[str, int]:
        return _Metrics(self)


def _named(d: dict) -> bool:
    return d["op"]["sub"] != "args" and "." not in d["name"] and not d["name"].startswith("_")


def _outputs(x: Facts) -> set[tuple[str, str]]:
    """(output, input): what from outside (parameters, names not set here) goes into what returns, self or a global get."""
    given: dict[int, set[str]] = {}
    for u in x.uses:
        if not x.seen[u["id"]] or any(x.defs[d]["op"]["sub"] == "args" for d in x.seen[u["id"]]):
            given.setdefault(u["op"]["op_id"], set()).add(u["name"])
    out = set()
    for o in x.ops:
        names = ["<return>"] if o["kind"] == "return" and o["uses"] else []
        names += [t for t in o["targets"] if t.startswith("self.") or t in (x.f["globals"] or ())]
        for name in names:
            out |= {(name, i) for n in K.closure(x.needs, o["op_id"]) for i in given.get(n, ())}
    return out


def _paths(x: Facts) -> Iterator[tuple]:
    for i, path in enumerate(x.g.paths(x.g.entry, x.g.exits[-1]) if x.g.exits else []):
        yield i, len(path), ">".join(map(str, path))


#: name: the columns read, and the rows (a, b, name).
RELATIONS: dict[str, tuple[tuple[str, ...], Callable[[Facts], Iterator[tuple]]]] = {
    "dom": (GRAPH, lambda x: ((b, d, None) for b in x.blocks for d in x.g.members(x.dom[b]))),
    "pdom": (GRAPH, lambda x: ((b, d, None) for b in x.blocks for d in x.g.members(x.pdom[b]))),
    "ipdom": (GRAPH, lambda x: ((b, p, None) for b, p in x.near.items())),
    "control": (GRAPH, lambda x: ((b, a, None) for b, a in sorted(x.control))),
    "reach": (GRAPH, lambda x: ((b, None, None) for b in sorted(x.reach))),
    "back": (GRAPH, lambda x: ((b, s, None) for b, s in x.g.back_edges(x.dom))),
    "spine": (GRAPH, lambda x: ((b, None, None) for b in x.g.members(x.pdom[x.g.entry] & ~x.g.bit[x.g.entry]))),
    "pred": (GRAPH, lambda x: ((b, p, None) for b in x.blocks for p in x.g.pred[b])),
    "region": (GRAPH, lambda x: dict.fromkeys((h, b, None) for s, h in x.g.back_edges(x.dom) for b in sorted(K.region(x.g, h, s)))),
    "path": (GRAPH, _paths),
    "nesting": (FLOW, lambda x: ((b, n, None) for b, n in x.nesting.items())),
    "use_def": (FLOW, lambda x: ((u["op"]["op_id"], x.defs[d]["op"]["op_id"], u["name"]) for u in x.uses for d in x.seen[u["id"]])),
    "unread": (FLOW, lambda x: ((d["op"]["op_id"], None, d["name"]) for d in x.defs if d["id"] not in x.readers and _named(d))),
    "ambiguous": (FLOW, lambda x: ((u["op"]["op_id"], len(x.seen[u["id"]]), u["name"]) for u in x.uses if len(x.seen[u["id"]]) > 1 and "." not in u["name"])),
    "fan_out": (FLOW, lambda x: ((d["op"]["op_id"], len(x.readers[d["id"]]), d["name"]) for d in x.defs if d["id"] in x.readers)),
    "overloaded": (FLOW, lambda x: ((None, n, name) for name, n in K.overloaded(x.uses, x.defs, x.seen).items())),
    "live_in": (FLOW, lambda x: ((b, None, n) for b in x.blocks for n in sorted(x.live_in[b]))),
    "assigned": (FLOW, lambda x: ((b, None, n) for b in x.blocks for n in sorted(x.held[b]))),
    "const": (FLOW, lambda x: ((b, None, f"{n}={v}") for (b, n), v in sorted(x.const.items()))),
    "op_needs": (FLOW, lambda x: ((a, b, None) for a, bs in x.needs.items() for b in sorted(bs))),
    "op_slice": (FLOW, lambda x: ((a, n, None) for a in x.needs if (n := len(K.closure(x.needs, a) - {a})))),
    "output_input": ((*FLOW, "globals"), lambda x: ((None, None, f"{o}<-{i}") for o, i in sorted(_outputs(x)))),
}


def _span(x: Facts) -> int:
    return max((u["op"]["op_id"] - x.defs[d]["op"]["op_id"] for d, us in x.readers.items() for u in us), default=0)


METRICS: dict[str, Callable[[Facts], int]] = {
    "blocks": lambda x: len(x.blocks),
    "control_edges": lambda x: len({(e["src"], e["dst"], e["kind"]) for e in x.f["edges"]}),
    "branches": lambda x: sum(o["kind"] == "branch" for o in x.ops),
    "exits": lambda x: len(x.f["exits"]),
    "defs": lambda x: len(x.defs),
    "uses": lambda x: len(x.uses),
    "cyclomatic": lambda x: sum(max(0, len(x.g.flow[b]) - 1) for b in x.blocks) + sum(o["kind"] == "enter_except" for o in x.ops) + 1,
    "cognitive": lambda x: sum(1 + x.nesting[b] for b in x.branch_blocks),
    "max_nesting": lambda x: max(x.nesting.values(), default=0),
    "depdegree": lambda x: sum(map(len, x.seen.values())),
    "max_live_span": lambda x: max(0, _span(x)),
    "back_edges": lambda x: len(x.g.back_edges(x.dom)),
}


class _Metrics(dict):
    """Metrics by name, each computed when first looked up."""

    def __init__(self, x: Facts):
        super().__init__()
        self.x = x

    def __missing__(self, name: str) -> int:
        self[name] = METRICS[name](self.x)
        return self[name]


def _each(fns: DataFrame | Program, columns: tuple[str, ...], ddl: str, rows: Callable[[Facts], Iterator[tuple]], lines: tuple[str, ...] = (), where: tuple[str, ...] = (), at_once: Callable[[straight.Flow], list[pa.Array]] | None = None) -> DataFrame:
    """fq and what ``rows`` yields for each function; of a program also its columns ``where``. ``at_once`` gives the same
    rows as columns, for a batch of functions of one block."""
    if isinstance(fns, Program):
        return fns.each(ddl, lambda f: rows(Facts(f)), lines, where)
    schema = StructType.fromDDL("fq string, " + ddl)
    arrow = to_arrow_schema(schema)
    width = len(schema) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if at_once is not None:
                alone = straight.split(batch)
                flow = straight.Flow(batch.filter(pa.array(alone)))
                if not flow.twice:
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(at_once(flow), arrow)], schema=arrow)
                    batch = batch.filter(pa.array(~alone))
            for i in range(0, batch.num_rows, SLICE):
                out: list[list] = [[] for _ in range(width + 1)]
                for row in batch.slice(i, SLICE).to_pylist():
                    for values in rows(Facts(row)):
                        out[0].append(row["fq"])
                        for column, value in zip(out[1:], values):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return fns.select(*[c for c in columns if c in fns.columns]).mapInArrow(run, schema)


def relation(fns: DataFrame | Program, name: str) -> DataFrame:
    """(fq, a, b, name) of one of ``RELATIONS``."""
    columns, rows = RELATIONS[name]
    return _each(fns, columns, "a int, b int, name string", rows, at_once=straight.RELATIONS.get(name))


def metrics(fns: DataFrame | Program, names: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """fq and the metrics asked for."""

    def rows(x: Facts) -> Iterator[tuple]:
        found = x.metrics
        yield tuple(found[n] for n in names)

    at_once = (lambda x: straight.metrics(x, names)) if set(names) <= set(straight.METRICS) else None
    return _each(fns, FLOW, ", ".join(f"{n} int" for n in names), rows, at_once=at_once)


def findings(fns: DataFrame | Program, only: tuple[str, ...] | None = None, where: tuple[str, ...] = ()) -> DataFrame:
    """fq, emit (order within the function) and the findings of all passes, or of ``only`` those named. Those of a program
    come without ``detail``, which has line numbers in its text."""
    ddl = FINDING.removesuffix(", detail string") if isinstance(fns, Program) else FINDING
    fields = [c.split()[0] for c in ddl.split(", ")]

    def rows(x: Facts) -> Iterator[tuple]:
        for i, one in enumerate(passes.run(x, only)):
            yield (i, *(one[c] for c in fields))

    at_once = (lambda x: straight.findings(x, only)) if only and set(only) <= straight.PASSES else None
    return _each(fns, EVERYTHING, "emit int, " + ddl, rows, ("line",), where, at_once)


Asked = DataFrame | Callable[[dict], Iterator[dict]]


def _asked(fns: DataFrame | Program, asked: Asked, name: str, *columns: str) -> tuple[DataFrame | Program, Callable[[Facts], list]]:
    """``fns`` and what is asked of each function, each once: rows (fq, ``columns``), or for a program a function of its facts."""
    if isinstance(fns, Program):
        return fns, lambda x: [dict(t) for t in {tuple(a.items()) for a in asked(x.f)}]
    lists = asked.groupBy("fq").agg(F.collect_set(F.struct(*columns)).alias(name))
    return fns.join(lists, "fq"), lambda x: x.f[name]


def walks(fns: DataFrame | Program, starts: Asked, direction: str = "forward", edges: str = "both", most: int = 3, kinds: tuple[str, ...] = ()) -> DataFrame:
    """fq, start and steps of a breadth-first walk in each function from its ``starts`` (fq, kind, id)."""
    fields = [c.split()[0] for c in STEP.split(", ")]
    fns, asked = _asked(fns, starts, "starts", "kind", "id")

    def rows(x: Facts) -> Iterator[tuple]:
        known = {"block": set(x.blocks), "op": {o["op_id"] for o in x.ops}, "def": range(len(x.defs)), "use": range(len(x.uses))}
        for s in sorted(asked(x), key=lambda s: (s["kind"], s["id"])):
            if s["id"] in known.get(s["kind"], ()):
                for step in K.walk(x.f, x, (s["kind"], s["id"]), direction, edges, most, set(kinds) or None):
                    yield (f"{s['kind']}:{s['id']}", *(step[c] for c in fields))

    return _each(fns, (*FLOW, "starts"), "start string, " + STEP, rows, ("line",))


def slices(fns: DataFrame | Program, starts: Asked, backward: bool = True, most: int = 5) -> DataFrame:
    """Walks over data edges (with the branches that decide, backward)."""
    return walks(fns, starts, "backward" if backward else "forward", "data", most)


def paths(fns: DataFrame | Program, ends: Asked, most_edges: int = 8, most: int = 20) -> DataFrame:
    """fq, start, goal, path: simple paths between blocks (fq, start, goal), the last successor's first."""
    fns, asked = _asked(fns, ends, "ends", "start", "goal")

    def rows(x: Facts) -> Iterator[tuple]:
        for e in sorted(asked(x), key=lambda e: (e["start"], e["goal"])):
            if e["start"] in x.g.bit and e["goal"] in x.g.bit:
                for path in x.g.paths(e["start"], e["goal"], most_edges, most):
                    yield e["start"], e["goal"], ">".join(map(str, path))

    return _each(fns, (*GRAPH, "ends"), "start int, goal int, path string", rows)


def guards(fns: DataFrame | Program, lines: Asked, where: tuple[str, ...] = ()) -> DataFrame:
    """fq, line, depth, branch_op, condition, arm: for each line asked for (fq, line) the branches that decide whether it
    runs, the innermost first, with the arm taken ('then', 'else', or null where both lead there)."""
    fns, asked = _asked(fns, lines, "asked", "line")

    def rows(x: Facts) -> Iterator[tuple]:
        deciding: dict[int, list[int]] = {}
        for b, a in sorted(x.control):
            deciding.setdefault(b, []).append(a)
        branch = {o["block_id"]: o for o in x.ops if o["kind"] == "branch" and o["sub"] not in ("break", "continue", "case")}
        for line in sorted(a["line"] for a in asked(x)):
            todo = [(o["block_id"], 1) for o in x.ops if o["line"] == line][:1]
            met = {b for b, _ in todo}
            while todo:
                b, depth = todo.pop(0)
                for a in sorted(deciding.get(b, ()), key=lambda a: -x.dom[a].bit_count()):
                    if a not in met:
                        met.add(a)
                        todo.append((a, depth + 1))
                        arms = x.g.flow[a][:2]
                        # an arm that leads back to before the branch decides nothing
                        took = [i for i, s in enumerate(arms) if x.dom[b] & ~x.dom[a] & x.g.bit[s]]
                        if a in branch:
                            yield line, depth, branch[a]["op_id"], branch[a]["cond"], ("then", "else")[took[0]] if len(took) == 1 else None

    return _each(fns, (*FLOW, "asked"), "line int, depth int, branch_op int, condition string, arm string", rows, ("line",), where)


def verify_refactor(old: DataFrame, new: DataFrame) -> DataFrame:
    """fq, change ('lost' or 'gained'), flow: inputs of outputs that only one of two sets of functions has."""
    sides = [relation(a, "output_input").select("fq", F.col("name").alias("flow")) for a in (old, new)]
    lost, gained = sides[0].exceptAll(sides[1]), sides[1].exceptAll(sides[0])
    return lost.withColumn("change", F.lit("lost")).unionByName(gained.withColumn("change", F.lit("gained"))).select("fq", "change", "flow")


DELTAS = ("blocks", "branches", "exits", "cyclomatic", "max_nesting", "depdegree")
SIMPLER = ("branches", "cyclomatic", "cognitive", "max_nesting", "depdegree")


def _sides(old: DataFrame, new: DataFrame, names: tuple[str, ...]) -> DataFrame:
    sides = [metrics(a, names).select("fq", *[F.col(k).alias(f"{p}_{k}") for k in names]) for a, p in ((old, "old"), (new, "new"))]
    return sides[0].join(sides[1], "fq", "full_outer")


def structural_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """fq and old and new values of the metrics of functions that changed, came or went."""
    both = _sides(old, new, DELTAS)
    same = F.lit(True)
    for k in DELTAS:
        same &= F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}"))
    return both.where(~same)


def verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """fq, preserved (no input of an output came or went), simpler (no metric is worse, some better), lost and gained."""
    flows = verify_refactor(old, new).groupBy("fq").agg(*[F.sort_array(F.collect_set(F.when(F.col("change") == c, F.col("flow")))).alias(c) for c in ("lost", "gained")])
    both = _sides(old, new, SIMPLER).dropna()
    worse, better = F.lit(False), F.lit(False)
    for k in SIMPLER:
        worse |= F.col(f"new_{k}") > F.col(f"old_{k}")
        better |= F.col(f"new_{k}") < F.col(f"old_{k}")
    none = F.array().cast("array<string>")
    return both.join(flows, "fq", "left").select("fq", F.col("lost").isNull().alias("preserved"), (~worse & better).alias("simpler"), F.coalesce("lost", none).alias("lost"), F.coalesce("gained", none).alias("gained"))


def census(fns: DataFrame, top: int = 12) -> DataFrame:
    """fq, blocks, branches, exits, max_live_span of the ``top`` largest functions."""
    keys = ("blocks", "branches", "exits", "max_live_span")
    return metrics(fns, keys).orderBy(*[F.col(k).desc() for k in keys], "fq").limit(top)
