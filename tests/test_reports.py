"""Summaries, text lines, compiled code and the store of lowered modules."""

import pytest

from codeflux.functions import fixpoint
from codeflux.operators import analysis, exceptions, program, reports
from codeflux.sources import bytecode, facts, store

MILL = """
import bag

class Wheel:
    def __init__(self):
        self.turns = []
    def turn(self, n):
        self.turns.append(n)
        if n < 0:
            raise ValueError(n)
        return self.turns

class Stone(Wheel):
    def turn(self, n):
        return super().turn(n)

class Saw(Wheel):
    pass

class Both(Stone, Saw):
    pass

def grind(corn):
    stone = Stone()
    return sieve(stone.turn(corn))

def sieve(flour):
    dust = flour
    return grind(flour) if flour else None

print("open")
"""


@pytest.fixture(scope="module")
def modules(spark):
    return fixpoint.cut(facts.lower(spark.createDataFrame([("mill.py", MILL), ("bag.py", "def tie():\n    pass\n")], "relpath string, src string")))


@pytest.fixture(scope="module")
def fns(modules):
    return fixpoint.cut(facts.functions(modules))


@pytest.fixture(scope="module")
def seen(modules, fns):
    return fixpoint.cut(program.evidence(modules, fns))


@pytest.fixture(scope="module")
def edges(seen):
    return fixpoint.cut(program.call_graph(program.sites_of(seen)))


def last(fq):
    return fq.split(":")[-1]


def test_call_trees_and_summaries(edges, seen, fns):
    roots = edges.where("caller like '%grind'").selectExpr("caller as fq").distinct()
    tree = {(tuple(map(last, r.path)), r.note) for r in reports.call_tree(edges, roots).collect()}
    assert {(("grind",), ""), (("grind", "sieve"), ""), (("grind", "sieve", "grind"), "repeat"), (("grind", "Stone.turn"), "ambiguous")} <= tree
    assert {last(r.path[-1]) for r in reports.call_tree(edges, roots, sharp=True).collect()} == {"grind", "sieve"}
    counts = {r.what: r.n for r in reports.call_summary(edges, seen).collect()}
    assert counts["edges"] == edges.count() and counts["ambiguous"] >= 2 and counts["unresolved"] >= 1
    assert ("grind", "sieve") in {(last(r.fq), last(r.other)) for r in reports.reference_graph(fns).collect()}
    goal = fns.where("qualname = 'Wheel.turn'").select("fq")
    # grind and sieve call each other, so no chain begins at a function that nobody calls
    assert program.call_paths(edges, goal).isEmpty()
    chain = edges.limit(1).selectExpr("'g' as goal", "array('mill.py:grind', 'mill.py:Stone.turn') as path")
    assert [r.text for r in reports.path_lines(chain, edges).collect()] == ["mill.py:grind -~2-> mill.py:Stone.turn"]


def test_class_trees(modules):
    forest = fixpoint.cut(program.class_forest(modules)[0])
    assert [last(r.root) for r in reports.class_roots(forest).collect()] == ["Wheel"]
    ways = {(tuple(map(last, r.path)), r.again) for r in reports.class_tree(forest).collect()}
    assert ways == {(("Wheel",), False), (("Wheel", "Saw"), False), (("Wheel", "Stone"), False), (("Wheel", "Saw", "Both"), False), (("Wheel", "Stone", "Both"), True)}
    lines = [r.text for r in reports.tree_lines(reports.class_tree(forest)).orderBy("path").collect()]
    assert lines[0] == "mill.py:Wheel" and lines[-1].endswith("Both (again)")
    assert reports.class_summary(forest).count() == 0


def test_state_of_functions(modules, fns):
    rows = {(last(r.fq), r.what) for r in reports.cell_dossier(modules, fns, "turns").collect()}
    assert rows == {("Wheel.__init__", "writes"), ("Wheel.turn", "changes"), ("Wheel.turn", "only reads")}
    prints = {last(r.fq): (r.reads, r.writes) for r in reports.footprints(program.state_accesses(modules, fns)).collect()}
    assert prints["Wheel.__init__"] == ([], ["mill.py:Wheel.turns"])


def test_reports(spark, modules, fns, edges):
    parts = {}
    for r in reports.program_report(modules, fns).collect():
        parts.setdefault(r.part, {})[r.name] = r.n
    assert parts["size"]["modules"] == 2 and parts["size"]["functions"] == fns.count() and "hub" in parts and "cycle" in parts
    work = {r.relpath: (r.fan_in, r.fan_out, len(r.work)) for r in reports.import_report(modules).collect()}
    assert work == {"mill.py": (0, 1, 1), "bag.py": (1, 0, 0)}
    escaped = exceptions.program_escapes(modules, fns)
    assert ("widest", "ValueError") in {(r.part, r.exc) for r in reports.raises_report(escaped, edges).collect()}
    assert [r.name for r in reports.catalog(spark).orderBy("place").collect()][0] == "unreachable"


def test_lines_of_text(fns):
    found = reports.with_hints(analysis.findings(fns)).where("pass_name = 'dead-store'").collect()
    assert [(r.ref, r.verify) for r in found] == [("mill.py:sieve:op:1", "dataflow mill.py:sieve")]
    assert "dead-store" in reports.finding_lines(analysis.findings(fns)).where("text like '%dust%'").first().text
    turn = fns.where("qualname = 'Wheel.turn'")
    lines = [r.text for r in reports.block_lines(turn).orderBy("pos").collect()]
    assert lines[0].startswith("bb0 L") and "->bb" in lines[0] and lines[-1].endswith("end")
    walks = analysis.walks(turn, turn.selectExpr("fq", "'block' as kind", "entry as id"), most=1)
    assert [r.text for r in reports.walk_lines(walks).orderBy("step").collect()][:2] == ["bb0", "  -> bb1"]


def test_blocks_of_compiled_code(spark):
    src = "def f(a):\n    try:\n        while a:\n            a = g(a)\n    except OSError:\n        return 1\n    return a\n\nclass C:\n    def m(self):\n        return self\n"
    rows = bytecode.blocks(spark.createDataFrame([("b.py", src), ("bad.py", "def f(:")], "relpath string, src string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.fq, []).append(r)
    assert {"b.py:f", "b.py:C.m"} <= set(by) and len(by["b.py:f"]) > 3 and any(r.handlers for r in by["b.py:f"])
    starts = {r.start for r in by["b.py:f"]}
    assert all(set(r.next) <= starts and set(r.handlers) <= starts for r in by["b.py:f"]) and min(starts) == 0


def test_the_store_lowers_what_changed(spark, tmp_path):
    root, kept = tmp_path / "src", str(tmp_path / "store")
    root.mkdir()
    (root / "a.py").write_text("def f():\n    return g()\n\ndef g():\n    return 1\n")
    (root / "b.py").write_text("def h():\n    return 2\n")
    assert store.refresh(spark, str(root), kept)[1] == {"lowered": 2, "kept": 0, "gone": 0}
    assert [(r.caller, r.callee) for r in store.call_edges(spark, kept).collect()] == [("a.py:f", "a.py:g")]
    (root / "b.py").unlink()
    (root / "c.py").write_text("def k():\n    return 3\n")
    modules, counts = store.refresh(spark, str(root), kept)
    assert counts == {"lowered": 1, "kept": 1, "gone": 1} and sorted(r.relpath for r in modules.select("relpath").collect()) == ["a.py", "c.py"]
    assert store.refresh(spark, str(root), kept)[1] == {"lowered": 0, "kept": 2, "gone": 0}
