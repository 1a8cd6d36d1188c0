"""Commands over a small tree of files."""

import json

import pytest

from codeflux import cli

SOURCE = """LIMIT = 4

class Kettle:
    def __init__(self):
        self.water = 0

    def fill(self, cups):
        if cups > LIMIT:
            raise OverflowError(cups)
        self.water = cups
        return self.water

def brew(kettle, cups):
    left = kettle.fill(cups)
    unused = left  # flow: ok
    gone = left
    return left

def breakfast(kettle):
    try:
        return brew(kettle, 2)
    except OverflowError:
        return None
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "kitchen.py").write_text(SOURCE)
    (root / "bad.py").write_text("def f(:\n")
    return root


@pytest.fixture
def run(spark, tree, capsys):
    def call(command, target="", *more):
        code = cli.main([command, f"{tree}/{target}" if target else str(tree), *more])
        out = capsys.readouterr().out
        return code, [json.loads(x) for x in out.splitlines() if x.startswith("{")]

    return call


@pytest.mark.parametrize(
    "command",
    ["cfg", "dataflow", "metrics", "callgraph", "state", "classes", "imports", "catches", "raises", "report", "opportunities", "check", "hubs", "dominators", "census", "errors", "show", "cycles"],
)
def test_commands_give_rows(run, command):
    code, rows = run(command)
    assert code == 0 and (rows or command in ("cycles", "imports", "classes"))


def test_findings_without_those_suppressed(run):
    rows = run("opportunities", "kitchen.py", "--only", "dead-store")[1]
    assert [r["title"].split()[0] for r in rows] == ["gone"]


def test_exceptions_with_their_way(run):
    rows = {r["fq"]: r["chain"] for r in run("raises", "kitchen.py")[1]}
    assert rows == {"kitchen.py:Kettle.fill": ["kitchen.py:Kettle.fill"]}  # brew calls fill through an object: too weak


def test_what_leads_to_a_line(run):
    rows = run("at", "kitchen.py", "--line", "9")[1]
    assert {(r["what"], r["text"]) for r in rows if r["what"] != "op"} == {("guard", "cups > LIMIT then"), ("chain", "kitchen.py:breakfast -> kitchen.py:brew -> kitchen.py:Kettle.fill")}


def test_walks_slices_and_paths_from_addresses(run, tree):
    ref = "kitchen.py:Kettle.fill:use:cups@10"
    rows = run("slice", "kitchen.py:Kettle.fill", "--from", ref)[1]
    assert rows[0]["name"] == "cups" and any(r["via"] == "ctrl-dep" for r in rows)
    assert run("walk", "kitchen.py:Kettle.fill", "--from", "kitchen.py:Kettle.fill:bb:0")[1][0]["kind"] == "block"
    rows = run("paths", "kitchen.py:Kettle.fill", "--from", "kitchen.py:Kettle.fill:bb:0", "--goal", "kitchen.py:Kettle.fill:def:self.water@10")[1]
    assert len(rows) == 1
    assert run("walk", "kitchen.py:Kettle.fill", "--from", "kitchen.py:Kettle.fill:bb:99")[0] == 2


def test_traces_impact_and_paths_of_calls(run):
    assert any(r["kind"] == "arg" and r["var"] == "cups" for r in run("trace", "kitchen.py", "--var", "kettle")[1] + run("trace", "kitchen.py", "--var", "cups")[1])
    rows = run("impact", "kitchen.py", "--focus", "fill")[1]
    assert {("up", "kitchen.py:brew", 1), ("up", "kitchen.py:breakfast", 2)} <= {(r["what"], r.get("fq"), r.get("depth")) for r in rows} and any(r["note"] == "entry" for r in rows)
    assert run("callgraph", "kitchen.py", "--to", "fill")[1][0]["path"][0] == "kitchen.py:breakfast"
    assert run("callgraph", "kitchen.py", "--focus", "brew")[1]


def test_verify_holds_two_states(run, tree, tmp_path):
    (tmp_path / "kitchen.py").write_text(SOURCE.replace("    gone = left\n", ""))
    rows = run("verify", "kitchen.py", "--old", f"{tmp_path}/kitchen.py")[1]
    assert rows and all(r["preserved"] for r in rows)


def test_live_modules_are_found_not_imported(run):
    assert cli.main(["metrics", "live:sndhdr_that_is_not_there"]) == 2
    assert cli.main(["metrics", "live:this"]) == 0


def test_exit_codes(run):
    assert run("metrics", "none.py")[0] == 2 and run("metrics", "kitchen.py:nothing")[0] == 2 and run("metrics", "bad.py")[0] == 4


def test_lines_of_text(run, tree, capsys):
    assert cli.main(["cfg", f"{tree}/kitchen.py:brew", "--text"]) == 0
    assert capsys.readouterr().out.startswith("bb0 L")
    assert run("summary")[1] and run("tree", "kitchen.py", "--focus", "breakfast")[1] and run("cell", "kitchen.py", "--focus", "water")[1]
