"""Modules lowered by pieces against modules lowered whole."""

import pytest

from codeflux.functions.fixpoint import cut
from codeflux.operators import analysis, exceptions, lower, pieces, reports
from codeflux.sources import facts

BAKERY = '''"""Dough and ovens."""
import os, json as j
from .flour import sift


RACKS = [1, 2]
warm: int = len(RACKS)
print(RACKS)


def knead(dough, hands):
    from late import rest

    if hands:
        dough.append(hands)
    elif dough:
        raise ValueError(dough)
    else:
        return rest
    return len(dough)


@staticmethod
@j.wraps
def proof(x: dict):
    def inner(k):
        import very.late
        return k + x

    try:
        return inner(x["a"])
    except (KeyError, OSError) as e:
        sift(e)
        raise


class Oven(Shelf):
    heat = 3

    def bake(self, loaf):
        global RACKS
        RACKS = loaf
        self.loaf = os.path.join(loaf)
        return super().bake(loaf)


try:
    import fast
except ImportError:
    fast = None
else:
    pass
'''
ODD = [
    BAKERY, BAKERY.replace("\n", "\r\n"), "", "\n", "  x = 1\n  y = 2\n", "def f(:\n", "@late\n", "from __future__ import annotations\ndef f(a: B):\n    return a\n",
    "def f():\n    return 1\n\ndef f(a):\n    return a\n", "def A():\n    def x():\n        return 1\n\nclass A:\n    def x(self):\n        return 2\n", 'x = """a\nb = 1\n"""\ndef f():\n    return x\n',
    "def f(n):\n    return f(n - 1)\n", "def f(f12):\n    return f12\n", "x = (\n1,\n)\ny = 1 + \\\n2\n", "def f():\n    x = 1\n   \n    return x\n", "return 5\ndef f(a):\n    return a\n", "# only this", "def f(): pass; x = 1\n#end\nasync def g(): await f()",
    "if a:\n    global b\nb = 1\ndef f():\n    return b\n", "def ThisFunction0(a):\n    return a\n", "def f[T](x: T):\n    return x\nclass C:\n    pass\nclass C(D):\n    def m(self): return __class__\n",
]


@pytest.mark.parametrize("source", ODD)
def test_pieces_give_what_the_whole_gives(source):
    held = pieces.Pieces()
    for _ in range(2):  # made, and known
        parts = held.of("shop/bakery.py", source)
        assert pieces.module("shop/bakery.py", parts) | {"functions": list(pieces.functions(parts))} == lower.lower_module("shop/bakery.py", source)


@pytest.mark.parametrize("source", ODD + ["def f(a):\n    return " + "-" * 600 + "a\n\n\nclass C:\n    def m(self):\n        return " + "-" * 600 + "a\n"])
def test_modules_without_bodies_are_the_same(source):
    parts = pieces.Pieces(bodies=False).of("shop/bakery.py", source)
    got, want = pieces.module("shop/bakery.py", parts), lower.lower_module("shop/bakery.py", source)
    assert got | {"functions": 0} == want | {"functions": 0}


def test_a_text_is_lowered_once_whatever_its_function_is_called(monkeypatch):
    made = []
    inner = lower.lower_function
    monkeypatch.setattr(lower, "lower_function", lambda *a: made.append(a[1]) or inner(*a))
    held = pieces.Pieces()
    for i in range(50):
        parts = held.of(f"m{i}.py", f"def head(a):\n    return a\n\n\ndef f{i}(x):\n    y = x\n    return y\n\n\ndef g{i}(x):\n    y = x\n    return y\n\n")
        assert [f["qualname"] for f in pieces.functions(parts)] == ["head", f"f{i}", f"g{i}"]
    assert len(made) <= 4


def test_texts_are_forgotten_beyond_a_size():
    held = pieces.Pieces(most=5_000)
    for i in range(10):
        held.of("m.py", f"x = {i}\n")
    assert held.full()
    held.forget()
    assert not held.known and not held.full()


@pytest.fixture(scope="module")
def both(spark):
    rows = [(f"d{i}/m{i}.py", s.replace("knead", f"knead{i}")) for i, s in enumerate(ODD * 3)]
    src = spark.createDataFrame(rows, "relpath string, src string")
    modules = cut(facts.lower(src))
    return facts.Program(src), modules, cut(facts.functions(modules))


def same(a, b):
    assert a.columns == b.columns
    rows = sorted(map(repr, a.collect()))
    assert rows and rows == sorted(map(repr, b.collect()))


def test_program_gives_the_tables_of_lowering(both):
    program, modules, fns = both
    same(program.modules("relpath", "module_name", "error", "imports", "classes", "globals", "side_effects", "call_assigns", "failed"), modules.select("relpath", "module_name", "error", "imports", "classes", "globals", "side_effects", "call_assigns", "failed"))
    same(program.table("params", "exits", where=facts.WHERE), fns.select("fq", *facts.WHERE, "params", "exits"))
    same(program.inner("ops", "op_id", "line", "end", "targets", "calls"), facts.ops(fns).select("fq", "op_id", "line", "end", "targets", "calls"))
    same(program.inner("blocks", "block_id", "line_lo", "line_hi"), facts.blocks(fns).select("fq", "block_id", "line_lo", "line_hi"))


def test_program_gives_what_analysis_gives(both, monkeypatch):
    program, _, fns = both
    same(analysis.findings(program), analysis.findings(fns).drop("detail"))
    same(analysis.metrics(program), analysis.metrics(fns))
    same(analysis.relation(program, "use_def"), analysis.relation(fns, "use_def"))
    same(exceptions.handlers(program), exceptions.handlers(exceptions.analyze(fns)))
    same(exceptions.raised_in(program, implicit=True), exceptions.raised(exceptions.analyze(fns, True)).drop("detail"))
    same(reports.block_lines(program), reports.block_lines(fns))
    lines = facts.ops(fns).where("line > 0").select("fq", "line").distinct()
    same(analysis.guards(program, lambda f: ({"line": o["line"]} for o in f["ops"] if o["line"] > 0)), analysis.guards(fns, lines))
