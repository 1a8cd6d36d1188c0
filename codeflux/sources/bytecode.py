"""Compiled code as a source: blocks of instructions between jumps, from compiling alone; nothing is run."""

from __future__ import annotations

import dis
from types import CodeType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK = "fq string, start int, n int, first_op string, last_op string, line int, next array<int>, handlers array<int>"


def code_blocks(code: CodeType) -> list[dict]:
    """Blocks by the offset of their first instruction: jump targets, ends of exception ranges and what follows a jump begin
    new ones."""
    steps = list(dis.get_instructions(code))
    table = list(dis.Bytecode(code).exception_entries)
    leaps = {*dis.hasjrel, *dis.hasjabs}
    ends = ("RETURN_VALUE", "RETURN_CONST", "RAISE_VARARGS", "RERAISE")
    heads = {0, *(t.target for t in table), *(t.start for t in table), *(t.end for t in table)}
    for i, s in enumerate(steps):
        if s.opcode in leaps:
            heads.add(s.argval)
        if (s.opcode in leaps or s.opname in ends) and i + 1 < len(steps):
            heads.add(steps[i + 1].offset)
    groups: list[list] = []
    for s in steps:
        if s.offset in heads or not groups:
            groups.append([])
        groups[-1].append(s)
    out = []
    for i, g in enumerate(groups):
        last = g[-1]
        after = [last.argval] if last.opcode in leaps else []
        falls = last.opname not in (*ends, "JUMP_FORWARD", "JUMP_BACKWARD", "JUMP_BACKWARD_NO_INTERRUPT")
        if falls and i + 1 < len(groups):
            after.insert(0, groups[i + 1][0].offset)
        caught = sorted({t.target for t in table if t.start <= g[0].offset < t.end})
        line = next((s.positions.lineno for s in g if s.positions and s.positions.lineno), None)
        out.append({"start": g[0].offset, "n": len(g), "first_op": g[0].opname, "last_op": last.opname, "line": line, "next": after, "handlers": caught})
    return out


def blocks(sources: DataFrame) -> DataFrame:
    """fq, start, n, first_op, last_op, line, next, handlers of every function's compiled code, from (relpath, src)."""
    schema = StructType.fromDDL(BLOCK)
    arrow = to_arrow_schema(schema)

    def of(relpath: str, src: str) -> list[dict]:
        try:
            todo = [compile(src, relpath, "exec", dont_inherit=True)]
        except (SyntaxError, ValueError, RecursionError):
            return []
        out = []
        while todo:
            code = todo.pop()
            todo += [c for c in code.co_consts if isinstance(c, CodeType)]
            if code.co_name != "<module>":
                out += [b | {"fq": f"{relpath}:{code.co_qualname.replace('.<locals>', '')}"} for b in code_blocks(code)]
        return out

    def run(batches):
        for batch in batches:
            for relpath, src in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                yield pa.RecordBatch.from_pylist(of(relpath, src or ""), arrow)

    return sources.select("relpath", "src").mapInArrow(run, schema)
