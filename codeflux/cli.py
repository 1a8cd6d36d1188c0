"""Command line: ``python -m codeflux.cli COMMAND TARGET`` prints JSON rows.

A target is a folder, a file, ``file.py:function`` or ``live:module`` (found, never imported). Exit codes: 0 done, 1 failed,
2 no such target, 4 the target does not parse.
"""

from __future__ import annotations

import argparse
import importlib.util
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeflux.functions import refs
from codeflux.functions.fixpoint import cut
from codeflux.operators import analysis, exceptions, passes, program, reports
from codeflux.sources import facts


class Missing(Exception):
    """There is no such file, function or address."""


class Unparsable(Exception):
    """The one file asked for does not parse."""


class Target:
    """A folder, or one file of it, with what has been lowered of it."""

    def __init__(self, spark: SparkSession, text: str, exclude_tests: bool = False):
        self.spark, self.function = spark, None
        if text.startswith("live:"):
            spec = importlib.util.find_spec(text[5:])
            if spec is None or not spec.origin:
                raise Missing(text)
            text = os.path.dirname(spec.origin) if spec.submodule_search_locations else spec.origin
        path, _, name = text.partition(":")
        if not os.path.exists(path):
            raise Missing(text)
        self.folder = path if os.path.isdir(path) else os.path.dirname(os.path.abspath(path))
        self.sources = facts.scan(spark, self.folder, exclude_tests)
        if self.folder != path:
            self.sources = self.sources.where(F.col("relpath") == os.path.basename(path))
        self.modules = cut(facts.lower(self.sources))
        if self.folder != path and (row := self.modules.where("error is not null").first()):
            raise Unparsable(f"{row.relpath}: {row.error}")
        self.fns = cut(facts.functions(self.modules))
        if name:
            self.fns = cut(facts.named(self.fns, name.split(":")[0]))
            if self.fns.isEmpty():
                raise Missing(text)

    def evidence(self) -> DataFrame:
        return cut(program.evidence(self.modules, self.fns))

    def edges(self) -> DataFrame:
        return cut(program.call_graph(program.sites_of(self.evidence())))

    def node(self, ref: str) -> DataFrame:
        """(fq, kind, id) of the block, operation, definition or use that an address means."""
        found = cut(refs.resolve_nodes(self.fns, ref))
        if found.isEmpty():
            raise Missing(f"stale address: {ref}")
        return found


def _ranked(found: DataFrame) -> DataFrame:
    rank = F.coalesce(*[F.when((F.col("soundness") == s) & (F.col("modality") == m), F.lit(r)) for (s, m), r in passes.RANK.items()])
    return found.withColumn("rank", rank)


def opportunities(t: Target, x: argparse.Namespace) -> DataFrame:
    """Findings of all passes without those that a pragma in the source suppresses, the weightiest first."""
    found = analysis.findings(t.fns, tuple(x.only.split(",")) if x.only else None)
    found = found.join(t.fns.select("fq", "relpath"), "fq")
    lines = facts.source_lines(facts.text_of(t.sources))
    kept = program.suppressed(found, lines).where("not suppressed").drop("suppressed")
    return _ranked(kept).orderBy("rank", "relpath", "fq", "line", "emit").limit(x.top)


def report(t: Target, x: argparse.Namespace) -> DataFrame:
    """A row for each function with its metrics, their percentiles among the program's, its fans and its findings."""
    keys = ("blocks", "branches", "exits", "cyclomatic", "cognitive", "max_nesting", "depdegree", "max_live_span")
    rows = cut(analysis.metrics(t.fns, keys))
    if rows.count() >= 10:
        for key in passes.THRESHOLDS:
            rows = program.percentiles(rows, key, f"{key}_pct")
    found = analysis.findings(t.fns).groupBy("fq").agg(F.count("*").alias("findings"))
    return rows.join(program.fans(t.edges()), "fq", "left").join(found, "fq", "left").na.fill(0, ["fan_in", "fan_out", "findings"]).orderBy(F.desc("cyclomatic"), "fq")


def raises(t: Target, x: argparse.Namespace) -> DataFrame:
    found = cut(exceptions.program_escapes(t.modules, t.fns, x.implicit))
    return found.select("fq", "exc", "depth", "line").join(program.witnesses(found), ["fq", "exc"]).orderBy("fq", "exc")


def at(t: Target, x: argparse.Namespace) -> DataFrame:
    """The function that owns a line, what happens there, the branches that decide on it and the chains of calls to it."""
    spans = t.fns.select("relpath", "fq", F.col("first_line").alias("lo"), F.col("last_line").alias("hi"))
    line = t.modules.where("error is null").select("relpath", F.lit(x.line).alias("line"))
    owner = cut(program.functions_at(spans, line))
    here = t.fns.join(owner.select("fq"), "fq", "left_semi")
    ops = facts.ops(here).where(F.col("line") == x.line).select("fq", F.lit("op").alias("what"), F.concat_ws(" ", "kind", F.array_join("targets", ","), F.lit("<-"), F.array_join("uses", ",")).alias("text"), F.col("op_id").alias("ord"))
    guard = analysis.guards(here, owner.select("fq", "line")).where("depth <= 6").select("fq", F.lit("guard").alias("what"), F.concat_ws(" ", "condition", "arm").alias("text"), F.col("depth").alias("ord"))
    paths = program.call_paths(t.edges(), owner.select("fq"), most=3)
    chains = paths.select(F.col("goal").alias("fq"), F.lit("chain").alias("what"), F.array_join("path", " -> ").alias("text"), F.size("path").alias("ord"))
    return ops.unionByName(guard).unionByName(chains).orderBy("fq", "what", "ord")


def impact(t: Target, x: argparse.Namespace) -> DataFrame:
    """What calls and is called by functions: those named, or those that differ from a revision; with the state they share."""
    focus = facts.named(t.fns, x.focus) if x.focus else program.functions_at(
        t.fns.select("relpath", "fq", F.col("first_line").alias("lo"), F.col("last_line").alias("hi")), facts.changed_lines(t.spark, t.folder, x.since))
    return program.impact_report(t.edges(), focus.select("fq").distinct(), program.state_accesses(t.modules, t.fns), x.depth)


def callgraph(t: Target, x: argparse.Namespace) -> DataFrame:
    edges = t.edges()
    if x.to:
        return program.call_paths(edges, facts.named(t.fns, x.to).select("fq"))
    if x.focus:
        return program.reachable_from(edges, facts.named(t.fns, x.focus).select("fq"), x.depth)
    return edges


def verify(t: Target, x: argparse.Namespace) -> DataFrame:
    return analysis.verdicts(Target(t.spark, x.old).fns, t.fns)


def walk(t: Target, x: argparse.Namespace) -> DataFrame:
    return analysis.walks(t.fns, t.node(x.source), x.direction, x.edges, x.depth)


def paths(t: Target, x: argparse.Namespace) -> DataFrame:
    ends = [refs.block_of(t.fns, t.node(r)).select("fq", F.col("block_id").alias(n)) for r, n in ((x.source, "start"), (x.goal, "goal"))]
    return analysis.paths(t.fns, ends[0].join(ends[1], "fq"))


def dataflow(t: Target, x: argparse.Namespace) -> DataFrame:
    rows = analysis.relation(t.fns, "use_def").select("fq", F.col("a").alias("use_op"), F.col("b").alias("def_op"), "name")
    return rows.where(F.col("name") == x.var) if x.var else rows


def trace(t: Target, x: argparse.Namespace) -> DataFrame:
    return program.trace(program.value_flows(t.modules, t.fns), program.seeds_named(t.fns, x.var), x.depth).orderBy("depth", "fq", "var").limit(300)


def state(t: Target, x: argparse.Namespace) -> DataFrame:
    cells = program.state_cells(program.state_accesses(t.modules, t.fns))
    if x.focus:
        cells = cells.where(F.contains("cell", F.lit(x.focus)))
    return cells.orderBy(F.col("flags") == "", F.desc(F.col("writers") + F.col("readers")), F.desc("writers"), "cell")


def cfg(t: Target, x: argparse.Namespace) -> DataFrame:
    return facts.blocks(t.fns).join(facts.cfg_edges(t.fns).groupBy("fq", F.col("src").alias("block_id")).agg(F.sort_array(F.collect_list(F.struct("ord", "dst", "kind"))).alias("next")), ["fq", "block_id"], "left").orderBy("fq", "pos")


COMMANDS = {
    "cfg": cfg, "dataflow": dataflow, "walk": walk, "paths": paths, "trace": trace, "state": state, "raises": raises, "at": at, "impact": impact,
    "callgraph": callgraph, "report": report, "verify": verify, "opportunities": opportunities, "check": opportunities,
    "slice": lambda t, x: analysis.slices(t.fns, t.node(x.source), x.direction != "forward"),
    "metrics": lambda t, x: analysis.metrics(t.fns),
    "show": lambda t, x: facts.ops(t.fns).orderBy("fq", "op_id"),
    "hubs": lambda t, x: program.hubs(t.edges()),
    "cycles": lambda t, x: program.sharp_cycles(t.edges()),
    "classes": lambda t, x: program.class_forest(t.modules)[0],
    "imports": lambda t, x: program.import_graph(t.modules),
    "catches": lambda t, x: exceptions.handlers(exceptions.analyze(t.fns)).orderBy("fq", "line"),
    "dominators": lambda t, x: analysis.relation(t.fns, "dom").select("fq", F.col("a").alias("block"), F.col("b").alias("dominator")),
    "census": lambda t, x: analysis.census(t.fns),
    "summary": lambda t, x: reports.program_report(t.modules, t.fns),
    "tree": lambda t, x: reports.call_tree(t.edges(), facts.named(t.fns, x.focus).select("fq"), x.depth, x.sharp),
    "cell": lambda t, x: reports.cell_dossier(t.modules, t.fns, x.focus),
    "errors": lambda t, x: facts.parse_errors(t.modules),
}


#: How rows become lines of text.
TEXT = {
    "cfg": lambda t, x, rows: reports.block_lines(t.fns).orderBy("fq", "pos"),
    "walk": lambda t, x, rows: reports.walk_lines(rows).orderBy("fq", "start", "step"),
    "slice": lambda t, x, rows: reports.walk_lines(rows).orderBy("fq", "start", "step"),
    "classes": lambda t, x, rows: reports.tree_lines(reports.class_tree(rows)).orderBy("path"),
    "opportunities": lambda t, x, rows: reports.finding_lines(rows),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeflux", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("target")
    p.add_argument("--exclude-tests", action="store_true")
    p.add_argument("--out", help="folder to write JSON rows to, instead of printing them")
    p.add_argument("--from", dest="source", help="address to start from: path:function:kind:number or name@line")
    p.add_argument("--goal", help="address where paths end")
    p.add_argument("--direction", choices=("forward", "backward", "both"), default=None)
    p.add_argument("--edges", choices=("control", "data", "both"), default="both")
    p.add_argument("--depth", type=int, default=None, help="most steps: 3 for walks and call trees, 4 for impact, 6 for traces")
    p.add_argument("--var", help="name to follow")
    p.add_argument("--focus", help="function or cell that rows are about")
    p.add_argument("--to", help="function that chains of calls lead to")
    p.add_argument("--since", default="HEAD", help="revision that the folder is held against")
    p.add_argument("--old", help="target before a change, for verify")
    p.add_argument("--line", type=int, help="line of a file, for at")
    p.add_argument("--only", help="passes to run, comma-separated")
    p.add_argument("--top", type=int, default=60)
    p.add_argument("--sharp", action="store_true", help="leave out calls that rest on a name alone")
    p.add_argument("--text", action="store_true", help="lines of text instead of JSON, for " + ", ".join(TEXT))
    p.add_argument("--implicit", action="store_true", help="count what subscripts and attributes may raise")
    return p


NEEDS = {"tree": ["focus"], "cell": ["focus"], "walk": ["source"], "slice": ["source"], "paths": ["source", "goal"], "trace": ["var"], "at": ["line"], "verify": ["old"]}


def main(args: list[str] | None = None) -> int:
    p = parser()
    x = p.parse_args(args)
    for name in NEEDS.get(x.command, ()):
        if getattr(x, name) is None:
            p.error(f"{x.command} needs --{'from' if name == 'source' else name}")
    x.direction = x.direction or ("forward" if x.command == "walk" else "backward")
    x.depth = x.depth or {"impact": 4, "trace": 6}.get(x.command, 3)
    spark = SparkSession.builder.appName("codeflux").getOrCreate()
    try:
        target = Target(spark, x.target, x.exclude_tests)
        rows = COMMANDS[x.command](target, x)
        if x.text and x.command in TEXT:
            for row in TEXT[x.command](target, x, rows).select("text").toLocalIterator():
                print(row.text)
            return 0
        if x.out:
            rows.write.mode("overwrite").json(x.out)
        else:
            for line in rows.toJSON().toLocalIterator():
                print(line)
    except Missing as e:
        print(f"no such target: {e}", file=sys.stderr)
        return 2
    except Unparsable as e:
        print(e, file=sys.stderr)
        return 4
    return 0


if __name__ == "__main__":
    sys.exit(main())
