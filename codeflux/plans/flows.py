"""Registered queries over the program of ``templates``: lowering, calls, exceptions, state, imports and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeflux.functions.fixpoint import cut
from codeflux.operators import analysis, exceptions, program, reports
from codeflux.plans import expected as X
from codeflux.plans.templates import expected, template_source
from codeflux.sources import facts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, rows: list[tuple] | None, columns: str, types: str = ""):
    """Registers a query over the program; ``rows`` are what each of its functions gives, in ``columns`` (after fq)."""

    def register(f):
        QUERIES[name] = f
        if rows is not None:
            ORACLES[name] = expected(rows, columns, types)
        return f

    return register


def _source(spark: SparkSession, sf_dir: str) -> facts.Program:
    return facts.Program(template_source(spark, sf_dir))


#: What the operators over whole programs read of modules and functions, and of operations.
MODULES = ("relpath", "module_name", "imports", "classes", "globals")
OPS = ("op_id", "block_id", "kind", "targets", "uses", "calls")


def _program(spark: SparkSession, sf_dir: str, *fields: str) -> tuple[DataFrame, DataFrame]:
    """Modules and functions, with those ``fields`` of functions."""
    source = _source(spark, sf_dir)
    return cut(source.modules(*MODULES)), cut(source.table(*fields, where=("relpath", "qualname", "simple"), of_ops=OPS))


def _whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """As ``_program``, with all that lowering gives, lines included."""
    modules = cut(facts.lower(template_source(spark, sf_dir)))
    return modules, cut(facts.functions(modules))


def _text(c: str) -> F.Column:
    return F.array_join(c, " ").alias(c)


@query("lowered_ops", X.OPS, "op_id, block_id, kind, sub, targets, uses", "int, int, varchar, varchar, varchar, varchar")
def lowered_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, sf_dir).inner("ops", "op_id", "block_id", "kind", "sub", "targets", "uses").select("fq", "op_id", "block_id", "kind", "sub", _text("targets"), _text("uses"))


@query("lowered_edges", X.EDGES, "src, dst, kind", "int, int, varchar")
def lowered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, sf_dir).inner("edges", "src", "dst", "kind")


@query("lowered_exits", X.EXITS, "exits, locals, frees", "varchar, varchar, varchar")
def lowered_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, sf_dir).table("exits", "locals", "frees").select("fq", F.array_join(F.transform("exits", lambda x: x.cast("string")), " ").alias("exits"), _text("locals"), _text("frees"))


@query("function_metrics", X.METRICS, ", ".join(analysis.METRICS), ", ".join(["int"] * len(analysis.METRICS)))
def function_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.metrics(_source(spark, sf_dir))


@query("findings_ranked", X.FINDINGS, "emit, pass_name, kind, line, modality, soundness", "int, varchar, varchar, int, varchar, varchar")
def findings_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every function, in the order of their weight; lines count from the function's first."""
    found = analysis.findings(_source(spark, sf_dir), where=("first_line",))
    return found.select("fq", "emit", "pass_name", "kind", (F.col("line") - F.col("first_line")).alias("line"), "modality", "soundness")


@query("constant_values", X.CONSTANTS, "block, value", "int, varchar")
def constant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.relation(_source(spark, sf_dir), "const").select("fq", F.col("a").alias("block"), F.col("name").alias("value"))


@query("overloaded_names", X.OVERLOADED, "name, parts", "varchar, int")
def overloaded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.relation(_source(spark, sf_dir), "overloaded").select("fq", "name", F.col("b").alias("parts"))


@query("loop_regions", X.REGIONS, "header, block", "int, int")
def loop_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.relation(_source(spark, sf_dir), "region").select("fq", F.col("a").alias("header"), F.col("b").alias("block"))


@query("output_inputs", X.OUTPUTS, "flow", "varchar")
def output_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.relation(_source(spark, sf_dir), "output_input").select("fq", F.col("name").alias("flow"))


@query("flow_walks", X.WALKS, "step, depth, kind, id, name, via, parent, frontier", "int, int, varchar, int, varchar, varchar, int, boolean")
def flow_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps forward over control and data, from each function's first block."""
    return analysis.walks(_source(spark, sf_dir), lambda f: [{"kind": "block", "id": f["entry"]}]).select("fq", "step", "depth", "kind", "id", "name", "via", "parent", "frontier")


@query("return_slices", X.SLICES, "start, step, kind, id, name, via", "varchar, int, varchar, int, varchar, varchar")
def return_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every value that returns comes from, five steps back."""
    starts = lambda f: ({"kind": "op", "id": o["op_id"]} for o in f["ops"] if o["kind"] == "return" and o["uses"])
    return analysis.slices(_source(spark, sf_dir), starts).select("fq", "start", "step", "kind", "id", "name", "via")


@query("guard_chains", X.GUARDS, "line, depth, branch_op, condition, arm", "int, int, int, varchar, varchar")
def guard_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branches that decide on each line of every function; lines count from the function's first."""
    lines = lambda f: ({"line": o["line"]} for o in f["ops"] if o["line"] > 0)
    found = analysis.guards(_source(spark, sf_dir), lines, ("first_line",))
    return found.select("fq", (F.col("line") - F.col("first_line")).alias("line"), "depth", "branch_op", "condition", "arm")


@query("block_paths", X.PATHS, "path", "varchar")
def block_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths from each function's first block to each of its exits."""
    ends = lambda f: ({"start": f["entry"], "goal": b} for b in f["exits"])
    return analysis.paths(_source(spark, sf_dir), ends).select("fq", "path")


@query("resolved_calls", X.CALLS, "func, target, kind, k", "varchar, varchar, varchar, int")
def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each call of the program means, and by which rule."""
    source = _source(spark, sf_dir)
    fns = cut(source.table(where=("relpath", "qualname", "simple")))
    called = source.each("name string", lambda f: ((n,) for n in dict.fromkeys(c["func"] for o in f["ops"] for c in o["calls"] if c["func"])))
    found = program.resolve_names(cut(source.modules(*MODULES)), fns, called)
    return found.select("fq", F.col("name").alias("func"), "target", "kind", "k")


@query("program_calls", X.EDGES_BETWEEN, "callee, k, via_arg, soft", "varchar, int, int, int")
def program_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = program.call_graph(program.sites_of(program.evidence(*_program(spark, sf_dir, "locals", "ops"))))
    return edges.select(F.col("caller").alias("fq"), "callee", "k", "via_arg", "soft")


@query("call_paths", None, "")
def call_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of callers of every method of a class, from functions that nobody calls."""
    modules, fns = _program(spark, sf_dir, "locals", "ops")
    edges = cut(program.call_graph(program.sites_of(program.evidence(modules, fns))))
    goals = program.class_methods(modules, fns).select("fq")
    return program.call_paths(edges, goals).select(F.col("goal").alias("fq"), F.array_join("path", " > ").alias("path"))


@query("handler_census", X.HANDLERS, "block_id, exc, binds, exit, sets, calls, broad", "int, varchar, varchar, varchar, varchar, varchar, boolean")
def handler_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exceptions.handlers(_source(spark, sf_dir))
    return found.select("fq", "block_id", "exc", "binds", "exit", _text("sets"), _text("calls"), "broad")


@query("local_raises", X.RAISES, "exc, implicit", "varchar, boolean")
def local_raises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What functions raise themselves, subscripts and attributes included."""
    return exceptions.raised_in(_source(spark, sf_dir), implicit=True).select("fq", "exc", "implicit")


@query("program_escapes", X.ESCAPES, "exc, depth, chain", "varchar, int, varchar")
def program_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exception that may leave a function, with the functions it comes through."""
    found = cut(exceptions.program_escapes(*_whole(spark, sf_dir)))
    chains = program.witnesses(found).select("fq", "exc", F.array_join("chain", " < ").alias("chain"))
    return found.select("fq", "exc", "depth").join(chains, ["fq", "exc"])


@query("state_accesses", X.STATE, "cell, kind, mode", "varchar, varchar, varchar")
def state_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.state_accesses(*_program(spark, sf_dir, "globals", "ops")).select("fq", "cell", "kind", "mode")


@query("value_trace", X.TRACE, "origin_var, to_fq, to_var, depth, kind", "varchar, varchar, varchar, int, varchar")
def value_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first parameter of every order's function may go."""
    modules, fns = _program(spark, sf_dir, "locals", "globals", "params", "ops")
    seeds = fns.where("size(params) > 0 and simple rlike '^f[0-9]+$'").select("fq", F.element_at("params", 1).alias("var"))
    found = program.trace(program.value_flows(modules, fns), seeds)
    return found.select(F.col("origin_fq").alias("fq"), "origin_var", F.col("fq").alias("to_fq"), F.col("var").alias("to_var"), "depth", "kind")


@query("overrides", X.OVERRIDES, "child, parent, method")
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = program.class_forest(_source(spark, sf_dir).modules("relpath", "classes"))[1]
    return found.select(F.concat(F.element_at(F.split("child", ":"), 1), F.lit(":")).alias("fq"), "child", "parent", "method")


@query("import_graph", X.IMPORTS, "dst, dotted, lazy", "varchar, varchar, boolean")
def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = program.import_graph(cut(_source(spark, sf_dir).modules("relpath", "module_name", "imports")))
    return found.select(F.concat("src", F.lit(":")).alias("fq"), "dst", "dotted", "lazy")


def _external_sql() -> str:
    from codeflux.plans.templates import PROGRAM_SQL

    return f"with {PROGRAM_SQL} select 'os' as root, count(*) as n from m union all select 'json', 1"


def external_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.external_roots(program.import_graph(cut(_source(spark, sf_dir).modules("relpath", "module_name", "imports"))))


def deferred_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.deferred_cycles(program.import_graph(cut(_source(spark, sf_dir).modules("relpath", "module_name", "imports"))))


QUERIES["deferred_cycles"], ORACLES["deferred_cycles"] = deferred_cycles, "select 'pkg/core.py' as src, 'pkg/late.py' as dst"
QUERIES["external_roots"], ORACLES["external_roots"] = external_roots, _external_sql()


@query("call_trees", X.TREES, "path, depth, note", "varchar, int, varchar")
def call_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order's function calls, three calls deep."""
    modules, fns = _program(spark, sf_dir, "locals", "ops")
    edges = program.call_graph(program.sites_of(program.evidence(modules, fns)))
    tree = reports.call_tree(edges, fns.where("simple rlike '^f[0-9]+$'").select("fq"))
    return tree.select(F.col("root").alias("fq"), F.array_join("path", " > ").alias("path"), "depth", "note")


@query("function_footprints", X.FOOTPRINTS, "reads, writes", "varchar, varchar")
def function_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.footprints(program.state_accesses(*_program(spark, sf_dir, "globals", "ops")))
    return found.select("fq", _text("reads"), _text("writes"))


@query("class_trees", X.CLASS_TREES, "path, again", "varchar, boolean")
def class_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = reports.class_tree(program.class_forest(cut(_source(spark, sf_dir).modules("relpath", "classes")))[0])
    return tree.select(F.concat(F.element_at(F.split(F.element_at("path", 1), ":"), 1), F.lit(":")).alias("fq"), F.array_join("path", " > ").alias("path"), "again")


@query("finding_hints", X.HINTS, "emit, ref, verify", "int, varchar, varchar")
def finding_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of each finding's operation and the command that shows what it rests on."""
    return reports.with_hints(analysis.findings(_source(spark, sf_dir))).select("fq", "emit", "ref", "verify")


@query("module_reports", X.MODULE_REPORTS, "fan_out, work, call_assigns", "int, varchar, int")
def module_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every module depends on, and what it does when it is imported."""
    found = reports.import_report(cut(_source(spark, sf_dir).modules("relpath", "module_name", "imports", "side_effects", "call_assigns")))
    return found.select(F.concat("relpath", F.lit(":")).alias("fq"), F.col("fan_out").cast("int").alias("fan_out"), _text("work"), "call_assigns")


@query("block_texts", X.BLOCK_TEXTS, "pos, text", "int, varchar")
def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block as a line of text, without its line numbers."""
    found = reports.block_lines(_source(spark, sf_dir))
    return found.select("fq", "pos", F.regexp_replace("text", r" L\d+-\d+:", ":").alias("text"))
