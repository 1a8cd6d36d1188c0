"""Summaries of a program as rows, and text lines made of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeflux.functions.fixpoint import cut
from codeflux.operators import analysis, exceptions, passes, program
from codeflux.sources import facts

#: Commands that show what a finding rests on, by pass.
HINTS = {
    "unreachable": "cfg {fq}", "redundant-branch": "walk {fq} --from {ref} --direction backward", "const-branch": "dataflow {fq}", "use-before-def": "slice {fq} --from {ref}",
    "dead-store": "dataflow {fq}", "complexity": "metrics {fq}", "decomposition": "slice {fq} --from {ref}", "scope-coupling": "show {fq}", "lossy-projection": "show {fq}",
    "input-mutation": "slice {fq} --from {ref}",
}


def catalog(spark) -> DataFrame:
    """name, place of every pass."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(passes.names())], "name string, place int")


def with_hints(findings: DataFrame) -> DataFrame:
    """Findings with ``ref`` (the address of the operation) and ``verify`` (the command that shows it)."""
    ref = F.concat_ws(":", "fq", F.lit("op"), F.col("op_id").cast("string"))
    hint = F.element_at(F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair]), F.col("pass_name"))
    return findings.withColumn("ref", ref).withColumn("verify", F.replace(F.replace(hint, F.lit("{fq}"), F.col("fq")), F.lit("{ref}"), F.col("ref")))


def finding_lines(findings: DataFrame) -> DataFrame:
    """fq, emit, text of findings, a line each."""
    return findings.select("fq", "emit", F.format_string("%s L%d [%s/%s] %s: %s", "fq", "line", "soundness", "modality", "pass_name", "title").alias("text"))


# call graph -----------------------------------------------------------------------------------------------------------


def edge_mark(k: Column, soft: Column) -> Column:
    """How a call is drawn: ~ on its name alone, ~k where k functions may be meant."""
    return F.when(k > 1, F.concat(F.lit("-~"), k.cast("string"), F.lit("->"))).when(soft == 1, "-~->").otherwise("->")


def path_lines(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """goal, text of chains of calls, with the marks of their edges."""
    steps = paths.withColumn("n", F.monotonically_increasing_id()).select("goal", "n", F.posexplode("path").alias("at", "fq"))
    after = steps.select("n", (F.col("at") - 1).alias("at"), F.col("fq").alias("callee"))
    met = steps.join(after, ["n", "at"], "left").join(edges.withColumnRenamed("caller", "fq"), ["fq", "callee"], "left")
    part = F.when(F.col("callee").isNull(), F.col("fq")).otherwise(F.concat_ws(" ", "fq", edge_mark(F.col("k"), F.col("soft"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", part.alias("part")))), lambda x: x["part"]), " ")
    return met.groupBy("goal", "n").agg(text.alias("text")).drop("n")


def call_tree(edges: DataFrame, roots: DataFrame, most: int = 3, sharp: bool = False) -> DataFrame:
    """root, path, depth, note: what each root (fq) calls, as a tree; a branch ends at an ambiguous call and at a function
    that is above itself. ``sharp`` leaves out calls that rest on a name alone."""
    ways = cut(edges.where(program.SHARP) if sharp else edges)
    front = roots.select(F.col("fq").alias("root"), F.array("fq").alias("path"), F.lit(0).alias("depth"), F.lit("").alias("note"))
    out = front
    for depth in range(1, most + 1):
        step = front.where("note = ''").join(ways, F.element_at("path", -1) == F.col("caller"))
        note = F.when(F.array_contains("path", F.col("callee")), "repeat").when(F.col("k") > 1, "ambiguous").otherwise("")
        front = cut(step.select("root", F.concat("path", F.array("callee")).alias("path"), F.lit(depth).alias("depth"), note.alias("note")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def call_summary(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """what, n: how many edges, ambiguous and name-only ones, and calls that nothing answers."""
    marks = F.array(F.lit("edges"), F.when(F.col("k") > 1, "ambiguous"), F.when(F.col("soft") == 1, "name only"), F.when(F.col("via_arg") == 1, "through an argument"))
    counts = edges.select(F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("what")).groupBy("what").agg(F.count("*").alias("n"))
    return counts.unionByName(program.unresolved(evidence).select(F.lit("unresolved").alias("what"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def reference_graph(fns: DataFrame) -> DataFrame:
    """fq, other: functions of one file that name each other, by the last part of what they read."""
    names = fns.select("fq", "relpath", F.explode("ops.uses").alias("us")).select("fq", "relpath", F.explode("us").alias("use"))
    last = names.select("fq", "relpath", F.element_at(F.split("use", r"\."), -1).alias("simple")).distinct()
    return last.join(fns.select("relpath", "simple", F.col("fq").alias("other")), ["relpath", "simple"]).where("fq <> other").select("fq", "other").distinct()


# classes --------------------------------------------------------------------------------------------------------------


def class_roots(forest: DataFrame) -> DataFrame:
    """root: classes of the program that others come of and that come of none of the program's."""
    inside = forest.where("inside")
    return inside.select(F.col("parent").alias("root")).distinct().join(inside.select(F.col("child").alias("root")), "root", "left_anti")


def class_tree(forest: DataFrame, most: int = 50) -> DataFrame:
    """path, again: every way from a root down; ``again`` where a class has been met on an earlier way (a diamond)."""
    inside = cut(forest.where("inside").select("child", "parent"))
    front = class_roots(forest).select(F.array("root").alias("path"))
    out = front
    for _ in range(most):
        front = cut(front.join(inside, F.element_at("path", -1) == F.col("parent")).where("not array_contains(path, child)").select(F.concat("path", F.array("child")).alias("path")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    turn = F.row_number().over(Window.partitionBy(F.element_at("path", -1)).orderBy("path"))
    return out.select("path", (turn > 1).alias("again"))


def tree_lines(tree: DataFrame) -> DataFrame:
    """path, text: a class tree as indented lines, in the order of ``path``."""
    name = F.element_at("path", -1)
    return tree.select("path", F.concat(F.repeat(F.lit("  "), F.size("path") - 1), name, F.when(F.col("again"), " (again)").otherwise("")).alias("text"))


def class_summary(forest: DataFrame) -> DataFrame:
    """base, n: classes of other programs that classes here come of."""
    return forest.where("not inside").groupBy(F.col("parent").alias("base")).agg(F.count("*").alias("n"))


# state ----------------------------------------------------------------------------------------------------------------


def cell_dossier(modules: DataFrame, fns: DataFrame, focus: str, most: int = 3) -> DataFrame:
    """cell, fq, what, lines: writes, calls of methods on the attribute, and functions that only read it, of the ``most``
    first cells whose name holds ``focus``."""
    accesses = cut(program.state_accesses(modules, fns))
    cells = accesses.where(F.contains("cell", F.lit(focus))).select("cell", "kind").distinct().orderBy("cell").limit(most)
    mine = accesses.join(F.broadcast(cells), ["cell", "kind"]).withColumn("name", F.when(F.col("kind") == "attr", F.concat(F.lit("self."), F.element_at(F.split("cell", r"\."), -1))).otherwise(F.element_at(F.split("cell", ":"), -1)))
    ops = fns.select("fq", F.explode("ops").alias("o")).select("fq", "o.line", "o.targets", "o.calls")
    met = mine.select("cell", "fq", "name", "mode").join(ops, "fq")
    lines = lambda df, what: df.groupBy("cell", "fq").agg(F.lit(what).alias("what"), F.sort_array(F.collect_set("line")).alias("lines"))
    under = lambda x: (x == F.col("name")) | x.startswith(F.concat(F.col("name"), F.lit(".")))
    writes = lines(met.where((F.col("mode") == "w") & F.exists("targets", under)), "writes")
    mutators = [F.concat(F.col("name"), F.lit(f".{m}")) for m in sorted(passes.MUTATORS)]
    changes = lines(met.where(F.exists("calls", lambda c: c["func"].isin(*mutators))), "changes")
    readers = mine.groupBy("cell", "fq").agg(F.max("mode").alias("mode")).where("mode = 'r'").select("cell", "fq", F.lit("only reads").alias("what"), F.array().cast("array<int>").alias("lines"))
    return writes.unionByName(changes).unionByName(readers)


def footprints(accesses: DataFrame) -> DataFrame:
    """fq, reads, writes: cells that each function touches."""
    side = lambda mode: F.sort_array(F.collect_set(F.when(F.col("mode") == mode, F.col("cell"))))
    return accesses.groupBy("fq").agg(side("r").alias("reads"), side("w").alias("writes"))


# programs -------------------------------------------------------------------------------------------------------------


def raises_report(escaped: DataFrame, edges: DataFrame, most: int = 15) -> DataFrame:
    """part, fq, exc: what leaves functions that nobody calls ('entry'), and types that leave the most functions ('widest')."""
    called = edges.select(F.col("callee").alias("fq")).distinct()
    surface = escaped.join(called, "fq", "left_anti").select(F.lit("entry").alias("part"), "fq", "exc").orderBy("fq", "exc").limit(most)
    widest = escaped.groupBy("exc").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "exc").limit(most)
    return surface.unionByName(widest.select(F.lit("widest").alias("part"), F.col("n").cast("string").alias("fq"), "exc"))


def import_report(modules: DataFrame) -> DataFrame:
    """relpath, fan_in, fan_out, work: each module's dependencies, and what it does when it is imported."""
    edges = program.module_edges(program.import_graph(modules))
    into, out = (edges.groupBy(F.col(c).alias("relpath")).agg(F.count("*").alias(n)) for c, n in (("dst", "fan_in"), ("src", "fan_out")))
    work = modules.select("relpath", F.transform("side_effects", lambda s: F.concat(F.lit("L"), s["line"], F.lit(" "), s["what"])).alias("work"), "call_assigns")
    return work.join(into, "relpath", "left").join(out, "relpath", "left").na.fill(0, ["fan_in", "fan_out"])


def program_report(modules: DataFrame, fns: DataFrame) -> DataFrame:
    """part, name, n: sizes of a program, its largest functions, hubs, cycles, flagged cells, handlers and parse errors."""
    modules, fns = cut(modules), cut(fns)
    edges = cut(program.call_graph(program.sites_of(program.evidence(modules, fns))))
    row = lambda df, part, name, n: df.select(F.lit(part).alias("part"), F.col(name).cast("string").alias("name"), F.col(n).cast("long").alias("n"))
    sizes = modules.agg(F.count("*").alias("n")).withColumn("x", F.lit("modules")).unionByName(fns.agg(F.count("*").alias("n")).withColumn("x", F.lit("functions"))).unionByName(edges.agg(F.count("*").alias("n")).withColumn("x", F.lit("calls")))
    parts = [row(sizes, "size", "x", "n"), row(analysis.census(fns), "largest", "fq", "blocks"), row(program.hubs(edges), "hub", "fq", "fan_in")]
    parts += [row(program.sharp_cycles(edges).groupBy("scc").agg(F.count("*").alias("n")), "cycle", "scc", "n")]
    flagged = program.state_cells(program.state_accesses(modules, fns)).where("flags <> ''")
    parts += [row(flagged.withColumn("n", F.col("writers") + F.col("readers")), "state", "cell", "n")]
    parts += [row(exceptions.census(exceptions.handlers(exceptions.analyze(fns))), "handlers", "kind", "n")]
    parts += [row(facts.parse_errors(modules).withColumn("n", F.lit(1)), "error", "relpath", "n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# text -----------------------------------------------------------------------------------------------------------------


def _block_parts(f: dict):
    """pos, head, line_lo, line_hi, rest of the lines that ``block_lines`` makes."""
    body, out = {}, {}
    for o in f["ops"]:
        body.setdefault(o["block_id"], []).append(" ".join([f"op{o['op_id']}:{o['kind']}", ",".join(o["targets"]), *(["<- " + ",".join(o["uses"])] if o["uses"] else [])]))
    for e in f["edges"]:
        out.setdefault(e["src"], []).append(f"{'~>' if e['kind'] == 'e' else '->'}bb{e['dst']}")
    for b in f["blocks"]:
        n = b["block_id"]
        if n in body or n in out:
            note = " (handler)" if b["is_handler"] else " (finally)" if b["is_finally"] else ""
            yield b["pos"], f"bb{n}{note}", b["line_lo"], b["line_hi"], f"{'; '.join(body.get(n, ()))} {' '.join(out.get(n, ())) or 'end'}"


def block_lines(fns: DataFrame | facts.Program) -> DataFrame:
    """fq, pos, text: each block with its lines, what it does and where it leads; passages without source are left out."""
    if isinstance(fns, facts.Program):
        parts = fns.each("pos int, head string, line_lo int, line_hi int, rest string", _block_parts, ("line_lo", "line_hi"))
        return parts.select("fq", "pos", F.concat("head", F.lit(" L"), "line_lo", F.lit("-"), "line_hi", F.lit(": "), "rest").alias("text"))
    ops = fns.select("fq", F.explode("ops").alias("o")).select("fq", "o.block_id", "o.op_id", F.concat_ws(" ", F.concat(F.lit("op"), F.col("o.op_id"), F.lit(":"), F.col("o.kind")), F.array_join("o.targets", ","), F.when(F.size("o.uses") > 0, F.concat(F.lit("<- "), F.array_join("o.uses", ",")))).alias("t"))
    body = ops.groupBy("fq", "block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op_id", "t"))), lambda x: x["t"]), "; ").alias("body"))
    way = F.concat(F.when(F.col("kind") == "e", "~>").otherwise("->"), F.lit("bb"), F.col("dst"))
    out = facts.cfg_edges(fns).groupBy("fq", F.col("src").alias("block_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", way.alias("w")))), lambda x: x["w"]), " ").alias("out"))
    note = F.when(F.col("is_handler"), " (handler)").when(F.col("is_finally"), " (finally)").otherwise("")
    each = facts.blocks(fns).join(body, ["fq", "block_id"], "left").join(out, ["fq", "block_id"], "left").where("body is not null or out is not null")
    return each.select("fq", "pos", F.concat(F.lit("bb"), "block_id", note, F.format_string(" L%d-%d: ", "line_lo", "line_hi"), F.coalesce("body", F.lit("")), F.lit(" "), F.coalesce("out", F.lit("end"))).alias("text"))


def walk_lines(walks: DataFrame) -> DataFrame:
    """fq, start, step, text: the steps of walks, indented by depth; '...' where there is more."""
    word = F.when(F.col("via") == "except", "~> ").when(F.col("via") == "ctrl-dep", "c> ").when(F.col("via") == "start", "").otherwise("-> ")
    label = F.when(F.col("kind") == "block", F.concat(F.lit("bb"), "id")).when(F.col("kind") == "op", F.concat(F.lit("op"), "id", F.lit(":"), "name")).otherwise(F.concat_ws(":", "kind", "name"))
    at = F.when(F.col("line") > 0, F.concat(F.lit("@"), "line")).otherwise("")
    return walks.select("fq", "start", "step", F.concat(F.repeat(F.lit("  "), F.col("depth")), word, label, at, F.when(F.col("frontier"), " ...").otherwise("")).alias("text"))
