"""Whole-program operators: call resolution, call graph, state, imports, classes, exceptions, impact."""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeflux.functions import fixpoint
from codeflux.sources import facts

#: More functions of one simple name than this say nothing about a call.
SMEAR = 24
BUILTINS = sorted(dir(builtins))
BUILTIN_METHODS = sorted({m for t in (str, bytes, dict, list, set, tuple, frozenset) for m in dir(t) if not m.startswith("_")})


# calls ----------------------------------------------------------------------------------------------------------------


def _parts(path: Column) -> Column:
    return F.split(path, r"\.")


def _scope(qualname: Column) -> Column:
    """The name just outside a qualified name; empty at the top."""
    return F.regexp_extract(qualname, r"^(?:.*\.)?([^.]+)\.[^.]+$", 1)


def absolute(dotted: Column, package: Column) -> Column:
    """A dotted path with its leading dots read from ``package`` (an array): one dot is the package itself."""
    level = F.length(F.regexp_extract(dotted, r"^(\.*)", 1))
    above = F.slice(package, 1, F.greatest(F.size(package) - level + 1, F.lit(0)))
    tail = F.regexp_replace(dotted, r"^\.+", "")
    return F.when(level > 0, F.array_join(F.filter(F.concat(above, F.array(tail)), lambda x: x != ""), ".")).otherwise(dotted)


def modules_named(names: DataFrame, modules: DataFrame) -> DataFrame:
    """name, found: the module of that name, or the only one whose own name ends it (the root may lie below the import's)."""
    known = modules.where("module_name <> ''").groupBy(F.col("module_name").alias("tail")).agg(F.min("relpath").alias("found"), F.count("*").alias("n"))
    starts = F.sequence(F.lit(1), F.size(_parts(F.col("name"))))
    tails = names.select("name").distinct().where("name <> ''").withColumn("at", F.explode(starts))
    met = tails.withColumn("tail", F.array_join(F.slice(_parts(F.col("name")), F.col("at"), F.lit(1 << 20)), ".")).join(known, "tail")
    best = met.groupBy("name").agg(F.min_by("found", "at").alias("found"), F.min("at").alias("at"), F.sum("n").alias("n"))
    return best.where("at = 1 or n = 1").select("name", "found")


def resolve_names(modules: DataFrame, fns: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fq, name, target, kind, k): what each wanted (fq, name) calls; target is null where nothing in the program is meant.

    Every rule gives candidates with a rank, and rules that end the search give a row without target; of each name the
    rows of its smallest rank stay."""
    at = fns.select("fq", "relpath", "qualname").join(modules.select("relpath", "module_name"), "relpath")
    sites = wanted.where("name is not null and name <> ''").select("fq", "name").distinct().join(at, "fq")
    sites = sites.withColumns({"parts": _parts(F.col("name")), "scope": _scope(F.col("qualname"))})
    sites = sites.withColumns({"first": F.element_at("parts", 1), "last": F.element_at("parts", -1), "n": F.size("parts")})
    # a call through some object: only a method can be meant, and not the caller's own name
    sites = fixpoint.cut(sites.withColumn("through", (F.col("n") > 1) & ~((F.col("n") == 2) & F.col("first").isin("self", "cls"))))
    named = fns.select(F.col("fq").alias("target"), F.col("relpath").alias("t_path"), F.col("qualname").alias("t_name"), F.col("simple").alias("t_simple"), _scope(F.col("qualname")).alias("t_scope"))
    named = fixpoint.cut(named)
    classes = modules.select("relpath", F.explode("classes").alias("c")).select(F.col("relpath").alias("c_path"), F.col("c.name").alias("cls"), "c.bases")
    in_class = sites.join(classes, (F.col("relpath") == F.col("c_path")) & (F.col("scope") == F.col("cls")))

    def out(df: DataFrame, rank: int, kind: str, target="target") -> DataFrame:
        return df.select("fq", "name", (F.col(target) if target else F.lit(None).cast("string")).alias("target"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))

    def method(df: DataFrame, owner: str) -> DataFrame:
        return df.join(named, (F.col("t_path") == F.col("relpath")) & (F.col("t_scope") == F.col(owner)) & (F.col("t_simple") == F.col("last")))

    above = in_class.where("first like 'super(%' and n = 2")
    own = in_class.where("first in ('self', 'cls') and n = 2")
    rules = [out(method(above.withColumn("base", F.explode("bases")), "base"), 0, "self"), out(above, 1, "self", None)]
    rules += [out(method(own, "cls"), 2, "self"), out(method(own.withColumn("base", F.explode("bases")), "base"), 3, "self")]

    bound = modules.select("relpath", "module_name", F.posexplode("imports").alias("pos", "i")).select(F.col("relpath").alias("i_path"), "module_name", "pos", F.col("i.name").alias("i_name"), "i.target", "i.lazy")
    # of the imports of a name those at the top count, the last of them; of the others the first
    turn = F.when(F.col("lazy"), F.col("pos")).otherwise(-F.col("pos"))
    bound = bound.groupBy("i_path", "module_name", "i_name").agg(F.min_by("target", F.struct("lazy", turn)).alias("dotted"))
    own_parts = F.when(F.col("module_name") == "", F.array().cast("array<string>")).otherwise(_parts(F.col("module_name")))
    package = F.when(F.col("i_path").endswith("__init__.py"), own_parts).otherwise(F.slice(own_parts, 1, F.greatest(F.size(own_parts) - 1, F.lit(0))))
    bound = bound.select("i_path", "i_name", absolute(F.col("dotted"), package).alias("whole"))
    imported = sites.join(bound, (F.col("relpath") == F.col("i_path")) & (F.col("first") == F.col("i_name")))
    full = F.filter(F.concat(_parts(F.col("whole")), F.slice("parts", 2, 1 << 20)), lambda x: x != "")
    imported = imported.withColumn("full", full).where("size(full) > 0")
    imported = imported.select("fq", "name", F.element_at("full", -1).alias("symbol"), F.array_join(F.slice("full", 1, F.size("full") - 1), ".").alias("owner"))
    homes = modules_named(imported.select(F.col("owner").alias("name")), modules).select(F.col("name").alias("owner"), "found")
    housed = fixpoint.cut(imported.join(homes, "owner"))
    reached = housed.join(named, (F.col("found") == F.col("t_path")) & (F.col("symbol") == F.col("t_simple")))
    built = housed.join(classes, (F.col("found") == F.col("c_path")) & (F.col("symbol") == F.col("cls"))).join(named.where("t_simple = '__init__'"), (F.col("found") == F.col("t_path")) & (F.col("t_scope") == F.col("cls")))
    rules += [out(reached, 4, "import"), out(built, 5, "import"), out(imported, 6, "import", None)]

    local = sites.join(named, (F.col("t_path") == F.col("relpath")) & (F.col("t_simple") == F.col("last")))
    rules += [out(local.where("not through"), 7, "same-module"), out(local.where("through and target <> fq and t_name like '%.%'"), 7, "global")]
    made = sites.join(classes, (F.col("relpath") == F.col("c_path")) & (F.col("last") == F.col("cls")))
    ctor = made.join(named.where("t_simple = '__init__'"), (F.col("t_path") == F.col("relpath")) & (F.col("t_scope") == F.col("cls")))
    rules += [out(ctor, 8, "ctor"), out(made, 9, "ctor", None), out(sites.where(F.col("last").isin(BUILTINS) & (F.col("n") == 1)), 10, "builtin", None)]

    counts = named.groupBy(F.col("t_simple").alias("last")).agg(F.count("*").alias("hits"))
    wide = sites.join(counts, "last").withColumn("capped", (F.col("hits") > SMEAR) | ((F.col("n") > 1) & F.col("last").isin(BUILTIN_METHODS) & (F.col("hits") > 3)))
    rules += [out(wide.where("capped"), 11, "smear-capped", None)]
    rules += [out(wide.where("not capped").join(named, F.col("last") == F.col("t_simple")).where("not through or (target <> fq and t_name like '%.%')"), 12, "global")]
    rules += [out(sites, 13, "global", None)]
    every = rules[0]
    for r in rules[1:]:
        every = every.unionByName(r)
    site = Window.partitionBy("fq", "name")
    best = every.distinct().withColumn("least", F.min("rank").over(site)).where("rank = least")
    return best.select("fq", "name", "target", "kind", F.count("target").over(site).cast("int").alias("k"))


def evidence(modules: DataFrame, fns: DataFrame) -> DataFrame:
    """(fq, op_id, seq, func, target, kind, k, via_arg): call sites, and bare names given as arguments that are no locals.

    ``seq`` orders what a function does: block, operation, call, argument (-1 is the call itself)."""
    each = fns.select("fq", "locals", F.explode("ops").alias("o")).select("fq", "locals", "o.op_id", "o.block_id", F.posexplode("o.calls").alias("ord", "c"))
    seq = lambda last: F.struct("block_id", "op_id", "ord", last.alias("arg"))
    direct = each.select("fq", "op_id", seq(F.lit(-1)).alias("seq"), F.col("c.func").alias("func"), F.lit(False).alias("via_arg"))
    given = each.select("fq", "locals", "op_id", "block_id", "ord", F.posexplode("c.args").alias("at", "name")).where("name is not null and name not like '%.%' and not array_contains(locals, name)")
    every = direct.where("func <> ''").unionByName(given.select("fq", "op_id", seq(F.col("at")).alias("seq"), F.col("name").alias("func"), F.lit(True).alias("via_arg")))
    every = fixpoint.cut(every)
    found = resolve_names(modules, fns, every.select("fq", F.col("func").alias("name")))
    return every.join(found.withColumnRenamed("name", "func"), ["fq", "func"]).where("not via_arg or (target is not null and k <= 2)")


def resolve_calls(modules: DataFrame, fns: DataFrame) -> DataFrame:
    """(fq, op_id, ord, func, target, kind, k): call sites with their targets; target is null where none is known."""
    return evidence(modules, fns).where("not via_arg").select("fq", "op_id", F.col("seq.ord").alias("ord"), "func", "target", "kind", "k")


def call_graph(sites: DataFrame) -> DataFrame:
    """caller, callee, k, via_arg, soft from (caller, callee, k, via_arg, soft) sites: fewest candidates, whether some
    site passes the callee as an argument, and whether the last site (by ``seq``, else all) rests on its name alone."""
    soft = F.max_by(F.col("soft").cast("int"), "seq") if "seq" in sites.columns else F.min(F.col("soft").cast("int"))
    return sites.groupBy("caller", "callee").agg(F.min("k").cast("int").alias("k"), F.max(F.col("via_arg").cast("int")).alias("via_arg"), soft.alias("soft"))


def sites_of(resolved: DataFrame) -> DataFrame:
    via = F.col("via_arg") if "via_arg" in resolved.columns else F.lit(False)
    seq = ["seq"] if "seq" in resolved.columns else []
    return resolved.where("target is not null").select(F.col("fq").alias("caller"), F.col("target").alias("callee"), "k", via.alias("via_arg"), (F.col("kind") == "global").alias("soft"), *seq)


def unresolved(resolved: DataFrame) -> DataFrame:
    """fq, n: call sites that nothing in the program answers."""
    return resolved.where("target is null").groupBy("fq").agg(F.count("*").alias("n"))


def fans(edges: DataFrame) -> DataFrame:
    """fq, fan_in, fan_out of every function on an edge."""
    ways = edges.select(F.col("callee").alias("fq"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("caller").alias("fq"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ways.groupBy("fq").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def entrypoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("caller").alias("fq")).distinct().join(edges.select(F.col("callee").alias("fq")), "fq", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("callee").alias("fq")).distinct().join(edges.select(F.col("caller").alias("fq")), "fq", "left_anti")


def hubs(edges: DataFrame, top: int = 10) -> DataFrame:
    return fans(edges).orderBy(F.col("fan_in").desc(), F.col("fan_out").desc(), "fq").limit(top)


def as_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


def cycles(edges: DataFrame) -> DataFrame:
    """fq, scc of functions on cycles of two or more."""
    return fixpoint.components(as_edges(edges)).select(F.col("node").alias("fq"), "scc")


SHARP = "soft = 0 and k = 1"


def sharp_cycles(edges: DataFrame) -> DataFrame:
    """fq, scc, smeared: cycles of two or more with whether they need an ambiguous or name-only edge to close, and
    functions that certainly call themselves."""
    found = fixpoint.cut(cycles(edges))
    ends = lambda c: found.select(F.col("fq").alias(c), F.col("scc").alias(f"{c}_scc"))
    inside = edges.where(SHARP).join(ends("caller"), "caller").join(ends("callee"), "callee").where("caller_scc = callee_scc")
    sure = fixpoint.components(as_edges(inside)).select(F.col("node").alias("fq"), F.col("scc").alias("sure"))
    members = found.join(sure, "fq", "left").groupBy("scc").agg((F.count_distinct("sure") != 1).alias("parts"), F.max(F.col("sure").isNull()).alias("left_out"))
    rings = found.join(members.select("scc", (F.col("parts") | F.col("left_out")).alias("smeared")), "scc").select("fq", "scc", "smeared")
    own = edges.where(f"caller = callee and {SHARP}").select(F.col("caller").alias("fq")).join(found, "fq", "left_anti")
    return rings.unionByName(own.select("fq", F.col("fq").alias("scc"), F.lit(False).alias("smeared")))


def reachable_from(edges: DataFrame, roots: DataFrame, most: int = 6) -> DataFrame:
    """root, fq, depth: what each root (fq) calls, directly or not, within ``most`` calls."""
    found = fixpoint.distances(as_edges(edges), roots.select(F.col("fq").alias("node")), most)
    return found.select("root", F.col("node").alias("fq"), "depth")


def layers(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """fq and its least distance from any of ``roots`` (fq)."""
    found = fixpoint.distances(as_edges(edges), roots.select(F.col("fq").alias("node")))
    return found.groupBy(F.col("node").alias("fq")).agg(F.min("depth").alias("depth"))


def impact(edges: DataFrame, focus: DataFrame, up: int = 4, down: int = 2) -> DataFrame:
    """focus, direction, fq, depth: callers of each focus function to ``up`` steps, callees to ``down``."""
    flipped = edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    roots = focus.select(F.col("fq").alias("node"))
    one = fixpoint.distances(flipped, roots, up).withColumn("direction", F.lit("up"))
    two = fixpoint.distances(as_edges(edges), roots, down).withColumn("direction", F.lit("down"))
    return one.unionByName(two).where("depth > 0").select(F.col("root").alias("focus"), "direction", F.col("node").alias("fq"), "depth")


def impact_report(edges: DataFrame, focus: DataFrame, accesses: DataFrame, up: int = 4) -> DataFrame:
    """focus, what, fq, depth, note: callers and callees of each focus function, whether a caller is one that nobody calls,
    how many edges each step meets and how many of them are ambiguous, and functions that share its state."""
    reached = fixpoint.cut(impact(edges, focus, up, min(up, 2)))
    entry = entrypoints(edges).withColumn("entry", F.lit("entry"))
    rows = reached.join(entry, "fq", "left").select("focus", F.col("direction").alias("what"), "fq", "depth", F.coalesce("entry", F.lit("")).alias("note"))
    ways = edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "k")
    from_up = reached.where("direction = 'up'").unionByName(focus.select(F.col("fq").alias("focus"), F.lit("up").alias("direction"), "fq", F.lit(0).alias("depth")))
    scanned = from_up.where(F.col("depth") < up).join(ways.select(F.col("dst").alias("fq"), "k"), "fq").groupBy("focus").agg(F.count("*").alias("n"), F.count_if(F.col("k") > 1).alias("loose"))
    counts = scanned.select("focus", F.lit("edges").alias("what"), F.lit(None).cast("string").alias("fq"), F.lit(None).cast("int").alias("depth"), F.concat_ws(" ", "n", F.lit("of them"), "loose", F.lit("ambiguous")).alias("note"))
    own = focus.select(F.col("fq").alias("focus"), "fq").join(accesses, "fq").select("focus", "cell", F.col("mode").alias("own"))
    others = own.join(accesses.select("cell", "fq", "mode"), "cell").where("fq <> focus and own <> mode")
    shared = others.select("focus", F.when(F.col("own") == "w", "reads what it writes").otherwise("writes what it reads").alias("what"), "fq", F.lit(None).cast("int").alias("depth"), F.col("cell").alias("note")).distinct()
    return rows.unionByName(counts).unionByName(shared)


def call_paths(edges: DataFrame, goal: DataFrame, most_edges: int = 8, most: int = 10) -> DataFrame:
    """goal, path: acyclic chains of callers that end at functions nobody calls; the shortest ``most`` of each goal."""
    flipped = edges.select(F.col("callee").alias("at"), F.col("caller").alias("by"))
    front, done = goal.select(F.col("fq").alias("goal"), F.array("fq").alias("path")), None
    called = flipped.select(F.col("at").alias("head")).distinct()
    for _ in range(most_edges + 1):
        front = front.withColumn("head", F.element_at("path", 1))
        ended = front.join(called, "head", "left_anti").select("goal", "path")
        done = ended if done is None else done.unionByName(ended)
        step = front.join(flipped, F.col("head") == F.col("at")).where("not array_contains(path, by)")
        front = fixpoint.cut(step.select("goal", F.concat(F.array("by"), "path").alias("path")))
        if front.isEmpty():
            break
    best = F.row_number().over(Window.partitionBy("goal").orderBy(F.size("path"), F.array_join("path", ">")))
    return done.withColumn("r", best).where(F.col("r") <= most).drop("r")


# state ----------------------------------------------------------------------------------------------------------------


def state_accesses(modules: DataFrame, fns: DataFrame) -> DataFrame:
    """(cell, kind, fq, mode): attributes of self, and globals, that functions write or read."""
    every = fns.select("fq", "relpath", "qualname", "globals", F.explode("ops").alias("o"))
    side = lambda names, mode: F.transform(names, lambda t: F.struct(t.alias("name"), F.lit(mode).alias("mode")))
    touched = every.select("fq", "relpath", "qualname", "globals", F.explode(F.concat(side("o.targets", "w"), side("o.uses", "r"))).alias("x")).select("fq", "relpath", "qualname", "globals", "x.name", "x.mode").distinct()
    classes = modules.select(F.col("relpath").alias("c_path"), F.explode("classes").alias("c")).select("c_path", F.col("c.name").alias("cls"), "c.methods")
    attrs = touched.withColumn("attr", F.regexp_extract("name", r"^self\.([^.\[]+)", 1)).where("attr <> ''")
    attrs = attrs.join(classes, (F.col("relpath") == F.col("c_path")) & (_scope(F.col("qualname")) == F.col("cls"))).where("not array_contains(methods, attr)")
    cells = attrs.select(F.concat(F.col("relpath"), F.lit(":"), F.col("cls"), F.lit("."), F.col("attr")).alias("cell"), F.lit("attr").alias("kind"), "fq", "mode")
    declared = modules.select(F.col("relpath").alias("g_path"), F.explode("globals").alias("g")).distinct()
    shared = touched.join(declared, (F.col("relpath") == F.col("g_path")) & (F.col("name") == F.col("g")))
    shared = shared.where((F.col("mode") == "r") | F.array_contains("globals", F.col("name")))
    return cells.unionByName(shared.select(F.concat(F.col("relpath"), F.lit(":GLOBAL:"), F.col("name")).alias("cell"), F.lit("global").alias("kind"), "fq", "mode")).distinct()


def state_cells(accesses: DataFrame) -> DataFrame:
    """cell, writers, readers and flags from (cell, fq, mode) with kind, where known ('global' has a flag of its own)."""
    kind = F.min("kind") if "kind" in accesses.columns else F.lit("attr")
    cells = accesses.groupBy("cell").agg(kind.alias("kind"), F.collect_set(F.when(F.col("mode") == "w", F.col("fq"))).alias("w"), F.collect_set(F.when(F.col("mode") == "r", F.col("fq"))).alias("r"))
    flag = lambda c, name: F.when(c, F.lit(name))
    flags = F.array_join(
        F.array(
            flag((F.size("w") >= 2) & (F.size(F.array_except("r", "w")) > 0), "shared-mutable-channel"),
            flag((F.col("kind") == "global") & (F.size("w") > 0) & (F.size("r") >= 2), "global-channel"), flag(F.size("w") >= 3, "many-writers"), flag(F.size("r") >= 6, "widely-read"),
        ), ",",
    )
    return cells.select("cell", F.size("w").alias("writers"), F.size("r").alias("readers"), flags.alias("flags"))


# values across functions ----------------------------------------------------------------------------------------------


def value_flows(modules: DataFrame, fns: DataFrame) -> DataFrame:
    """(fq, var, to_fq, to_var, kind, seq): where a name's value may go in one step: what returns to the callers that keep
    it, arguments to parameters, what is stored in self to the readers of that attribute, and plain assignments."""
    each = fixpoint.cut(fns.select("fq", "qualname", F.explode("ops").alias("o")).select("fq", "qualname", "o.op_id", "o.kind", "o.targets", "o.uses", "o.calls"))
    resolved = fixpoint.cut(resolve_calls(modules, fns).where("target is not null"))
    used = each.select("fq", "qualname", "op_id", "kind", "targets", F.explode("uses").alias("var"))
    flow = lambda df, fq, var, kind, part: df.select("fq", "var", F.col(fq).alias("to_fq"), F.col(var).alias("to_var"), F.lit(kind).alias("kind"), F.struct("op_id", F.lit(part).alias("part"), F.col(fq).alias("f"), F.col(var).alias("v")).alias("seq"))

    keeps = each.where("size(targets) > 0").join(resolved.select("fq", "op_id", "target").distinct(), ["fq", "op_id"])
    keeps = keeps.select(F.col("target").alias("fq"), F.col("fq").alias("caller"), F.element_at("targets", 1).alias("into")).distinct()
    returned = flow(used.where("kind = 'return'").join(keeps, "fq"), "caller", "into", "return", 0)

    sites = each.select("fq", "op_id", F.posexplode("calls").alias("ord", "c")).select("fq", "op_id", "ord", F.posexplode("c.args").alias("at", "var")).where("var is not null")
    first = sites.groupBy("fq", "op_id", "ord", "var").agg(F.min("at").alias("at"))
    is_method = class_methods(modules, fns).select(F.col("fq").alias("target"), F.lit(1).alias("m"))
    params = fns.select(F.col("fq").alias("target"), "params").join(is_method, "target", "left")
    bound = F.when(F.col("m").isNotNull() & F.get("params", F.lit(0)).isin("self", "cls"), F.col("at") + 1).otherwise(F.col("at"))
    passed = first.join(resolved.select("fq", "op_id", "ord", "target"), ["fq", "op_id", "ord"]).join(params, "target").withColumn("param", F.get("params", bound)).where("param is not null")
    passed = flow(passed, "target", "param", "arg", 1)

    stored = used.withColumn("t", F.explode("targets")).where("t <> var").withColumn("attr", F.regexp_extract("t", r"^self\.([^.\[]+)", 1))
    own = class_methods(modules, fns).select("fq", "cls_key")
    escaping = stored.where("attr <> ''").join(own, "fq").withColumns({"name": F.concat(F.lit("self."), "attr"), "cell": F.concat("cls_key", F.lit("."), F.col("attr"))})
    readers = state_accesses(modules, fns).where("mode = 'r' and kind = 'attr'").select("cell", F.col("fq").alias("reader"))
    out = flow(escaping.join(readers, "cell"), "reader", "name", "store", 2).unionByName(flow(escaping, "fq", "name", "store", 3))
    plain = stored.join(own.select("fq"), "fq", "left_semi").where("t not like 'self.%'").unionByName(stored.join(own.select("fq"), "fq", "left_anti"))
    return returned.unionByName(passed).unionByName(out).unionByName(flow(plain, "fq", "t", "assign", 4)).distinct()


def class_methods(modules: DataFrame, fns: DataFrame) -> DataFrame:
    """fq, cls_key: functions whose scope is a class of their module."""
    classes = modules.select(F.col("relpath").alias("c_path"), F.explode("classes.name").alias("cls"))
    met = fns.select("fq", "relpath", _scope(F.col("qualname")).alias("scope")).join(classes, (F.col("relpath") == F.col("c_path")) & (F.col("scope") == F.col("cls")))
    return met.select("fq", F.concat_ws(":", "relpath", "cls").alias("cls_key")).distinct()


def trace(flows: DataFrame, seeds: DataFrame, most: int = 6) -> DataFrame:
    """origin_fq, origin_var, fq, var, depth, kind: what a seed's (fq, var) value may reach in ``most`` steps, each once,
    by the way found first."""
    flows = fixpoint.cut(flows)
    key = ["origin_fq", "origin_var", "fq", "var"]
    front = fixpoint.cut(seeds.select(F.col("fq").alias("origin_fq"), F.col("var").alias("origin_var"), "fq", "var").distinct().withColumns({"depth": F.lit(0), "kind": F.lit("origin")}))
    seen = front
    for depth in range(1, most + 1):
        step = front.select(*key).join(flows, ["fq", "var"])
        step = step.groupBy("origin_fq", "origin_var", F.col("to_fq").alias("fq"), F.col("to_var").alias("var")).agg(F.min(F.struct("fq", "var", "seq", "kind")).alias("x"))
        fresh = step.join(seen.select(*key), key, "left_anti")
        front = fixpoint.cut(fresh.select(*key, F.lit(depth).alias("depth"), F.col("x.kind").alias("kind")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def seeds_named(fns: DataFrame, var: str) -> DataFrame:
    """fq, var of the functions that set a name."""
    return fns.where(F.exists("ops", lambda o: F.array_contains(o["targets"], var))).select("fq", F.lit(var).alias("var"))


# imports and classes --------------------------------------------------------------------------------------------------


def import_graph(modules: DataFrame) -> DataFrame:
    """src, dst (null outside the program), dotted, lazy: each module's imports, found by the longest prefix of their path
    that a module's name equals or alone ends; src and dst are paths of files."""
    uses = modules.select("relpath", F.col("module_name").alias("own"), F.explode("imports").alias("i")).select("relpath", "own", F.col("i.target").alias("written"), "i.lazy").distinct()
    parts = _parts(F.col("own"))
    none = F.array().cast("array<string>")
    package = F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.when(F.col("relpath").endswith("__init__.py") & (F.col("own") != ""), parts).otherwise(none))
    uses = fixpoint.cut(uses.select("relpath", "lazy", "written", absolute(F.col("written"), package).alias("path")))
    cuts = uses.select("path").distinct().where("path <> ''").withColumn("n", F.explode(F.sequence(F.lit(1), F.size(_parts(F.col("path"))))))
    cuts = cuts.withColumn("name", F.array_join(F.slice(_parts(F.col("path")), 1, F.col("n")), "."))
    best = cuts.join(modules_named(cuts, modules), "name").groupBy("path").agg(F.max_by("found", "n").alias("dst"))
    return uses.join(best, "path", "left").select(F.col("relpath").alias("src"), "dst", F.col("written").alias("dotted"), "lazy")


def module_edges(imports: DataFrame) -> DataFrame:
    """src, dst, lazy: dependencies between modules of the program; late ones only where there is none at once."""
    return imports.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("lazy").alias("lazy"))


def external_roots(imports: DataFrame) -> DataFrame:
    """root, n: first names of imports that leave the program, counted once for each module, path and kind."""
    out = imports.where("dst is null and dotted not like '.%'").select("src", "dotted", "lazy").distinct()
    return out.groupBy(F.element_at(_parts(F.col("dotted")), 1).alias("root")).agg(F.count("*").alias("n"))


def deferred_cycles(imports: DataFrame) -> DataFrame:
    """src, dst: late imports that would close a cycle if they ran at once. Only the late imports' ends are searched from."""
    edges = fixpoint.cut(module_edges(imports))
    late = edges.where("lazy").select("src", "dst")
    back = fixpoint.distances(edges.where("not lazy").select("src", "dst"), late.select(F.col("dst").alias("node")).distinct())
    return late.join(back.select(F.col("root").alias("dst"), F.col("node").alias("src")), ["src", "dst"], "left_semi")


def import_layers(edges: DataFrame) -> DataFrame:
    """node, layer over (src, dst): the longest way down; nodes of a cycle count as one."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    scc = fixpoint.components(edges)
    group = fixpoint.cut(nodes.join(scc, "node", "left").select("node", F.coalesce("scc", "node").alias("g")))
    flat = edges.join(group.select(F.col("node").alias("src"), F.col("g").alias("a")), "src").join(group.select(F.col("node").alias("dst"), F.col("g").alias("b")), "dst")
    flat = fixpoint.cut(flat.where("a <> b").select("a", "b").distinct())
    if flat.count() <= fixpoint.SMALL_EDGES:
        kind = flat.schema["a"].dataType.simpleString()
        high = fixpoint.in_one_task(flat.select(F.col("a").alias("src"), F.col("b").alias("dst")), fixpoint.heights, f"g {kind}, layer int")
        return group.join(high, "g", "left").select("node", F.coalesce("layer", F.lit(0)).alias("layer"))
    level = fixpoint.cut(group.select("g").distinct().withColumn("layer", F.lit(0)))
    while True:
        up = flat.join(level.select(F.col("g").alias("b"), "layer"), "b").groupBy(F.col("a").alias("g")).agg((F.max("layer") + 1).alias("up"))
        new = fixpoint.cut(level.join(up, "g", "left").select("g", F.greatest("layer", F.coalesce("up", "layer")).alias("layer"), F.col("layer").alias("old")))
        if new.where("layer > old").isEmpty():
            return group.join(level, "g").select("node", "layer")
        level = new.drop("old")


def class_forest(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (child, parent, inside: whether the parent is in the program) and overrides (child, parent, method)."""
    classes = modules.select("relpath", F.explode("classes").alias("c")).select(F.concat_ws(":", "relpath", "c.name").alias("key"), "relpath", "c.*")
    bases = classes.select("key", "relpath", "methods", F.explode("bases").alias("base"))
    near = classes.select(F.col("relpath").alias("n_path"), F.col("name").alias("n_name"), F.col("key").alias("near"), F.col("methods").alias("m1"))
    alone = classes.groupBy(F.col("name").alias("a_name")).agg(F.count("*").alias("n"), F.first("key").alias("far"), F.first("methods").alias("m2")).where("n = 1")
    met = bases.join(near, (F.col("relpath") == F.col("n_path")) & (F.col("base") == F.col("n_name")), "left").join(alone, F.col("base") == F.col("a_name"), "left")
    parent = F.coalesce("near", "far")
    edges = met.select(F.col("key").alias("child"), F.coalesce(parent, "base").alias("parent"), parent.isNotNull().alias("inside"))
    shared = F.array_except(F.array_intersect("methods", F.coalesce("m1", "m2")), F.array(F.lit("__init__")))
    return edges, met.where(parent.isNotNull()).select(F.col("key").alias("child"), parent.alias("parent"), F.explode(shared).alias("method"))


# exceptions -----------------------------------------------------------------------------------------------------------


def exception_parents(spark) -> DataFrame:
    """(exc, above): each built-in exception and every class it is, itself included; made from the interpreter."""
    kinds = {n: t for n, t in vars(builtins).items() if isinstance(t, type) and issubclass(t, BaseException)}
    return spark.createDataFrame(sorted({(n, a.__name__) for n, t in kinds.items() for a in t.__mro__ if issubclass(a, BaseException)} | {(n, n) for n in kinds}), "exc string, above string")


def escapes(local: DataFrame, sharp: DataFrame, parents: DataFrame) -> DataFrame:
    """(fq, exc, depth, via, line): exceptions that leave functions, over how many calls they came first, through which
    callee and at which line of the function (null where it raises itself).

    ``local``: (fq, exc) raised and not caught at once; ``sharp``: (fq, callee, caught array of types) and maybe line."""
    if "line" not in sharp.columns:
        sharp = sharp.withColumn("line", F.lit(None).cast("int"))
    sharp = fixpoint.cut(sharp.select(F.col("fq").alias("caller"), F.col("callee").alias("fq"), "caught", "line").distinct())
    above = F.broadcast(parents.groupBy("exc").agg(F.collect_set("above").alias("above")))
    kind = local.schema["fq"].dataType
    front = fixpoint.cut(local.select("fq", "exc").distinct().withColumns({"depth": F.lit(0), "via": F.lit(None).cast(kind), "line": F.lit(None).cast("int")}))
    seen, depth = front, 0
    while not front.isEmpty():
        depth += 1
        up = front.select("fq", "exc").join(sharp, "fq").join(above, "exc", "left")
        stopped = F.arrays_overlap("caught", F.coalesce("above", F.array("exc", F.element_at(_parts(F.col("exc")), -1), F.lit("Exception"), F.lit("BaseException"))))
        fresh = up.where(~stopped).groupBy(F.col("caller").alias("fq"), "exc").agg(F.min(F.struct("line", F.col("fq").alias("via"))).alias("x"))
        fresh = fresh.join(seen.select("fq", "exc"), ["fq", "exc"], "left_anti")
        front = fixpoint.cut(fresh.select("fq", "exc", F.lit(depth).alias("depth"), "x.via", "x.line"))
        seen = seen.unionByName(front)
    return seen


def witnesses(escaped: DataFrame, most: int = 6) -> DataFrame:
    """(fq, exc, chain): the functions an exception comes through, from the one it leaves to where it is raised, at most
    ``most``."""
    step = fixpoint.cut(escaped.select("fq", "exc", "via"))
    row = step.select("fq", "exc", F.array("fq").alias("chain"), F.col("via").alias("next"))
    link = step.select(F.col("fq").alias("next"), "exc", F.col("via").alias("after"))
    for _ in range(most - 1):
        row = row.join(link, ["next", "exc"], "left").select("fq", "exc", F.when(F.col("next").isNull(), F.col("chain")).otherwise(F.concat("chain", F.array("next"))).alias("chain"), F.col("after").alias("next"))
    return row.select("fq", "exc", "chain")


def functions_at(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """relpath, line, fq: the innermost function (fq, relpath, lo, hi) that holds each line."""
    width = 256
    cut_spans = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    met = lines.withColumn("bin", F.floor(F.col("line") / width)).join(cut_spans, ["relpath", "bin"]).where("line between lo and hi")
    return met.groupBy("relpath", "line").agg(F.min_by("fq", F.struct(F.col("hi") - F.col("lo"), "fq")).alias("fq"))


def suppressed(findings: DataFrame, lines: DataFrame, marker: str = "flow") -> DataFrame:
    """``findings`` (relpath, line, pass_name) with a flag: the line has a pragma ``marker: ok`` for all or these passes."""
    rule = marker + r":\s*ok(?:\(([^)]*)\))?"
    named = F.transform(F.split(F.regexp_extract("text", rule, 1), ","), lambda x: F.trim(x))
    met = findings.join(lines.where(F.col("text").rlike(rule)), ["relpath", "line"], "left")
    quiet = F.col("text").isNotNull() & ((F.regexp_extract("text", rule, 1) == "") | F.array_contains(named, F.col("pass_name")))
    return met.withColumn("suppressed", F.coalesce(quiet, F.lit(False))).drop("text")


def percentiles(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the share of rows with a strictly smaller ``value``, in whole hundredths.

    Ranks come from the counts of distinct values, so the one ordered pass is over those alone."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = rows.agg(F.count("*").alias("total"))
    ranked = counts.withColumn("below", below).join(F.broadcast(total)).select(value, F.bround(100 * F.col("below") / F.col("total"), 0).cast("int").alias(name))
    return rows.join(ranked, value)
