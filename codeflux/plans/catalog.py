"""Registered queries: the engine's operators over the benchmark tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeflux.functions import fixpoint
from codeflux.operators import analysis, program
from codeflux.plans import adapters as A
from codeflux.plans import flows
from codeflux.sources import facts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


E, D, P = f"with recursive {A.EVENTS_SQL}", A.DOM_SQL, A.PDOM_SQL
DP = f"{E}, {D}, {P}"


# graph relations over event functions ---------------------------------------------------------------------------------


def _relation(name: str, rel: str, sql: str, a: str, b: str | None = None, text: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = [F.col("a").alias(a)] + ([F.col("b").alias(b)] if b else []) + ([F.col("name").alias(text)] if text else [])
        return analysis.relation(A.event_functions(spark, sf_dir), rel).select("fq", *columns)

    query(name, sql)(run)


_relation("dominators", "dom", f"{E}, {D} select fq, b as block, d as dominator from dom", "block", "dominator")
_relation("post_dominators", "pdom", f"{E}, {P} select fq, b as block, d as dominator from pdom", "block", "dominator")
_relation("immediate_post_dominators", "ipdom", f"{E}, {P} select fq, b as block, d as nearest from ipdom", "block", "nearest")
_relation(
    "control_dependence", "control",
    f"{E}, {P} select distinct g.fq, y.d as block, g.src as decided_by from edge g join pdom y on y.fq = g.fq and y.b = g.dst "
    "where not exists (select 1 from pdom p where p.fq = g.fq and p.b = g.src and p.d = g.dst) "
    "and (y.d = g.src or not exists (select 1 from pdom p where p.fq = g.fq and p.b = g.src and p.d = y.d))",
    "block", "decided_by",
)
_relation("block_preds", "pred", f"{E} select fq, dst as block, src as pred from edge", "block", "pred")
_relation("reachable_blocks", "reach", f"{E}, r as (select fq, b from entry union select r.fq, g.dst from r join edge g on g.fq = r.fq and g.src = r.b) select fq, b as block from r", "block")
_relation("loop_headers", "back", f"{E}, {D} select g.fq, g.src as tail, g.dst as header from edge g join dom on dom.fq = g.fq and dom.b = g.src and dom.d = g.dst", "tail", "header")
_relation("spine", "spine", f"{E}, {P} select p.fq, p.d as block from pdom p join entry e on e.fq = p.fq and e.b = p.b where p.d <> p.b", "block")
_relation(
    "reaching_defs_cfg", "use_def",
    f"""{E}, last as (select fq, b, target, max(op_id) as d from op group by fq, b, target),
rin as (select g.fq, g.dst as b, l.target, l.d from edge g join last l on l.fq = g.fq and l.b = g.src
        union select g.fq, g.dst, r.target, r.d from rin r join edge g on g.fq = r.fq and g.src = r.b
        where not exists (select 1 from last k where k.fq = r.fq and k.b = r.b and k.target = r.target)),
inb as (select u.fq, u.op_id, u.use, max(o.op_id) as d from op u join op o on o.fq = u.fq and o.b = u.b and o.target = u.use and o.op_id < u.op_id group by u.fq, u.op_id, u.use)
select fq, op_id as use_op, d as def_op, use as name from inb
union all select u.fq, u.op_id, r.d, u.use from op u join rin r on r.fq = u.fq and r.b = u.b and r.target = u.use
where not exists (select 1 from inb i where i.fq = u.fq and i.op_id = u.op_id)""",
    "use_op", "def_op", "name",
)
_relation(
    "liveness", "live_in",
    f"""{E}, w as (select distinct fq, b, target from op),
up as (select distinct u.fq, u.b, u.use as name from op u where not exists (select 1 from op o where o.fq = u.fq and o.b = u.b and o.target = u.use and o.op_id < u.op_id)),
live as (select fq, b, name from up union select g.fq, g.src, l.name from live l join edge g on g.fq = l.fq and g.dst = l.b
         where not exists (select 1 from w where w.fq = g.fq and w.b = g.src and w.target = l.name))
select fq, b as block, name from live""",
    "block", None, "name",
)
_relation(
    "definite_assignment", "assigned",
    f"""{E}, w as (select distinct fq, b, target from op), names as (select distinct fq, target as name from op),
un as (select e.fq, e.b, n.name from entry e join names n on n.fq = e.fq
       union select g.fq, g.dst, u.name from un u join edge g on g.fq = u.fq and g.src = u.b
       where not exists (select 1 from w where w.fq = u.fq and w.b = u.b and w.target = u.name))
select k.fq, k.b as block, n.name from block k join names n on n.fq = k.fq where not exists (select 1 from un where un.fq = k.fq and un.b = k.b and un.name = n.name)""",
    "block", None, "name",
)


@query(
    "simple_paths",
    f"""{E}, walk as (select fq, b, [b] as path from entry
union all select w.fq, g.dst, list_append(w.path, g.dst) from walk w join edge g on g.fq = w.fq and g.src = w.b join final f on f.fq = w.fq
where w.b <> f.b and not list_contains(w.path, g.dst) and len(w.path) <= 8)
select w.fq, cast(len(w.path) as integer) as steps, array_to_string(w.path, '>') as path from walk w join final f on f.fq = w.fq and f.b = w.b
where len(w.path) > 1 or w.fq in (select e.fq from entry e join final f2 on f2.fq = e.fq and f2.b = e.b)""",
)
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.relation(A.event_functions(spark, sf_dir), "path")
    return found.select("fq", F.col("b").alias("steps"), F.col("name").alias("path"))


@query(
    "metrics",
    f"""{E} select k.fq, cast(count(*) as integer) as blocks, cast(max(n) as integer) as control_edges, cast(1 + sum(greatest(0, coalesce(o.n_out, 0) - 1)) as integer) as cyclomatic
from block k left join (select fq, src, count(*) as n_out from edge group by fq, src) o on o.fq = k.fq and o.src = k.b
join (select fq, count(*) as n from edge group by fq) t on t.fq = k.fq group by k.fq""",
)
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.metrics(A.event_functions(spark, sf_dir), ("blocks", "control_edges", "cyclomatic"))


@query("cfg_edges", f"{E} select fq, src, dst from edge")
def cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.cfg_edges(A.event_functions(spark, sf_dir)).select("fq", "src", "dst")


@query("exit_blocks", f"{E} select fq, b as block from final")
def exit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.event_functions(spark, sf_dir).select("fq", F.explode("exits").alias("block"))


@query(
    "path_dependent_uses",
    ORACLES["reaching_defs_cfg"].replace("select fq, op_id as use_op, d as def_op, use as name from inb", "select fq, use_op, name, cast(count(*) as integer) as n from (select fq, op_id as use_op, d as def_op, use as name from inb")
    + ") group by fq, use_op, name having count(*) > 1",
)
def path_dependent_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.relation(A.event_functions(spark, sf_dir), "ambiguous").select("fq", F.col("a").alias("use_op"), "name", F.col("b").alias("n"))


# data flow over order functions ---------------------------------------------------------------------------------------

O = f"with {A.ORDERS_SQL}"


@query("reaching_defs", f"{O} select fq, a as use_op, cast(b as integer) as def_op, name from ud")
def reaching_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.relation(A.order_functions(spark, sf_dir), "use_def").select("fq", F.col("a").alias("use_op"), F.col("b").alias("def_op"), "name")


@query("never_read_defs", f"{O} select fq, op_id as def_op, target as name from op o where not exists (select 1 from ud where ud.fq = o.fq and ud.b = o.op_id)")
def never_read_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.relation(A.order_functions(spark, sf_dir), "unread").select("fq", F.col("a").alias("def_op"), "name")


@query(
    "depdegree_live_span",
    f"""{O}, s as (select fq, b, max(a) - b as span from ud group by fq, b) select o.fq, cast(coalesce(max(u.n), 0) as integer) as depdegree, cast(coalesce(max(m.span), 0) as integer) as max_live_span
from (select distinct fq from op) o left join (select fq, count(*) as n from ud group by fq) u using (fq) left join (select fq, max(span) as span from s group by fq) m using (fq) group by o.fq""",
)
def depdegree_live_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.metrics(A.order_functions(spark, sf_dir), ("depdegree", "max_live_span"))


@query(
    "metric_percentiles",
    f"""{O}, m as (select o.fq, coalesce(u.n, 0) as depdegree from (select distinct fq from op) o left join (select fq, count(*) as n from ud group by fq) u using (fq))
select fq, cast(depdegree as integer) as depdegree, cast(round_even(100.0 * (select count(*) from m y where y.depdegree < m.depdegree) / (select count(*) from m), 0) as integer) as percentile from m""",
)
def metric_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixpoint.cut(analysis.metrics(A.order_functions(spark, sf_dir), ("depdegree",)))  # counted, totalled and joined
    return program.percentiles(rows, "depdegree", "percentile").select("fq", "depdegree", "percentile")


def _findings(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return analysis.findings(A.order_functions(spark, sf_dir), (name,)).select("fq", "op_id", "kind")


@query("dead_stores", f"""{O} select fq, op_id, 'dead_store' as kind from op o where not exists (select 1 from ud where ud.fq = o.fq and ud.b = o.op_id)""")
def dead_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, "dead-store")


@query(
    "use_before_def",
    f"""{O} select fq, op_id, 'unbound' as kind from op u where exists (select 1 from op d where d.fq = u.fq and d.target = u.use)
and not exists (select 1 from op d where d.fq = u.fq and d.target = u.use and d.op_id < u.op_id)""",
)
def use_before_def(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, "use-before-def")


@query(
    "findings_by_pass",
    f"""{O} select 'dead-store' as pass_name, count(*) as n from op o where not exists (select 1 from ud where ud.fq = o.fq and ud.b = o.op_id)
union all select 'use-before-def', count(*) from op u where exists (select 1 from op d where d.fq = u.fq and d.target = u.use)
and not exists (select 1 from op d where d.fq = u.fq and d.target = u.use and d.op_id < u.op_id)""",
)
def findings_by_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.findings(A.order_functions(spark, sf_dir), ("dead-store", "use-before-def")).groupBy("pass_name").agg(F.count("*").alias("n"))


@query(
    "op_slices",
    f"with recursive {A.ORDERS_SQL}, r as (select fq, a as op_id, b as needs from ud union select r.fq, r.op_id, ud.b from r join ud on ud.fq = r.fq and ud.a = r.needs) select fq, op_id, count(*) as size from r group by fq, op_id",
)
def op_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many earlier operations each needs, directly or not."""
    return analysis.relation(A.order_functions(spark, sf_dir), "op_slice").select("fq", F.col("a").alias("op_id"), F.col("b").cast("long").alias("size"))


@query("def_use_summary", f"{O} select fq, b as def_op, cast(count(*) as integer) as reads from ud group by fq, b")
def def_use_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.relation(A.order_functions(spark, sf_dir), "fan_out").select("fq", F.col("a").alias("def_op"), F.col("b").alias("reads"))


# call graph -----------------------------------------------------------------------------------------------------------

C, CR = f"with {A.CALLS_SQL}", f"with recursive {A.CALLS_SQL}"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.call_graph(A.supply_calls(spark, sf_dir))


@query("call_edges", f"{C} select * from call")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir)


@query(
    "hubs",
    f"""{C}, w as (select callee as fq, 1 as i, 0 as o from call union all select caller, 0, 1 from call)
select fq, cast(sum(i) as bigint) as fan_in, cast(sum(o) as bigint) as fan_out from w group by fq order by fan_in desc, fan_out desc, fq limit 10""",
)
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.hubs(_calls(spark, sf_dir))


@query("entrypoints", f"{C} select distinct caller as fq from call where caller not in (select callee from call)")
def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.entrypoints(_calls(spark, sf_dir))


@query("leaves", f"{C} select distinct callee as fq from call where callee not in (select caller from call)")
def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.leaves(_calls(spark, sf_dir))


TC = "tc as (select caller as a, callee as b from call union select tc.a, call.callee from tc join call on call.caller = tc.b)"


@query("call_cycles", f"{CR}, {TC} select x.a as fq, min(x.b) as scc from tc x join tc y on x.a = y.b and x.b = y.a group by x.a having count(distinct x.b) > 1")
def call_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.cycles(_calls(spark, sf_dir))


@query("call_closure", f"{CR}, {TC} select a as src, b as dst from tc")
def call_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixpoint.closure_by_components(program.as_edges(_calls(spark, sf_dir)))


@query(
    "call_layers",
    f"""{CR}, root as (select distinct caller as fq from call where caller not in (select callee from call)),
l as (select fq, 0 as depth from root union select call.callee, l.depth + 1 from l join call on call.caller = l.fq where l.depth < 60)
select fq, cast(min(depth) as integer) as depth from l group by fq""",
)
def call_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fixpoint.cut(_calls(spark, sf_dir))
    return program.layers(edges, program.entrypoints(edges))


@query(
    "impact_closure",
    f"""{CR}, focus as (select distinct callee as fq from call),
up as (select fq as focus, fq, 0 as depth from focus union select up.focus, call.caller, up.depth + 1 from up join call on call.callee = up.fq where up.depth < 4),
down as (select fq as focus, fq, 0 as depth from focus union select down.focus, call.callee, down.depth + 1 from down join call on call.caller = down.fq where down.depth < 2)
select focus, 'up' as direction, fq, cast(min(depth) as integer) as depth from up group by focus, fq having min(depth) > 0
union all select focus, 'down', fq, cast(min(depth) as integer) from down group by focus, fq having min(depth) > 0""",
)
def impact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fixpoint.cut(_calls(spark, sf_dir))
    return program.impact(edges, edges.select(F.col("callee").alias("fq")).distinct())


EXC = ["KeyError", "ValueError", "OSError"]


@query(
    "exception_escape",
    f"""{CR}, loc as (select distinct caller as fq, case caller % 3 when 0 then 'KeyError' when 1 then 'ValueError' else 'OSError' end as exc from call where caller % 4 = 0),
stop as (select caller, callee, case k % 3 when 0 then 'LookupError' when 1 then 'ValueError' else 'none' end as caught from call where soft = 0),
esc as (select fq, exc from loc union select s.caller, e.exc from esc e join stop s on s.callee = e.fq
        where not (s.caught = e.exc or (s.caught = 'LookupError' and e.exc = 'KeyError')))
select fq, exc from esc""",
)
def exception_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fixpoint.cut(_calls(spark, sf_dir))
    kind = lambda c, names: F.element_at(F.array(*[F.lit(n) for n in names]), (c % 3 + 1).cast("int"))
    local = edges.where("caller % 4 = 0").select(F.col("caller").alias("fq"), kind(F.col("caller"), EXC).alias("exc"))
    sharp = edges.where("soft = 0").select(F.col("caller").alias("fq"), "callee", F.array(kind(F.col("k"), ["LookupError", "ValueError", "none"])).alias("caught"))
    return program.escapes(local, sharp, program.exception_parents(spark)).select("fq", "exc")


# state, spans, deltas, imports, classes -------------------------------------------------------------------------------


@query(
    "state_cells",
    """with a as (select distinct l_partkey % 200 as cell, l_suppkey % 20 as fq, case when l_returnflag = 'R' then 'w' else 'r' end as mode from lineitem),
c as (select cell, count(*) filter (mode = 'w') as w, count(*) filter (mode = 'r') as r,
      count(*) filter (mode = 'r' and not exists (select 1 from a y where y.cell = a.cell and y.fq = a.fq and y.mode = 'w')) as outside from a group by cell)
select cell, cast(w as integer) as writers, cast(r as integer) as readers,
       concat_ws(',', case when w >= 2 and outside > 0 then 'shared-mutable-channel' end, case when w >= 3 then 'many-writers' end, case when r >= 6 then 'widely-read' end) as flags from c""",
)
def state_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.state_cells(A.state_access(spark, sf_dir))


@query(
    "function_at_line",
    """with span as (select o_custkey % 50 as f, o_orderkey as fq, o_orderkey % 900 as lo, o_orderkey % 900 + o_custkey % 90 as hi from orders),
line as (select distinct c_custkey % 50 as f, c_custkey as line from customer)
select cast(f as varchar) as relpath, line, fq from (select l.f, l.line, s.fq, row_number() over (partition by l.f, l.line order by s.hi - s.lo, s.fq) as r
from line l join span s on s.f = l.f and l.line between s.lo and s.hi) where r = 1""",
)
def function_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = A.table(spark, sf_dir, "orders").selectExpr("cast(o_custkey % 50 as string) as relpath", "o_orderkey as fq", "o_orderkey % 900 as lo", "o_orderkey % 900 + o_custkey % 90 as hi")
    lines = A.table(spark, sf_dir, "customer").selectExpr("cast(c_custkey % 50 as string) as relpath", "c_custkey as line").distinct()
    return program.functions_at(spans, lines)


@query(
    "import_layers",
    f"""{CR}, dag as (select distinct caller as s, callee as d from call where caller < callee), l as (select node, 0 as layer from (select s as node from dag union select d from dag)
union select dag.s, l.layer + 1 from l join dag on dag.d = l.node) select node, cast(max(layer) as integer) as layer from l group by node""",
)
def import_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _calls(spark, sf_dir).where("caller < callee").select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()
    return program.import_layers(fixpoint.cut(edges))


@query("sharp_cycles", f"""{CR.replace("with recursive", "with recursive")}, sharp as (select caller, callee from call where soft = 0 and k = 1), {TC},
st as (select caller as a, callee as b from sharp union select st.a, s.callee from st join sharp s on s.caller = st.b),
comp as (select x.a as fq, min(x.b) as scc, count(distinct x.b) as n from tc x join tc y on x.a = y.b and x.b = y.a group by x.a having count(distinct x.b) > 1),
inner_ as (select x.a as fq, count(distinct x.b) as n from st x join st y on x.a = y.b and x.b = y.a join comp p on p.fq = x.a join comp q on q.fq = x.b and q.scc = p.scc group by x.a)
select c.fq, c.scc, not bool_and(coalesce(i.n, 0) = c.n) over (partition by c.scc) as smeared from comp c left join inner_ i using (fq)
union all select s.caller, s.caller, false from sharp s where s.caller = s.callee and s.caller not in (select fq from comp)""")
def sharp_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.sharp_cycles(fixpoint.cut(_calls(spark, sf_dir)))


@query(
    "reachable_from",
    f"""{CR}, r as (select distinct caller as root, caller as fq, 0 as depth from call union select r.root, call.callee, r.depth + 1 from r join call on call.caller = r.fq where r.depth < 2)
select root, fq, cast(min(depth) as integer) as depth from r group by root, fq""",
)
def reachable_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fixpoint.cut(_calls(spark, sf_dir))
    return program.reachable_from(edges, edges.select(F.col("caller").alias("fq")).distinct(), 2)


@query(
    "class_forest",
    """select n_name || '.py:' || n_name as child, 'r_' || r_name || '.py:' || r_name as parent, true as inside from nation join region on n_regionkey = r_regionkey
union all select 'r_' || r_name || '.py:' || r_name, 'object', false from region""",
)
def class_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each nation and each region, with a class that comes of the region's, or of object."""
    struct = "array<struct<name:string,bases:array<string>,methods:array<string>>>"
    cls = lambda name, base: F.array(F.struct(F.col(name).alias("name"), F.array(base).alias("bases"), F.array(F.lit("run")).alias("methods"))).cast(struct).alias("classes")
    nation, region = A.table(spark, sf_dir, "nation"), A.table(spark, sf_dir, "region")
    child = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_name", F.lit(".py")).alias("relpath"), cls("n_name", F.col("r_name")))
    root = region.select(F.concat(F.lit("r_"), "r_name", F.lit(".py")).alias("relpath"), cls("r_name", F.lit("object")))
    return program.class_forest(child.unionByName(root))[0]


# source made of line items --------------------------------------------------------------------------------------------

SRC = """line as (select l_orderkey, 'c' || o_custkey || '.py:f' || l_orderkey as fq, l_returnflag as flag, l_suppkey, l_shipdate from lineitem join orders on l_orderkey = o_orderkey)"""


@query(
    "lowered_metrics",
    f"""with {SRC}, m as (select fq, count(*) filter (flag = 'R') as r, count(*) filter (flag = 'A') as a from line group by fq)
select fq, cast(1 + 2 * r as integer) as blocks, cast(3 * r as integer) as control_edges, cast(r as integer) as branches, cast(1 + r as integer) as cyclomatic,
       cast(r as integer) as cognitive, cast(case when r > 0 then 1 else 0 end as integer) as max_nesting, cast(7 + r + a as integer) as defs from m
union all select distinct split_part(fq, ':', 1) || ':g' || i, 1, 0, 0, 1, 0, 0, 1 from m, range(9) h(i)""",
)
def lowered_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    fns = facts.Program(A.order_source(spark, sf_dir))
    return analysis.metrics(fns, ("blocks", "control_edges", "branches", "cyclomatic", "cognitive", "max_nesting", "defs"))


@query(
    "lowered_call_graph",
    f"with {SRC} select distinct fq as caller, split_part(fq, ':', 1) || ':g' || (l_suppkey % 9) as callee from line where flag not in ('R', 'A')",
)
def lowered_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = facts.Program(fixpoint.cut(A.order_source(spark, sf_dir)))
    fns = source.table("locals", "ops", where=("relpath", "qualname", "simple"), of_ops=("op_id", "block_id", "calls"))
    found = program.evidence(fixpoint.cut(source.modules(*flows.MODULES)), fixpoint.cut(fns))
    return program.call_graph(program.sites_of(found)).select("caller", "callee")


@query("lowered_findings")
def lowered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    fns = facts.Program(A.order_source(spark, sf_dir))
    return analysis.findings(fns).select("fq", "pass_name", "kind", "line", "soundness", "modality", "title")


#: The old program of ``structural_deltas`` is made of the line items shipped before this day, the new one of all.
OLD_UNTIL = "1997-01-01"
_SIDE = ", ".join(f"{sql} as {{p}}_{name}" for name, sql in (("blocks", "1 + 2 * r"), ("branches", "r"), ("exits", "1"), ("cyclomatic", "1 + r"), ("max_nesting", "least(r, 1)")))


@query("structural_deltas")
def structural_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose metrics differ between two states of the program, with ``analysis.structural_deltas``."""
    sides = [facts.Program(A.order_source(spark, sf_dir, of)) for of in (f"l_shipdate < date '{OLD_UNTIL}'", None)]
    return analysis.structural_deltas(*sides)


@query(
    "structure_changes",
    f"""with {SRC}, new as (select fq, count(*) filter (flag = 'R') as r from line group by fq), old as (select fq, count(*) filter (flag = 'R') as r from line where l_shipdate < date '{OLD_UNTIL}' group by fq),
a as (select fq, {_SIDE.format(p="old")} from old), b as (select fq, {_SIDE.format(p="new")} from new)
select fq, {", ".join(f"cast({p}_{k} as integer) as {p}_{k}" for k in ("blocks", "branches", "exits", "cyclomatic", "max_nesting") for p in ("old", "new"))} from a full join b using (fq)
where old_blocks is distinct from new_blocks
union all select distinct split_part(fq, ':', 1) || ':g' || i, null, 1, null, 0, null, 1, null, 1, null, 0 from new, range(9) h(i) where split_part(fq, ':', 1) not in (select split_part(fq, ':', 1) from old)""",
)
def structure_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``structural_deltas`` whose blocks differ, with the metrics that a closed formula gives."""
    keys = ("blocks", "branches", "exits", "cyclomatic", "max_nesting")
    found = structural_deltas(spark, sf_dir).where("not old_blocks <=> new_blocks")
    return found.select("fq", *[f"{p}_{k}" for k in keys for p in ("old", "new")])


QUERIES |= flows.QUERIES
ORACLES |= flows.ORACLES
