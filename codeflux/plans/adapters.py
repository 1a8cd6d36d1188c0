"""Benchmark tables read as program facts, so that the real operators run on them.

Each adapter has a DataFrame form and the SQL common table expressions that say the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def lowering_tasks(spark: SparkSession) -> int:
    """How many tasks share the lowering of source text: its bytes are few beside the time it takes."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What data flow reads of operations.
FLOW_FIELDS = ("op_id", "block_id", "kind", "sub", "targets", "uses", "line", "calls")


def _op(op_id: Column, block_id: Column, target: Column, use: Column, only: tuple[str, ...] | None = None) -> Column:
    text = lambda v=None: F.lit(v).cast("string")
    fields = (
        op_id.cast("int"), block_id.cast("int"), text("assign"), text(""),
        F.array(target), F.array(use), (op_id + 1).cast("int"),
        F.array().cast("array<struct<func:string,args:array<string>>>"), text(), text(), text(),
        F.array().cast("array<struct<root:string,path:string>>"), F.lit(False), (op_id + 1).cast("int"),
    )
    names = ("op_id", "block_id", "kind", "sub", "targets", "uses", "line", "calls", "cond", "const", "exc", "stores", "synthetic", "end")
    return F.struct(*[c.alias(n) for n, c in zip(names, fields) if only is None or n in only])


def _function(rows: DataFrame, entry: Column, exits: Column, blocks: Column, edges: Column, ops: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    names = {c: none for c in ("params", "globals", "nonlocals", "own_nonlocals")}
    rows = rows.withColumns({"entry": entry, "exits": exits, "blocks": blocks, "edges": edges, "ops": ops} | names)
    return rows.withColumn("locals", F.array_distinct(F.flatten(F.transform("ops", lambda o: o["targets"]))))


def event_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function per user: blocks are event types, edges consecutive events, an operation per event."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")).cast("int") - 1
    events = table(spark, sf_dir, "events").withColumn("p", order)
    one = F.struct("p", kind.alias("b"), "event_id")
    rows = events.groupBy(F.col("user_id").cast("string").alias("fq")).agg(F.array_sort(F.collect_list(one)).alias("s"))
    ids = F.array_distinct(F.transform("s", lambda x: x["b"]))
    no, zero = F.lit(False), F.lit(0)
    blocks = F.transform(ids, lambda b, i: F.struct(b.alias("block_id"), i.alias("pos"), no.alias("is_handler"), no.alias("is_finally"), zero.alias("line_lo"), zero.alias("line_hi")))
    steps = F.when(F.size("s") > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.element_at("s", i)["b"].alias("src"), F.element_at("s", i + 1)["b"].alias("dst"))))).otherwise(
        F.array().cast("array<struct<src:int,dst:int>>")
    )
    edges = F.transform(steps, lambda e, i: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), F.lit("n").alias("kind"), i.alias("ord")))
    name = lambda n: F.concat(F.lit("v"), (n % 5).cast("string"))
    ops = F.transform("s", lambda x, i: _op(i, x["b"], name(x["event_id"]), name(F.floor(x["event_id"] / 5))))
    return _function(rows, F.element_at("s", 1)["b"], F.array(F.element_at("s", -1)["b"]), blocks, edges, ops)


EVENTS_SQL = """
s as (select cast(user_id as varchar) as fq, p, event_id, cast(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 as integer) as b
      from (select *, row_number() over (partition by user_id order by ts, event_id) as p from events)),
block as (select fq, b, min(p) as pos from s group by fq, b),
edge as (select distinct x.fq, x.b as src, y.b as dst from s x join s y on x.fq = y.fq and y.p = x.p + 1),
entry as (select fq, b from s where p = 1),
final as (select fq, arg_max(b, p) as b from s group by fq),
op as (select fq, cast(p - 1 as integer) as op_id, b, 'v' || (event_id % 5) as target, 'v' || ((event_id // 5) % 5) as use from s)
"""

DOM_SQL = """
ndom as (select e.fq, k.b as d, e.b from entry e join block k on k.fq = e.fq and k.b <> e.b
         union select n.fq, n.d, g.dst from ndom n join edge g on g.fq = n.fq and g.src = n.b join entry e on e.fq = n.fq where g.dst <> n.d and g.dst <> e.b),
dom as (select x.fq, x.b, d.b as d from block x join block d using (fq) where not exists (select 1 from ndom n where n.fq = x.fq and n.d = d.b and n.b = x.b))
"""

PDOM_SQL = """
npdom as (select e.fq, k.b as d, e.b from final e join block k on k.fq = e.fq and k.b <> e.b
          union select n.fq, n.d, g.src from npdom n join edge g on g.fq = n.fq and g.dst = n.b join final e on e.fq = n.fq where g.src <> n.d and g.src <> e.b),
pdom as (select x.fq, x.b, d.b as d from block x join block d using (fq) where not exists (select 1 from npdom n where n.fq = x.fq and n.d = d.b and n.b = x.b)),
pcount as (select fq, b, count(*) as n from pdom group by fq, b),
ipdom as (select fq, b, d from (select p.fq, p.b, p.d, row_number() over (partition by p.fq, p.b order by c.n desc, p.d) as r
          from pdom p join pcount c on c.fq = p.fq and c.b = p.d where p.b <> p.d) where r = 1)
"""


def order_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function per order: one block, an operation per line item."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    one = F.struct(*keys)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("fq")).agg(F.array_sort(F.collect_list(one)).alias("s"))
    no, zero = F.lit(False), F.lit(0)
    blocks = F.array(F.struct(zero.alias("block_id"), zero.alias("pos"), no.alias("is_handler"), no.alias("is_finally"), zero.alias("line_lo"), zero.alias("line_hi")))
    name = lambda n: F.concat(F.lit("v"), (n % 7).cast("string"))
    ops = F.transform("s", lambda x, i: _op(i, zero, name(x["l_partkey"]), name(x["l_suppkey"]), FLOW_FIELDS))
    edges = F.array().cast("array<struct<src:int,dst:int,kind:string,ord:int>>")
    return _function(rows, zero, F.array(zero), blocks, edges, ops)


ORDERS_SQL = """
op as (select cast(l_orderkey as varchar) as fq, 'v' || (l_partkey % 7) as target, 'v' || (l_suppkey % 7) as use,
       cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 as integer) as op_id
       from lineitem),
ud as (select u.fq, u.op_id as a, max(d.op_id) as b, u.use as name from op u join op d on d.fq = u.fq and d.target = u.use and d.op_id < u.op_id group by u.fq, u.op_id, u.use)
"""


def supply_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites (caller, callee, k, via_arg, soft, seq): from a line's supplier to the next line's in the same order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("callee", F.lead("l_suppkey").over(order)).where("callee is not null")
    return rows.select(
        F.col("l_suppkey").alias("caller"), "callee", F.col("l_linenumber").alias("k"), (F.col("l_returnflag") == "R").alias("via_arg"), (F.col("l_returnflag") == "N").alias("soft")
    )


CALLS_SQL = """
site as (select * from (select l_suppkey as caller, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as callee,
         l_linenumber as k, l_returnflag = 'R' as via_arg, l_returnflag = 'N' as soft from lineitem) where callee is not null),
call as (select caller, callee, min(k) as k, max(cast(via_arg as integer)) as via_arg, min(cast(soft as integer)) as soft from site group by caller, callee)
"""


def state_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, fq, mode): line items as reads and writes of shared state."""
    rows = table(spark, sf_dir, "lineitem")
    mode = F.when(F.col("l_returnflag") == "R", "w").otherwise("r")
    return rows.select((F.col("l_partkey") % 200).alias("cell"), (F.col("l_suppkey") % 20).alias("fq"), mode.alias("mode"))


def order_source(spark: SparkSession, sf_dir: str, of: str | None = None) -> DataFrame:
    """(relpath, src): a module per customer, a Python function per order, a statement or two per line item (those that ``of`` holds for)."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if of is not None:
        items = items.where(of)
    text = F.when(F.col("l_returnflag") == "R", F.format_string("    if v%d:\n        v%d = 1", F.col("l_partkey") % 7, F.col("l_suppkey") % 7))
    text = text.when(F.col("l_returnflag") == "A", F.format_string("    v%d = v%d + 1", F.col("l_partkey") % 7, F.col("l_suppkey") % 7))
    text = text.otherwise(F.format_string("    g%d(v%d)", F.col("l_suppkey") % 9, F.col("l_partkey") % 7))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", text.alias("t"))
    items = items.select("o_custkey", "o_orderkey", line.alias("line")).repartition(lowering_tasks(spark), "o_custkey")
    body = items.groupBy("o_custkey", "o_orderkey").agg(F.array_sort(F.collect_list("line")).alias("b"))
    code = F.concat(F.format_string("def f%d(v0, v1, v2, v3, v4, v5, v6):\n", "o_orderkey"), F.array_join(F.transform("b", lambda x: x["t"]), "\n"))
    files = body.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", code.alias("c")))), lambda x: x["c"]), "\n\n").alias("src"))
    helpers = "".join(f"def g{i}(x):\n    return x\n\n" for i in range(9))
    return files.select(F.format_string("c%d.py", "o_custkey").alias("relpath"), F.concat(F.lit(helpers), "src").alias("src"))
