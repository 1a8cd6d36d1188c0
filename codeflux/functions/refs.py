"""Addresses of blocks, operations, definitions and uses: ``path:qualname:kind:ident``, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = r"^(.*):([^:]+):(bb|op|def|use):([^:]+)$"


def parse_ref(ref: Column) -> Column:
    """path, qualname, kind, number or name and line; null where the text is no address."""
    ident = F.regexp_extract(ref, SHAPE, 4)
    part = lambda i: F.regexp_extract(ref, SHAPE, i)
    name, line = F.regexp_extract(ident, r"^(.*?)(?:@(\d+))?$", 1), F.regexp_extract(ident, r"@(\d+)$", 1)
    number = ident.rlike(r"^\d+$")
    return F.when(
        ref.rlike(SHAPE),
        F.struct(
            part(1).alias("path"), part(2).alias("qualname"), part(3).alias("kind"),
            F.when(number, ident.try_cast("int")).alias("id"), F.when(~number, name).alias("name"), F.when(~number & (line != ""), line.try_cast("int")).alias("line"),
        ),
    )


def format_ref(path: Column, qualname: Column, kind: Column, ident: Column) -> Column:
    return F.concat_ws(":", path, qualname, kind, ident)


def resolve_refs(refs: DataFrame, ops: DataFrame) -> DataFrame:
    """ref, op_id: the operation that each def or use address (ref; fq, kind, name, line) means, the nearest line winning;
    null for stale addresses."""
    named = ops.select("fq", "op_id", F.col("line").alias("at"), F.explode(F.concat(F.transform("targets", lambda t: F.struct(F.lit("def").alias("kind"), t.alias("name"))), F.transform("uses", lambda t: F.struct(F.lit("use").alias("kind"), t.alias("name"))))).alias("x"))
    near = F.min_by("op_id", F.struct(F.abs(F.coalesce(F.col("line"), F.lit(0)) - F.col("at")), "op_id"))
    met = refs.join(named.select("fq", "op_id", "at", "x.*"), ["fq", "kind", "name"]).groupBy("ref").agg(near.alias("op_id"))
    return refs.select("ref").join(met, "ref", "left")


def resolve_nodes(fns: DataFrame, ref: str) -> DataFrame:
    """(fq, kind, id): the block, operation, definition or use that one address means; no row for a stale one.

    Definitions and uses are numbered in order of block and operation; a name without number means the one nearest to the
    line given, the first of those equally near."""
    spark = fns.sparkSession
    parsed = spark.createDataFrame([(ref,)], "ref string").select(parse_ref(F.col("ref")).alias("r")).where("r is not null").select("r.*").first()
    empty = spark.createDataFrame([], "fq string, kind string, id int")
    if parsed is None:
        return empty
    here = fns.where((F.col("qualname") == parsed.qualname) & ((F.col("relpath") == parsed.path) | F.lit(parsed.path).endswith(F.concat(F.lit("/"), F.col("relpath")))))
    if parsed.kind in ("bb", "op"):
        inside, field, kind = ("blocks", "block_id", "block") if parsed.kind == "bb" else ("ops", "op_id", "op")
        met = here.where(F.exists(inside, lambda x: x[field] == parsed.id)) if parsed.id is not None else here.limit(0)
        return met.select("fq", F.lit(kind).alias("kind"), F.lit(parsed.id).cast("int").alias("id"))
    names = "targets" if parsed.kind == "def" else "uses"
    flat = F.flatten(F.transform("ops", lambda o: F.transform(o[names], lambda n, i: F.struct(o["block_id"].alias("b"), o["op_id"].alias("o"), i.alias("i"), n.alias("name"), o["line"].alias("line")))))
    each = here.select("fq", F.posexplode(F.array_sort(flat)).alias("id", "x")).select("fq", "id", "x.name", "x.line")
    if parsed.id is not None:
        met = each.where(F.col("id") == parsed.id)
    else:
        near = F.abs(F.col("line") - parsed.line) if parsed.line is not None else F.lit(0)
        met = each.where(F.col("name") == parsed.name).groupBy("fq").agg(F.min_by("id", F.struct(near, "id")).alias("id"))
    return met.select("fq", F.lit(parsed.kind).alias("kind"), F.col("id").cast("int").alias("id"))


def block_of(fns: DataFrame, nodes: DataFrame) -> DataFrame:
    """fq, block_id of nodes (fq, kind, id)."""
    where = lambda names: F.array_sort(F.flatten(F.transform("ops", lambda o: F.transform(o[names], lambda n, i: F.struct(o["block_id"].alias("b"), o["op_id"].alias("o"), i.alias("i"))))))
    met = nodes.join(fns.select("fq", "ops"), "fq")
    op = F.element_at(F.filter("ops", lambda o: o["op_id"] == F.col("id")), 1)["block_id"]
    spot = F.when(F.col("kind") == "block", F.col("id")).when(F.col("kind") == "op", op)
    spot = spot.when(F.col("kind") == "def", F.get(where("targets"), F.col("id"))["b"]).otherwise(F.get(where("uses"), F.col("id"))["b"])
    return met.select("fq", spot.alias("block_id"))
