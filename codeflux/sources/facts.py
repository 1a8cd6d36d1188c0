"""Source files as a table, and the fact tables that lowering makes of them."""

from __future__ import annotations

import io
import subprocess
import tokenize
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codeflux.operators import pieces as P
from codeflux.operators.lower import _module_name, lower_module

# Folders that a scan leaves out (fixed values).
SKIPPED = ("__pycache__", ".venv", "venv", ".git", "build", "dist", ".mypy_cache", ".pytest_cache", "node_modules", ".tox", ".eggs")

OP = (
    "struct<op_id:int,block_id:int,kind:string,sub:string,targets:array<string>,uses:array<string>,line:int,"
    "calls:array<struct<func:string,args:array<string>>>,cond:string,const:string,exc:string,"
    "stores:array<struct<root:string,path:string>>,synthetic:boolean,end:int,reads:array<struct<base:string,key:string>>,"
    "shape:struct<open:boolean,dynamic:boolean,spreads:array<string>,fields:array<struct<key:string,container:boolean,reads:array<string>>>>>"
)
FUNCTION = (
    "qualname:string,simple:string,first_line:int,last_line:int,entry:int,exits:array<int>,params:array<string>,locals:array<string>,"
    "globals:array<string>,nonlocals:array<string>,own_nonlocals:array<string>,frees:array<string>,subscripts:int,"
    "annotations:array<struct<name:string,text:string>>,kwarg:string,proven:array<string>,doubted:array<string>,"
    "blocks:array<struct<block_id:int,pos:int,is_handler:boolean,is_finally:boolean,line_lo:int,line_hi:int>>,"
    f"edges:array<struct<src:int,dst:int,kind:string,ord:int>>,ops:array<{OP}>"
)
MODULE = (
    "relpath string, error string, module_name string, imports array<struct<name:string,target:string,module:string,lazy:boolean>>, "
    f"classes array<struct<name:string,bases:array<string>,methods:array<string>>>, functions array<struct<{FUNCTION}>>, "
    "globals array<string>, side_effects array<struct<line:int,what:string>>, call_assigns int, failed array<string>"
)


#: Modules lowered before their facts are handed on.
SLICE = 16


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def scan(spark: SparkSession, root: str, exclude_tests: bool = False) -> DataFrame:
    """relpath, src, mtime, size of every .py file below ``root``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(root)
    rel = F.expr(f"substring(path, instr(path, {_quoted(root.rstrip('/') + '/')}) + {len(root.rstrip('/')) + 1})")
    found = files.select(rel.alias("relpath"), F.col("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    skipped = "(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    found = found.where(~F.col("relpath").rlike(skipped))
    if exclude_tests:
        found = found.where(~F.col("relpath").rlike(r"(^|/)test_[^/]*$|(^|/)tests/"))
    return found.select("relpath", "content", "mtime", "size")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: What keeps a file from being lowered at all.
FAULTS = (SyntaxError, UnicodeDecodeError, RecursionError, LookupError)


def _decoded(src: bytes) -> str:
    encoding, _ = tokenize.detect_encoding(io.BytesIO(src).readline)
    return io.TextIOWrapper(io.BytesIO(src), encoding).read()


def _faulty(relpath: str, e: Exception) -> dict:
    return lower_module(relpath, "") | {"error": f"{type(e).__name__}: {e}"}


def lower(sources: DataFrame) -> DataFrame:
    """One row per module, from (relpath, src string or content binary); files that do not parse give their error."""
    arrow = to_arrow_schema(schema(MODULE))
    binary = "content" in sources.columns

    def one(relpath: str, src: str | bytes | None) -> dict:
        try:
            return lower_module(relpath, (_decoded(src) if binary else src) or "")
        except FAULTS as e:
            return _faulty(relpath, e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):  # what a task holds at once is a few modules' facts
                part = batch.slice(i, SLICE)
                yield pa.RecordBatch.from_pylist([one(*row) for row in zip(*(part.column(c).to_pylist() for c in (0, 1)))], arrow)

    return sources.select("relpath", "content" if binary else "src").mapInArrow(run, schema(MODULE))


#: Rows handed on at once, and rows of pieces kept at once.
ROWS, KEPT = 50_000, 200_000
WHERE = ("relpath", "qualname", "simple", "first_line")


class _Rows:
    """Rows of pieces, each made once; what is handed on is taken from them by their places."""

    def __init__(self, arrow: pa.Schema):
        self.arrow, self.table, self.fresh, self.n = arrow, arrow.empty_table(), [], 0

    def add(self, rows: list[tuple]) -> tuple[int, int]:
        self.fresh += rows
        self.n += len(rows)
        return self.n - len(rows), len(rows)

    def take(self, places: np.ndarray) -> pa.RecordBatch:
        if self.fresh:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.fresh), self.arrow)]
            self.table = pa.concat_tables([self.table, pa.Table.from_arrays(columns, schema=self.arrow)]).combine_chunks()
            self.fresh = []
        if not len(places):
            return pa.RecordBatch.from_pylist([], self.arrow)
        return self.table.take(pa.array(places)).combine_chunks().to_batches()[0]


def _parts(pieces: P.Pieces, relpath: str, src: str | bytes | None, binary: bool) -> list[tuple[str, int, P.Piece]]:
    try:
        return pieces.of(relpath, _decoded(src) if binary else src)
    except FAULTS as e:
        return [("", 0, P.Piece(_faulty(relpath, e), 0, []))]


class Program:
    """A program that is lowered where its facts are asked for: one pass from source text to the rows that are wanted.

    ``rows`` is asked once for each distinct text of a function (``pieces``); names, paths and lines are put in after that."""

    def __init__(self, sources: DataFrame):
        self.binary = "content" in sources.columns
        self.sources = sources.select("relpath", "content" if self.binary else "src")

    def each(self, ddl: str, rows: Callable[[dict], Iterator[tuple]], lines: tuple[str, ...] = (), where: tuple[str, ...] = ()) -> DataFrame:
        """fq, those of ``WHERE`` asked for, and what ``rows`` yields for each function. ``lines`` names the columns that hold
        lines (0: none)."""
        out = schema(", ".join(["fq string", *(f"{w} {'int' if w == 'first_line' else 'string'}" for w in where), *[ddl] * bool(ddl)]))
        arrow, held = to_arrow_schema(out), to_arrow_schema(schema(", ".join(["__q string, __s string, __l int", *[ddl] * bool(ddl)])))
        fields = [f.name for f in arrow][1 + len(where) :]
        binary = self.binary

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, store, place = P.Pieces(), _Rows(held), {}
            paths: list[str] = []
            heads: list[str] = []
            shifts: list[int] = []
            spans: list[tuple[int, int]] = []

            def made(p: P.Piece) -> tuple[int, int]:
                found = []
                for f in p.facts["functions"]:
                    q = f["qualname"][len(P.NAME) :] if p.named else f["qualname"]
                    simple = None if p.named and not q else f["simple"]
                    found += [(q, simple, f["first_line"], *values) for values in rows(f | {"fq": f"?:{f['qualname']}"})]
                return store.add(found)

            def emit() -> pa.RecordBatch:
                span = np.array(spans, np.int64).reshape(-1, 2)
                n = span[:, 1]
                at = np.repeat(span[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                got, which = store.take(at), pa.array(np.repeat(np.arange(len(n)), n))
                name, path = (pa.array(x, pa.string()).take(which) for x in (heads, paths))
                shift = pa.array(np.array(shifts, np.int32)).take(which)
                moved = lambda c: pc.if_else(pc.greater(c, 0), pc.add(c, shift), c).cast(pa.int32())
                own = pc.binary_join_element_wise(name, got.column("__q"), "")
                known = {"fq": lambda: pc.binary_join_element_wise(path, own, ":"), "relpath": lambda: path, "qualname": lambda: own, "simple": lambda: pc.coalesce(got.column("__s"), name), "first_line": lambda: moved(got.column("__l"))}
                columns = [known[c]() for c in ("fq", *where)] + [moved(got.column(c)) if c in lines else got.column(c) for c in fields]
                for x in (paths, heads, shifts, spans):
                    x.clear()
                if store.n > KEPT or pieces.full():
                    pieces.forget()
                    place.clear()
                    store.__init__(held)
                return pa.RecordBatch.from_arrays(columns, schema=arrow)

            for batch in batches:
                total = 0
                for relpath, src in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for name, shift, p in _parts(pieces, relpath, src, binary):
                        if not p.names:
                            continue
                        if (span := place.get(p)) is None:
                            span = place[p] = made(p)
                        if span[1]:
                            paths.append(relpath)
                            heads.append(name)
                            shifts.append(shift)
                            spans.append(span)
                            total += span[1]
                    if total > ROWS or store.n > KEPT + ROWS:
                        yield emit()
                        total = 0
                if spans:
                    yield emit()

        return self.sources.mapInArrow(run, out)

    def table(self, *fields: str, where: tuple[str, ...] = (), of_ops: tuple[str, ...] = ()) -> DataFrame:
        """A row for each function, with those ``fields`` of ``FUNCTION`` that hold no lines; of its operations ``of_ops``."""
        kinds = {f.name: f.dataType for f in schema(FUNCTION)}
        if "ops" in fields:
            kinds["ops"].elementType.fields = [f for f in kinds["ops"].elementType.fields if f.name in of_ops]
        ddl = ", ".join(f"{n} {kinds[n].simpleString()}" for n in fields)

        def rows(f: dict) -> Iterator[tuple]:
            ops = [{k: o[k] for k in of_ops} for o in f["ops"]]
            yield tuple(ops if n == "ops" else f[n] for n in fields)

        return self.each(ddl, rows, (), where)

    def inner(self, name: str, *fields: str) -> DataFrame:
        """A row for each of a function's ``ops``, ``edges`` or ``blocks``, with those fields."""
        kinds = {f.name: f.dataType for f in {f.name: f.dataType for f in schema(FUNCTION)}[name].elementType}
        ddl = ", ".join(f"{n} {kinds[n].simpleString()}" for n in fields)
        return self.each(ddl, lambda f: (tuple(x[n] for n in fields) for x in f[name]), tuple(n for n in fields if n in ("line", "end", "line_lo", "line_hi")))

    def modules(self, *columns: str) -> DataFrame:
        """Those columns of ``MODULE`` that are asked for, functions aside."""
        kinds = {f.name: f for f in schema(MODULE) if f.name != "functions"}
        out = StructType([kinds[c] for c in columns])
        inner = [c for c in columns if c not in ("relpath", "module_name")]
        arrow = to_arrow_schema(out)
        held = to_arrow_schema(StructType([kinds[c] for c in inner]))
        binary = self.binary

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, store, place = P.Pieces(bodies=False), _Rows(held), {}
            for batch in batches:
                for i in range(0, batch.num_rows, 2048):
                    part = batch.slice(i, 2048)
                    paths, spots = part.column(0).to_pylist(), []
                    for relpath, src in zip(paths, part.column(1).to_pylist()):
                        parts = _parts(pieces, relpath, src, binary)
                        # what gives nothing but functions leaves no mark on the module
                        key = tuple((p, at if p.facts["side_effects"] else 0) for _, at, p in parts if not p.quiet) if len(parts) > 1 else (parts[0][2],)
                        if (spot := place.get(key)) is None:
                            row = P.module(relpath, parts)
                            spot = place[key] = store.add([tuple(row[c] for c in inner)])[0]
                        spots.append(spot)
                    got = store.take(np.array(spots, np.int64)) if inner else None
                    fresh = {"relpath": lambda: pa.array(paths, pa.string()), "module_name": lambda: pa.array([_module_name(x) for x in paths], pa.string())}
                    yield pa.RecordBatch.from_arrays([fresh[c]() if c in fresh else got.column(c) for c in columns], schema=arrow)
                    if store.n > 20_000 or pieces.full():
                        pieces.forget()
                        place.clear()
                        store.__init__(held)

        return self.sources.mapInArrow(run, out)


def functions(modules: DataFrame) -> DataFrame:
    """One row per function: fq, relpath and all its facts."""
    each = modules.select("relpath", F.explode("functions").alias("f")).select("relpath", "f.*")
    return each.select(F.concat_ws(":", "relpath", "qualname").alias("fq"), "*")


def named(fns: DataFrame, name: str) -> DataFrame:
    """Functions that a name means: a whole fq or path ending, a qualified name or its ending, a simple name. Of endings in
    one file only the shallowest counts, then the first by name."""
    from pyspark.sql import Window

    path, _, qual = name.rpartition(":")
    quoted = "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in qual)
    fits = F.col("qualname").rlike(rf"(^|\.){quoted}$")
    if path:
        fits &= (F.col("relpath") == path) | F.col("relpath").endswith("/" + path)
    depth = F.struct(F.size(F.split("qualname", r"\.")), F.col("qualname"))
    first = F.row_number().over(Window.partitionBy("relpath").orderBy(depth))
    return fns.where(fits).withColumn("place", first).where("place = 1").drop("place")


def text_of(sources: DataFrame) -> DataFrame:
    """relpath, src of scanned files, as UTF-8."""
    return sources.select("relpath", F.decode("content", "UTF-8").alias("src")) if "content" in sources.columns else sources


def blocks(fns: DataFrame) -> DataFrame:
    return fns.select("fq", F.explode("blocks").alias("x")).select("fq", "x.*")


def cfg_edges(fns: DataFrame) -> DataFrame:
    return fns.select("fq", F.explode("edges").alias("x")).select("fq", "x.*")


def ops(fns: DataFrame) -> DataFrame:
    return fns.select("fq", F.explode("ops").alias("x")).select("fq", "x.*")


def calls(fns: DataFrame) -> DataFrame:
    """fq, op_id, ord, func, args of every call site."""
    return ops(fns).select("fq", "op_id", F.posexplode("calls").alias("ord", "c")).select("fq", "op_id", "ord", "c.func", "c.args")


def parse_errors(modules: DataFrame) -> DataFrame:
    """relpath, error: modules that do not parse, and functions that cannot be lowered."""
    lost = modules.select("relpath", F.explode("failed").alias("error"))
    return modules.where("error is not null").select("relpath", "error").unionByName(lost)


def source_lines(sources: DataFrame) -> DataFrame:
    """relpath, line (from 1), text."""
    return sources.select("relpath", F.posexplode(F.split("src", "\n")).alias("at", "text")).select("relpath", (F.col("at") + 1).alias("line"), "text")


def changed_lines(spark: SparkSession, repo: str, revision: str) -> DataFrame:
    """relpath, line: lines of the working tree that differ from ``revision``."""
    diff = subprocess.run(["git", "-C", repo, "diff", "-U0", revision, "--", "."], capture_output=True, text=True, check=True).stdout
    return parse_diff(spark.createDataFrame([(i, x) for i, x in enumerate(diff.split("\n"))], "n long, text string"))


def parse_diff(lines: DataFrame) -> DataFrame:
    """relpath, line from the (n, text) lines of a diff without context."""
    from pyspark.sql import Window

    path = F.when(F.col("text").startswith("+++ "), F.regexp_extract("text", r"^\+\+\+ b/(.*)$", 1))
    tagged = lines.withColumn("relpath", F.last(path, True).over(Window.orderBy("n")))  # one diff, already on the driver
    hunk = tagged.where(F.col("text").startswith("@@")).where(F.col("relpath").endswith(".py"))
    start = F.regexp_extract("text", r"\+(\d+)", 1).cast("int")
    size = F.regexp_extract("text", r"\+\d+,(\d+)", 1)
    count = F.when(size == "", 1).otherwise(size.cast("int"))
    return hunk.select("relpath", F.explode(F.sequence(start, start + F.greatest(count, F.lit(1)) - 1)).alias("line")).distinct()
