"""Shared helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows and bytes of a small side that may be broadcast; beyond them operators let Spark shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 48 << 20

#: Most rows and bytes of a batch between Spark and a Python worker.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codeflux-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "codeflux-" + uuid.uuid4().hex)
    with small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """While it holds, rows go to Python workers in batches of a few megabytes: texts may be long, and a task holds a batch
    several times over, within and without the heap."""
    before = {k: spark.conf.get(k) for k in ARROW}
    try:
        for k, v in ARROW.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        for name in {os.path.dirname(f) for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            if path.getName().startswith("codeflux-"):
                path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files whose plans are gone, instead of at the driver's next garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _cell_bytes(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a cell takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_cell_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        flat = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType))
        whole = F.size(column) * 8 if flat else F.octet_length(F.to_json(column))
        return F.coalesce(F.greatest(whole, F.lit(0)), F.lit(0)) + 24
    return F.lit(8) if not isinstance(kind, T.MapType) else F.octet_length(F.to_json(column)) + 24


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``most`` bytes; reads no more than it must."""
    size = sum((_cell_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    n, held = df.limit(rows + 1).select(size.alias("size")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return n <= rows and held <= most


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes have been checked to be few, else as it is."""
    return F.broadcast(df) if small(df, rows, most) else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def bind(use, **values: Column) -> Column:
    """``use`` of a struct of ``values``, each computed once. An expression named inside a lambda would be computed again
    for every element."""
    one = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.element_at(F.transform(F.array(one), use), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def sample(rows: DataFrame, turn: str, size: Column, most_rows: int, most_bytes: int) -> DataFrame:
    """The rows whose 64-bit hash ``turn`` is below the part that lets ``most_rows`` rows and ``most_bytes`` bytes be
    expected; all of them where there are not more. Nothing is sorted and no key is gathered."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size.cast("double")), F.lit(0.0))).first()
    share = min(1.0, most_rows / max(n, 1), most_bytes / max(total, 1.0))
    return rows if share >= 1 else rows.where(F.col(turn) < int(-(2**63) + share * 2**64))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, component), component being the smallest node that ``edges`` reach.

    Each round takes every node's smallest label among its neighbours and then jumps to that label's own label, so
    chains shrink by doubling. Rounds are written tables; labels never reach the driver.
    """
    both = materialize(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .where("u <> v")
        .distinct()
    )
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")))
    while True:
        near = (
            both.join(labels.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v")
            .groupBy("u")
            .agg(F.min("cv").alias("m"))
        )
        step = labels.join(near, "u", "left").select("u", "c", F.least("c", F.coalesce("m", "c")).alias("n"))
        jump = labels.select(F.col("u").alias("n"), F.col("c").alias("cn"))
        new = materialize(step.join(jump, "n", "left").select("u", "c", F.least("n", F.coalesce("cn", "n")).alias("n")))
        if new.where("n < c").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("n").alias("component"))
        labels = new.select("u", F.col("n").alias("c"))
