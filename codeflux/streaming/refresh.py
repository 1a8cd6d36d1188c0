"""Keeps a store of lowered modules up to date from a folder of source files, as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeflux.sources import facts

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str) -> DataFrame:
    """A stream of relpath, content and mtime of new and changed .py files below ``root``."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    rel = F.expr(f"substring(path, instr(path, {facts._quoted(base)}) + {len(base)})")
    return stream.select(rel.alias("relpath"), "content", F.col("modificationTime").alias("mtime"))


def refresh(spark: SparkSession, root: str, store: str, checkpoint: str) -> StreamingQuery:
    """Lowers what is new and appends it to ``store`` with the batch that brought it; ends when all is read.

    A batch that runs again after a failure replaces its own rows, as its partition is written anew."""

    def write(batch: DataFrame, number: int) -> None:
        facts.lower(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return watch(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    """The latest row of every module in ``store``."""
    rows = spark.read.parquet(store)
    latest = rows.groupBy("relpath").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["relpath", "batch"], "left_semi").drop("batch")
