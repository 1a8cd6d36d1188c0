"""A store of lowered modules beside the files they come of: what has not changed is not lowered again.

A manifest holds path, time and size of each file as it was lowered, and the fingerprint of the lowering code. A new
version is written whole beside the old one and becomes current by its marker file, so readers never see half of one.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeflux.operators import lower, program
from codeflux.sources import facts


def fingerprint() -> str:
    """Changes with the code that lowers and resolves."""
    return hashlib.sha256("".join(inspect.getsource(m) for m in (lower, facts, program)).encode()).hexdigest()[:16]


def _versions(spark: SparkSession, store: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    # a version is whole once its last table has been written
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/manifest/_SUCCESS")))


def refresh(spark: SparkSession, root: str, store: str, exclude_tests: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """The modules of ``root``, of which only new and changed files are lowered, and how many were kept, lowered and gone."""
    files = facts.scan(spark, root, exclude_tests)
    now = files.select("relpath", F.col("mtime").cast("double").alias("mtime"), "size").withColumn("made_by", F.lit(fingerprint()))
    versions = _versions(spark, store)
    if versions:
        old = f"{store}/v={versions[-1]}"
        before = spark.read.parquet(f"{old}/manifest")
        same = now.join(before, ["relpath", "mtime", "size", "made_by"], "left_semi").select("relpath")
        kept = spark.read.parquet(f"{old}/modules").join(same, "relpath", "left_semi")
        fresh = facts.lower(files.join(same, "relpath", "left_anti"))
        gone = before.join(now, "relpath", "left_anti").count()
    else:
        kept, gone = None, 0
        fresh = facts.lower(files)
    out = f"{store}/v={versions[-1] + 1 if versions else 0}"
    fresh.write.mode("overwrite").parquet(f"{out}/modules")
    lowered = spark.read.parquet(f"{out}/modules").count()
    if kept is not None:
        kept.write.mode("append").parquet(f"{out}/modules")
    now.write.mode("overwrite").parquet(f"{out}/manifest")
    modules = spark.read.parquet(f"{out}/modules")
    return modules, {"lowered": lowered, "kept": modules.count() - lowered, "gone": gone}


def call_edges(spark: SparkSession, store: str) -> DataFrame:
    """The call graph of the current version, made once and kept with it."""
    here = f"{store}/v={_versions(spark, store)[-1]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{here}/edges/_SUCCESS")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        modules = spark.read.parquet(f"{here}/modules")
        found = program.evidence(modules, facts.functions(modules))
        program.call_graph(program.sites_of(found)).write.mode("overwrite").parquet(f"{here}/edges")
    return spark.read.parquet(f"{here}/edges")
