"""A corpus pipeline: quality, near duplicates, benchmark passages, personal data, source weights.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each
stage's result to the shared folder as Parquet and reads it again as the next one's input. All stages but the last return
the columns of their input, whatever else it has; the last adds how many words of a document, and how many copies, the mix
takes.

Defined results of every stage: an empty table gives an empty result; a null text counts as an empty one and stays null; a
null doc_id is an id like any other, but near duplicates are never sought for it; a null source is a source of its own.
Rows that repeat whole share a fate in every stage but the second, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeflux.llm import decontaminate, jaccard, mixing, pii, quality
from codeflux.llm.common import crc_bucket, materialize, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores below its threshold go; one at the threshold stays. Without labels all stay."""
    learn = crc_bucket(F.col("doc_id"), 5) != 0
    weights, _ = quality.train(docs, table(spark, sf_dir, "labels"), "quality", learn)
    return quality.keep_good(docs, weights)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: that with the smallest id, and
    of rows with one id and text an arbitrary one. Documents without words are no duplicates."""
    return jaccard.keep_one(docs, k=5, pct=80)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two benchmark items or more go; a single item's passages are cut from the others."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; where spans overlap, by the kind of the first."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words and copies it takes of each."""
    return mixing.apply_mix(docs)


STAGES = [
    ("quality_pu", reject_low_quality),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", remove_benchmarks),
    ("pii", mask_personal_data),
    ("source_mixing", mix_sources),
]

#: A fitted model and a join's components stand before the rest, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
