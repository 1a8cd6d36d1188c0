"""The registered queries: thin, each giving the columns agreed for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language, mixing, pii, quality, suffixes, topk, toxicity, warc
from .common import crc_bucket, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_items >= decontaminate.FEWEST_ITEMS).alias("contaminated"),
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_groups(table(spark, sf_dir, "documents"), k=4, pct=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_kind(F.col("base"), i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 5) == 0
    weights, bias = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out)
    scores = toxicity.score(docs, weights, bias)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 3) == 1
    found = language.predict(docs, language.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 5) == 0
    weights, _ = quality.train(docs, table(spark, sf_dir, "labels"), "quality", ~held_out)
    scores = quality.score(docs, weights)
    good = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scores.select("doc_id", held_out.alias("held_out"), "score", good.alias("predicted"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_source_mixing": op2_source_mixing,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_exact_topk": op5_exact_topk,
    "op6_language_codes": op6_language_codes,
    "op7_quality_pu": op7_quality_pu,
    "op8_warc_bundles": op8_warc_bundles,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
}
