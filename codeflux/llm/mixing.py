"""Mixing sources to target weights by hash-threshold histograms (DataFrame operations only).

Every row gets a 60-bit hash of its id and text. Per source, words are summed by the top 12 hash bits; the running sum
finds the bucket in which the source's budget ends, and only that bucket is summed again by the next 12 bits, and so
on, until it holds one hash value. What remains is one threshold per source: rows below it are taken once more than the
others. Nothing is sorted but at most 4096 bucket sums per source.

Defined results: a null text has size 0; a null source is a source of its own and comes last; rows that repeat (same id
and text) share a hash and are taken alike; sources without words have target 0; an empty table gives an empty result;
columns beside those named are kept by ``apply_mix`` and ignored by ``plan_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, maybe_broadcast

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of the MD5 of seed, id and text."""
    none = F.lit("")
    whole = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), none), F.coalesce(text, none))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``place``, from 0, by code point with null last; sorts by range, without one task for all sources."""
    order = F.col("source").asc_nulls_last()
    parts = materialize(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("local", place).join(F.broadcast(offsets), "part").withColumn(
        "place", F.col("local") + F.col("before")
    )


def _targets(sources: DataFrame, weights: tuple, share: float, repeats: int) -> DataFrame:
    """Adds ``target``: ``share`` of all words by weight, capped at ``repeats`` times a source, the excess reshared."""
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    placed = _ranked(sources).withColumn("weight", F.element_at(kinds, (F.col("place") % len(weights) + 1).cast("int")))
    placed = materialize(placed.select("source", "source_size", "weight"))
    budget = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * float(repeats)
    level, known = F.lit(0.0), -1
    while True:  # each round caps more sources, so it ends; a round reads only the table of sources
        capped = level >= cap if known >= 0 else F.lit(False)
        n, taken, rest = placed.agg(
            F.coalesce(F.sum(capped.cast("int")), F.lit(0)),
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == known or not rest:
            break
        known, level = n, (budget - taken) * F.col("weight") / rest
    return placed.withColumn("target", F.least(level, cap) if rest else cap)


def plan_mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target, passes, threshold. ``sized``: source, size, hash."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = _targets(totals, weights, share, repeats)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("passes", passes.cast("long"))
    plan = materialize(plan.withColumn("need", F.col("target") - F.col("passes") * F.col("source_size")))
    done = None
    open_ = plan.where("need > 0").select("source", F.lit(0).cast("long").alias("prefix"), "need")
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        above, shift = HASH_BITS - (level - 1) * LEVEL_BITS, HASH_BITS - level * LEVEL_BITS
        inside = sized.alias("s").join(
            maybe_broadcast(open_).alias("o"),
            F.col("s.source").eqNullSafe(F.col("o.source")) & (F.shiftright("s.hash", above) == F.col("o.prefix")),
        )
        sums = (
            inside.where("s.size > 0")
            .groupBy(F.col("s.source").alias("source"), F.shiftright("s.hash", shift).alias("bucket"), "need")
            .agg(F.sum("s.size").alias("words"), F.min("s.hash").alias("low"), F.max("s.hash").alias("high"))
        )
        so_far = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        edge = sums.withColumn("through", so_far).where("through > need and through - words <= need")
        edge = materialize(edge.withColumn("rest", F.col("need") - F.col("through") + F.col("words")))
        one = F.col("low") == F.col("high")
        nearer = F.col("words") - F.col("rest") < F.col("rest")
        cut = F.when(F.col("rest") <= 0, F.col("low")).otherwise(F.when(nearer, F.col("low") + 1).otherwise(F.col("low")))
        found = edge.where(one | (F.col("rest") <= 0)).select("source", cut.alias("threshold"))
        done = found if done is None else done.unionByName(found)
        open_ = edge.where(~one & (F.col("rest") > 0)).select("source", F.col("bucket").alias("prefix"), F.col("rest").alias("need"))
        if open_.isEmpty():
            break
    everything = F.when(F.col("p.need") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0))
    return (
        plan.alias("p")
        .join(done.alias("d"), F.col("p.source").eqNullSafe(F.col("d.source")), "left")
        .select("p.source", "p.source_size", "p.target", "p.passes", F.coalesce("d.threshold", everything).alias("threshold"))
    )


def sized_rows(docs: DataFrame, seed: int = 17) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text"), seed).alias("hash"))


def take(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with source_size, target and taken (words, repeats counted)."""
    plan = materialize(plan)
    joined = sized.alias("s").join(maybe_broadcast(plan).alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")), "left")
    copies = F.col("p.passes") + (F.col("s.hash") < F.col("p.threshold")).cast("long")
    return joined.select("s.*", "p.source_size", "p.target", (F.col("s.size") * copies).alias("taken"))


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``."""
    sized = materialize(sized_rows(docs, seed))
    return take(sized, plan_mix(sized, weights, share, repeats)).drop("hash")


def apply_mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole, with ``mix_words`` and ``mix_copies`` (how often each is taken);
    where ``docs`` has columns of these names, underscores are added to the new ones."""
    sized = materialize(sized_rows(docs, seed).drop("doc_id"))
    plan = materialize(plan_mix(sized, weights, share, repeats))
    size, hash_ = free_name(docs, "mix_size"), free_name(docs, "mix_hash")
    hashed = docs.withColumns({size: word_count(F.col("text")), hash_: row_hash(F.col("doc_id"), F.col("text"), seed)})
    joined = hashed.alias("s").join(maybe_broadcast(plan).alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")), "left")
    copies = F.col("p.passes") + (F.col(f"s.{hash_}") < F.col("p.threshold")).cast("long")
    words, times = free_name(docs, "mix_words"), free_name(docs, "mix_copies")
    kept = [F.col(f"s.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*kept, (F.col(f"s.{size}") * copies).alias(words), copies.alias(times)).where(F.col(times) > 0)
