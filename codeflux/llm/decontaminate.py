"""Benchmark decontamination with a broadcast set of test n-gram hashes (DataFrame operations only).

Benchmark items become windows of ``n`` consecutive words (a shorter item is one window of all its words). Of every
document word window of those lengths the hash alone, with its place, is looked up in the tests' hashes: broadcast where
they are few, by shuffle where they are not. Rows that meet any are read again, and each of their hits is verified word by
word. No text and no list of words travels with windows, so the work is linear in a text's length on both paths.

Defined results: a null text has no words, n_words 0 and no hits; items without an id or without words give no
windows; items that repeat count once by id; rows that repeat (same id and text) each get the same result, and a null
doc_id is an id like any other; an empty benchmark marks nothing; other columns are kept by ``decontaminate`` and
ignored by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, bind, materialize, maybe_broadcast, small

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 8
FEWEST_ITEMS = 2


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def hashed(of: Column) -> Column:
    """A hash for each word; a window's hash is that of its words' hashes."""
    return F.transform(of, lambda w: F.xxhash64(w))


def _windows(of: Column, length: int) -> Column:
    """Place, length and hash of all windows of ``length`` words, from the words' hashes; none where there are fewer."""
    starts = F.sequence(F.lit(0), F.size(of) - length)
    one = lambda i: F.struct(i.cast("int").alias("start"), F.lit(length).alias("length"), F.xxhash64(F.slice(of, i + 1, length)).alias("hash"))
    none = F.array().cast("array<struct<start:int,length:int,hash:bigint>>")
    return F.when(F.size(of) >= length, F.transform(starts, one)).otherwise(none)


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows: length, hash, words, items (ids as strings)."""
    item = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    length = F.least(F.size("w"), F.lit(n))
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - length))
    cut = item.where("size(w) > 0").select("item", "w", length.alias("length"), starts.alias("start"))
    each = cut.select("item", "length", F.slice("w", F.col("start") + 1, F.col("length")).alias("words"))
    found = each.groupBy("length", "words").agg(F.collect_set("item").alias("items"))
    return found.withColumn("hash", F.xxhash64(hashed(F.col("words"))))


def _candidates(docs: DataFrame, tests: DataFrame, lengths: list[int], broadcast_rows: int) -> DataFrame:
    """doc_id, text_hash, n_words, copies (rows with this id and text) and hits (place, length, hash) whose hash a test has."""
    doc = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    doc = doc.select("doc_id", "text_hash", F.size("w").alias("n"), hashed(F.col("w")).alias("h"))
    mark = F.struct(F.lit(-1).alias("start"), F.col("n").alias("length"), F.lit(None).cast("bigint").alias("hash"))
    # the words' hashes are bound once; named inside, they would be computed for every window
    spots = bind(lambda s: F.concat(F.array(s["mark"]), *[_windows(s["h"], k) for k in lengths]), mark=mark, h=F.col("h"))
    each = doc.select("doc_id", "text_hash", F.explode(spots).alias("x")).select("doc_id", "text_hash", "x.*")
    keys = tests.select("hash", "length").distinct().withColumn("known", F.lit(True))
    if small(tests, broadcast_rows):
        rows = each.join(F.broadcast(keys), ["hash", "length"], "left").where("start < 0 or known")
    else:
        rows = each.where("start >= 0").join(keys, ["hash", "length"]).unionByName(each.where("start < 0").withColumn("known", F.lit(None).cast("boolean")))
    is_mark = F.col("start") < 0
    return rows.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(is_mark, F.col("length"))).cast("long").alias("n_words"),
        F.count(F.when(is_mark, 1)).alias("copies"),
        F.collect_set(F.when(~is_mark, F.struct("start", "length", "hash"))).alias("hits"),
    )


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, hits (word positions, from 0), items (sorted ids)."""
    tests = materialize(item_windows(benchmark, n))
    lengths = sorted(r[0] for r in tests.select("length").distinct().collect())  # at most n values
    met = materialize(_candidates(docs, tests, lengths, broadcast_rows))

    some = met.where("size(hits) > 0").select("doc_id", "text_hash", "hits")
    on = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.xxhash64("d.text") == F.col("m.text_hash"))
    again = docs.select("doc_id", "text").alias("d").join(maybe_broadcast(some).alias("m"), on)
    again = again.select("m.doc_id", "m.text_hash", "m.hits", words(F.col("d.text")).alias("w"))
    cut = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length"), h["hash"].alias("hash"), F.slice("w", h["start"] + 1, h["length"]).alias("words")))
    each = again.select("doc_id", "text_hash", F.explode(cut).alias("x")).select("doc_id", "text_hash", "x.*")
    sure = each.join(maybe_broadcast(tests.select("hash", "length", "words", "items")), ["hash", "length", "words"])
    spans = sure.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("items").alias("sets"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    spans = spans.select("doc_id", "text_hash", F.array_distinct(covered).alias("hits"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))
    spans = materialize(spans)

    both = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.text_hash").eqNullSafe(F.col("b.text_hash"))
    per = met.select("doc_id", "text_hash", "n_words", "copies").alias("a").join(maybe_broadcast(spans).alias("b"), both, "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    per = per.select("a.doc_id", "a.text_hash", "n_words", "copies", F.coalesce("b.hits", none("int")).alias("hits"), F.coalesce("b.items", none("string")).alias("items"))
    return per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, fewest_items: int = FEWEST_ITEMS) -> DataFrame:
    """``docs`` without the rows that hold windows of ``fewest_items`` items or more; in other rows the words hit are
    cut, each with what follows it up to the next word, and n_chars is set anew if there is such a column."""
    hit = scan(docs, benchmark, n).where("size(hits) > 0").select("doc_id", "text_hash", "hits", F.size("items").alias("n_items"))
    hit = materialize(hit.distinct())
    on = F.col("o.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.xxhash64("o.text") == F.col("h.text_hash"))
    met = docs.alias("o").join(maybe_broadcast(hit).alias("h"), on, "left").where(f"h.n_items is null or h.n_items < {fewest_items}")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(F.col("o.text"), F.lit(f"{word}++{gap}*+"), F.lit(0))
    head = F.regexp_extract("o.text", f"^{gap}*+", 0)

    def rest(s: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(s["pieces"]) - 1), F.col("h.hits"))
        return F.array_join(F.transform(kept, lambda i: F.element_at(s["pieces"], i + 1)), "")

    cut = F.concat(head, bind(rest, pieces=pieces))
    text = F.when(F.col("h.hits").isNull(), F.col("o.text")).otherwise(cut)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("h.hits").isNull(), F.col("o.n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    return met.select(*[new.get(c, F.col(f"o.`{c}`")).alias(c) for c in docs.columns])
