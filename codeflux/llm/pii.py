"""Personal data by fixed shapes, and by bootstrapped contextual extraction (DataFrame operations only).

Emails, addresses, cards and phone numbers are found by their shapes. Those are the seeds: the two words before a token
are its pattern, and tokens that look like identifiers (holding a digit or an @) are instances. Patterns are scored by
the instances they bring up and instances by the patterns that bring them up, in turn, over the whole corpus: seeds stay
at 1, everything else starts at 0. In each round a pattern's support is the sum of its instances' scores, found ones as
well as seeds; with ``LEAST_SEEDS`` of support or more its score is the mean of all its instances, else 0. So what one
pattern finds can bring up another. Tokens after a pattern that ends with a high score, and that no base span touches,
are personal data too, of the kind that most of the pattern's support has; their spans take in the groups of digits that
follow with one space between (up to ``MOST_GROUPS``).

Seeds, patterns and instances are counted as (pattern, instance) edges, summed before any shuffle by key, so a pattern
that a third of the rows hold is one row per task; no row holds more than one document's tokens.

Defined results: a null text is empty and has no spans; matches that fail their kind's test (part over 255, length or
check digit) are dropped and not tried again from within; rows that repeat each get their own result; a null doc_id is
an id like any other; without seeds nothing is added; an empty table gives an empty result; other columns are kept by
``mask`` and ignored by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, materialize, maybe_broadcast, small

KINDS = ("email", "ip", "card", "phone")
# Each shape starts where a run of its characters does or where the last match ended, and never gives back what it took:
# the same matches as the plain shape, without trying every place of a long run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x00-\x20])[^\x00-\x20@0-9]*+[@0-9][^\x00-\x20]*+"
# Groups of digits that go on an identifier: looked at from each token, not taken.
MOST_GROUPS = 16
TAIL = rf"(?=((?:\x20\(?[0-9]++(?:[)/-]++[0-9]++)*+\)?+(?=[.,;:!?)\]\"']*+(?:[\x00-\x20]|$))){{0,{MOST_GROUPS}}}+))"
ROUNDS, LEAST_SEEDS, CONFIDENT = 3, 5, 0.8
BLOCK = 64
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _places(text: Column, pattern: str) -> Column:
    """value and the text before of every match."""
    return bind(
        lambda s: F.transform(s["found"], lambda value, i: F.struct(value.alias("value"), F.element_at(s["between"], i + 1).alias("before"))),
        found=F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        between=F.split(text, pattern, -1),
    )


def _token_places(text: Column) -> Column:
    """value, the text before, the last words before (tokens among them) and the length of the groups after of every token."""

    def near(s: Column, i: Column) -> Column:
        gap = lambda j: F.right(F.get(s["between"], j), F.lit(64))
        own = lambda j: F.right(F.get(s["found"], j), F.lit(64))
        return F.concat_ws("", own(i - 2), gap(i - 1), own(i - 1), gap(i))

    return bind(
        lambda s: F.transform(
            s["found"], lambda value, i: F.struct(value.alias("value"), F.element_at(s["between"], i + 1).alias("before"), near(s, i).alias("near"), F.length(F.get(s["tails"], i)).alias("tail"))
        ),
        found=F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)),
        between=F.split(text, TOKEN, -1),
        tails=F.regexp_extract_all(text, F.lit(TOKEN + TAIL), F.lit(1)),
    )


def _offsets(hits: Column, **more: str) -> Column:
    """Adds start and end to hits (value, before, and ``more`` fields by type). Sums run over whole blocks first, so long lists stay cheap."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def with_sizes(s: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(s["sizes"]) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: add(F.slice(s["sizes"], b * BLOCK + 1, BLOCK)))
        return bind(with_blocks, hits=s["hits"], sizes=s["sizes"], blocks=blocks)

    def with_blocks(s: Column) -> Column:
        def place(h: Column, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            before = add(F.slice(s["blocks"], 1, b)) + add(F.slice(s["sizes"], b * BLOCK + 1, i - b * BLOCK)) + F.length(h["before"])
            return F.struct(before.alias("start"), (before + F.length(h["value"])).alias("end"), h["value"].alias("value"), h["before"].alias("before"), *[h[m].alias(m) for m in more])

        return F.transform(s["hits"], place)

    fields = "".join(f",{m}:{t}" for m, t in more.items())
    empty = F.array().cast(f"array<struct<start:int,end:int,value:string,before:string{fields}>>")
    sizes = F.transform(hits, lambda h: F.length(h["before"]) + F.length(h["value"]))
    return F.when(F.size(hits) > 0, bind(with_sizes, hits=hits, sizes=sizes)).otherwise(empty)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        plain = lambda part: F.ltrim(part, F.lit("0"))
        low = lambda part: (F.length(plain(part)) <= 3) & (F.concat(F.lit("0"), F.left(plain(part), F.lit(3))).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), low)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (spans by start, then kind) and tokens (identifier-like, with pattern) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    maybe = {"email": F.instr("text", "@") > 0, "phone": F.instr("text", "+") > 0}
    none = F.array().cast("array<struct<value:string,before:string>>")
    hits = {k: F.when(maybe[k], _places(F.col("text"), p)).otherwise(none) if k in maybe else _places(F.col("text"), p) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE))}
    rows = rows.withColumns({f"h_{k}": v for k, v in hits.items()}).withColumn("h_token", _token_places(F.col("text")))
    rows = rows.withColumns({f"p_{k}": _offsets(F.col(f"h_{k}")) for k in KINDS} | {"p_token": _offsets(F.col("h_token"), near="string", tail="int")})

    def of_kind(i: int, kind: str) -> Column:
        passed = F.filter(f"p_{kind}", lambda h: _valid(kind, h["value"]))
        return F.transform(passed, lambda h: F.struct(h["start"].alias("start"), F.lit(i).alias("kind"), h["end"].alias("end")))

    base = [of_kind(i, kind) for i, kind in enumerate(KINDS)]
    rows = rows.withColumn("base", F.array_sort(F.concat(*base)))

    def token(h: Column) -> Column:
        words = F.filter(F.split(F.lower(F.translate(h["near"], ".,;:()[]\"'", "          ")), r"\s+"), lambda w: w != "")
        context = F.when(F.size(words) >= 2, F.xxhash64(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2)))
        # a full stop or bracket at the end is not part of an identifier
        value = F.regexp_replace(h["value"], r"[.,;:!?)\]\"']+$", "")
        start = h["start"] + F.length(h["value"]) - F.length(F.ltrim(h["value"], F.lit("([\"'")))
        return F.struct(start.alias("start"), (h["start"] + F.length(value)).alias("end"), context.alias("pattern"), F.xxhash64(value).alias("instance"), F.when(value == h["value"], h["tail"]).otherwise(0).alias("tail"))

    def kind(t: Column) -> Column:
        """Kind of the first base span that touches the token; -1 if none does."""
        met = F.filter("base", lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"]))
        return F.when(F.size(met) > 0, F.element_at(met, 1)["kind"]).otherwise(-1)

    tokens = F.filter(F.transform("p_token", token), lambda t: t["pattern"].isNotNull() & (t["end"] > t["start"]))
    rows = rows.select("doc_id", "text_hash", "base", tokens.alias("t"))
    return rows.select("doc_id", "text_hash", "base", F.transform("t", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["pattern"].alias("pattern"), t["instance"].alias("instance"), t["tail"].alias("tail"), kind(t).alias("kind"))).alias("tokens"))


def score_patterns(spans: DataFrame, rounds: int = ROUNDS, least: int = LEAST_SEEDS) -> DataFrame:
    """pattern, kind, score: of patterns that have a support of ``least`` or more at the end.

    An instance scores the mean of its patterns that have support; what scores 0 is left out of the joins of a round."""
    each = spans.select(F.explode("tokens").alias("t")).select("t.*")
    edges = materialize(each.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    seeds = materialize(edges.where("kind >= 0").groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0)))
    edges = edges.select("pattern", "instance")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))

    def support(instances: DataFrame) -> DataFrame:
        by_kind = edges.join(maybe_broadcast(instances), "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("s"))
        total = by_kind.groupBy("pattern").agg(F.sum("s").alias("s"), F.max(F.struct("s", (-F.col("kind")).alias("k"))).alias("best")).where(F.col("s") >= least)
        return materialize(sizes.join(maybe_broadcast(materialize(total)), "pattern").select("pattern", (-F.col("best.k")).alias("kind"), (F.col("s") / F.col("n")).alias("score")))

    patterns = support(seeds)
    for _ in range(rounds):
        by = edges.join(maybe_broadcast(patterns), "pattern").groupBy("instance").agg(F.avg("score").alias("score"), F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("best"))
        found = by.join(maybe_broadcast(seeds), "instance", "left_anti").select("instance", (-F.col("best.k")).alias("kind"), "score")
        patterns = support(materialize(seeds.unionByName(found)))
    return patterns


def find(docs: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """doc_id, text_hash, base and spans (base and added) for every row."""
    spans = materialize(with_spans(docs))
    good = materialize(score_patterns(spans).where(F.col("score") >= confident).select("pattern", F.col("kind").alias("as")))
    fresh = spans.select("doc_id", "text_hash", F.explode(F.filter("tokens", lambda t: t["kind"] < 0)).alias("t"))
    found = fresh.select("doc_id", "text_hash", "t.start", (F.col("t.end") + F.col("t.tail")).alias("end"), "t.pattern")
    found = found.join(F.broadcast(good) if small(good) else good, "pattern").select("doc_id", "text_hash", F.lit(None).cast(_SPAN).alias("base"), F.struct("start", F.col("as").alias("kind"), "end").alias("span"))
    marks = spans.select("doc_id", "text_hash", "base", F.lit(None).cast("struct<start:int,kind:int,end:int>").alias("span"))
    per = marks.unionByName(found).groupBy("doc_id", "text_hash").agg(F.first("base", True).alias("base"), F.count("base").alias("copies"), F.collect_set("span").alias("added"))
    per = per.withColumn("spans", F.array_sort(F.concat("base", "added")))
    return per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "text_hash", "base", "spans")


def count_kind(spans: Column, i: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def mask(docs: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """``docs`` with each stretch that spans cover replaced by its first span's kind in angle brackets; n_chars, if
    there is such a column, is set anew where the text changed."""
    found = find(docs, confident).where("size(spans) > 0").distinct()
    acc = "array<struct<start:int,kind:int,end:int>>"

    def merge(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(a) > 0) & (s["start"] < F.try_element_at(a, F.lit(-1))["end"]), joined).otherwise(F.concat(a, F.array(s)))

    runs = F.aggregate("spans", F.array().cast(acc), merge)
    found = materialize(found.select("doc_id", "text_hash", runs.alias("runs")))
    on = F.col("o.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(F.coalesce(F.col("o.text"), F.lit(""))) == F.col("f.text_hash"))
    met = docs.alias("o").join(maybe_broadcast(found).alias("f"), on, "left")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    runs, text = F.col("f.runs"), F.col("o.text")
    piece = lambda r, i: F.concat(
        F.substring(text, F.when(i > 0, F.element_at(runs, F.greatest(i, F.lit(1)))["end"]).otherwise(0) + 1, r["start"] - F.when(i > 0, F.element_at(runs, F.greatest(i, F.lit(1)))["end"]).otherwise(0)),
        F.element_at(names, r["kind"] + 1),
    )
    masked = F.concat(F.array_join(F.transform(runs, piece), ""), F.substring(text, F.element_at(runs, -1)["end"] + 1, F.length(text)))
    changed = runs.isNotNull()
    new = {"text": F.when(changed, masked).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(masked).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("o.n_chars"))
    return met.select(*[new.get(c, F.col(f"o.`{c}`")).alias(c) for c in docs.columns])
