"""Language identification by error-correcting output codes.

Each language gets a codeword; for each bit a binary classifier over hashed byte 1- to 3-grams says how surely the bit
is set. The codeword with the least loss, each bit weighted by how well its classifier did in training, names the
language; a text whose two best codewords are close is flagged ambiguous. Codes are all splits of the languages up to 6
of them, and a fixed pseudo-random code of ``CODE`` bits beyond. Fitted in one task on a sample by the hash of id and text:
about ``MOST_ROWS`` rows for each language and ``MOST_ALL`` in all are expected of it. All texts are scored whole, where
they lie.

Defined results: null texts and texts without a letter are `und` with score 0; null languages are not learnt from; with
one language known every text with a letter is that, with none all are `und`; ties go to the smaller code point; rows
that repeat are learnt from once and scored alike; rows without an id are not learnt from; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, small_batches
from .tokens import _LOWER, U, mix, runs, utf8

DIM_BITS, MOST_ROWS, MOST_ALL, STEPS, CODE = 12, 2_500, 10_000, 150, 63
DIM = 1 << DIM_BITS
AMBIGUOUS = 0.7


def codewords(n: int) -> np.ndarray:
    """n x bits, of -1 and 1."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        splits = [s for s in itertools.product((-1, 1), repeat=n - 1) if -1 in s]
        return np.array([[1, *s] for s in splits], float).T
    return np.where(np.random.default_rng(n).random((n, CODE)) < 0.5, -1.0, 1.0)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """rows x DIM: square roots of the shares of hashed byte n-grams."""
    n, total = len(at) - 1, None
    x = _LOWER[data].astype(U)
    x = np.where((x < U(97)) | ((x > U(122)) & (x < U(128))), U(32), x)
    row = np.repeat(np.arange(n), np.diff(at))
    code = np.zeros(len(x), U)
    total = np.zeros(n * DIM, np.int64)
    for k in range(3):
        if len(x) <= k:
            break
        code = (code[:-1] if k else code) * U(257) + x[k:] + U(1)
        same = row[: len(code)] == row[k:]
        bucket = (mix(code + (U(k) << U(40))) >> U(64 - DIM_BITS)).astype(np.int64)
        total += np.bincount((row[: len(code)] * DIM + bucket)[same], minlength=n * DIM)
    total = total.reshape(n, DIM)
    return np.sqrt(total / np.maximum(total.sum(1, keepdims=True), 1)).astype(np.float32)


def _featurize(batches):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for i, j in runs(at, 1 << 18):
            cells = [r.astype(np.float16).tobytes() for r in features(data[at[i] : at[j]], at[i : j + 1] - at[i])]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), batch.column("turn").slice(i, j - i), pa.array(cells, pa.binary())], ["lang", "turn", "x"])


def fit(x: np.ndarray, y: np.ndarray, codes: np.ndarray, steps: int = STEPS, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIM + 1 rows, a column for each bit) and the weight of each bit: its log odds of being right."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    aim = codes[y].astype(np.float32)
    share = (1 / np.bincount(y, minlength=len(codes))[y] / len(set(y.tolist()))).astype(np.float32)[:, None]
    w, m, v = (np.zeros((x.shape[1], codes.shape[1]), np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        g = -x.T @ (share * aim / (1 + np.exp(np.clip(aim * (x @ w), -30, 30)))) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    right = np.clip(((aim * (x @ w)) > 0).mean(0), 0.5, 0.999)
    return w, np.log(right / (1 - right)).clip(1e-3)


def decode(margins: np.ndarray, codes: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best codeword, its share of the evidence and whether the second best is close."""
    loss = np.stack([(np.logaddexp(0, -c * margins) * trust).sum(1) / trust.sum() for c in codes], 1)
    odds = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    odds /= odds.sum(1, keepdims=True)
    best = odds.argmax(1)
    top = odds[np.arange(len(best)), best]
    return best, top, top < AMBIGUOUS


def _fit(steps: int):
    def run(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("lang", "turn", "x")))
        rows.sort(key=lambda r: (r[0].encode(), r[1], r[2]))
        names = list(dict.fromkeys(r[0] for r in rows))
        codes = codewords(len(names))
        if len(names) > 1:
            x = np.array([np.frombuffer(r[2], np.float16) for r in rows], np.float32)
            w, trust = fit(x, np.array([names.index(r[0]) for r in rows]), codes, steps)
        else:
            w, trust = np.zeros((DIM + 1, 1), np.float32), np.ones(1)
        yield pa.RecordBatch.from_pylist([{"names": names, "weights": w.astype(np.float32).tobytes(), "trust": trust.tolist()}], pa.schema([("names", pa.list_(pa.string())), ("weights", pa.binary()), ("trust", pa.list_(pa.float64()))]))

    return run


def train(docs: DataFrame, learn: Column, most_rows: int = MOST_ROWS, steps: int = STEPS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights and bit weights, from the rows where ``learn``; about ``most_rows`` of each language, fewer where
    the languages are so many that ``MOST_ALL`` rows would be passed.

    A language's rows are those whose hash is below its own threshold, found by one count: no language is gathered."""
    turn = F.xxhash64(F.lit(3), "doc_id", "text")
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    counts = materialize(known.groupBy("lang").agg(F.count("*").alias("n")))
    each = min(most_rows, max(1, MOST_ALL // max(counts.count(), 1)))
    limits = counts.select("lang", F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")).alias("share"))
    below = (F.lit(-(2.0**63)) + F.col("share") * F.lit(2.0**64)).cast("decimal(38,0)")
    chosen = known.withColumn("turn", turn).join(maybe_broadcast(limits), "lang").where((F.col("share") >= 1) | (F.col("turn") < below))
    rows = chosen.select("lang", "text", "turn").distinct()
    ready = rows.select("lang", "turn", "text").mapInArrow(_featurize, "lang string, turn bigint, x binary")
    with small_batches(docs.sparkSession):
        found = ready.repartition(1).mapInArrow(_fit(steps), "names array<string>, weights binary, trust array<double>").collect()
    if not found or not found[0].names:
        return [], np.zeros((DIM + 1, 1), np.float32), np.ones(1)
    trust = np.array(found[0].trust)
    return list(found[0].names), np.frombuffer(found[0].weights, np.float32).reshape(DIM + 1, -1), trust


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names, w, trust = shared.value
        codes = codewords(len(names))
        for batch in batches:
            data, at = utf8(batch.column("text"))
            letters = np.array(batch.column("letters").fill_null(False))
            for i, j in runs(at, 1 << 18):
                ok = letters[i:j] & bool(names)
                lang, score, close = np.full(j - i, "und", object), np.zeros(j - i), np.zeros(j - i, bool)
                if ok.any():
                    x = features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                    best, top, near = decode((x @ w[:-1] + w[-1]).astype(float), codes, trust)
                    lang[ok], score[ok], close[ok] = np.array(names, object)[best[ok]], top[ok], near[ok]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(lang, pa.string()), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    letters = F.col("text").rlike(r"\p{L}").alias("letters")
    return docs.select("doc_id", "text", letters).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
