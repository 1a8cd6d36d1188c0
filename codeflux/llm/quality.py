"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and unlabelled texts are all that is learnt from; negatives are never shown. A first linear model
parts positives from unlabelled texts; it scores every document of the table, and the histogram of these scores gives the
class prior: of all sets {score at least t} the one where documents are rarest beside positives bounds the share of
positives among all. The second minimises
prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)]) by gradient steps with logistic loss; where the
bracket is negative the step goes the other way, which keeps the risk from falling below zero by overfitting.

Features are how often each hashed word shape occurs (letters, capitals and digits folded, other signs kept), alone and
in pairs (which also tell whether the word is the same). Fitted in one task on samples by hash, of which about
``MOST_ROWS`` positives and as many unlabelled rows are expected; all texts are scored whole, where they lie.

Defined results: null and empty texts have no features and get the bias alone; null labels and rows without an id are not
learnt from; without positives every score is 0.5; rows that repeat are learnt from once and scored alike; an empty table
gives an empty result; other columns are kept by ``keep_good``, and ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, maybe_broadcast, sample, small_batches
from .tokens import SPACE, U, mix, runs, utf8, words

DIM_BITS, MOST_ROWS, STEPS = 9, 6_000, 300
THRESHOLD = 0.3
DIM = 2 << DIM_BITS

#: Classes of bytes: small letter, capital, digit and beyond ASCII fold; other signs stay themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """rows x DIM: square roots of the shares of word shapes and of pairs of shapes."""
    n = len(at) - 1
    kind = _CLASS[data]
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    where = np.flatnonzero(begins)
    out = np.zeros((n, DIM), np.float32)
    if not len(where):
        return out
    turn = inside.copy()  # one sign for each stretch of equal classes in a word
    turn[1:] &= begins[1:] | (kind[1:] != kind[:-1])
    spot = np.flatnonzero(turn)
    word = np.cumsum(begins)[spot] - 1
    local = np.arange(len(spot)) - np.searchsorted(word, np.arange(len(where)))[word]
    value = mix(kind[spot].astype(U) + (np.minimum(local, 30).astype(U) << U(8)))
    shape = mix(np.add.reduceat(value, np.searchsorted(word, np.arange(len(where)))))
    row = np.searchsorted(at, where, "right") - 1
    half = 1 << DIM_BITS
    one = np.bincount(row * half + (shape >> U(64 - DIM_BITS)).astype(np.int64), minlength=n * half).reshape(n, half)
    same = row[1:] == row[:-1]
    again = (name := words(data, at, SPACE)[0])[1:] == name[:-1]
    pair = (mix((shape[:-1] * U(3) ^ shape[1:]) + again.astype(U)) >> U(64 - DIM_BITS)).astype(np.int64)[same]
    two = np.bincount(row[:-1][same] * half + pair, minlength=n * half).reshape(n, half)
    for k, counts in enumerate((one, two)):
        out[:, k * half : (k + 1) * half] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    return out


def _featurize(batches):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for i, j in runs(at, 1 << 18):
            x = features(data[at[i] : at[j]], at[i : j + 1] - at[i])
            cells = [r.astype(np.float16).tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([batch.column("positive").slice(i, j - i), batch.column("turn").slice(i, j - i), pa.array(cells, pa.binary())], ["positive", "turn", "x"])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class _Adam:
    def __init__(self, size: int, rate: float):
        self.w, self.m, self.v = (np.zeros(size, np.float32) for _ in range(3))
        self.t, self.rate = 0, rate

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m = (0.9 * self.m + 0.1 * g).astype(np.float32)
        self.v = (0.999 * self.v + 0.001 * g * g).astype(np.float32)
        self.w -= np.float32(self.rate) * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8).astype(np.float32)


def prior(positive: np.ndarray, below: np.ndarray, counts: np.ndarray, least: float = 0.1) -> float:
    """Share of positives among all: from the positives' scores, and how many documents score in each bin from ``below``."""
    cuts = np.quantile(positive, np.linspace(0.0, 1 - least, 40))
    above = np.append(np.cumsum(counts[::-1])[::-1], 0) / max(counts.sum(), 1)
    ratios = [above[np.searchsorted(below, t, "left")] / max((positive >= t).mean(), 1e-9) for t in cuts]
    return float(np.clip(min(ratios), 0.05, 0.98))


def parting(p: np.ndarray, u: np.ndarray, steps: int, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model of positives against unlabelled rows."""
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (p, u))
    both = _Adam(p.shape[1], rate)
    for _ in range(steps):
        both.step(-p.T @ (1 - _sigmoid(p @ both.w)) / len(p) + u.T @ _sigmoid(u @ both.w) / len(u) + decay * both.w)
    return both.w


def nnpu(p: np.ndarray, u: np.ndarray, share: float, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) that minimise the non-negative risk at a prior of ``share``."""
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (p, u))
    model = _Adam(p.shape[1], rate)
    for _ in range(steps):
        model.step(risk_gradient(model.w, p, u, share) + decay * model.w)
    return model.w


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, share: float) -> np.ndarray:
    """The step of the non-negative risk: its gradient, or that of the bracket turned round where the bracket is negative."""
    sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
    negative = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + share * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
    rest = u.T @ su / len(u) - share * (p.T @ sp) / len(p)
    return -share * (p.T @ (1 - sp)) / len(p) + rest if negative >= 0 else -rest


def _rows(batches) -> tuple[np.ndarray, np.ndarray]:
    held = {True: [], False: []}
    for batch in batches:
        for positive, turn, x in zip(*(batch.column(c).to_pylist() for c in ("positive", "turn", "x"))):
            held[positive].append((turn, x))
    return tuple(np.array([np.frombuffer(x, np.float16) for _, x in sorted(held[k])], np.float32).reshape(-1, DIM) for k in (True, False))


def _first(steps: int):
    """The parting model, and the margins it gives the positives."""

    def run(batches):
        p, u = _rows(batches)
        w = parting(p, u, steps) if len(p) and len(u) else np.zeros(DIM + 1, np.float32)
        margins = p @ w[:-1] + w[-1] if len(p) else np.zeros(0)
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(float).tolist()], kind), pa.array([margins.astype(float).tolist()], kind)], ["weights", "margins"])

    return run


def _second(steps: int, share: float):
    def run(batches):
        p, u = _rows(batches)
        w = nnpu(p, u, share, steps) if len(p) and len(u) else np.zeros(DIM + 1)
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(w, float).tolist()], pa.list_(pa.float64()))], ["weights"])

    return run


#: Bins of a score, for the histogram of all documents.
BINS = 4096


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most_rows: int = MOST_ROWS, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and the class prior. ``learn``: which label rows to learn from; of them only positives are used."""
    known = labels.where(learn & (F.col(label) == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = sample(known.withColumn("h", F.xxhash64("doc_id")), "h", F.lit(16), most_rows, 1 << 62).drop("h")
    mine = docs.where("doc_id is not null").select("doc_id", "text")
    turn = lambda seed: F.xxhash64(F.lit(seed), "doc_id", "text")
    good = mine.join(maybe_broadcast(known), "doc_id").select("text", turn(1).alias("turn"), F.lit(True).alias("positive"))
    rest = mine.select("text", turn(2).alias("turn"), F.lit(False).alias("positive"))
    rows = sample(good, "turn", F.lit(1), most_rows, 1 << 62).unionByName(sample(rest, "turn", F.lit(1), most_rows, 1 << 62)).distinct()
    ready = materialize(rows.mapInArrow(_featurize, "positive boolean, turn bigint, x binary"), "none").repartition(1)
    first = ready.mapInArrow(_first(steps // 2), "weights array<double>, margins array<double>").first()
    if first is None or not first.margins:
        return np.zeros(DIM + 1, np.float32), 0.5
    scores = score(docs, np.array(first.weights, np.float32))
    bin_ = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    with small_batches(docs.sparkSession):
        bins = scores.groupBy(bin_).agg(F.count("*").alias("n")).collect()
    counts = np.zeros(BINS)
    for b in bins:
        counts[b.bin] = b.n
    share = prior(_sigmoid(np.array(first.margins)), np.arange(BINS) / BINS, counts)
    found = ready.mapInArrow(_second(steps, share), "weights array<double>").first()
    return np.array(found.weights, np.float32), share


def scored(docs: DataFrame, weights: np.ndarray, keep: list[str], text: str, score: str) -> DataFrame:
    """``keep`` columns and the score of every row; ``text`` and ``score`` are names that ``docs`` does not have."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(len(keep)))
            for i, j in runs(at, 1 << 18):
                x = features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                s = _sigmoid((x @ shared.value[:-1] + shared.value[-1]).astype(float))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(keep))), pa.array(s)], [*keep, score])

    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(text)).mapInArrow(run, kept.schema.add(score, "double"))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row."""
    return scored(docs.select("doc_id", "text"), weights, ["doc_id"], "body", "score")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    text, mark = free_name(docs, "cf_text"), free_name(docs, "cf_score")
    return scored(docs, weights, docs.columns, text, mark).where(F.col(f"`{mark}`") >= threshold).drop(mark)
