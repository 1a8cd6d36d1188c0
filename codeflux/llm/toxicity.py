"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the buckets of its words, its neighbouring pairs and its pairs one or two words apart, each once.
FTRL-proximal keeps a rate per coordinate and an L1 term that leaves most weights at zero; the rest, at most
2**BUCKET_BITS numbers, is broadcast. L1 also draws what is kept towards zero, so the bias is set anew at the end: a score
of 0.5 lies where the F1 measure on the rows learnt from is best. The model is fitted in one task, on a sample of the
labelled rows by the hash of id and text: about ``MOST_ROWS`` rows and ``MOST_BYTES`` bytes of text are expected of it,
whatever there is. All texts are scored whole, where they lie.

Defined results: null and empty texts get the bias alone; labels that are null, and label rows that no document has, are
not learnt from, nor are rows without an id; rows that repeat are learnt from once and scored alike; equal margins go to
the same side; without labels of both kinds every score is the share of label 1 (0 if there are none); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, sample, small_batches
from .tokens import BREAK, U, mix, runs, utf8, words

BUCKET_BITS, MOST_ROWS, MOST_BYTES, EPOCHS = 20, 20_000, 64 << 20, 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 20.0, 0.1
GAPS = (1, 2, 3)


def _features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram and skip-gram of rows."""
    hashes, row = words(data, at, BREAK)
    shift = U(64 - BUCKET_BITS)
    buckets, rows = [hashes >> shift], [row]
    for gap in GAPS:
        if len(hashes) > gap:
            both = mix(hashes[:-gap] * U(2 * gap + 1) ^ (hashes[gap:] << U(1)) ^ U(gap))
            same = row[:-gap] == row[gap:]
            buckets.append((both >> shift)[same])
            rows.append(row[:-gap][same])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(rows)


def _featurize(batches):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for i, j in runs(at, 1 << 19):
            bucket, row = _features(data[at[i] : at[j]], at[i : j + 1] - at[i])
            order = np.argsort(row, kind="stable")
            bucket, row = bucket[order], row[order]
            ends = np.searchsorted(row, np.arange(j - i + 1))
            found = [np.unique(bucket[a:b]).astype(np.int32) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i), batch.column("turn").slice(i, j - i), pa.array(found, pa.list_(pa.int32()))], ["label", "turn", "features"])


def ftrl(rows: list[tuple[int, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes in the order given."""
    z, n, bias_z, bias_n = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS), 0.0, 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias():
        return -bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA)

    for _ in range(epochs):
        for label, x in rows:
            w = weight(z[x], n[x])
            g = 1 / (1 + math.exp(-min(max(w.sum() + bias(), -35), 35))) - label
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - sigma * w
            n[x] += g * g
            step = (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / ALPHA
            bias_z += g - step * bias()
            bias_n += g * g
    return weight(z, n), bias()


def best_cut(margins: np.ndarray, positive: np.ndarray) -> float:
    """The margin at and above which calling rows positive gives the best F1, midway to the next below."""
    order = np.argsort(-margins, kind="stable")
    ranked, hits = margins[order], np.cumsum(positive[order])
    last = np.append(ranked[1:] != ranked[:-1], True)  # equal margins are on one side
    f1 = np.where(last, 2 * hits / (np.arange(1, len(ranked) + 1) + positive.sum()), -1)
    at = int(np.argmax(f1))
    return float((ranked[at] + ranked[at + 1]) / 2) if at + 1 < len(ranked) else float(ranked[at])


def _fit(epochs: int):
    def run(batches):
        rows = []
        for batch in batches:
            flat, ends = np.asarray(batch.column("features").values), np.asarray(batch.column("features").offsets)
            labels, turns = batch.column("label").to_pylist(), batch.column("turn").to_pylist()
            rows += [(t, y, flat[a:b]) for t, y, a, b in zip(turns, labels, ends[:-1], ends[1:])]
        rows.sort(key=lambda r: (r[0], r[1]))
        share = sum(r[1] for r in rows) / max(len(rows), 1)
        if 0 < share < 1:
            w, b = ftrl([r[1:] for r in rows], epochs)
            b -= best_cut(np.array([w[x].sum() + b for _, _, x in rows]), np.array([y for _, y, _ in rows]))
        else:
            w, b = np.zeros(0), math.log((share + 1e-9) / (1 - share + 1e-9))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], b))], ["bucket", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights by bucket, and the bias. ``learn``: which label rows to learn from."""
    known = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    known = sample(known.withColumn("h", F.xxhash64("doc_id")), "h", F.lit(16), most_rows, most_bytes).drop("h")
    turn = F.xxhash64(F.lit(1), "doc_id", "text")
    rows = docs.select("doc_id", "text").join(maybe_broadcast(known), "doc_id").select("text", "label", turn.alias("turn"))
    # an id may stand for any number of rows
    rows = sample(rows, "turn", F.coalesce(F.octet_length("text"), F.lit(0)), most_rows, most_bytes).distinct()
    ready = rows.mapInArrow(_featurize, "label int, turn bigint, features array<int>")
    with small_batches(docs.sparkSession):
        found = ready.repartition(1).mapInArrow(_fit(epochs), "bucket bigint, weight double").collect()
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    for r in found:
        if r.bucket >= 0:
            weights[r.bucket] = r.weight
    return weights, next((r.weight for r in found if r.bucket < 0), -20.0)


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in runs(at, 1 << 19):
                bucket, row = _features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                hit = shared.value[bucket] != 0
                pairs = np.unique((row[hit] << BUCKET_BITS) | bucket[hit])
                total = np.bincount(pairs >> BUCKET_BITS, shared.value[pairs & ((1 << BUCKET_BITS) - 1)], j - i) + bias
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
