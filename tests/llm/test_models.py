"""Held-out accuracy of the three models, and rows that they must bear."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeflux.llm import language, quality, toxicity

ALL = True


def test_toxicity_learns_words(spark, docs, prose):
    rng = random.Random(1)
    labels, texts = [], []
    for _ in range(400):
        bad = rng.random() < 0.3
        words = prose(40).split()
        if bad:
            words[rng.randrange(40)] = rng.choice(["vile", "nasty"])
        texts.append(" ".join(words))
        labels.append(int(bad))
    texts += [None, "", "..."]
    frame = docs(texts)
    known = spark.createDataFrame([*enumerate(labels), (9999, 1), (None, 1), (400, None)], "doc_id long, toxic int")
    weights, bias = toxicity.train(frame, known, "toxic", F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(frame, weights, bias).collect()}
    held = [i for i in range(0, 400, 4)]
    assert np.mean([(got[i] >= 0.5) == labels[i] for i in held]) >= 0.97 and got[400] == got[401] == got[402] < 0.5
    assert (weights != 0).sum() < 5000


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    weights, bias = toxicity.train(docs(["a b"]), none, "toxic", F.lit(ALL))
    assert toxicity.score(docs(["a b", None]), weights, bias).where("score < 0.5").count() == 2
    assert toxicity.score(docs(["a"]).limit(0), weights, bias).count() == 0


def test_quality_from_positives_alone(spark, docs, prose):
    rng = random.Random(2)
    good = [prose(rng.randint(30, 80)).capitalize() + "." for _ in range(300)]
    junk = [" ".join(w + rng.choice(["###", "$$$", "!!"]) for w in prose(40).split()) for _ in range(60)] + [" ".join([prose(1)] * 50) for _ in range(40)]
    frame = docs([*good, *junk, None, ""])
    known = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)], "doc_id long, quality int")
    weights, share = quality.train(frame, known, "quality", F.lit(ALL), steps=150)
    assert 0.55 < share < 0.9
    got = {r.doc_id: r.score for r in quality.score(frame, weights).collect()}
    assert np.mean([got[i] >= 0.3 for i in range(1, 300, 2)]) >= 0.97 and np.mean([got[i] < 0.3 for i in range(300, 400)]) >= 0.9
    kept = quality.keep_good(frame, weights)
    assert kept.columns == frame.columns and 290 <= kept.count() < 330


def test_quality_without_labels(spark, docs):
    weights, _ = quality.train(docs(["a"]), spark.createDataFrame([], "doc_id long, quality int"), "quality", F.lit(ALL))
    assert [r.score for r in quality.score(docs(["a", None]), weights).collect()] == [0.5, 0.5]
    assert quality.score(docs(["a"]).limit(0), weights).count() == 0


SOUNDS = {"aa": ["bada", "gado", "dabo"], "ee": ["lire", "nile", "reli"], "oo": ["kutz", "zuk", "tuzk"], "uu": ["çéà", "éçà", "àçé"]}


def test_language_codes(docs):
    rng = random.Random(3)
    langs = [rng.choice(list(SOUNDS)) for _ in range(200)]
    texts = [" ".join(rng.choices(SOUNDS[g], k=12)) for g in langs] + [None, "", "123 ... 456", "Bada gado"]
    frame = docs(texts, langs=[*langs, "aa", None, "ee", None])
    model = language.train(frame, F.col("doc_id") % 3 != 1, steps=60)
    got = {r.doc_id: r for r in language.predict(frame, model).collect()}
    assert np.mean([got[i].lang_pred == langs[i] for i in range(1, 200, 3)]) == 1
    assert [got[i].lang_pred for i in (200, 201, 202, 203)] == ["und", "und", "und", "aa"] and got[200].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_rows(docs):
    none = language.train(docs(["a"], langs=[None]), F.lit(ALL))
    assert [r.lang_pred for r in language.predict(docs(["a"]), none).collect()] == ["und"]
    one = language.train(docs(["abc"], langs=["xx"]), F.lit(ALL))
    assert [r.lang_pred for r in language.predict(docs(["abc", "1"]), one).collect()] == ["xx", "und"]


@pytest.mark.parametrize("n", [2, 4, 6, 9])
def test_codewords_stand_apart(n):
    codes = language.codewords(n)
    assert len({tuple(c) for c in codes}) == n and min((a != b).sum() for i, a in enumerate(codes) for b in codes[:i]) >= (1 if n == 2 else codes.shape[1] // 4)


def test_ftrl_is_the_plain_rule(monkeypatch):
    """The vectorised learner against one coordinate at a time."""
    import math

    monkeypatch.setattr(toxicity, "L1", 0.4)
    rng = random.Random(9)
    rows = [(rng.random() < 0.4, np.array(sorted(rng.sample(range(12), 4)), np.int32)) for _ in range(80)]
    z, n = [0.0] * 13, [0.0] * 13
    weight = lambda i: 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    bias = lambda: -z[12] / ((toxicity.BETA + math.sqrt(n[12])) / toxicity.ALPHA)
    for _ in range(2):
        for y, x in rows:
            w = {i: weight(i) for i in x.tolist()}
            b = bias()
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for i, wi in [*w.items(), (12, b)]:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - s * wi
                n[i] += g * g
    got, at = toxicity.ftrl(rows, 2)
    assert got[:12] == pytest.approx([weight(i) for i in range(12)]) and at == pytest.approx(bias())


def test_best_cut_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for _ in range(30):
        m, y = rng.integers(-5, 5, 20) / 2, rng.random(20) < 0.4
        f1 = lambda c: 2 * ((m >= c) & y).sum() / max(1, (m >= c).sum() + y.sum())
        assert f1(toxicity.best_cut(m, y)) == max(f1(c) for c in m)


def test_risk_step_is_the_risk_gradient():
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (50, 4))
    loss = lambda x: np.log1p(np.exp(-x))

    def parts(w, share):
        return share * loss(p @ w).mean(), loss(-(u @ w)).mean() - share * loss(-(p @ w)).mean()

    for share, scale in ((0.3, 0.5), (0.9, 3.0)):
        w = rng.normal(0, scale, 4)
        use = (lambda v: sum(parts(v, share))) if parts(w, share)[1] >= 0 else (lambda v: -parts(v, share)[1])
        slope = [(use(w + h) - use(w - h)) / 2e-6 for h in np.eye(4) * 1e-6]
        assert quality.risk_gradient(w, p, u, share) == pytest.approx(slope, abs=1e-4)


def test_decoding_by_the_loss_of_each_codeword():
    codes, trust = language.codewords(4), np.linspace(0.5, 2, 7)
    margins = np.random.default_rng(4).normal(0, 2, (20, 7))
    best, top, close = language.decode(margins, codes, trust)
    for row, b in zip(margins, best):
        losses = [sum(t * np.log1p(np.exp(-c * m)) for t, c, m in zip(trust, code, row)) for code in codes]
        assert losses[b] == min(losses)
    assert ((0 < top) & (top <= 1)).all() and close.tolist() == (top < language.AMBIGUOUS).tolist()


@pytest.mark.parametrize("ids", [[None] * 6, [1, 1, 1, 2, None, 3]])
def test_models_bear_awkward_rows(spark, docs, ids):
    texts = ["vile " * 30_000, "good words here", "good words here", None, "", "plain text"]
    frame = docs(texts, ids=ids, langs=["aa", "bb", None, "aa", "bb", "aa"])
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0), (3, 0, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    weights, bias = toxicity.train(frame, labels, "toxic", F.lit(ALL))
    assert all(0 <= r.score <= 1 for r in toxicity.score(frame, weights, bias).collect()) and toxicity.score(frame, weights, bias).count() == 6
    good, share = quality.train(frame, labels, "quality", F.lit(ALL), steps=10)
    assert quality.score(frame, good).count() == 6 and 0 < share < 1
    found = language.predict(frame, language.train(frame, F.lit(ALL), steps=5)).collect()
    assert len(found) == 6 and sum(r.lang_pred == "und" for r in found) >= 2


def test_samples_hold_what_they_promise(spark):
    from codeflux.llm.common import sample

    rows = spark.range(20_000).select(F.xxhash64("id").alias("turn"))
    assert 800 < sample(rows, "turn", F.lit(1), 1000, 1 << 40).count() < 1200 and 80 < sample(rows, "turn", F.lit(10), 1000, 1000).count() < 120
    assert sample(rows, "turn", F.lit(1), 20_000, 1 << 40).count() == 20_000
