import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, node string, hash long, c int, label string, own_hash string, own_md5 int, mix_size string, mix_words string, cf_text string, cf_score string, h string"


def rows_of(texts, ids=None, langs=None, sources=None):
    """Document rows with columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t or ""), 7, "n", 3, 1, "x", "o", 5, "m", "w", "t", "s", "h") for k, (i, t) in enumerate(zip(ids, texts))]


@pytest.fixture(scope="session")
def docs(spark):
    return lambda texts, **more: spark.createDataFrame(rows_of(texts, **more), SCHEMA)


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "rho", "sigma", "tau", "phi", "Über", "chi", "psi", "omega", "kappa", "mu", "nu", "x1"]
    return lambda n, seed=None: " ".join((random.Random(seed) if seed is not None else rng).choices(words, k=n))
