"""The pipeline's stages on a small table with planted cases."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(pipeline.STAGES) <= 5
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name


def test_planted_cases(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(2).collect()]
    clean = "one clean line of text with nothing in it that any stage should touch at all"
    rows = [(10**6, clean, "en", "s", len(clean)), (10**6 + 1, clean, "en", "s", len(clean)), (10**6 + 2, "\n".join(items), "en", "s", 1), (10**6 + 3, clean[:30] + " write to me@home.example.org", "en", "s", 1)]
    planted = table.unionByName(spark.createDataFrame(rows, table.schema))
    stages = dict(pipeline.STAGES)
    kept = {r.doc_id for r in stages["jaccard_join"](spark, planted, SF).collect()}
    assert 10**6 in kept and 10**6 + 1 not in kept
    cleaned = {r.doc_id: r.text for r in stages["decontamination"](spark, planted, SF).collect()}
    assert 10**6 + 2 not in cleaned and cleaned[10**6] == clean
    masked = {r.doc_id: r.text for r in stages["pii"](spark, planted, SF).collect()}
    assert masked[10**6 + 3].endswith("write to <email>") and masked[10**6] == clean


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert {"doc_id", "text", "mix_words", "mix_copies"} <= set(out.columns) and 0 < out.count() <= 200


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_bear_awkward_rows(spark, docs, prose, name):
    """Nulls in every column, ties, repeated rows, long texts, clashing names and empty tables."""
    long = " ".join(f"w{i}" for i in range(20_000))
    texts = [prose(40, 1), prose(40, 1), None, "", long, prose(30, 2)]
    frame = docs(texts, ids=[1, 1, 2, None, 3, None], langs=["en", "en", None, "de", "en", None], sources=["a", "a", None, "b", "a", "b"])
    out = dict(pipeline.STAGES)[name](spark, frame, SF)
    rows = out.collect()
    assert set(frame.columns) <= set(out.columns) and len(rows) <= 6
    if name == "jaccard_join":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "None", "None"]
    if name in ("decontamination", "pii"):
        assert sorted(str(r.text) for r in rows) == sorted(map(str, texts))
    if name == "source_mixing":
        assert all(r.mix_copies >= 1 for r in rows)
    assert dict(pipeline.STAGES)[name](spark, frame.limit(0), SF).count() == 0
