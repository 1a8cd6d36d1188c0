"""The registered queries: their columns, their SQL where there is any, and what held-out rows say of the models."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from test_text_operators import SHAPES, base

import __spark_entry__
from codeflux.llm import oracles, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2_source_mixing": "doc_id size source_size target taken",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_exact_topk": "query_id rank vec_id score",
    "op6_language_codes": "doc_id held_out lang_pred score",
    "op7_quality_pu": "doc_id held_out score predicted",
    "op8_warc_bundles": "page_id payload_bytes payload_digest record_type refers_to",
    "op9_jaccard_join": "doc_id n_shingles component_id",
    "op10_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def cell(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def test_all_ten_and_the_pipeline_are_registered():
    assert set(queries.QUERIES) == set(COLUMNS) and set(COLUMNS) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, SF)
    want = sql.execute(oracles.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert set(COLUMNS[name].split()) <= set(columns) and sorted(columns) == sorted(got.columns)
    assert sorted([cell(v) for v in row] for row in want.fetchall()) == sorted([cell(r[c]) for c in columns] for r in got.collect())


def rows(spark, sql, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    found = got.collect()
    assert sorted(r.doc_id for r in found) == [r[0] for r in sql.execute("select doc_id from documents order by 1").fetchall()]
    return found


def test_personal_data_by_brute_force(spark, sql):
    texts = dict(sql.execute("select doc_id, text from documents").fetchall())
    kinds = list(SHAPES)
    for r in rows(spark, sql, "op3_pii"):
        spans = base(texts[r.doc_id])
        told = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores))
    return (rank[labels].sum() - labels.sum() * (labels.sum() - 1) / 2) / max(labels.sum() * (~labels).sum(), 1)


@pytest.mark.parametrize(("name", "label", "cut"), [("op4_toxicity", "toxic", 0.5), ("op7_quality_pu", "quality", 0.3)])
def test_scores_of_held_out_rows(spark, sql, name, label, cut):
    known = dict(sql.execute(f"select doc_id, {label} from labels where {label} is not null").fetchall())
    found = rows(spark, sql, name)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in found if r.doc_id in known and r.held_out]
    labels = np.array([known[r.doc_id] == 1 for r in held])
    if 2 <= labels.sum() < len(labels) - 1:
        assert auc(np.array([r.score for r in held]), labels) >= (0.9 if label == "quality" else 0.5)


def test_languages_of_held_out_rows(spark, sql):
    known = dict(sql.execute("select doc_id, lang from documents where lang is not null").fetchall())
    held = [r for r in rows(spark, sql, "op6_language_codes") if r.held_out and r.doc_id in known and r.lang_pred != "und"]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.lang_pred == known[r.doc_id] for r in held]) >= 0.9
