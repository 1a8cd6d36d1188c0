"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from codeflux.plans.catalog import ORACLES
from codeflux.plans.catalog import QUERIES as CATALOG

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in CATALOG if n in ORACLES)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def cell(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sql, name):
    got = CATALOG[name](spark, SF)
    want = sql.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted([cell(v) for v in row] for row in want.fetchall()) == sorted([cell(r[c]) for c in columns] for r in got.collect())


def test_every_line_item_is_a_call_site(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate").collect()
    orders = {}
    for r in lines:
        orders.setdefault(r.l_orderkey, []).append((r.l_linenumber, r.l_partkey, r.l_suppkey, *r[4:]))
    want = {(a[2], b[2]) for rows in orders.values() for a, b in zip(sorted(rows), sorted(rows)[1:])}
    assert {(r.caller, r.callee) for r in CATALOG["call_edges"](spark, SF).collect()} == want


def test_chains_of_callers_by_brute_force(spark):
    """call_paths has no SQL: its chains stop at ten for each method."""
    calls = {}
    for r in CATALOG["program_calls"](spark, SF).collect():
        calls.setdefault(r.callee, set()).add(r.fq)

    def chains(tail):
        by = sorted(calls.get(tail[0], set()) - set(tail))
        if not calls.get(tail[0]):
            return [tail]
        return [c for b in by if len(tail) <= 8 for c in chains([b, *tail])]

    got = {}
    for r in CATALOG["call_paths"](spark, SF).collect():
        got.setdefault(r.fq, set()).add(r.path)
    assert len(got) > 100
    for fq, paths in got.items():
        every = sorted(chains([fq]), key=lambda c: (len(c), ">".join(c)))[:10]
        assert paths == {" > ".join(c) for c in every}


def test_findings_of_every_customer(spark, sql):
    found = CATALOG["lowered_findings"](spark, SF).select("fq").distinct().collect()
    modules = {r.fq.split(":")[0] for r in found}
    customers = sql.execute("select count(distinct o_custkey) from orders join lineitem on l_orderkey = o_orderkey where l_returnflag in ('R', 'A')").fetchone()[0]
    assert len(modules) > customers // 2


def test_lines_of_all_customers(spark, tmp_path):
    spark.createDataFrame([(899 + 900, 89)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(939,), (989,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = CATALOG["function_at_line"](spark, str(tmp_path)).collect()
    assert [(r.relpath, r.line, r.fq) for r in got] == [("39", 939, 1799)]


def test_structural_deltas_name_all_metrics(spark):
    rows = CATALOG["structural_deltas"](spark, SF).collect()
    keys = ["blocks", "branches", "exits", "cyclomatic", "max_nesting", "depdegree"]
    assert set(rows[0].asDict()) == {"fq", *[f"{side}_{k}" for side in ("old", "new") for k in keys]}
    assert all(any(r[f"old_{k}"] != r[f"new_{k}"] for k in keys) for r in rows)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
