"""Every registered query equals its DuckDB twin on the smoke data set."""

from __future__ import annotations

import json

import duckdb
import pytest

import __spark_entry__ as entry
from shopfloor import oracle, registry
from tests.conftest import SMOKE
from tools.check_oracle import TABLES, rows_of
from tools.plan_report import summary

QUERIES = registry.queries()
SQL = oracle.statements()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMOKE)
    a, ac = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.sql(SQL[name])
    b, bc = rows_of(res.columns, res.fetchall())
    assert ac == bc
    assert sorted(a, key=repr) == sorted(b, key=repr)
    plan = summary(df._jdf.queryExecution().executedPlan().toString())
    assert plan["nested_loop"] == 0


def test_json_documents_hold_the_rows(spark):
    docs = {r.machine_uid: json.loads(r.json) for r in QUERIES["machine_complete_nested"](spark, SMOKE).collect()}
    flat = QUERIES["machine_complete"](spark, SMOKE).collect()
    assert len(docs) == len(flat)
    for r in flat:
        d = docs[r.machine_uid]
        assert d["machine_data"]["machine_status"] == r.machine_status and d["oee_data"]["oee"] == r.oee
        assert d["production_data"]["produced_reels"] == r.produced_reels
    rows = {r.machine_uid: json.loads(r.json) for r in QUERIES["machine_catalog_json"](spark, SMOKE).collect()}
    assert rows == {r.machine_uid: {k: v for k, v in r.asDict().items() if v is not None}
                    for r in QUERIES["machine_catalog"](spark, SMOKE).collect()}


@pytest.mark.parametrize("name", sorted(registry.SCOPED))
def test_scoped_results_hold_no_other_tenant(spark, name):
    mine = {r.machine_id: r.machine_uid for r in QUERIES["machine_lookup"](spark, SMOKE).collect() if r.company_id == "1"}
    known = set(mine) | set(mine.values())
    key = lambda r: r["machine_id"] if "machine_id" in r else r["machine_uid"]
    assert {key(r) for r in QUERIES[f"{name}_tenant"](spark, SMOKE).collect()} <= known
    assert {key(r) for r in QUERIES[f"{name}_machine"](spark, SMOKE).collect()} <= {"1", "M1"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "oee" in df.columns
