"""Every query of the catalog against its DuckDB twin (row count, column names,
order-insensitive values), at sf0.001 — the driver repeats this at sf0.01 —
and against the plan rules: no cross or nested-loop joins, no Python
evaluation, whole-stage codegen around the scans."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from farewise.plans.catalog import QUERIES as CATALOG
from farewise.plans.explain import plan_text

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")
QUERIES = {k: v for k, v in entry.queries().items() if k in CATALOG}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in CATALOG}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "nation", "region", "customer", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    plan = plan_text(df, "formatted")  # the final AQE plan, after execution
    for op in FORBIDDEN:
        assert op not in plan, f"{name} uses {op}"
    if "Scan parquet" in plan:
        assert "codegen id" in plan, f"{name} has no codegen span"
    cur = duck.execute(ORACLES[name])
    o_cols, o_rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert len(s_rows) == len(o_rows)
    assert _canon(s_cols, s_rows) == _canon(o_cols, o_rows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 3
    assert df.columns == ["rank", "centroid_long", "centroid_lat", "avg_revenue", "avg_tip",
                          "trips", "distance_mi", "expected_price"]
