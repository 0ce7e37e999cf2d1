"""Every registered query against its DuckDB oracle at sf0.001 (the driver's gate runs sf0.01)."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from conftest import SF_SMALL

TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _names():
    from memlake.plans import load_all
    q, o = load_all()
    return sorted(o)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, queries, con, name):
    q, o = queries
    sdf = q[name](spark, SF_SMALL)
    srows = sorted((tuple(_norm(x) for x in r) for r in sdf.collect()), key=repr)
    res = con.execute(o[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == sorted(sdf.columns)
    idx = [ocols.index(c) for c in sdf.columns]
    orows = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert srows == orows


def test_every_query_registered_has_docs_or_oracle(queries):
    q, o = queries
    assert len(q) >= 70
    missing = [n for n in q if n not in o]
    assert set(missing) <= {"kmeans_ml"}


def test_entry_smoke(spark):
    import importlib.util
    spec = importlib.util.spec_from_file_location(
        "spark_entry", os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    df = m.entry(spark)
    assert df.count() > 0
    assert set(m.oracle_sql()) <= set(m.queries())
