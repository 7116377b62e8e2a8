"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math

import pytest

import __spark_entry__ as engine
from callweave.plans import catalog

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.6g}"
    return str(v)


def frames(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sql, name):
    got = engine.queries()[name](spark, SF)
    want = sql.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert frames(got.columns, got.collect()) == frames(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert engine.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    assert engine.entry(spark).count() > 0
