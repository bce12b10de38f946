"""Every query of the core runs on the smallest tables and matches its SQL twin there."""

import glob
import math
import os

import pytest

from confab.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def canonical(df):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, float) or type(v).__name__.startswith("float") else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_twins_belong_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_twin(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_twin_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0
