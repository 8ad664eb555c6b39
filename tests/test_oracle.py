"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from skeinrank.plans import oracle, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    return "nan" if math.isnan(x) else f"{float(x):.5f}"


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got = queries.queries()[name](spark, DIR)
    want = db.sql(oracle.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_query_has_rows(spark, name):
    assert queries.queries()[name](spark, DIR).count() > 0
