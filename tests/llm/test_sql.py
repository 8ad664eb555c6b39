"""The queries with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from skeinrank.llm import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = registry.queries()[name](spark, DIR)
    want = db.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = want.select(", ".join(columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))
