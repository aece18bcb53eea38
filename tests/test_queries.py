"""Every registered query of the library against its SQL in DuckDB, value by value."""

import math
import os

import duckdb
import pytest

from scriptorium.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(cell(v) for v in r) for r in got.select(*columns).collect()), key=repr)
    if name not in registry.SQL:
        return
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(cell(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert len(rows) == len(expected)
    assert rows == expected
