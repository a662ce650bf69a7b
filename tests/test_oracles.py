"""Every registered query against its DuckDB statement, on the smallest tables."""

import os

import duckdb
import pytest

from kelpie.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(v[i] for i in order) for v in values], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
