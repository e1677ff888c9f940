"""Every registered domain query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from scaffweave.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    frame = q.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = tables.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert ours == theirs


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(q.ORACLE_SQL)
