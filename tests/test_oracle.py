"""Every registered query that has SQL, against DuckDB over the same small tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from pagequarry.oracle import ORACLE_SQL
from pagequarry.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, db, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_runs(spark):
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        assert QUERIES[name](spark, SF).count() > 0
