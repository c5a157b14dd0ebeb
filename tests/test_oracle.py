"""Every query with SQL against DuckDB on the smallest tables, and every other query for rows."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from sylvastack.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, db, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got
    if name in ORACLE_SQL:
        rel = db.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
