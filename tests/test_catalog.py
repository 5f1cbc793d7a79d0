"""Every catalog query against its oracle, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from scrubwell.plans import catalog

SF = "/root/testdata/sf0.001"


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(frame, columns):
    return sorted(tuple(shown(r[c]) for c in columns) for r in frame)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, oracle, name):
    df = catalog.queries()[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert got
        return
    result = oracle.execute(sql)
    columns = [c[0] for c in result.description]
    expected = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
    assert sorted(columns) == sorted(df.columns)
    assert rows(got, sorted(columns)) == rows(expected, sorted(columns))
