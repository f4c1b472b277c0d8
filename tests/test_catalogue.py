"""Every query with SQL gives the rows of the SQL on the smallest data."""

import os

import duckdb
import pytest

from tracefold.plans import catalogue

DATA = "/root/testdata/sf0.001"


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    cur = con.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    df = catalogue.QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns) and sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    assert sorted(tuple(map(norm, r)) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
