import os

import duckdb
import pytest

from averis.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    got = sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in Q.QUERIES[name](spark, DATA).collect())
    want = sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in c.execute(Q.SQL[name]).fetchall())
    assert got == want
