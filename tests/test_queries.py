"""Every core query with SQL agrees with it on the smallest tables; the rest give rows."""

import math
import os

import duckdb
import pytest

from averis.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES = {k: v for m in registry.modules() for k, v in m.QUERIES.items()}
SQL = {k: v for m in registry.modules() for k, v in m.SQL.items()}


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    return tuple(map(cell, v)) if isinstance(v, list) else int(v) if isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in cols]
    want = sorted((tuple(cell(float(r[i]) if r[i].__class__.__name__ == "Decimal" else r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-9)) for x, y in zip(a, b)), (a, b)
