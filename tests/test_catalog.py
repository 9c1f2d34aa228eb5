"""Every registered query with SQL against DuckDB; the others must give rows."""

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def canonical(row):
    out = []
    for v in row:
        if isinstance(v, float):
            v = None if math.isnan(v) else round(v, 5) + 0.0
        out.append(str(v) if not isinstance(v, (int, float, bool, type(None))) else v)
    return repr(out)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    if name not in ORACLES:
        assert got.count() > 0
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    at = [names.index(c) for c in order]
    assert sorted(canonical([r[c] for c in order]) for r in got.collect()) == sorted(canonical([r[i] for i in at]) for r in want.fetchall())


def test_all_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
