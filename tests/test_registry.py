"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from breakfold.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


def rows(records, cols):
    fix = lambda v: round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted(str([fix(r[c]) for c in cols]) for r in records)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.SQL])
def test_sql(spark, con, name):
    got = [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]
    rel = con.sql(registry.SQL[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    cols = sorted(rel.columns)
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["qid", "occ", "frq"]
