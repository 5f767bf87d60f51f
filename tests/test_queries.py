"""Every registered query against SQL of its own, on the smallest tables."""

import os

import duckdb
import pytest

from glyphmill.plans import catalog
from glyphmill.plans.adapters import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    cur = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    want = sorted(repr([r[names.index(c)] for c in cols]) for r in cur.fetchall())
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
