import importlib.util
import os

import duckdb
import pytest

from leafmill.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("pages", "documents", "conversations"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = con.sql(registry.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(repr, df[columns].astype(str).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.QUERIES) <= set(e.queries())
    if importlib.util.find_spec("leafmill.llm") is None:
        assert set(e.queries()) == set(registry.QUERIES)
