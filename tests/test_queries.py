"""Every named query against its SQL on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from trailweave.plans import catalog
from trailweave.sources import shared

DATA = os.environ.get("TRAILWEAVE_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    with shared.scratch(spark):
        got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert not shared.children(spark, shared.folder(spark))  # nothing that a query writes outlives it
    want = db.execute(catalog.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert got.equals(want)


def test_entry_module(spark):
    q, o = entry_module.queries(), entry_module.oracle_sql()
    assert set(catalog.QUERIES) <= set(q) and set(o) <= set(q)
