"""Every query with SQL agrees with it on the smallest tables; the others run."""

import glob
import os
from functools import cache

import duckdb
import pytest

import __spark_entry__ as entry
from docweave.plans import catalog

SF = "/root/testdata/sf0.001"
# Its SQL picks for each quantile by itself, which needs quantiles that lie apart.
LARGER = {"near_quantiles": "/root/testdata/sf0.01"}


@cache
def tables(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    folder = LARGER.get(name, SF)
    found = catalog.QUERIES[name](spark, folder).toPandas()
    if name not in catalog.ORACLES:
        assert len(found.columns)
        return
    expected = tables(folder).sql(catalog.ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    flat = lambda df: sorted(map(tuple, df[columns].astype(str).itertuples(index=False)))
    assert flat(found) == flat(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
