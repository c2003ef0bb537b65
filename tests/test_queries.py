"""Every query with SQL gives the same rows in Spark and DuckDB; the others run over whole tables."""

import math
import os

import duckdb
import pytest

from loomtext import catalog

DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        c.execute(f"create view {name.split('.')[0]} as select * from '{DIR}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    found = sorted(repr([plain(v) for v in r]) for r in df.select(columns).collect())
    result = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    order = [names.index(x) for x in columns]
    assert found == sorted(repr([plain(r[i]) for i in order]) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
