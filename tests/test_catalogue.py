"""Every query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from cairnflow.plans import catalogue
from cairnflow.session import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def plain(df, columns):
    def one(x):
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
            return str(list(x))
        if x is None or (not isinstance(x, str) and pd.isna(x)):
            return ""
        if isinstance(x, float):
            return str(int(x)) if math.isfinite(x) and x == int(x) else repr(round(x, 5))
        return str(x)

    return sorted(tuple(one(x) for x in row) for row in df[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        want = con.sql(catalogue.ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert plain(got, columns) == plain(want, columns)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["cacheId", "tagKey", "tagValue", "createdDate"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    """An entry's rows, and a grid's window, are read with pushed filters and few columns."""
    from cairnflow.operators import grid as g

    cells = spark.read.schema("layer int, row int, col int, value double")
    plan = g.crop(cells.parquet(f"{SF}/part.parquet"), g.Grid(100, 20, g.Extent(0, 20, -100, 0)), g.Extent(5, 15, -30, -10))[0]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row" in plan and "PushedFilters" in plan
    plan = catalogue.tags(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
