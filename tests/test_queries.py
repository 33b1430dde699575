"""Every query with SQL, against DuckDB on the smallest tables; and how plans reach the files."""

import os

import duckdb
import numpy as np
import pytest

from quern import plans
from quern.sources.tables import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return c


def text(df):
    one = lambda v: "" if v is None or str(v) in ("<NA>", "NaT", "nan") else f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_its_sql(spark, con, name):
    want, got = con.sql(plans.SQL[name]).df(), plans.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert text(got) == text(want)


def test_scans_are_pruned_and_filtered(spark):
    plan = table(spark, DATA, "lineitem").where("l_quantity > 40").select("l_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan
