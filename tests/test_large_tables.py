"""What larger tables bring: keys of more digits, teachers that are all twins."""

import duckdb
import pytest

from quern import plans
from quern.operators import models

DATA = "/root/testdata/sf0.001"


def test_a_teacher_of_twins_alone_scores_null(spark):
    rows = spark.createDataFrame([(i, i % 2, float(i % 3)) for i in range(30)], "id long, y int, a double")
    out = models.teacher(rows, rows, ["a"]).collect()
    assert sorted(r["id"] for r in out) == list(range(30)) and all(r["score"] is None for r in out)
    other = rows.union(spark.createDataFrame([(100, 0, 7.0), (101, 1, 9.0)], rows.schema))
    assert all(0 <= r["score"] <= 1 for r in models.teacher(other, rows, ["a"]).collect())


def test_nearest_keys_of_more_digits_than_may_differ(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"copy (select o_orderkey + k * 1000000 as o_orderkey, o_custkey + k * 40000 as o_custkey, * exclude (o_orderkey, o_custkey) from '{DATA}/orders.parquet', range(3) r(k)) to '{tmp_path}/orders.parquet'")
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    assert con.sql("select max(o_custkey) >= 6 ** 6 from orders").fetchall() == [(True,)]
    want = con.sql(plans.SQL["t12_nearest_key"] + " order by id").fetchall()
    got = plans.QUERIES["t12_nearest_key"](spark, str(tmp_path)).orderBy("id").collect()
    assert len(got) == len(want) and all(g[0] == w[0] and tuple(g)[1:] == pytest.approx(w[1:], abs=2e-6) for g, w in zip(got, want, strict=True))
