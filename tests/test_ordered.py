"""Sums before, ranks and samples by ranges, in one range and in many, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions.scalars import uniform
from quern.operators import ordered, sampling

ROWS = [(random.Random(k).choice([None, "g", "h"]), random.Random(-k).choice([None, *range(12)]), k % 4) for k in range(1, 120)]


@pytest.fixture(params=[1 << 18, 5], ids=["one", "many"])
def ranges(request, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", request.param)


def rows_of(spark, rows=ROWS):
    return spark.createDataFrame(rows, "g string, v int, w int")


def test_sums_before(spark, ranges):
    got = {(r["g"], r["v"]): (r["s"], r["s_before"], r["s_all"]) for r in ordered.before(rows_of(spark), "v", {"s": F.col("w")}, ["g"]).collect()}
    want = {}
    for g, v, _ in ROWS:
        if v is not None:
            own = [(x, w) for h, x, w in ROWS if h == g and x is not None]
            want[g, v] = (sum(w for x, w in own if x == v), sum(w for x, w in own if x < v), sum(w for _, w in own))
    assert got == want


def test_sums_of_decimals_keep_their_type(spark, ranges):
    out = ordered.before(rows_of(spark), "v", {"s": F.col("w").cast("decimal(10,2)")})
    last = max(out.collect(), key=lambda r: r["v"])
    known = [w for _, v, w in ROWS if v is not None]
    assert last["s_all"] == sum(known) and last["s_before"] == sum(w for _, v, w in ROWS if v is not None and v < last["v"])


def test_places_and_empty_tables(spark, ranges):
    values = rows_of(spark).where("v is not null").select("v").distinct()
    assert sorted(tuple(r) for r in ordered.numbered(values, "v", "k").collect()) == list(zip(range(12), range(12), strict=True))
    none = rows_of(spark, [])
    assert ordered.before(none, "v", {"s": F.col("w")}, ["g"]).count() == 0 and ordered.numbered(none.select("v"), "v", "k").count() == 0


@pytest.mark.parametrize("k", [0, 1, 17, 500])
def test_lowest_mean(spark, ranges, k):
    known = sorted(v for _, v, _ in ROWS if v is not None)[:k]
    got = ordered.lowest_mean(rows_of(spark), "v", k, "m").first()["m"]
    assert got == (pytest.approx(sum(known) / len(known)) if known else None)


@pytest.mark.parametrize("n", [0, 7, 33, 200])
def test_weighted_sample_is_the_head_of_all_draws(spark, ranges, n):
    df = spark.createDataFrame([(k, w) for k, (_, _, w) in enumerate(ROWS)], "id int, w int")
    df = df.union(df).union(df.where("id < 3").select(F.lit(None).cast("int"), "w"))
    draw = F.try_divide(-F.log(1 - uniform("s", F.col("id"))), F.col("w"))
    want = [tuple(r) for r in df.where("w > 0").withColumn("draw", draw).orderBy("draw", "id").collect()]
    assert sorted(map(str, (tuple(r) for r in sampling.weighted(df, n, "s", "w").collect()))) == sorted(map(str, want[:n]))
