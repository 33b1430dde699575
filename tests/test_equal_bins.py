"""Boosted fits that read rows of equal bins as one are those over all rows."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from quern.operators import models
from quern.sources import scratch

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        y, a, b = rng.randint(0, 1), float(rng.randint(0, 6)), float(rng.randint(0, 4))
        rows.append((i, y, i % 3, i % 7 == 0, a + 2 * y, b, a * b + rng.random(), a - b + rng.random() if i % 5 else None))
    return spark.createDataFrame(rows, "id long, y int, fold int, is_es boolean, a double, b double, s double, t double").repartition(3).persist()


@pytest.fixture
def kept(monkeypatch):
    found = {}
    monkeypatch.setattr(models, "stored", lambda d, n: found.setdefault(n, scratch.stored(d, n)))
    return found


def test_outputs_are_fitted_on_means_of_equal_bins(df, kept):
    got = {r["id"]: r for r in models.multi_output(df, ["s", "t"], FEATURES).collect()}
    assert len(got) == 900 and kept["cells"].count() <= 3 * 9 * 5  # before: all rows in each fit; targets have a value for each row
    rows = models._assembled(df, FEATURES)
    for t in ("s", "t"):
        taught = rows.where(F.col("fold") != 1).dropna(subset=[t])
        want = GBTRegressor(labelCol=t, maxDepth=3, maxIter=8, seed=7).fit(taught).transform(rows.where("fold = 1"))
        assert all(got[r["id"]][f"pred_{t}"] == pytest.approx(r["prediction"], abs=1e-9) for r in want.select("id", "prediction").collect())


def test_fits_that_stop_early_read_equal_bins_once(df, kept):
    scored, rounds = models.early_stopped(df, FEATURES, 6)
    got = {r["id"]: (r["y"], r["fold"], r["score"]) for r in scored.collect()}
    assert len(got) == 900 and kept["cells"].count() <= 3 * 2 * 2 * 9 * 5  # before: all rows in each fit
    rows = models._assembled(df.withColumn("y", F.col("y").cast("double")), FEATURES)
    grown = lambda n: GBTClassifier(labelCol="y", maxDepth=3, maxIter=n, stepSize=0.2, seed=7)
    best = []
    for f in range(3):
        other = rows.where(F.col("fold") != f)
        losses = grown(6).fit(other.where("not is_es")).evaluateEachIteration(other.where("is_es"))
        best.append(1 + losses.index(min(losses)))
    assert rounds == sorted(best)[1]
    want = grown(rounds).fit(rows.where("fold <> 2")).transform(rows.where("fold = 2")).select("id", "y", vector_to_array("probability")[1].alias("s"))
    for r in want.collect():
        assert got[r["id"]][:2] == (r["y"], 2) and got[r["id"]][2] == pytest.approx(r["s"], abs=1e-9)
