"""Equal rows are one with a weight: fits over them are those over all rows."""

import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from quern.operators import blending, compositions, gates, models, sampling
from quern.operators.metrics import auc
from quern.operators.ordered import hashed_place
from quern.plans import composition_queries
from quern.sources import scratch

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        y = rng.randint(0, 1)
        rows.append((i, y, i % 3, float(rng.randint(0, 3) + y), float(rng.randint(0, 2))))
    return spark.createDataFrame(rows, "id long, y int, fold int, a double, b double").repartition(3).persist()


def plain(rows):
    return LogisticRegression(labelCol="y", regParam=1e-3, tol=1e-12).fit(models._assembled(rows.withColumn("y", F.col("y").cast("double")), FEATURES))


def test_a_logistic_fit_on_weights_is_that_on_rows(df):
    cells = models.weighed(df.withColumn("y", F.col("y").cast("double")), FEATURES)
    assert cells.count() < 40
    want, got = plain(df), models.logistic(cells, FEATURES)
    assert got.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), abs=1e-4) and got.intercept == pytest.approx(want.intercept, abs=1e-4)


def test_a_learning_curve_places_rows_once_and_fits_on_weights(df, monkeypatch):
    kept = []
    monkeypatch.setattr(gates, "stored", lambda d, n: kept.append((n, d.count())) or scratch.stored(d, n))
    got = {r["share"]: r for r in gates.learning_curve(df, FEATURES, [0.5, 0.25, 1.0], "s").collect()}
    assert [n for n, _ in kept] == ["placed", "cells"] and kept[1][1] < 200
    placed = hashed_place(df.withColumn("t", F.col("fold") != 0), ["t"], "s")
    for s in (0.25, 0.5, 1.0):
        fit = plain(placed.where(F.col("t") & (F.col("place") < int(600 * s))))
        scored = fit.transform(models._assembled(df.where("fold = 0"), FEATURES)).select("y", models.vector_to_array("probability")[1].alias("score"))
        assert got[s]["rows"] == int(600 * s) and got[s]["auc"] == pytest.approx(auc(scored, "score").first()["auc"], abs=1e-3)


def test_out_of_fold_fits_read_equal_rows_once(df, monkeypatch):
    kept = {}
    monkeypatch.setattr(models, "stored", lambda d, n: kept.setdefault(n, scratch.stored(d, n)))
    got = {r["id"]: r["score"] for r in models.out_of_fold(df, FEATURES, "logistic").collect()}
    assert kept["cells"].count() < 200
    for f in range(3):
        scored = plain(df.where(F.col("fold") != f)).transform(models._assembled(df.where(F.col("fold") == f), FEATURES))
        assert all(got[r["id"]] == pytest.approx(r["s"], abs=1e-4) for r in scored.select("id", models.vector_to_array("probability")[1].alias("s")).collect())


def test_votes_join_scores_and_labels_once(df):
    long = df.select("id", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), (F.col(m) / 8).alias("score")) for m in FEATURES))))
    out = compositions.voted(long, df.select("id", "fold", "y"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # before: two for each fold
    got = {r["id"]: r["score"] for r in out.collect()}
    for f in range(3):
        w = {m: max(auc(df.where(F.col("fold") != f), m).first()["auc"] - 0.5, 1e-6) for m in FEATURES}
        for r in df.where(F.col("fold") == f).collect():
            assert got[r["id"]] == pytest.approx(sum(w[m] * r[m] / 8 for m in FEATURES) / sum(w.values()), abs=1e-12)


def test_nested_greedy_is_a_hill_climb_in_each_fold_over_one_stored_table(df, monkeypatch):
    kept = []
    monkeypatch.setattr(gates, "stored", lambda d, n: kept.append(n) or scratch.stored(d, n))
    third = (F.col("b") + F.col("id") % 7) / 20
    long = df.select("id", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), s.alias("score")) for m, s in (("a", F.col("a") / 8), ("b", F.col("b") / 8), ("c", third))))))
    long = long.where("model <> 'c' or id % 5 > 0")  # a model without all rows
    out = gates.nested_greedy(long, df.select("id", "y", "fold"), 3)
    got = {r["id"]: r["score"] for r in out.collect()}
    assert kept == ["wide"] and out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0 and len(got) == 900
    for f in range(3):
        chosen = blending.greedy(long, df.where(F.col("fold") != f).select("id", "y"), 3)
        own = long.join(df.where(F.col("fold") == f).select("id"), "id")
        want = blending.blend(own.where(F.col("model").isin(*chosen)), {m: chosen.count(m) for m in chosen}, "logit")
        assert all(got[r["id"]] == pytest.approx(r["score"], abs=1e-12) for r in want.collect())


def test_arms_with_pseudo_labels_place_rows_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(composition_queries, "stored", lambda d, n: kept.append(n) or scratch.stored(d, n))
    assert composition_queries.g18_pseudo_labels(spark, "/root/testdata/sf0.001").count() == 3 and kept == ["numbers", "pseudo"]


def test_a_class_bootstrap_deals_more_rows_to_more_tasks(df, monkeypatch):
    want = sorted(map(tuple, sampling.class_bootstrap(df, 3, "s").select("draw", "id", "times", "a").collect()))
    monkeypatch.setattr(sampling, "TASK_ROWS", 50)
    out = sampling.class_bootstrap(df, 3, "s")
    assert out.rdd.getNumPartitions() == 72 and sorted(map(tuple, out.select("draw", "id", "times", "a").collect())) == want
    assert sum(r[2] for r in want) == 2700 and len({r[:2] for r in want}) == len(want)


def test_factorisation_machines_over_equal_rows_are_those_of_mllib(df, monkeypatch):
    kept = {}
    monkeypatch.setattr(models, "stored", lambda d, n: kept.setdefault(n, scratch.stored(d, n)))
    got = {r["id"]: r["score"] for r in models.out_of_fold(df, FEATURES, "factor").collect()}
    assert kept["cells"].count() < 200 and len(got) == 900  # before: no cells, all rows in each step
    rows = models._assembled(df.withColumn("y", F.col("y").cast("double")), FEATURES)
    for f in range(3):
        scored = models.MODELS["factor"](2).fit(rows.where(F.col("fold") != f)).transform(rows.where(F.col("fold") == f))
        assert all(got[r["id"]] == pytest.approx(r["s"], abs=1e-9) for r in scored.select("id", models.vector_to_array("probability")[1].alias("s")).collect())


@pytest.mark.parametrize("model", ["boosted", "stumps"])
def test_boosted_trees_over_equal_rows_are_those_over_all_rows(df, monkeypatch, model):
    kept = {}
    monkeypatch.setattr(models, "stored", lambda d, n: kept.setdefault(n, scratch.stored(d, n)))
    got = {r["id"]: r["score"] for r in models.out_of_fold(df, FEATURES, model).collect()}
    assert kept["cells"].count() < 200 and len(got) == 900  # before: no cells, all rows in each fit
    rows = models._assembled(df.withColumn("y", F.col("y").cast("double")), FEATURES)
    for f in range(2):
        scored = models.MODELS[model](2).fit(rows.where(F.col("fold") != f)).transform(rows.where(F.col("fold") == f))
        assert all(got[r["id"]] == pytest.approx(r["s"], abs=1e-9) for r in scored.select("id", models.vector_to_array("probability")[1].alias("s")).collect())


def test_bins_hold_few_values_apart_and_many_in_like_counts(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") > 0, F.col("id") % 500).cast("double").alias("many"), F.when(F.col("id") < 998, 1.0).when(F.col("id") < 999, 2.0).otherwise(float("nan")).alias("few"), F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("text"))
    rows = models.indexed(rows, ["text"])
    out = rows.withColumns(models.in_bins(rows, ["many", "few", "text_code"]))
    counts = {r[0]: r[1] for r in out.groupBy("many").count().collect()}
    assert counts.pop(0.0) == 1 and len(counts) == 32 and max(counts.values()) <= 34
    assert {r[0]: r[1] for r in out.groupBy("few").count().collect()} == {0.0: 1, 1.0: 998, 2.0: 1}
    assert out.schema["text_code"].metadata["ml_attr"]["type"] == "nominal" and models.weighed(out.withColumn("y", F.lit(1)), ["text_code"]).schema["text_code"].metadata == out.schema["text_code"].metadata


def test_a_forest_over_equal_rows_draws_rows_and_not_cells(df, monkeypatch):
    kept = {}
    monkeypatch.setattr(models, "stored", lambda d, n: kept.setdefault(n, scratch.stored(d, n)))
    got = {r["id"]: r["score"] for r in models.out_of_fold(df, FEATURES, "forest").collect()}
    cells = kept["cells"].select("_w", "_times").collect()  # before: no cells
    assert len(got) == 900 and len(cells) < 200 and abs(sum(sum(r[1]) for r in cells) - 36000) < 950
    assert 0.8 < sum((x - r[0]) ** 2 / r[0] for r in cells for x in r[1]) / (40 * len(cells)) < 1.2  # Poisson: the variance is the mean
    rows = models._assembled(df.withColumn("y", F.col("y").cast("double")), FEATURES)
    scored = models.MODELS["forest"](2).fit(rows.where("fold <> 0")).transform(rows.where("fold = 0")).select("id", models.vector_to_array("probability")[1].alias("s")).collect()
    assert sum(abs(got[r["id"]] - r["s"]) for r in scored) / len(scored) < 0.03
