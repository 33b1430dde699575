"""Compositions against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import blending, folds, models, screens


def credit(one, zero):
    return 1.0 if one > zero else 0.5 if one == zero else 0.0


def auc(y, s):
    pairs = [(i, j) for i in range(len(y)) for j in range(len(y)) if y[i] > y[j]]
    return sum(credit(s[i], s[j]) for i, j in pairs) / len(pairs)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    return [(i, rng.randint(0, 1), rng.randint(1, 9) / 10, rng.randint(1, 9) / 10, "xyz"[i % 3]) for i in range(90)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, y int, a double, b double, g string")


def long(df):
    return df.select("id", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in ("a", "b")))))


def test_group_offsets_solve_their_equation(df, rows):
    for r in screens.group_offsets(df, "a", "g", 2.0).collect():
        own = [x for x in rows if x[4] == r["group"]]
        grad = sum(y - 1 / (1 + math.exp(-(round(math.log(a / (1 - a)), 4) + r["offset"]))) for _, y, a, _, _ in own) - 2.0 * r["offset"]
        assert abs(grad) < 1e-9


def test_marginal_gain(df, rows):
    y, a, b = ([r[k] for r in rows] for k in (1, 2, 3))
    got = {r["model"]: r for r in screens.marginal_gain(long(df), df.select("id", "y")).collect()}
    whole = auc(y, [round((p + q) / 2, 12) for p, q in zip(a, b, strict=True)])
    for m, other in (("a", b), ("b", a)):
        assert abs(got[m]["auc_without"] - auc(y, [round(v, 12) for v in other])) < 0.02
        assert abs(got[m]["gain"] + got[m]["auc_without"] - whole) < 0.02


def test_noise_ceiling_by_expectation(spark):
    """Against a simulation-free count: true labels 1 beat true labels 0 with chance c, equals with a half."""
    c, f, r = 0.8, 0.2, 0.3
    p1 = r * (1 - f) + (1 - r) * f
    a, b = r * (1 - f) / p1, r * f / (1 - p1)
    want = a * (1 - b) * c + a * b * 0.5 + (1 - a) * (1 - b) * 0.5 + (1 - a) * b * (1 - c)
    got = spark.range(1).select(screens.noise_ceiling(F.lit(c), F.lit(f), F.lit(r))).first()[0]
    assert abs(got - want) < 1e-12


def test_greedy_takes_the_best_first(df, rows):
    y, a, b = ([r[k] for r in rows] for k in (1, 2, 3))
    best = "a" if auc(y, a) >= auc(y, b) else "b"
    assert blending.greedy(long(df), df.select("id", "y"), 2, "prob")[0] == best


def test_out_of_fold_scores_ignore_own_labels(df):
    data = folds.stratified(df, 3, "s")
    flipped = data.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    one, two = ({r["id"]: r["score"] for r in models.out_of_fold(d, ["a", "b"], "logistic").where("fold = 1").collect()} for d in (data, flipped))
    assert one == pytest.approx(two, abs=1e-12) and len(one) > 20


def test_calibration_is_monotone(df):
    fit = df.select("id", "y", F.col("a").alias("score"))
    for f in (models.platt, models.isotonic):
        got = sorted((r["score"], r["calibrated"]) for r in f(fit, fit).collect())
        steps = [q[1] - p[1] for p, q in zip(got, got[1:], strict=False)]
        assert all(s >= -1e-12 for s in steps) or all(s <= 1e-12 for s in steps)
