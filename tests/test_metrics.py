"""Metrics against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import metrics, neighbours, pairs, profiles, sampling
from quern.operators.ordered import before, midrank, numbered, quantiles

Y = [0, 1, 1, 0, 1, 0, 0, 1]
A = [0.25, 0.95, 0.25, 0.5, 0.5, 0.5, 0.05, 0.75]
B = [0.5, 0.75, 0.5, 0.25, 0.95, 0.05, 0.15, 0.25]


def frame(spark, y, a, b):
    return spark.createDataFrame([(i, *map(float, r[1:]), int(r[0])) for i, r in enumerate(zip(y, a, b, strict=True))], "id long, a double, b double, y int")


def credit(one, zero):
    return 1.0 if one > zero else 0.5 if one == zero else 0.0


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(8)
    y = [rng.randint(0, 1) for _ in range(160)]
    return y, [rng.randint(0, 12) / 10 for _ in y], [rng.randint(0, 12) / 10 for _ in y]


def test_auc_with_ties_and_weights(spark, noisy):
    y, a, b = noisy
    w = [i % 5 for i in range(len(y))]
    num = sum(w[i] * w[j] * credit(a[i], a[j]) for i in range(len(y)) for j in range(len(y)) if y[i] > y[j])
    den = sum(w[i] * w[j] for i in range(len(y)) for j in range(len(y)) if y[i] > y[j])
    got = metrics.auc(frame(spark, y, a, b), "a", weight=F.col("id") % 5).first()
    assert abs(got["auc"] - num / den) < 1e-12 and got["pairs"] == den


def test_auc_of_one_class_is_null(spark):
    assert metrics.auc(frame(spark, [1, 1], [0.1, 0.2], [0, 0]), "a").first()["auc"] is None


def test_placements_and_delong(spark):
    df = frame(spark, Y, A, B)
    got = {r["id"]: r["v"] for r in metrics.placements(df, "a", "v").collect()}
    ones, zeros = ([i for i in range(8) if Y[i] == k] for k in (1, 0))
    for i in ones:
        assert got[i] == np.mean([credit(A[i], A[j]) for j in zeros])
    for j in zeros:
        assert got[j] == np.mean([credit(A[i], A[j]) for i in ones])
    d = {k: [np.mean([credit(s[i], s[j]) for j in zeros]) for i in ones] for k, s in (("a", A), ("b", B))}
    e = {k: [np.mean([credit(s[i], s[j]) for i in ones]) for j in zeros] for k, s in (("a", A), ("b", B))}
    se = np.sqrt(sum(np.var(np.subtract(x["b"], x["a"]), ddof=1) / 4 for x in (d, e)))
    row = metrics.delong(df, "a", "b").first()
    assert abs(row["se"] - se) < 1e-12 and abs(row["delta"] - (np.mean(d["b"]) - np.mean(d["a"]))) < 1e-12


def test_equal_scores_have_no_error(spark):
    row = metrics.delong(frame(spark, [0, 1, 0, 1], [0.1, 0.1, 0.8, 0.7], [0.1, 0.1, 0.8, 0.7]), "a", "b").first()
    assert (row["se"], row["delta"], row["p"]) == (0.0, 0.0, 1.0)


def test_holm(spark):
    rows = spark.createDataFrame([("x", 0.02), ("y", 0.5), ("z", 0.004), ("w", 0.015)], "t string, p double")
    got = {r["t"]: round(r["p_holm"], 12) for r in metrics.holm(rows, "p", "t").collect()}
    assert got == {"z": 0.016, "w": 0.045, "x": 0.045, "y": 0.5}


def test_total_variation(spark):
    a, b, c = (spark.createDataFrame([(v,) for v in values], "v string") for values in ("ppqr", "pqqs", "st"))
    assert metrics.total_variation(a, b, "v").first()["tv"] == 0.5
    assert metrics.total_variation(a, c, "v").first()["tv"] == 1.0
    assert metrics.total_variation(a, a, "v").first()["tv"] == 0.0


@pytest.mark.parametrize("case", ["tied", "noisy"])
def test_rescue_and_damage(spark, noisy, case):
    y, a, b = (Y, A, B) if case == "tied" else noisy
    change = [credit(b[i], b[j]) - credit(a[i], a[j]) for i in range(len(y)) for j in range(len(y)) if y[i] > y[j]]
    row = pairs.rescue_damage(frame(spark, y, a, b), "a", "b").first()
    assert row["rescue"] == sum(c for c in change if c > 0) and row["damage"] == -sum(c for c in change if c < 0)
    back = pairs.rescue_damage(frame(spark, y, b, a), "a", "b").first()
    assert (back["rescue"], back["damage"]) == (row["damage"], row["rescue"])
    best = [max(credit(b[i], b[j]), credit(a[i], a[j])) for i in range(len(y)) for j in range(len(y)) if y[i] > y[j]]
    assert abs(row["oracle_auc"] - np.mean(best)) < 1e-12


def test_running_sums_do_not_depend_on_ranges(spark, noisy):
    y, a, b = noisy
    got = before(frame(spark, y, a, b), "a", {"n": F.lit(1)}, ["y"]).collect()
    for r in got:
        assert r["n_before"] == sum(1 for v, k in zip(a, y, strict=True) if k == r["y"] and v < r["a"])
        assert r["n_all"] == y.count(r["y"])


def test_midrank(spark):
    got = {r["id"]: r["k"] for r in midrank(frame(spark, Y, A, B), "a", "k").collect()}
    assert [got[i] for i in range(8)] == [2.5, 8.0, 2.5, 5.0, 5.0, 5.0, 1.0, 7.0]


def test_nulls_lose_no_row(spark):
    rows = [(1, "a", 1.0), (2, None, 2.0), (3, "a", None), (4, None, None), (5, None, 2.0)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    got = {r["id"]: (r["r"], r["r_of"]) for r in midrank(df, "v", "r", ["k"]).collect()}
    assert got == {1: (1.0, 1), 2: (1.5, 2), 3: (None, None), 4: (None, None), 5: (1.5, 2)}
    stats = {r["id"]: (r["g_n"], r["g_median"]) for r in profiles.group_stats(df, "k", "v").collect()}
    assert stats == {1: (2, 1.0), 2: (3, 2.0), 3: (2, 1.0), 4: (3, 2.0), 5: (3, 2.0)}
    assert quantiles(df, "v", {"q": 0.75}).first()["q"] == 2.0 and quantiles(df.limit(0), "v", {"q": 0.5}).first()["q"] is None


def test_numbers_run_over_ranges(spark):
    values = spark.range(1000).select((F.col("id") * 7919 % 1000).cast("string").alias("v"))
    got = {r["v"]: r["n"] for r in numbered(values, "v", "n").collect()}
    assert got == {v: k for k, v in enumerate(sorted(map(str, range(1000))))}


def test_nearest_with_repeated_points(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (50, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, v array<double>, y int")
    got = {}
    for r in neighbours.knn(df, df, 5).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["ref"])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for i in range(50):
        assert got[i] == sorted((j for j in range(50) if j != i), key=lambda j: (d[i, j], j))[:5]


def test_cells_exclude_no_neighbour(spark, monkeypatch):
    """Clustered points in many cells, with labels that must agree and folds that must differ."""
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 3))[rng.integers(0, 6, 160)] * 5 + rng.normal(size=(160, 3))
    df = spark.createDataFrame([(i, v.tolist(), i % 2, i % 5) for i, v in enumerate(x)], "id long, v array<double>, y int, fold int")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for same, apart in ((None, None), ("y", "fold")):
        got = {}
        for r in neighbours.knn(df, df, 4, same=same, apart=apart).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append(r["ref"])
        for i in range(160):
            fits = [j for j in range(160) if j != i and (not same or (i - j) % 2 == 0) and (not apart or (i - j) % 5)]
            assert got[i] == sorted(fits, key=lambda j: (d[i, j], j))[:4]


def test_group_figures_stand_at_their_rows(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 5.0), (3, "a", 3.0)], "id long, k string, v double")
    got = {r["id"]: (r["g_n"], r["g_mean"], r["g_median"], r["g_range"]) for r in profiles.group_stats(df, "k", "v").collect()}
    assert got == {1: (2, 2.0, 2.0, 2.0), 2: (1, 5.0, 5.0, 0.0), 3: (2, 2.0, 2.0, 2.0)}


def test_poisson_weights_have_mean_one(spark):
    df = spark.range(4000).withColumnRenamed("id", "id")
    times = [r["times"] for r in sampling.bootstrap(df, 2, "s").collect()]
    assert abs(sum(times) / 8000 - 1) < 0.05


def test_fewer_pairs_are_met_as_rows_grow(spark, monkeypatch):
    for name, value in (("BLOCK", 32), ("CELLS", 16), ("LEAVES", 32)):
        monkeypatch.setattr(neighbours, name, value)
    rng, shares = np.random.default_rng(1), []
    centres = rng.random((40, 5)) * 10
    for n in (300, 2400):
        x = centres[rng.integers(0, 40, n)] + rng.normal(0, 0.3, (n, 5))
        x[: n // 10] = x[0]  # equal vectors
        df = spark.createDataFrame([(i, None if i % 50 == 49 else v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
        account = {}
        found = neighbours.knn(df.where("id % 7 = 0"), df, 4, account=account).collect()
        shares.append(account["met"] / account["all"])
        real = np.array([i % 50 != 49 for i in range(n)])
        for i in (i for i in range(0, n, 7) if real[i]):
            d = ((x - x[i]) ** 2).sum(axis=1)
            d[i], d[~real] = np.inf, np.inf
            assert [r["ref"] for r in sorted(found, key=lambda r: r["rank"]) if r["id"] == i] == np.lexsort((np.arange(n), d))[:4].tolist()
        assert all(real[r["id"]] and real[r["ref"]] for r in found)
    assert shares[1] < 0.6 * shares[0]
