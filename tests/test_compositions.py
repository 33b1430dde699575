"""Compositions on small tables: no row learns from its own fold, and results repeat."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import compositions, folds
from quern.operators.metrics import auc


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        y = rng.randint(0, 1)
        good = min(0.99, max(0.01, 0.5 + (y - 0.5) * 0.5 + rng.gauss(0, 0.2)))
        rows.append((i, y, good, rng.random(), [rng.random(), rng.random()], "uv"[i % 2], float(i % 9) if i % 5 else None))
    return folds.stratified(spark.createDataFrame(rows, "id long, y int, a double, b double, v array<double>, g string, x double"), 3, "s").persist()


def long(df):
    return df.select("id", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in ("a", "b")))))


def test_neighbours_are_nearest_of_other_folds(df):
    rows = {r["id"]: r for r in df.collect()}
    got = {}
    for r in compositions.fold_safe_knn(df, 3, F.col("id") % 4 != 0).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["ref"]))
    for i, r in rows.items():
        dist = sorted((sum((p - q) ** 2 for p, q in zip(r["v"], o["v"], strict=True)), j) for j, o in rows.items() if o["fold"] != r["fold"] and j % 4)
        assert [j for _, j in sorted(got[i])] == [j for _, j in dist[:3]]


def test_selections_prefer_the_better_model(df):
    assert compositions.maximin(long(df), df, 2)[0] == "a"
    labels = df.select("id", "y", "fold")
    better = auc(df, "b").first()["auc"]
    for scored in (compositions.top_stack(long(df), labels, 1), compositions.voted(long(df), labels), compositions.region_gate(long(df), labels, 3)):
        assert scored.count() == 200 and scored.select("id").distinct().count() == 200
        assert auc(scored, "score").first()["auc"] > better


def test_a_fold_is_not_judged_by_its_own_labels(df):
    labels = df.select("id", "y", "fold")
    turned = labels.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    for f in (lambda x: compositions.top_stack(long(df), x, 1), lambda x: compositions.voted(long(df), x), lambda x: compositions.region_gate(long(df), x, 3)):
        one, two = ({r["id"]: round(r["score"], 9) for r in f(x).where("fold = 0").collect()} for x in (labels, turned))
        assert one == two


def test_shuffle_moves_values_and_keeps_them(df):
    moved = compositions.shuffled(df, "a", "s")
    one, two = ({r["id"]: r["a"] for r in x.collect()} for x in (df, moved))
    assert sorted(one.values()) == sorted(two.values()) and one != two
    assert moved.columns == df.columns


def test_external_and_pseudo_rows(df):
    scored = compositions.with_external(df.where("id < 150"), df.where("id >= 150"), ["a"], 0.5)
    assert sorted(r["id"] for r in scored.collect()) == list(range(150))
    new = compositions.pseudo_labelled(df.where("fold > 0"), df.where("fold = 0"), "a", 0.2, "s").where("added").collect()
    fold = df.where("fold = 0").count()
    assert 0 < len(new) <= 0.4 * fold + 2 and all((r["a"] > 0.5) == bool(r["y"]) for r in new)


def test_prepared_columns(df):
    out = compositions.prepared(df, ["g"], ["x"], ["x"])
    row = out.agg(F.avg("z_x").alias("m"), F.stddev_pop("z_x").alias("s"), F.sum("missing_x").alias("n"), F.max("code_g").alias("c")).first()
    assert abs(row["m"]) < 1e-9 and abs(row["s"] - 1) < 1e-9 and row["n"] == 40 and row["c"] == 1


def test_subspaces_repeat_and_fits_give_each_id_once(df):
    assert compositions.subspaces(["p", "q", "r"], 4, 2, "s") == compositions.subspaces(["p", "q", "r"], 4, 2, "s")
    assert compositions.specialists(df, "g", ["a", "b"]).count() == 200
    assert compositions.leaves(df, df.select("id", "a", "b"), ["a", "b"], 3).where("size(leaves) = 3").count() == 200
    weights = df.select("id", F.lit(1.0).alias("w"))
    assert compositions.transferred(df, weights, "a", "b").where("abs(score - a) > 1e-9").count() == 0
