"""No row may learn from its own label, and the sums must be those of plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import encodings, folds


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(i, rng.randint(0, 1), rng.choice([*range(12), None]), i % 5) for i in range(300)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, y int, key long, fold int")


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_crossfit_by_hand(spark, rows):
    got = by_id(encodings.crossfit(frame(spark, rows), "key", [10]), "te_10")
    for i, _, key, fold in rows:
        other = [r for r in rows if r[3] != fold]
        prior = sum(r[1] for r in other) / len(other)
        own = [r[1] for r in other if r[2] == key and key is not None]
        assert abs(got[i] - (sum(own) + 10 * prior) / (len(own) + 10)) < 1e-12


def test_labels_of_a_fold_do_not_reach_it(spark, rows):
    flipped = [(i, 1 - y if f == 2 else y, k, f) for i, y, k, f in rows]
    for column, fit in (
        ("te_20", lambda d: encodings.crossfit(d, "key", [20])),
        ("te_auto", lambda d: encodings.crossfit_auto(d, "key")),
        ("te_near", lambda d: encodings.crossfit_nearest(d.na.fill(0, ["key"]), "key", 2, 4)),
    ):
        a, b = (by_id(fit(frame(spark, r)), column) for r in (rows, flipped))
        assert all(a[i] == b[i] for i, _, _, f in rows if f == 2), column
        assert any(a[i] != b[i] for i, _, _, f in rows if f != 2), column


def test_rows_that_stop_a_fit_teach_nobody(spark, rows):
    flipped = [(i, 1 - y if i % 10 == 3 else y, k, f) for i, y, k, f in rows]
    a, b = (by_id(encodings.crossfit(frame(spark, r), "key", [20], source=F.col("id") % 10 != 3), "te_20") for r in (rows, flipped))
    assert a == b


def test_apply_ignores_the_labels_it_encodes(spark, rows):
    df = frame(spark, rows)
    fit, new = df.where("fold > 0"), df.where("fold = 0")
    a = by_id(encodings.apply(fit, new, "key", [10]), "te_10")
    b = by_id(encodings.apply(fit, new.withColumn("y", 1 - F.col("y")), "key", [10]), "te_10")
    prior = fit.agg(F.avg("y")).first()[0]
    assert a == b
    assert all(a[i] == prior for i, _, k, f in rows if f == 0 and k is None)


def test_neighbours_at_one_digit(spark):
    near = encodings.neighbours(spark.createDataFrame([(1234567,)], "key long"), "key", 13, 6).collect()
    own = [(1234567 // 6**i) % 6 for i in range(13)]
    assert len({r["near"] for r in near}) == 65
    for r in near:
        assert sum(a != b for a, b in zip(own, [(r["near"] // 6**i) % 6 for i in range(13)], strict=True)) == 1


def test_single_key_crossfit(spark):
    rows = [(i, int(i % 3 == 0), 7, i % 4) for i in range(40)]
    got = by_id(encodings.crossfit(frame(spark, rows), "key", [1]), "te_1")
    for i, _, _, f in rows:
        other = [y for _, y, _, g in rows if g != f]
        assert abs(got[i] - (sum(other) + sum(other) / len(other)) / (len(other) + 1)) < 1e-12


def test_folds_are_even_and_do_not_move(spark, rows):
    df = frame(spark, rows).drop("fold")
    a, b = (by_id(folds.stratified(d, 5, "s"), "fold") for d in (df, df.repartition(7)))
    assert a == b
    for label in (0, 1):
        sizes = [sum(1 for i, y, _, _ in rows if y == label and a[i] == f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_hashed_folds_know_no_label(spark, rows):
    df = frame(spark, rows)
    a = by_id(df.withColumn("f", folds.hashed(4, "s")), "f")
    assert a == by_id(df.withColumn("y", 1 - F.col("y")).withColumn("f", folds.hashed(4, "s")), "f")


def test_early_stop_share(spark, rows):
    out = folds.early_stop(frame(spark, rows), 0.1, "s").collect()
    assert len(out) == len(rows)
    for f in range(5):
        for y in (0, 1):
            own = [r for r in out if r["fold"] == f and r["y"] == y]
            assert sum(r["is_es"] for r in own) == len(own) // 10
