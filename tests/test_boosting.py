"""Boosting and objectives over pairs, held against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import boosting, objectives
from quern.operators.boosting import SQUARED, boost

RNG = random.Random(7)


def made(n, signal=2.0):
    rows = []
    for i in range(n):
        x, z, c = RNG.random(), RNG.random(), RNG.randrange(4)
        y = int(RNG.random() < 1 / (1 + math.exp(-signal * (3 * (x - 0.5) + (1 if c == 2 else -0.3)))))
        rows.append((i, i % 3, y, None if i % 11 == 0 else x, z, float(c)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return made(600)


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, fold int, y int, x double, z double, c double").repartition(3)


def cuts_by_hand(values, bins):
    v = sorted(x for x in values if x is not None)
    return sorted({v[(len(v) - 1) * k // bins] for k in range(1, bins)})


def test_cuts_and_bins(df, rows):
    cuts = boosting.cut_points(df, ["x", "c"], 8)
    assert cuts == {"x": cuts_by_hand([r[3] for r in rows], 8), "c": cuts_by_hand([r[5] for r in rows], 8)}
    found = {r["id"]: r["b"] for r in df.select("id", boosting.bin_of(F.col("x"), cuts["x"]).alias("b")).collect()}
    assert found == {r[0]: 0 if r[3] is None else 1 + sum(c < r[3] for c in cuts["x"]) for r in rows}


def by_hand(rows, rounds, depth, rate, bins):
    """Margins of each row by its fold's model, with logistic loss, ridge 1 and whole units."""
    features = [[r[k] for r in rows] for k in (3, 4, 5)]
    cuts = [cuts_by_hand(f, bins) for f in features]
    binned = [[0 if v is None else 1 + sum(c < v for c in cuts[k]) for k, v in enumerate((r[3], r[4], r[5]))] for r in rows]
    out = {}
    for m in sorted({r[1] for r in rows}):
        train = [i for i, r in enumerate(rows) if r[1] != m]
        mean = sum(rows[i][2] for i in train) / len(train)
        s = [math.log(mean / (1 - mean))] * len(rows)
        for _ in range(rounds):
            p = [1 / (1 + math.exp(-v)) for v in s]
            g = [math.floor((q - r[2]) / 1e-7 + 0.5) for q, r in zip(p, rows, strict=True)]
            h = [math.floor(q * (1 - q) / 1e-7 + 0.5) for q in p]

            def grow(members, everyone, level):
                big_g, big_h = sum(g[i] for i in members), sum(h[i] for i in members)
                side = lambda a, b: (a * 1e-7) ** 2 / (b * 1e-7 + 1)
                best = None
                for f in range(3) if level < depth else ():
                    for b in sorted({binned[i][f] for i in members}):
                        left = [i for i in members if binned[i][f] <= b]
                        lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                        if len(left) == len(members) or min(lh, big_h - lh) * 1e-7 < 1e-3:
                            continue
                        gain = round((side(lg, lh) + side(big_g - lg, big_h - lh) - side(big_g, big_h)) / 2, 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, b)
                if best is None:
                    for i in everyone:
                        s[i] += -rate * big_g * 1e-7 / (big_h * 1e-7 + 1)
                    return
                for goes in (lambda i: binned[i][best[1]] <= best[2], lambda i: binned[i][best[1]] > best[2]):
                    grow([i for i in members if goes(i)], [i for i in everyone if goes(i)], level + 1)

            grow(train, range(len(rows)), 0)
        out |= {r[0]: s[i] for i, r in enumerate(rows) if r[1] == m}
    return out


def test_trees_are_those_of_plain_python(df, rows):
    found = boost(df, ["x", "z", "c"], rounds=2, depth=3, rate=0.4, bins=6)
    want = by_hand(rows, 2, 3, 0.4, 6)
    got = {r["id"]: r["margin"] for r in found.rows.collect()}
    assert got == pytest.approx(want, abs=1e-9)
    assert len(found.trees) == 2 and found.models == [0, 1, 2]


def test_loss_falls_with_each_round_and_runs_agree(df):
    one, two = (boost(df, ["x", "z", "c"], rounds=4, depth=2, rate=0.3, watch=True) for _ in range(2))
    assert all(b < a for a, b in zip(one.losses, one.losses[1:], strict=False))
    assert one.losses == two.losses and one.trees == two.trees


def test_a_margin_comes_back_without_rounds_and_is_improved_with_them(df):
    start = df.withColumn("m", F.when(F.col("id") != 5, F.col("z") - 0.5))
    same = boost(start, ["x"], rounds=0, margin="m").rows.collect()
    given = {r["id"]: r["m"] for r in start.collect()}
    assert {r["id"]: r["margin"] for r in same} == given and given[5] is None
    fitted = boost(start.where("id <> 5"), ["x", "c"], rounds=3, depth=2, rate=0.3, margin="m", watch=True)
    assert fitted.losses == sorted(fitted.losses, reverse=True)


def test_rows_that_stop_do_not_teach(df):
    es = df.withColumn("is_es", F.col("id") % 5 == 0)
    flipped = es.withColumn("y", F.when(F.col("is_es"), 1 - F.col("y")).otherwise(F.col("y")))
    a, b = (boost(d, ["x", "z", "c"], rounds=2, es="is_es", margin="z") for d in (es, flipped))
    assert a.trees == b.trees
    noise = boost(es.withColumn("y", (F.xxhash64("id") % 2 == 0).cast("int")), ["x", "z", "c"], rounds=12, depth=4, rate=1.0, ridge=0.01, es="is_es", patience=2)
    assert len(noise.losses) < 12 and len(noise.trees) == 1 + noise.losses.index(min(noise.losses))


def test_awkward_tables(spark, df):
    none = boost(df.limit(0), ["x"], rounds=2)
    assert none.rows.collect() == [] and none.trees == []
    alone = boost(df.withColumn("fold", F.lit(4)), ["x"], rounds=1).rows
    assert {r["margin"] for r in alone.collect()} == {0.0}
    odd = df.withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y"))).withColumn("fold", F.when(F.col("id") > 0, F.col("fold"))).withColumn("x", F.lit(None).cast("double"))
    got = {r["id"]: r["margin"] for r in boost(odd, ["x", "c"], rounds=1, bins=4).rows.collect()}
    assert len(got) == 600 and [k for k, v in got.items() if v is None] == [0]


def test_weights_count_as_repeats_and_squares_fit_means(df, rows):
    heavy = boost(df.withColumn("w", F.when(F.col("id") % 2 == 0, 2.0).otherwise(1.0)), ["c"], rounds=1, weight="w", margin="z", bins=64).trees[0]
    twice = boost(df.union(df.where("id % 2 = 0")), ["c"], rounds=1, margin="z", bins=64).trees[0]
    assert all(heavy[m].splits == twice[m].splits and heavy[m].values == pytest.approx(twice[m].values, abs=1e-6) for m in range(3))
    fitted = boost(df.withColumn("y", F.col("c")), ["c"], loss=SQUARED, rounds=1, depth=3, rate=1.0, ridge=0.0, bins=8)
    assert {r["id"]: r["margin"] for r in fitted.rows.collect()} == pytest.approx({r[0]: r[5] for r in rows}, abs=1e-5)


def test_other_rows_get_the_mean_of_the_models(df):
    fitted = boost(df, ["x", "c"], rounds=3, depth=2)
    got = {r["id"]: r["margin"] for r in boosting.apply(fitted, df.drop("fold", "y"), per_table=2).collect()}
    assert len(got) == 600 and np.std(list(got.values())) > 0.1
    shares = boost(df, ["x", "z", "c"], rounds=2, share_rows=0.5, share_features=0.4).trees
    assert all(len({f for f, _ in t.splits.values()}) <= 2 for trees in shares for t in trees.values())


def slopes_by_hand(rows, gap):
    ones, zeros = [r for r in rows if r[1] == 1 and r[2] is not None], [r for r in rows if r[1] == 0 and r[2] is not None]
    g, h, loss = {r[0]: 0.0 for r in rows}, {r[0]: 0.0 for r in rows}, 0.0
    for p in ones:
        for q in zeros:
            d, k = gap - p[2] + q[2], (len(ones) + len(zeros)) / (len(ones) * len(zeros))
            if d > 0:
                g[p[0]], g[q[0]] = g[p[0]] - 2 * d * k, g[q[0]] + 2 * d * k
                h[p[0]], h[q[0]] = h[p[0]] + 2 * k, h[q[0]] + 2 * k
                loss += d * d / (len(ones) * len(zeros))
    return g, h, loss


def test_pair_slopes_are_sums_over_all_pairs(spark):
    rows = [(i, RNG.choice([0, 1, 1, None] if i % 9 == 0 else [0, 1]), None if i % 13 == 0 else RNG.randrange(12) / 8, i % 2) for i in range(120)] + [(200, 1, 0.5, 7)]
    found = objectives.pair_slopes(spark.createDataFrame(rows, "id long, y int, margin double, model int"), gap=0.6).collect()
    for m in (0, 1, 7):
        g, h, loss = slopes_by_hand([r for r in rows if r[3] == m], 0.6) if m < 7 else ({200: 0.0}, {200: 0.0}, 0.0)
        own = [r for r in found if r["model"] == m]
        assert {r["id"]: r["g"] for r in own} == pytest.approx(g, abs=1e-9) and {r["id"]: r["h"] for r in own} == pytest.approx(h, abs=1e-9)
        assert sum(r["pair_loss"] for r in own) == pytest.approx(loss, abs=1e-9)


def auc(rows, s):
    ones, zeros = ([r[s] for r in rows if r["y"] == k and r[s] is not None] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_linear_and_boosted_pairs_beat_their_start_on_every_fold(df):
    whole = df.na.fill(0.5)
    scored, losses = objectives.linear_pair_fit(whole, ["x", "z", "c"], steps=3)
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:], strict=False)) and losses[0] == pytest.approx(1.0)
    trees = boost(whole, ["x", "z", "c"], loss=objectives.PAIRS, rounds=2, depth=2, rate=0.5).rows
    for found, s in ((scored.collect(), "score"), (trees.collect(), "margin")):
        assert all(auc([r for r in found if r["fold"] == k], s) > 0.6 for k in range(3))
