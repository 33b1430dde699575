"""Extra trees, ordered statistics, additive models, predicted ratings and tokens of numbers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import additive, auxiliary, compositions, encodings, forests, tokens
from quern.sources import scratch
from quern.sources.tables import table

RNG = random.Random(11)


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(400):
        x, z, c = RNG.random(), RNG.random(), RNG.randrange(5)
        r0 = min(5, int(3 * x + 2 * z + RNG.random()))
        out.append((i, i % 4, int(RNG.random() < (0.9 if (x > 0.5) == (z > 0.5) else 0.1)), x, None if i % 17 == 0 else z, f"c{c}" if c else None, r0, min(5, max(0, r0 + RNG.randrange(-1, 2)))))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, fold int, y int, x double, z double, c string, r0 int, r1 int").repartition(3)


def auc(found, s):
    ones, zeros = ([r[s] for r in found if r["y"] == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_ordered_statistics_see_earlier_rows_alone(df, rows):
    found = {r["id"]: r["ots"] for r in encodings.ordered_statistics(df, "c", "s", prior=0.25, weight=2.0, source=F.col("fold") != 1).collect()}
    place = lambda r: (hashlib.md5(f"s:{r[0]}".encode()).hexdigest(), r[0])
    for r in rows:
        seen = [o[2] for o in rows if o[5] == r[5] and o[1] != 1 and (r[1] == 1 or place(o) < place(r))]
        assert found[r[0]] == pytest.approx((sum(seen) + 0.5) / (len(seen) + 2))
    flipped = df.withColumn("y", F.when(F.col("id") == 7, 1 - F.col("y")).otherwise(F.col("y")))
    assert found[7] == {r["id"]: r["ots"] for r in encodings.ordered_statistics(flipped, "c", "s", prior=0.25, weight=2.0, source=F.col("fold") != 1).collect()}[7]


def test_ordered_boost_scores_its_folds(df):
    found = compositions.ordered_boost(df.withColumn("y", (F.col("c") == "c3").cast("int")).na.fill(0, ["y"]), ["x"], ["c"], only=[2], seeds=("a",), rounds=3, depth=2, rate=0.5).collect()
    assert len(found) == 100 and {r["fold"] for r in found} == {2} and auc(found, "margin") > 0.95


def test_extra_trees(df, rows):
    forest = forests.grow(df, ["x", "z"], trees=6, depth=3, share=0.9)
    again = forests.grow(df, ["x", "z"], trees=6, depth=3, share=0.9)
    leaves = lambda f: sorted(map(tuple, f.leaves.collect()))
    assert leaves(forest) == leaves(again)
    splits = [r for level in forest.levels for r in level.collect()]
    assert len({r["t"] for r in splits}) == len(splits) and all(0 < r["t"] < 1 for r in splits)
    found = forests.score(forest, df, ["x", "z"]).collect()
    assert len(found) == 400 and auc(found, "score") > 0.7
    flipped = df.withColumn("y", F.when(F.col("fold") == 2, 1 - F.col("y")).otherwise(F.col("y")))
    own = lambda f: sorted((r["id"], r["score"]) for r in f if r["fold"] == 2)
    assert own(forests.score(forests.grow(flipped, ["x", "z"], trees=6, depth=3, share=0.9), flipped, ["x", "z"]).collect()) == own(found)


def test_extra_trees_on_awkward_tables(df):
    assert forests.score(forests.grow(df.limit(0), ["x"], trees=2, depth=2), df.limit(0), ["x"]).collect() == []
    one = df.withColumn("fold", F.when(F.col("id") > 0, F.lit(3)))
    assert {r["score"] for r in forests.score(forests.grow(one, ["x"], trees=2, depth=2), one, ["x"]).collect()} == {None}
    with pytest.raises(ValueError):
        forests.grow(df, ["x"], trees=100_000, depth=4)


def test_pairs_find_what_shapes_cannot(df):
    single, both, ranking = additive.fit(df.withColumn("noise", (F.xxhash64("id") % 97).cast("double")), ["x", "noise", "z"], cycles=1, pairs=1, pair_cycles=2, rate=0.5, bins=8)
    assert {(r["f1"], r["f2"]) for r in ranking.where("rank = 1").collect()} == {("x", "z")}
    assert auc(both.rows.collect(), "margin") > auc(single.rows.collect(), "margin") + 0.15
    shapes = additive.shapes(single)
    assert {f for _, f, _, _ in shapes} <= {"x", "noise", "z"} and len(both.trees) == len(single.trees) + 2
    cuts, start = single.cuts, single.starts
    read = {(m, f, b): v for m, f, b, v in shapes}
    for r in single.rows.join(df.select("id", "x", "z", (F.xxhash64("id") % 97).cast("double").alias("noise")), "id").limit(40).collect():
        bins = {f: 0 if r[f] is None else 1 + sum(c < r[f] for c in cuts[f]) for f in cuts}
        assert r["margin"] == pytest.approx(start[r["fold"]] + sum(read.get((r["fold"], f, b), 0.0) for f, b in bins.items()))


def test_class_distributions_are_naive_bayes(df, rows):
    found = {r["id"]: r for r in auxiliary.class_distributions(df, ["r0", "r1"], ["c"], alpha=0.5).collect()}
    inputs = {"r0": [7, 5], "r1": [6, 5]}
    for r in rows[:60]:
        others = [o for o in rows if o[1] != r[1]]
        for name, at in (("r0", 6), ("r1", 7)):
            logs = []
            for k in range(6):
                n = sum(o[at] == k for o in others)
                v = math.log((n + 0.5) / (len(others) + 3))
                for i in inputs[name]:
                    kinds = len({o[i] for o in rows})
                    v += math.log((sum(o[at] == k and o[i] == r[i] for o in others) + 0.5) / (n + 0.5 * kinds))
                logs.append(v)
            w = [math.exp(x - max(logs)) for x in logs]
            assert found[r[0]][f"p_{name}"] == pytest.approx([x / sum(w) for x in w])


def test_chain_is_least_squares_and_does_not_leak(df, rows):
    features = {"r0": ["x"], "r1": ["x", "y"]}
    found = {r["id"]: r for r in auxiliary.linear_chain(df, features, ridge=0.0).collect()}
    data = np.array([(r[1], r[3], r[2], r[6], r[7]) for r in rows], float)
    fold = data[:, 0]
    solve = lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0]
    for m in range(4):
        first = np.zeros(len(rows))
        z = np.c_[np.ones(len(rows)), data[:, 1]]
        for f in range(4):
            fit = (fold != m) & (fold != f)
            first[fold == f] = z[fold == f] @ solve(z[fit], data[fit, 3])
        w = np.c_[z, data[:, 2], first]
        second = w @ solve(w[fold != m], data[fold != m, 4])
        for i in np.flatnonzero(fold == m):
            assert found[i]["pred_r0"] == pytest.approx(first[i]) and found[i]["pred_r1"] == pytest.approx(second[i])
    other = df.withColumns({t: F.when(F.col("fold") == 1, 5 - F.col(t)).otherwise(F.col(t)) for t in features})
    again = {r["id"]: r for r in auxiliary.linear_chain(other, features, ridge=0.0).collect()}
    own = [r[0] for r in rows if r[1] == 1]
    assert [tuple(again[i]) for i in own] == [tuple(found[i]) for i in own]
    assert any(again[r[0]]["pred_r1"] != found[r[0]]["pred_r1"] for r in rows if r[1] == 2)
    assert auxiliary.linear_chain(df.limit(0), features).collect() == []


def by_ranks(text, ranks):
    parts = [bytes([b]) for b in text.encode()]
    while True:
        known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not known:
            return [ranks[p] for p in parts]
        i = min(known)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_tokens_of_numbers(spark):
    import base64

    with open(tokens.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    keys = table(spark, "/root/testdata/sf0.001", "part").select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice") * 7919).alias("v"))
    found = tokens.number_tokens(keys, ["p_partkey", "v"]).collect()
    seen = Counter()
    for r in found:
        for c in ("p_partkey", "v"):
            ids = by_ranks(f" {int(r[c])}", ranks) if r[c] is not None else []
            seen[len(ids)] += 1
            assert (r[f"tok1_{c}"], r[f"tokL_{c}"], r[f"tokN_{c}"]) == ((ids[0], ids[-1] + 100_000 * len(ids), len(ids)) if ids else (-1, -1, 0))
    assert len(found) == keys.count() and len(seen) > 2
    odd = spark.createDataFrame([(float("nan"),), (1e300,), (-12.9,), (None,)], "v double")
    assert sorted(r["tokN_v"] for r in tokens.number_tokens(odd, ["v"]).collect())[:3] == [0, 0, 0]


def test_a_level_aggregates_a_node_once_for_all_features(df, monkeypatch):
    kept = {}
    monkeypatch.setattr(forests, "stored", lambda d, n: kept.setdefault(n, []).append(d._jdf.queryExecution().optimizedPlan().toString()) or scratch.stored(d, n))
    forests.grow(df, ["x", "z"], trees=3, depth=2)
    assert len(kept["cuts"]) == 2 and not any("Generate" in p for p in kept["cuts"])  # before: a row for each feature of a row in each tree
    assert all(p.count("Generate") == 1 for p in kept["ranges"])  # the trees that a row teaches
