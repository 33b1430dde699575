"""Extremely randomised trees: thresholds are drawn, not searched, and all trees of all folds grow a level at a time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import uniform
from quern.sources.scratch import stored

#: Rows of a table of splits that is broadcast, at most: trees of all folds times nodes of a level.
MOST_NODES = 1 << 17


@dataclass
class Forest:
    """``levels`` hold the splits ``(model, node, f, t)`` of each depth, ``leaves`` the label's mean ``(model, node, value)``. Model
    numbers count the trees of the first fold, then of the next."""

    levels: list[DataFrame]
    leaves: DataFrame
    folds: list[int]
    trees: int


def _entropy(ones: Column, n: Column) -> Column:
    """n times the entropy of a share of ones."""
    part = lambda k: F.when(k > 0, -k * F.log(k / n)).otherwise(0.0)
    return part(ones) + part(n - ones)


def _walked(rows: DataFrame, levels: Sequence[DataFrame]) -> DataFrame:
    """``rows(model, x, ...)`` with ``node``: where the splits lead; nulls go to the left."""
    rows = rows.withColumn("node", F.lit(1))
    for splits in levels:
        joined = rows.join(F.broadcast(splits), ["model", "node"], "left")
        right = F.coalesce(F.get("x", F.col("f")) > F.col("t"), F.lit(False)).cast("int")
        rows = joined.withColumn("node", F.when(F.col("f").isNotNull(), 2 * F.col("node") + right).otherwise(F.col("node"))).drop("f", "t")
    return rows


def grow(rows: DataFrame, features: Sequence[str], trees: int = 40, depth: int = 6, share: float = 0.5, least_rows: int = 4, seed: str = "extra") -> Forest:
    """For each fold ``trees`` trees on the labelled rows ``(id, fold, y, *features)`` of the other folds.

    A node draws ``share`` of the features by hash, and for each a threshold by hash between its least and greatest value there;
    the split is that of least entropy, ties by feature. A level of all trees is two aggregates with one row for each node:
    ranges of all features, then sums to the left of the thresholds, which are drawn once for a node and not for its rows.
    Rows are not copied for the features, nor for the trees before they walk: each level sends them through the levels above,
    which are broadcast and have MOST_NODES rows at most, or growing stops with an error.
    """
    data = stored(rows.where("y is not null and fold is not null").select("fold", F.col("y").cast("double").alias("y"), F.array(*(F.col(f).cast("double") for f in features)).alias("x")), "forest")
    by_fold = {r["fold"]: (r["t"], r["n"]) for r in data.groupBy("fold").agg(F.sum("y").alias("t"), F.count("*").alias("n")).collect()}
    folds = sorted(by_fold)
    if len(folds) * trees << max(depth - 1, 0) > MOST_NODES:
        raise ValueError("too many nodes to broadcast: fewer trees or levels")
    spark = rows.sparkSession
    mine = [(i * trees + t, 1, *(float(sum(v[k] for g, v in by_fold.items() if g != f)) for k in (1, 0))) for i, f in enumerate(folds) for t in range(trees)]
    open_nodes = spark.createDataFrame([r for r in mine if r[2]], "model int, node int, n double, t double")
    done, levels = [], []
    models = lambda i: F.sequence(F.lit(i * trees), F.lit((i + 1) * trees - 1))
    taught = F.flatten(F.array(*(F.when(F.col("fold") != f, models(i)).otherwise(F.array().cast("array<int>")) for i, f in enumerate(folds)))) if folds else F.array().cast("array<int>")
    long = data.select("y", "x", F.explode(taught).alias("model"))
    every = range(len(features))
    picked = lambda i: uniform(seed, F.lit("draw"), F.col("model"), F.col("node"), F.lit(i)) < share
    for _ in range(depth):
        here = _walked(long, levels).join(F.broadcast(open_nodes.select("model", "node")), ["model", "node"])
        value = [F.get("x", F.lit(i)) for i in every]
        ranges = stored(here.groupBy("model", "node").agg(*(f(v).alias(f"{k}{i}") for i, v in enumerate(value) for k, f in (("low", F.min), ("high", F.max)))), "ranges")
        drawn = lambda i: F.col(f"low{i}") + uniform(seed, F.col("model"), F.col("node"), F.lit(i)) * (F.col(f"high{i}") - F.col(f"low{i}"))
        cuts = stored(ranges.select("model", "node", *(F.when((F.col(f"high{i}") > F.col(f"low{i}")) & picked(i), drawn(i)).alias(f"cut{i}") for i in every)), "cuts")
        left = [F.coalesce(v <= F.col(f"cut{i}"), F.lit(True)) for i, v in enumerate(value)]
        sides = [a for i, to in enumerate(left) for a in (F.first(f"cut{i}").alias(f"cut{i}"), F.count_if(to).cast("double").alias(f"ln{i}"), F.sum(F.when(to, F.col("y")).otherwise(0.0)).alias(f"lt{i}"))]
        sums = here.join(F.broadcast(cuts), ["model", "node"]).groupBy("model", "node").agg(*sides)
        each = F.array(*(F.struct(F.lit(i).alias("f"), *(F.col(f"{c}{i}").alias(c) for c in ("cut", "ln", "lt"))) for i in every))
        sums = sums.select("model", "node", F.inline(each)).where("cut is not null")
        sums = sums.join(F.broadcast(open_nodes), ["model", "node"])
        rn, rt = F.col("n") - F.col("ln"), F.col("t") - F.col("lt")
        gain = F.round(_entropy(F.col("t"), F.col("n")) - _entropy(F.col("lt"), F.col("ln")) - _entropy(rt, rn), 9)
        sums = sums.withColumn("gain", gain).where((F.col("gain") > 0) & (F.least(F.col("ln"), rn) >= least_rows))
        best = sums.withColumn("_place", F.row_number().over(Window.partitionBy("model", "node").orderBy(F.desc("gain"), "f"))).where("_place = 1").drop("_place")
        best = stored(best, "splits")
        done.append(open_nodes.join(best, ["model", "node"], "left_anti"))
        levels.append(best.select("model", "node", "f", F.col("cut").alias("t")))
        sides = F.inline(F.array(F.struct((2 * F.col("node")).alias("node"), F.col("ln").alias("n"), F.col("lt").alias("t")), F.struct((2 * F.col("node") + 1).alias("node"), rn.alias("n"), rt.alias("t"))))
        open_nodes = stored(best.select("model", sides), "nodes")
    for d in done:
        open_nodes = open_nodes.union(d)
    return Forest(levels, stored(open_nodes.select("model", "node", (F.col("t") / F.col("n")).alias("value")), "leaves"), folds, trees)


def score(forest: Forest, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(id, fold, y, score)``: the mean over the trees of each row's own fold, which have not seen it. A row of no fold, or of a
    fold that holds all rows, has a null score."""
    own = F.array_position(F.array(*map(F.lit, forest.folds)), F.col("fold")) - 1 if forest.folds else F.lit(None).cast("long")
    models = F.sequence((own * forest.trees).cast("int"), ((own + 1) * forest.trees - 1).cast("int"))
    x = F.array(*(F.col(f).cast("double") for f in features))
    long = rows.select("id", "fold", "y", x.alias("x"), F.explode_outer(F.when(own >= 0, models)).alias("model"))
    found = _walked(long, forest.levels).join(F.broadcast(forest.leaves), ["model", "node"], "left")
    return found.groupBy("id", "fold", "y").agg(F.avg("value").alias("score"))
