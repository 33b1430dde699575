"""Additive models: shape functions of single features, then of the pairs that explain most of what is left."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.boosting import LOGISTIC, UNIT, Boosted, Loss, _slopes, boost
from quern.sources.scratch import stored


def shapes(fitted: Boosted) -> list[tuple[int, str, int, float]]:
    """``(fold, feature, bin, value)``: what each feature's trees add up to at each bin of it; of trees that split by one feature
    only. Bounded by folds, features and bins."""
    out: dict[tuple[int, str, int], float] = {}
    for trees in fitted.trees:
        for i, tree in trees.items():
            used = {f for f, _ in tree.splits.values()}
            for f in used if len(used) == 1 else ():
                for b in range(len(fitted.cuts[fitted.features[f]]) + 2):
                    node = 1
                    while node in tree.splits:
                        node = 2 * node + (b > tree.splits[node][1])
                    key = (fitted.models[i], fitted.features[f], b)
                    out[key] = out.get(key, 0.0) + tree.values[node]
    return sorted((*k, v) for k, v in out.items())


def pair_gains(fitted: Boosted, loss: Loss = LOGISTIC, coarse: int = 4, ridge: float = 1.0) -> DataFrame:
    """``(fold, f1, f2, gain, rank)``: for each pair of features what one step on cells of their bins, ``coarse`` bins wide, would
    take off the loss that the fit has left on the rows that teach a fold's model. All pairs of all folds are one
    aggregate into cells; ties go by the features' order."""
    taught = _slopes(fitted.table, loss, fitted.models)
    rows = taught.select("_bins", F.inline(F.array(*(F.struct(F.lit(i).alias("model"), F.get("_slopes", F.lit(i)).alias("slope")) for i in range(len(fitted.models)))))).where("slope is not null")
    cell = lambda f: F.floor(F.get("_bins", F.lit(f)) / coarse).cast("int")
    pairs = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), cell(a).alias("b1"), cell(b).alias("b2")) for a, b in combinations(range(len(fitted.features)), 2)]
    long = rows.select("model", F.col("slope.g").alias("g"), F.col("slope.h").alias("h"), F.inline(F.array(*pairs)))
    cells = long.groupBy("model", "f1", "f2", "b1", "b2").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    part = lambda g, h: (g * UNIT) * (g * UNIT) / (h * UNIT + ridge)
    gain = F.round((F.sum(part(F.col("g"), F.col("h"))) - part(F.sum("g"), F.sum("h"))) / 2, 6)
    found = cells.groupBy("model", "f1", "f2").agg(gain.alias("gain"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("gain"), "f1", "f2")))
    names, folds = F.array(*map(F.lit, fitted.features)), F.array(*map(F.lit, fitted.models))
    return ranked.select(F.get(folds, F.col("model")).alias("fold"), F.get(names, F.col("f1")).alias("f1"), F.get(names, F.col("f2")).alias("f2"), "gain", "rank")


def fit(df: DataFrame, features: Sequence[str], cycles: int = 3, pairs: int = 2, pair_cycles: int = 2, rate: float = 0.3, bins: int = 32, **how) -> tuple[Boosted, Boosted, DataFrame]:
    """Shape functions by ``cycles`` turns of all features, the fit that goes on from there with each fold's best ``pairs`` of
    features, and the ranking of pairs. Each fold's model chooses its pairs by the rows that teach it."""
    single = boost(df, features, turns=[[f] for _ in range(cycles) for f in features], depth=2, rate=rate, bins=bins, **how)
    ranking = stored(pair_gains(single), "pairs")
    best: dict[int, list[list[str]]] = {}
    for r in ranking.where(F.col("rank") <= pairs).orderBy("fold", "rank").collect():
        best.setdefault(r["fold"], []).append([r["f1"], r["f2"]])
    most = min((len(v) for v in best.values()), default=0)
    if not most:
        return single, single, ranking
    turns = [{m: best[m][k] for m in best} for _ in range(pair_cycles) for k in range(most)]
    return single, boost(df, features, turns=turns, depth=2, rate=rate, bins=bins, after=single, **how), ranking
