"""Blends of scores in long form: rows of (id, model, score)."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import clip, logit, sigmoid
from quern.operators.metrics import auc, ecdf
from quern.operators.ordered import mid_percentile, midrank
from quern.sources.scratch import stored


def transformed(scores: DataFrame, how: str) -> DataFrame:
    """``scores`` on the scale ``prob``, ``logit`` or ``rank`` (mid-rank share within the model)."""
    if how == "prob":
        return scores
    if how == "logit":
        return scores.withColumn("score", logit(F.col("score")))
    if how == "rank":
        ranked = midrank(scores, "score", "_r", ["model"])
        return ranked.select(*[c for c in scores.columns if c != "score"], (F.col("_r") / F.col("_r_of")).alias("score"))
    raise ValueError(f"no such scale: {how}")


def blend(scores: DataFrame, weights: dict[str, float] | None = None, how: str = "prob") -> DataFrame:
    """``(id, score)``: the weighted mean over models; equal weights if none are given."""
    scores = transformed(scores, how)
    if weights is None:
        return scores.groupBy("id").agg(F.avg("score").alias("score"))
    w: Column = F.lit(0.0)
    for m, v in weights.items():
        w = F.when(F.col("model") == m, F.lit(float(v))).otherwise(w)
    return scores.groupBy("id").agg((F.sum(w * F.col("score")) / F.sum(w)).alias("score"))


def family_weights(quality: dict[str, float], family: dict[str, str], heat: float) -> dict[str, float]:
    """Each family weighs the same; within it, models by the softmax of their quality."""
    out = {}
    for f in sorted(set(family.values())):
        own = [m for m in quality if family[m] == f]
        top = max(quality[m] for m in own)
        each = {m: exp((quality[m] - top) / heat) for m in own}
        out |= {m: v / sum(each.values()) / len(set(family.values())) for m, v in each.items()}
    return out


def fold_deltas(base: DataFrame, other: DataFrame, labels: DataFrame) -> DataFrame:
    """``(fold, auc_base, auc_other, delta)`` for two blends; ``labels`` has ``id, y, fold``."""
    labels = stored(labels.select("id", "y", "fold"), "labels")
    one = lambda s, n: auc(labels.join(s, "id"), "score", ["fold"]).select("fold", F.col("auc").alias(n))
    both = one(base, "auc_base").join(one(other, "auc_other"), "fold")
    return both.withColumn("delta", F.col("auc_other") - F.col("auc_base"))


def admission(deltas: DataFrame, gain: float, errors: float, folds: int) -> DataFrame:
    """One row: mean gain over folds, its standard error, folds with a gain, and whether all three tests pass."""
    row = deltas.agg(F.avg("delta").alias("mean"), (F.stddev_samp("delta") / F.sqrt(F.count("*"))).alias("se"), F.sum((F.col("delta") > 0).cast("int")).alias("positive"))
    return row.withColumn("admitted", (F.col("mean") >= gain) & (F.col("mean") >= errors * F.col("se")) & (F.col("positive") >= folds))


def greedy(scores: DataFrame, labels: DataFrame, steps: int, how: str = "logit") -> list[str]:
    """Models in the order that a hill climb with replacement adds them, while the AUC grows. A step scores all
    candidates in one query; the driver holds names only. Means are rounded to twelve digits: a tie must not hang on the
    order in which they are summed."""
    long = stored(transformed(scores, how).select("id", "model", "score"), "scores")
    chosen: list[str] = []
    best = 0.0
    for _ in range(steps):
        counts = {m: chosen.count(m) for m in set(chosen)}
        own = long.where(F.col("model").isin(*counts)) if counts else long.limit(0)
        w: Column = F.lit(0)
        for m, n in counts.items():
            w = F.when(F.col("model") == m, n).otherwise(w)
        so_far = own.groupBy("id").agg(F.sum(w * F.col("score")).alias("_sum"))
        tried = long.join(so_far, "id", "left").withColumn("score", F.round((F.col("score") + F.coalesce("_sum", F.lit(0.0))) / (len(chosen) + 1), 12))
        top = auc(tried.join(labels, "id"), "score", ["model"]).orderBy(F.desc("auc"), "model").first()
        if top is None or top["auc"] <= best:
            break
        best = top["auc"]
        chosen.append(top["model"])
    return chosen


def weight_grid(scores: DataFrame, labels: DataFrame, a: str, b: str, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, weight, auc)``: for each group of ``labels`` the weight of model ``a`` that ranks best, the smaller on ties."""
    wide = scores.groupBy("id").pivot("model", [a, b]).agg(F.first("score"))
    tried = labels.join(wide, "id").withColumn("weight", F.explode(F.array(*map(F.lit, grid))))
    tried = tried.withColumn("score", F.col("weight") * F.col(a) + (1 - F.col("weight")) * F.col(b))
    each = auc(tried, "score", [*by, "weight"])
    return each.groupBy(*by).agg(F.max_by("weight", F.struct("auc", -F.col("weight"))).alias("weight"), F.max("auc").alias("auc"))


def dispersion(scores: DataFrame) -> DataFrame:
    """``(id, spread, sd, iqr)``: range, deviation and interquartile range of a row's rank shares over models, of which there are
    few."""
    iqr = F.percentile("score", 0.75) - F.percentile("score", 0.25)
    return transformed(scores, "rank").groupBy("id").agg((F.max("score") - F.min("score")).alias("spread"), F.stddev_pop("score").alias("sd"), iqr.alias("iqr"))


def family_spread(scores: DataFrame, family: dict[str, str]) -> DataFrame:
    """``(id, family_spread)``: range of the mean rank shares of the models' families."""
    ranks = transformed(scores.where(F.col("model").isin(*family)), "rank")
    of = F.create_map(*(F.lit(x) for kv in family.items() for x in kv))
    means = ranks.groupBy("id", of[F.col("model")].alias("_f")).agg(F.avg("score").alias("_m"))
    return means.groupBy("id").agg((F.max("_m") - F.min("_m")).alias("family_spread"))


def combined(scores: DataFrame, rule: str, fit: DataFrame | None = None) -> DataFrame:
    """``(id, score)`` by a rule of composition: mean of logits (as a probability), of probabilities, of rank shares; geometric
    mean; median; the extreme farthest from one half; mean of each score's place among the scores of ``fit``."""
    if rule == "cdf":
        placed = ecdf(fit if fit is not None else scores, scores, "score", "_c", ["model"], spare=True)
        return placed.groupBy("id").agg(F.avg("_c").alias("score"))
    if rule in ("prob", "rank"):
        return blend(scores, None, rule)
    if rule == "logit":
        return blend(scores, None, "logit").withColumn("score", sigmoid(F.col("score")))
    s = clip(F.col("score"), 1e-6, 1 - 1e-6)
    rules = {"geometric": F.exp(F.avg(F.log(s))), "median": F.percentile("score", 0.5), "extreme": F.max_by("score", F.struct(F.abs(F.col("score") - 0.5), "model"))}
    if rule not in rules:
        raise ValueError(f"no such rule: {rule}")
    return scores.groupBy("id").agg(rules[rule].alias("score"))


def rank_geometry(scores: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """``(id, score)``: geometric mean over models of a score's mid-percentile within the row's group."""
    placed = mid_percentile(scores.join(groups.select("id", group), "id"), "score", "_p", ["model", group])
    return placed.groupBy("id").agg(F.exp(F.avg(F.log("_p"))).alias("score"))


def top_overlap(scores: DataFrame, a: str, b: str, share: float) -> DataFrame:
    """One row: how many ids the top ``share`` of two models have in common, and their share of it."""
    ranked = midrank(scores, "score", "_r", ["model"])
    top = ranked.where(F.col("_r") > F.col("_r_of") * (1 - share)).select("id", "model")
    left, right = top.where(F.col("model") == a).select("id"), top.where(F.col("model") == b).select("id")
    both = left.join(right, "id", "left_semi").agg(F.count("*").alias("common"))
    return both.withColumn("share", F.col("common") / F.lit(max(1, left.count())))
