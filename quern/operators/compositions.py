"""Compositions of fits, neighbours and blends, nested in folds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import md5
from math import log

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import clip, logit, sigmoid, uniform
from quern.operators import boosting, encodings, models, neighbours
from quern.operators.codes import codes, median_filled
from quern.operators.blending import blend, transformed
from quern.operators.encodings import crossfit
from quern.operators.metrics import auc, auc_elsewhere
from quern.operators.ordered import hashed_place, quantiles
from quern.operators.screens import confident
from quern.sources.scratch import stored


def _folds(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("fold").distinct().collect())


def fold_safe_knn(df: DataFrame, k: int, teaches: Column | None = None) -> DataFrame:
    """``(id, ref, d2, rank)``: each row's k nearest rows of other folds; with ``teaches``, of those it holds for."""
    pool = df if teaches is None else df.where(teaches)
    return neighbours.knn(df, pool, k, apart="fold")


def kernel_scores(df: DataFrame, near: DataFrame, segment: str) -> DataFrame:
    """``(id, score)``: mean label of a row's neighbours, weighted by exp(-d² / h²); h is the median, over the rows
    of its segment, of the distance to their farthest neighbour."""
    far = near.groupBy("id").agg(F.max("d2").alias("_far")).join(df.select("id", segment), "id")
    width = quantiles(far.select(segment, F.sqrt("_far").alias("_d")), "_d", {"_h": 0.5}, [segment])
    seen = near.join(df.select("id", segment), "id").join(width, segment).join(df.select(F.col("id").alias("ref"), "y"), "ref")
    w = F.exp(-F.col("d2") / F.greatest(F.col("_h") * F.col("_h"), F.lit(1e-12)))
    return seen.groupBy("id").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("score"))


def transfer_weights(near: DataFrame, share: float = 0.95) -> DataFrame:
    """``(id, d, w)``: d is the distance to the farthest neighbour of a source; w falls from 1 to 0 at its quantile."""
    far = stored(near.groupBy("id").agg(F.sqrt(F.max("d2")).alias("d")), "far")
    top = quantiles(far, "d", {"top": share}).first()
    top = top["top"] if top else None
    return far.withColumn("w", clip(1 - F.col("d") / F.lit(top or 1.0), 0.0, 1.0))


def transferred(rows: DataFrame, weights: DataFrame, source: str, own: str) -> DataFrame:
    """``rows`` with ``score``: logits of the source's score by ``w`` and of the own score by the rest."""
    w = F.coalesce(F.col("w"), F.lit(0.0))
    joined = rows.join(weights.select("id", "w"), "id", "left")
    return joined.withColumn("score", sigmoid(w * logit(F.col(source)) + (1 - w) * logit(F.col(own)))).drop("w")


def crossfit_targets(df: DataFrame, key: str, targets: Sequence[str], smooth: float = 20.0) -> DataFrame:
    """``(id, pred_<target>)``: the smoothed mean of each target by key, from other folds: columns predict each other."""
    out = df.select("id")
    for t in targets:
        one = crossfit(df.select("id", "fold", key, F.col(t).alias("y")), key, [smooth])
        out = out.join(one.select("id", F.col(f"te_{smooth:g}").alias(f"pred_{t}")), "id")
    return out


def prepared(df: DataFrame, categories: Sequence[str], numerics: Sequence[str], logged: Sequence[str] = ()) -> DataFrame:
    """``(id, code_<c>, z_<n>, missing_<n>)``: sorted codes; numbers with the median for nulls, those of ``logged``
    as log1p of their positive part, centred and scaled by the population deviation (1e-6 at least)."""
    out = df.select("id", *categories, *numerics)
    for c in categories:
        out = codes(out, c, f"code_{c}")
    out = out.withColumns({f"missing_{n}": F.col(n).isNull().cast("int") for n in numerics})
    out = median_filled(out, list(numerics))
    filled = {n: F.col(n) for n in numerics}
    filled |= {n: F.log1p(F.greatest(filled[n], F.lit(0.0))) for n in logged}
    out = stored(out.withColumns({f"z_{n}": v for n, v in filled.items()}), "prepared")
    at = out.agg(*(f(f"z_{n}").alias(f"{k}_{n}") for n in numerics for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = {f"z_{n}": (F.col(f"z_{n}") - F.lit(at[f"m_{n}"])) / F.lit(max(at[f"s_{n}"] or 0.0, 1e-6)) for n in numerics}
    return out.withColumns(scaled).select("id", *(f"code_{c}" for c in categories), *(f"{k}_{n}" for n in numerics for k in ("z", "missing")))


def averaging_curve(scores: DataFrame, labels: DataFrame, order: Sequence[str]) -> DataFrame:
    """``(members, auc)`` of the mean of the first members, for each number of them. Means are rounded to twelve digits:
    a tie must not hang on the order in which they are summed."""
    place = F.lit(None).cast("int")
    for i, m in enumerate(order, 1):
        place = F.when(F.col("model") == m, i).otherwise(place)
    grown = scores.withColumn("_at", place).where("_at is not null").withColumn("members", F.explode(F.sequence("_at", F.lit(len(order)))))
    means = grown.groupBy("members", "id").agg(F.round(F.avg("score"), 12).alias("score"))
    return auc(means.join(labels.select("id", "y"), "id"), "score", ["members"]).select("members", "auc")


def slope_per_doubling(curve: DataFrame, n: str, value: str) -> DataFrame:
    """One row: the gain in ``value`` for twice the rows, from the two largest sizes of the curve."""
    last = curve.orderBy(F.desc(n)).limit(2).agg(F.max(F.struct(n, value)).alias("b"), F.min(F.struct(n, value)).alias("a"))
    return last.select(((F.col(f"b.{value}") - F.col(f"a.{value}")) / F.log(F.col(f"b.{n}") / F.col(f"a.{n}")) * log(2)).alias("slope"))


def maximin(scores: DataFrame, labels: DataFrame, steps: int, least: float = 1e-9) -> list[str]:
    """Models whose mean has the best worst-fold AUC, added one by one while it grows. A step scores all candidates
    in one query; the driver holds names. Means are rounded to twelve digits."""
    scores = scores.withColumn("score", F.round("score", 12))
    chosen: list[str] = []
    best = -1.0
    every = scores.select("model").distinct()
    for _ in range(steps):
        own = scores.where(F.col("model").isin(*chosen)).groupBy("id").agg(F.sum("score").alias("_sum")) if chosen else None
        tried = scores.join(every.where(~F.col("model").isin(*chosen)), "model", "left_semi") if chosen else scores
        if own is not None:
            tried = tried.join(own, "id").withColumn("score", F.round((F.col("score") + F.col("_sum")) / (len(chosen) + 1), 12))
        each = auc(tried.join(labels.select("id", "y", "fold"), "id"), "score", ["model", "fold"])
        top = each.groupBy("model").agg(F.min("auc").alias("worst")).orderBy(F.desc("worst"), "model").first()
        if top is None or top["worst"] is None or top["worst"] <= best + least:
            break
        best = top["worst"]
        chosen.append(top["model"])
    return chosen


def top_stack(scores: DataFrame, labels: DataFrame, top: int) -> DataFrame:
    """``(id, fold, y, score)``: each fold scored by a logistic stack of the models that rank best on the others. Scores meet their
    labels once; the best models of all folds stand side by side in one stored table, which all fits read."""
    labels = stored(labels.select("id", "y", "fold"), "labels")
    long = stored(scores.select("id", "model", "score").join(labels, "id"), "scores")
    best = {}
    for f in _folds(labels):
        ranked = auc(long.where(F.col("fold") != f), "score", ["model"]).orderBy(F.desc("auc"), "model").limit(top)
        best[f] = sorted(r["model"] for r in ranked.select("model").collect())
    every = sorted({m for names in best.values() for m in names})
    wide = stored(long.where(F.col("model").isin(every)).groupBy("id", "y", "fold").pivot("model", every).agg(F.first(logit(F.col("score")))), "wide")
    out = []
    for f, names in best.items():
        teach, own = wide.where(F.col("fold") != f), wide.where(F.col("fold") == f)
        out.append(models.fit_apply(teach, own.withColumn("_y", F.col("y")), names, "logistic").select("id", "fold", F.col("_y").alias("y"), "score"))
    return reduce(DataFrame.unionByName, out)


def region_gate(scores: DataFrame, labels: DataFrame, bins: int) -> DataFrame:
    """``(id, fold, y, score)``: in each region of the mean rank, the model that ranks best there on other folds, where it
    beats the mean; elsewhere the mean."""
    ranks = transformed(scores, "rank")
    anchor = blend(ranks).withColumn("score", F.round("score", 12))  # a tie must not hang on the order in which ranks are summed
    region = F.least(F.floor(F.col("_r") * bins), F.lit(bins - 1)).cast("int").alias("region")
    placed = transformed(anchor.withColumn("model", F.lit("")), "rank").select("id", F.col("score").alias("_r")).select("id", region)
    every = ranks.select("id", "model", "score").unionByName(anchor.select("id", F.lit("").alias("model"), "score"))
    rows = stored(every.join(placed, "id").join(labels.select("id", "y", "fold"), "id"), "regions")
    out = []
    for f in _folds(labels):
        local = auc(rows.where(F.col("fold") != f), "score", ["region", "model"]).where("auc is not null")
        best = local.groupBy("region").agg(F.max_by("model", F.struct("auc", F.col("model") == "", "model")).alias("_best"))
        own = rows.where(F.col("fold") == f).join(best, "region", "left").where(F.col("model") == F.coalesce("_best", F.lit("")))
        out.append(own.select("id", "fold", "y", "score"))
    return reduce(DataFrame.unionByName, out)


def corrected(df: DataFrame, reference: str, features: Sequence[str], model: str = "boosted") -> DataFrame:
    """``(id, fold, y, score)``: an out-of-fold fit that sees the logit of a reference score beside the features."""
    return models.out_of_fold(df.withColumn("_z", logit(F.col(reference))), [*features, "_z"], model)


def subspaces(features: Sequence[str], n: int, size: int, seed: str) -> list[list[str]]:
    """n repeatable subsets of ``size`` features, in the order of the features."""
    place = lambda k, c: md5(f"{seed}:{k}:{c}".encode()).hexdigest()
    return [sorted(sorted(features, key=lambda c: place(k, c))[:size], key=list(features).index) for k in range(n)]


def subspace_scores(df: DataFrame, features: Sequence[str], n: int, size: int, seed: str, model: str = "logistic") -> DataFrame:
    """``(id, model, score)``: an out-of-fold fit on each subset of the features."""
    df = stored(df.select("id", "fold", "y", *features), "subspaces")
    fits = (models.out_of_fold(df.select("id", "fold", "y", *own), own, model).select("id", F.lit(f"s{k}").alias("model"), "score") for k, own in enumerate(subspaces(features, n, size, seed)))
    return reduce(DataFrame.unionByName, fits)


def voted(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, fold, y, score)``: models weighted, in each fold, by what their AUC on other folds has above one half. Scores meet
    their labels once, in a stored table."""
    labels = stored(labels.select("id", "fold", "y"), "labels")
    long = stored(scores.select("id", "model", "score").join(labels, "id"), "scores")
    each = auc_elsewhere(long, "score", _folds(labels), ["model"]).select(F.col("but").alias("fold"), "model", F.greatest(F.col("auc") - 0.5, F.lit(1e-6)).alias("_w"))
    return long.join(each, ["fold", "model"]).groupBy("id", "fold", "y").agg((F.sum(F.col("_w") * F.col("score")) / F.sum("_w")).alias("score"))


def specialists(df: DataFrame, segment: str, features: Sequence[str], model: str = "logistic") -> DataFrame:
    """``(id, fold, y, score)``: an out-of-fold fit for each value of ``segment``, put together."""
    values = sorted(r[0] for r in df.select(segment).distinct().collect() if r[0] is not None)
    return reduce(DataFrame.unionByName, (models.out_of_fold(df.where(F.col(segment) == v), features, model) for v in values))


def leaves(fit: DataFrame, rows: DataFrame, features: Sequence[str], trees: int = 10) -> DataFrame:
    """``rows`` with ``leaves``: the leaf that each tree of a boosted fit puts the row in."""
    grown = GBTClassifier(labelCol="y", maxDepth=3, maxIter=trees, seed=7, leafCol="_leaf").fit(models._assembled(fit.withColumn("y", F.col("y").cast("double")), features))
    out = grown.transform(models._assembled(rows, features))
    return out.select(*rows.columns, vector_to_array("_leaf").cast("array<int>").alias("leaves"))


def with_external(df: DataFrame, other: DataFrame, features: Sequence[str], weight: float, model: str = "logistic") -> DataFrame:
    """``(id, fold, y, score)``: out-of-fold fits that also learn from the rows of ``other``, at a weight. Those have fold
    -1, so they are scored but never returned."""
    both = df.select("id", "fold", "y", *features, F.lit(1.0).alias("_w")).unionByName(other.select("id", F.lit(-1).alias("fold"), "y", *features, F.lit(weight).alias("_w")))
    return models.out_of_fold(both, features, model, "_w").where("fold >= 0")


def pseudo_labelled(df: DataFrame, unlabelled: DataFrame, score: str, share: float, seed: str, duplicates: bool = False) -> DataFrame:
    """``df`` and the confident rows of ``unlabelled`` with their pseudo-labels; with ``duplicates``, the control: as many
    hashed rows of ``df`` again in expectation. ``added`` marks the new rows."""
    new = confident(unlabelled, score, share).drop("y").withColumnRenamed("label", "y")
    if duplicates:
        n, have = new.count(), max(1, df.count())
        new = df.where(uniform(seed, F.col("id")) < n / have)
    shared = [c for c in df.columns if c in new.columns]
    return df.select(*shared, F.lit(False).alias("added")).unionByName(new.select(*shared, F.lit(True).alias("added")))


def shuffled(df: DataFrame, column: str, seed: str) -> DataFrame:
    """``df`` with the values of one column moved to other rows by two hashed orders, whose places are then joined."""
    places = hashed_place(df, [], seed)
    values = hashed_place(df.select("id", column), [], seed + ":values").select("place", F.col(column).alias("_moved"))
    return places.join(values, "place").withColumn(column, F.col("_moved")).select(*df.columns)


def ordered_boost(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], only: Sequence[int] | None = None, seeds: Sequence[str] = ("order0", "order1"), **how) -> DataFrame:
    """``(id, fold, y, margin)``: each fold scored by trees on numbers and on ordered statistics of categories, one for each
    seed. Rows that teach see earlier ones alone; rows of the fold see all that teach. ``how`` goes to ``boosting.boost``."""
    folds = sorted(r[0] for r in df.where("fold is not null").select("fold").distinct().collect())
    out = []
    for m in folds if only is None else only:
        rows, names = df, list(numbers)
        for c in categories:
            for s in seeds:
                names.append(f"ots_{c}_{s}")
                rows = encodings.ordered_statistics(rows, c, s, source=F.col("fold") != m).withColumnRenamed("ots", names[-1])
        fitted = boosting.boost(stored(rows, "ordered"), names, only=[m], **how)
        out.append(fitted.rows.where(F.col("fold") == m))
    return reduce(DataFrame.unionByName, out)
