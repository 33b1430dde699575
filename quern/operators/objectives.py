"""An objective over all pairs of a 1 and a 0, from running sums over ordered scores; no pair is formed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.boosting import Loss
from quern.operators.ordered import before, met
from quern.sources.scratch import stored


def pair_slopes(df: DataFrame, score: str = "margin", label: str = "y", by: Sequence[str] = ("model",), gap: float = 1.0) -> DataFrame:
    """``df`` with ``g, h, pair_loss``: gradient and curvature by its score of the mean, over all pairs of a row of label 1 and
    one of label 0 within ``by``, of max(0, gap - (score of the 1 - score of the 0))^2, times the rows; and its share of
    that mean.

    A pair counts if score - gap * label of the 1 lies below that of the 0, so one order holds all pairs: a row's sums over
    its partners are sums of counts, scores and squares of all rows before or after it. Rows of a null score or label, and a
    group of one label, have slopes of 0.
    """
    by = list(by)
    s, one = F.col(score).cast("double"), F.col(label) == 1
    known = F.col(score).isNotNull() & F.col(label).isNotNull()
    keyed = df.withColumn("_v", F.when(known, s - gap * F.col(label)))
    sums = {"_p": one.cast("long"), "_q": (~one).cast("long")}
    for name, power in (("", s), ("2", s * s)):
        sums |= {f"_ps{name}": F.when(one, power).otherwise(0.0), f"_qs{name}": F.when(one, 0.0).otherwise(power)}
    found = before(keyed, "_v", sums, by)
    after = lambda k: F.col(f"{k}_all") - F.col(f"{k}_before") - F.col(k)
    parts = [after(k).alias(f"_{k}") for k in ("_q", "_qs", "_qs2")] + [F.col(f"{k}_before").alias(f"_{k}") for k in ("_p", "_ps", "_ps2")]
    found = found.select(*by, "_v", *parts, F.col("_p_all").alias("_P"), F.col("_q_all").alias("_Q"))
    rows = met(keyed, found, [*by, "_v"])
    c = F.col
    scale = (c("_P") + c("_Q")) / (c("_P") * c("_Q"))
    room = gap - s  # of a 1: what its partner's score exceeds minus the room
    up = -2 * (c("__q") * room + c("__qs"))
    down = 2 * (c("__p") * (gap + s) - c("__ps"))
    # Each pair once, at the row of label 1.
    loss = c("__q") * room * room + 2 * room * c("__qs") + c("__qs2")
    real = known & (c("_P") > 0) & (c("_Q") > 0)
    of = lambda x, y: F.when(real, F.when(one, x).otherwise(y) * scale).otherwise(0.0)
    share = F.when(real & one, loss / (c("_P") * c("_Q"))).otherwise(0.0)
    return rows.select(*df.columns, of(up, down).alias("g"), of(2.0 * c("__q"), 2.0 * c("__p")).alias("h"), share.alias("pair_loss"))


#: To boost by: the trees' gradients are those of all pairs. It starts at 0; the loss that is watched is the logistic one.
PAIRS = Loss(None, lambda y, s: F.log1p(F.exp(F.least(F.greatest(-s, F.lit(-35.0)), F.lit(35.0)))) + (1 - y) * s, lambda mean: F.lit(0.0) * mean, lambda rows: pair_slopes(rows).select("id", "model", "g", "h"))


def _weighted(weights: dict[int, np.ndarray], features: Sequence[str], model: Column) -> Column:
    """The linear score of a row by its model's weights."""
    score = lambda w: reduce(add, (F.lit(float(x)) * F.col(f) for x, f in zip(w, features, strict=True)))
    out = F.lit(None).cast("double")
    for m, w in weights.items():
        out = F.when(model == m, score(w)).otherwise(out)
    return out


def linear_pair_fit(df: DataFrame, features: Sequence[str], steps: int = 6, gap: float = 1.0) -> tuple[DataFrame, list[float]]:
    """``(id, fold, y, score)`` and the mean pair loss before each step and after the last: for each fold, weights of ``features``
    that lower the loss of ``pair_slopes`` over the rows of the other folds, scored on its own.

    Weights begin at 0. A step solves for the gradient by twice the mean of (x1 - x0)(x1 - x0)' over all pairs, from class
    means and second moments; as no pair's curvature exceeds that, no step raises the loss. The driver holds one square matrix of
    the features for each fold. Features should be of one scale; a null one makes a score null, which then has no part.
    """
    features = list(features)
    data = stored(df.select("id", "fold", F.col("y").cast("int").alias("y"), *(F.col(f).cast("double").alias(f) for f in features)), "linear")
    folds = sorted(r[0] for r in data.where("fold is not null").select("fold").distinct().collect())
    models = F.explode(F.array(*map(F.lit, folds)))
    long = data.withColumn("model", models).where((F.col("fold") != F.col("model")) & F.col("y").isNotNull() & F.forall(F.array(*features), lambda x: x.isNotNull()))
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    moments = [F.avg(f).alias(f"m{i}") for i, f in enumerate(features)] + [F.avg(F.col(features[i]) * F.col(features[j])).alias(f"m{i}_{j}") for i, j in pairs]
    by_class = {(r["model"], r["y"]): r for r in long.groupBy("model", "y").agg(*moments).collect()}
    curvature, weights = {}, {}
    for m in folds:
        weights[m] = np.zeros(len(features))
        if (m, 0) in by_class and (m, 1) in by_class:
            first, second = {}, {}
            for y in (0, 1):
                r = by_class[m, y]
                first[y] = np.array([r[f"m{i}"] for i in range(len(features))])
                second[y] = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(len(features))] for i in range(len(features))])
            cross = np.outer(first[1], first[0])
            curvature[m] = 2 * (second[0] + second[1] - cross - cross.T) + 1e-9 * np.eye(len(features))
    losses: list[float] = []
    for step in range(steps + 1):
        slopes = pair_slopes(long.withColumn("margin", _weighted(weights, features, F.col("model"))), gap=gap)
        sums = [F.sum(F.col("g") * F.col(f)).alias(f"g{i}") for i, f in enumerate(features)]
        found = slopes.groupBy("model").agg(F.sum("pair_loss").alias("loss"), F.count("*").alias("n"), *sums).collect()
        losses.append(float(np.mean([r["loss"] for r in found])) if found else 0.0)
        for r in found if step < steps else []:
            if r["model"] in curvature:
                gradient = np.array([r[f"g{i}"] for i in range(len(features))]) / r["n"]
                weights[r["model"]] = weights[r["model"]] - np.linalg.solve(curvature[r["model"]], gradient)
    return data.select("id", "fold", "y", _weighted(weights, features, F.col("fold")).alias("score")), losses
