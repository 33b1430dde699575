"""Ratings predicted from other columns: distributions of classes, and chains of linear predictions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import stored


def _by_fold(values: dict[int, float], fold: Column) -> Column:
    """A number for each fold; rows of other folds get that under None."""
    out = F.lit(float(values[None]))
    for f, v in values.items():
        if f is not None:
            out = F.when(fold == f, F.lit(float(v))).otherwise(out)
    return out


def class_distributions(df: DataFrame, targets: Sequence[str], features: Sequence[str], classes: int = 6, alpha: float = 1.0) -> DataFrame:
    """``(id, p_<target>)``: for each target the probabilities of classes 0 to ``classes - 1``, naive Bayes over all other targets
    and features of ``df(id, fold, ...)``, from the rows of other folds alone.

    Counts of (input, value) by the classes of all targets are one aggregate over rows unpivoted by input; a row's own fold is
    then taken off. Counts are raised by ``alpha``. Null is a value of an input like others, and a null target teaches its own
    distribution nothing; a null fold takes nothing off. Ids should be unique. Features are to be of few values: bin numbers
    before.
    """
    inputs = [*targets, *features]
    cells = [(t, c) for t in targets for c in range(classes)]
    long = F.inline(F.array(*(F.struct(F.lit(i).alias("_i"), F.col(c).cast("string").alias("_v")) for i, c in enumerate(inputs))))
    data = stored(df.select("id", "fold", *dict.fromkeys(inputs)), "classes")
    in_class = {f"{t}_{c}": F.count_if(F.col(t) == c) for t, c in cells}
    counted = stored(data.select("fold", *targets, long).groupBy("_i", "_v", "fold").agg(*(v.alias(f"_o_{k}") for k, v in in_class.items())), "class_counts")
    total = counted.groupBy("_i", "_v").agg(*(F.sum(f"_o_{k}").alias(f"_a_{k}") for k in in_class))
    kinds = {r["_i"]: r["n"] for r in total.groupBy("_i").agg(F.count("*").alias("n")).collect()}
    whole = data.groupBy("fold").agg(*(v.alias(k) for k, v in in_class.items())).collect()
    left = lambda k: {None: sum(r[k] for r in whole)} | {r["fold"]: sum(o[k] for o in whole) - r[k] for r in whole if r["fold"] is not None}
    sizes = {k: left(k) for k in in_class}
    spread = F.get(F.array(*(F.lit(float(kinds.get(i, 0))) for i in range(len(inputs)))), F.col("_i"))

    a, b = total.withColumnsRenamed({"_i": "_ai", "_v": "_av"}), counted.withColumnsRenamed({"_i": "_bi", "_v": "_bv", "fold": "_bf"})
    rows = data.select("id", "fold", long)
    rows = rows.join(a, (F.col("_i") == F.col("_ai")) & F.col("_v").eqNullSafe(F.col("_av")), "left")
    rows = rows.join(b, (F.col("_i") == F.col("_bi")) & F.col("_v").eqNullSafe(F.col("_bv")) & (F.col("fold") == F.col("_bf")), "left")

    def likelihood(t: str, c: int) -> Column:
        n = F.col(f"_a_{t}_{c}") - F.coalesce(F.col(f"_o_{t}_{c}"), F.lit(0))
        part = F.log((n + alpha) / (_by_fold(sizes[f"{t}_{c}"], F.col("fold")) + alpha * spread))
        return F.sum(F.when(F.col("_i") != inputs.index(t), part)).alias(f"_l_{t}_{c}")

    summed = rows.groupBy("id", "fold").agg(*(likelihood(t, c) for t, c in cells))
    out = []
    for t in targets:
        every = {f: sum(sizes[f"{t}_{c}"][f] for c in range(classes)) for f in sizes[f"{t}_0"]}
        logs = [F.coalesce(F.col(f"_l_{t}_{c}"), F.lit(0.0)) + F.log((_by_fold(sizes[f"{t}_{c}"], F.col("fold")) + alpha) / (_by_fold(every, F.col("fold")) + alpha * classes)) for c in range(classes)]
        most = F.greatest(*logs)
        weights = [F.exp(x - most) for x in logs]
        out.append(F.array(*(w / reduce(add, weights) for w in weights)).alias(f"p_{t}"))
    return summed.select("id", *out)


def linear_chain(df: DataFrame, features: dict[str, Sequence[str]], ridge: float = 1e-9) -> DataFrame:
    """``(id, pred_<target>)``: each target of ``df(id, fold, ...)``, in the order of ``features``, by least squares on its features
    and on the predictions of all targets before it, out of fold.

    For the model of fold m, a row of another fold f gets predictions of fits without m and f, a row of m those of fits
    without m: what a target is fitted on was predicted as it will be for rows of m, and no label of m has a part in it.
    A target is one aggregate of moments by (m, fold); fits are differences of sums, whose size hangs on folds and columns alone.
    Rows that lack a target or a feature do not teach; a null feature, or a null fold, gives null predictions.
    """
    columns = dict.fromkeys([*features, *(c for own in features.values() for c in own)])
    data = stored(df.select("id", "fold", *(F.col(c).cast("double").alias(c) for c in columns)), "chain")
    folds = sorted(r[0] for r in data.where("fold is not null").select("fold").distinct().collect())
    if not folds:
        return data.select("id", *(F.lit(None).cast("double").alias(f"pred_{t}") for t in features))
    chained: list[str] = []
    for t, own_features in features.items():
        size = 1 + len(own_features) + len(chained)
        inputs = lambda i: [F.lit(1.0), *(F.col(f) for f in own_features), *(F.get(f"_{c}", F.lit(i)) for c in chained)]  # noqa: E731, B023
        long = data.select("fold", F.col(t).alias("_t"), F.inline(F.array(*(F.struct(F.lit(i).alias("_m"), *(x.alias(f"_x{k}") for k, x in enumerate(inputs(i)))) for i in range(len(folds))))))
        known = reduce(lambda p, q: p & q, (F.col(c).isNotNull() for c in ("_t", "fold", *(f"_x{k}" for k in range(size)))))
        products = {f"s{i}_{j}": F.col(f"_x{i}") * F.col(f"_x{j}") for i in range(size) for j in range(i, size)} | {f"y{i}": F.col(f"_x{i}") * F.col("_t") for i in range(size)}
        sums = {(r["_m"], r["fold"]): r for r in long.where(known).groupBy("_m", "fold").agg(*(F.sum(v).alias(k) for k, v in products.items())).collect()}

        def weights(m: int, without: set[int]) -> list[float]:
            own = [r for (i, f), r in sums.items() if i == m and f not in without]  # noqa: B023
            left = np.array([[sum(r[f"s{min(i, j)}_{max(i, j)}"] for r in own) for j in range(size)] for i in range(size)], float)  # noqa: B023
            right = np.array([sum(r[f"y{i}"] for r in own) for i in range(size)], float)  # noqa: B023
            if not own:
                return [float("nan")] * size  # noqa: B023
            scale = np.sqrt(np.maximum(np.diag(left), 1e-300))
            return (np.linalg.solve(left / np.outer(scale, scale) + ridge * np.eye(len(scale)), right / scale) / scale).tolist()

        def predicted(i: int) -> Column:
            out = F.lit(None).cast("double")
            for f in folds:
                w = weights(i, {folds[i], f})
                out = F.when(F.col("fold") == f, F.nanvl(reduce(add, (F.lit(x) * c for x, c in zip(w, inputs(i), strict=True))), F.lit(None).cast("double"))).otherwise(out)  # noqa: B023
            return out

        data = stored(data.withColumn(f"_{t}", F.array(*(predicted(i) for i in range(len(folds))))), "chain")
        chained.append(t)
    own = F.array_position(F.array(*map(F.lit, folds)), F.col("fold")) - 1
    return data.select("id", *(F.get(f"_{t}", own.cast("int")).alias(f"pred_{t}") for t in features))
