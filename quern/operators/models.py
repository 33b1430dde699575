"""Model fits over folds with MLlib, as out-of-fold scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from statistics import median_high

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import clip, logit, sigmoid
from quern.operators.boosting import bin_of, cut_points
from quern.operators.ordered import met
from quern.sources.scratch import stored

Kinds = dict[str, Callable[[int], Estimator]]

#: Estimators by name; each takes the number of features.
MODELS: Kinds = {
    "boosted": lambda n: GBTClassifier(labelCol="y", maxDepth=4, maxIter=20, stepSize=0.1, seed=7),
    "stumps": lambda n: GBTClassifier(labelCol="y", maxDepth=1, maxIter=40, stepSize=0.2, seed=7),
    "forest": lambda n: RandomForestClassifier(labelCol="y", numTrees=40, maxDepth=6, featureSubsetStrategy="sqrt", seed=7),
    "logistic": lambda n: LogisticRegression(labelCol="y", regParam=1e-3),
    "factor": lambda n: FMClassifier(labelCol="y", factorSize=4, stepSize=0.05, maxIter=60, seed=7),
    "perceptron": lambda n: MultilayerPerceptronClassifier(labelCol="y", layers=[n, 16, 2], maxIter=60, seed=7),
}

#: Trees whose fit hangs on sums of weights alone, so that equal rows may be one.
TREES = ("boosted", "stumps")
#: MLlib looks for values in a sample of this number's square, which holds all cells, and takes no more bins than there are values.
ALL_BINS = 1 << 13


def _folds(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("fold").distinct().collect())


def in_parallel(one: Callable[[int], DataFrame], folds: list[int]) -> list[DataFrame]:
    """``one`` of each fold, at most four at a time: a fit is many small jobs, which leave cores idle one after the other."""
    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(one, folds))


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def weighed(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``(*by, y, *features, _w, _w2)``: rows that are equal in all of these as one, with the sum of their weights (1 each if none
    is named) and of their squares. A loss that sums over rows is the same over them, and columns of few values leave few."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.groupBy(*by, "y", *(F.col(f).cast("double").alias(f, metadata=df.schema[f].metadata) for f in features)).agg(F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"))


def logistic(cells: DataFrame, features: Sequence[str]) -> LogisticRegressionModel:
    """The fit of ``MODELS`` on the rows that ``weighed`` put together. MLlib penalises coefficients of scaled features, and the
    variance it scales by hangs on how weights are dealt to rows: the penalty makes good for that."""
    w, dealt, rows = cells.agg(F.sum("_w"), F.sum(F.col("_w") * F.col("_w")), F.sum("_w2")).first()
    estimator = MODELS["logistic"](len(features)).setWeightCol("_w")
    if w and w * w > dealt:
        estimator = estimator.setRegParam(estimator.getRegParam() * (w * w - dealt) / (w * w - rows))
    return estimator.fit(_assembled(cells, features))


def in_bins(df: DataFrame, features: Sequence[str], bins: int = 32) -> dict[str, Column]:
    """Each feature as the number of its bin, as trees of MLlib bin it, but cut by counts of all rows instead of a sample: a value
    is a bin of its own where there are no more than ``bins``, others are cut into so many of like counts. Codes of ``indexed``
    stay as they are, null and NaN stand in bin 0."""
    about = {f: df.schema[f].metadata for f in features}
    numbers = [f for f in features if about[f].get("ml_attr", {}).get("type") != "nominal"]
    number = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
    values = df.select(*(number(f).alias(f) for f in numbers))
    near = values.agg(*(F.approx_count_distinct(f) for f in numbers)).first() if numbers else []
    few = {f: values.select(f).where(F.col(f).isNotNull()).distinct() for f, n in zip(numbers, near, strict=True) if n <= 2 * bins}
    cuts = {f: sorted(r[0] for r in v.collect()) for f, v in few.items()}
    cuts = {f: v[:-1] for f, v in cuts.items() if len(v) <= bins}
    many = [f for f in numbers if f not in cuts]
    cuts |= cut_points(values, many, bins) if many else {}
    return {f: bin_of(number(f), cuts[f]).cast("double").alias(f) if f in cuts else F.col(f).alias(f, metadata=about[f]) for f in features}


class Factors:
    """A factorisation machine for each fold, all fitted side by side on ``cells(fold, y, *features, _w)``: the estimator of
    ``MODELS``, its start, loss, steps and end, but on rows with weights, which MLlib's does not take. A step is one aggregate:
    tasks sum gradients of their rows for all models, the driver gets one row for each model and coefficient."""

    def __init__(self, cells: DataFrame, features: Sequence[str], folds: Sequence[int]):
        self.features, self.folds = list(features), list(folds)
        estimator = MODELS["factor"](len(self.features))
        step, rounds, tol = estimator.getStepSize(), estimator.getMaxIter(), estimator.getTol()
        cells = cells.where(F.col("y").isNotNull() & F.col("fold").isNotNull())
        first = cells.limit(1)
        start = np.zeros(0)
        if not first.isEmpty():  # of no step, MLlib's fit is its start
            at = estimator.setMaxIter(0).fit(_assembled(first, self.features))
            start = np.concatenate([at.factors.toArray().ravel(), at.linear.toArray(), [at.intercept]])
        weights = cells.groupBy("fold").agg(F.sum("_w")).collect()
        rows = {m: sum(w for f, w in weights if f != m) for m in self.folds}
        at = self.coefficients = {m: start for m in self.folds}
        going = [m for m in self.folds if rows[m]]
        mean = {m: np.zeros_like(start) for m in going}
        square = {m: np.zeros_like(start) for m in going}
        for t in range(1, rounds + 1):
            if not going:
                break
            found = {m: np.zeros_like(start) for m in going}
            for r in cells.mapInPandas(self._slopes({m: at[m] for m in going}), "model int, place int, g double").groupBy("model", "place").agg(F.sum("g")).collect():
                found[r[0]][r[1]] = r[2] / rows[r[0]]
            for m in list(going):
                mean[m] = 0.9 * mean[m] + 0.1 * found[m]
                square[m] = 0.999 * square[m] + 0.001 * found[m] ** 2
                moved = at[m] - step * (mean[m] / (1 - 0.9**t)) / (np.sqrt(square[m] / (1 - 0.999**t)) + 1e-8)
                if np.linalg.norm(moved - at[m]) < tol * max(np.linalg.norm(moved), 1.0):
                    going.remove(m)
                at[m] = moved

    def _parts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        n = len(self.features)
        return at[: -n - 1].reshape(n, -1), at[-n - 1 : -1], at[-1]

    def _slopes(self, at: dict[int, np.ndarray]) -> Callable:
        features, parts = self.features, {m: self._parts(c) for m, c in at.items()}

        def sums(batches):
            found = dict.fromkeys(parts, 0.0)
            for b in batches:
                for m, (v, linear, intercept) in parts.items():
                    own = b[b["fold"] != m]
                    x = own[features].to_numpy(float)
                    s = x @ v
                    raw = intercept + x @ linear + ((s * s).sum(1) - (x * x) @ (v * v).sum(1)) / 2
                    d = own["_w"].to_numpy() * (1 / (1 + np.exp(-raw)) - own["y"].to_numpy(float))
                    found[m] = found[m] + np.concatenate([(x.T @ (d[:, None] * s) - v * ((x * x).T @ d)[:, None]).ravel(), x.T @ d, [d.sum()]])
            for m, g in found.items():
                if not np.isscalar(g):
                    yield pd.DataFrame({"model": m, "place": np.arange(len(g)), "g": g})

        return sums

    def score(self, fold: int) -> Column:
        v, linear, intercept = self._parts(self.coefficients[fold])
        x = [F.col(f).cast("double") for f in self.features]
        raw = reduce(lambda a, b: a + b, (F.lit(float(w)) * c for w, c in zip(linear, x, strict=True)), F.lit(float(intercept)))
        for k in range(v.shape[1]):
            terms = [F.lit(float(w)) * c for w, c in zip(v[:, k], x, strict=True)]
            total = reduce(lambda a, b: a + b, terms)
            raw = raw + (total * total - reduce(lambda a, b: a + b, (q * q for q in terms))) / 2
        return 1 / (1 + F.exp(-raw))


def forest(data: DataFrame, features: Sequence[str], weight: str | None = None) -> DataFrame:
    """``(id, fold, y, score)`` by the forest of ``MODELS`` on ``data(id, fold, y, *features)``, whose features are few bins. A bootstrap
    of rows draws a cell of n equal ones a Poisson number of mean n times; MLlib's own would draw the cell once for all. So each
    tree is a fit of its own on cells drawn by a hash of theirs, and cells, not rows, are scored by all trees."""
    grown = MODELS["forest"](len(features))
    trees, seed = grown.getNumTrees(), grown.getSeed()
    times = F.pandas_udf(lambda key, n: pd.Series([np.random.default_rng(k % 2**64).poisson(r, trees).tolist() for k, r in zip(key.tolist(), n, strict=True)]), "array<long>")
    cells = weighed(data, features, ["fold", *([weight] if weight else [])], weight)
    rows = F.coalesce(F.round(F.try_divide(F.col("_w") * F.col("_w"), F.col("_w2"))), F.lit(0.0))  # of one weight
    cells = cells.withColumns({"_each": F.try_divide(F.col("_w"), rows), "_times": times(F.xxhash64(F.lit(seed), "fold", "y", *features), rows)})
    cells = stored(_assembled(cells, features), "cells")
    folds = _folds(cells)

    def one(t: int, fold: int):
        drawn = F.get("_times", F.lit(t))
        taught = cells.where((F.col("fold") != fold) & F.col("y").isNotNull() & (drawn > 0)).withColumn("_w", drawn * F.col("_each"))
        return MODELS["forest"](len(features)).setNumTrees(1).setBootstrap(False).setSeed(seed + t).setMaxBins(ALL_BINS).setWeightCol("_w").fit(taught)

    with ThreadPoolExecutor(8) as pool:
        fitted = {f: [pool.submit(one, t, f) for t in range(trees)] for f in folds}
    scores = []
    for f in folds:
        out = cells.where(F.col("fold") == f).select("fold", *features, "features").dropDuplicates(["fold", *features]).withColumn("score", F.lit(0.0))
        for model in fitted[f]:
            scored = model.result().setRawPredictionCol("").setPredictionCol("").transform(out)
            out = scored.select("fold", *features, "features", (F.col("score") + vector_to_array("probability")[1] / trees).alias("score"))
        scores.append(out.drop("features"))
    scores = stored(reduce(DataFrame.unionByName, scores), "scores")
    return met(data, scores, ["fold", *features]).select("id", "fold", F.col("y").cast("int"), "score")


def out_of_fold(df: DataFrame, features: Sequence[str], model: str, weight: str | None = None) -> DataFrame:
    """``(id, fold, y, score)``: each fold scored by a model fitted on the others. The assembled rows are a stored table that
    all fits read, those that sum a loss over rows by way of ``weighed``; fits of several folds run side by side."""
    if model == "factor":
        rows = stored(df.withColumn("y", F.col("y").cast("double")), "rows")
        fitted = Factors(stored(weighed(rows, features, ["fold"], weight), "cells"), features, _folds(rows))
        return reduce(DataFrame.unionByName, (rows.where(F.col("fold") == f).select("id", "fold", F.col("y").cast("int"), fitted.score(f).alias("score")) for f in fitted.folds))
    if model in (*TREES, "forest"):  # they read bins, of which rows have few
        df = stored(df.select("id", "fold", "y", *features, *([weight] if weight else [])), "rows")
        df = df.withColumns(in_bins(df, features))
    if model == "forest":
        return forest(stored(df.withColumn("y", F.col("y").cast("double")), "binned"), features, weight)
    data = stored(_assembled(df.withColumn("y", F.col("y").cast("double")), features), "assembled")
    cells = stored(weighed(data, features, ["fold"], weight), "cells") if model in (*TREES, "logistic") else None

    def one(fold: int) -> DataFrame:
        if model in TREES:
            fitted = MODELS[model](len(features)).setMaxBins(ALL_BINS).setWeightCol("_w").fit(_assembled(cells.where(F.col("fold") != fold), features))
        elif cells is not None:
            fitted = logistic(cells.where(F.col("fold") != fold), features)
        else:
            estimator = MODELS[model](len(features))
            if weight:
                estimator = estimator.setWeightCol(weight)
            fitted = estimator.fit(data.where(F.col("fold") != fold))
        return fitted.transform(data.where(F.col("fold") == fold)).select("id", "fold", F.col("y").cast("int"), vector_to_array("probability")[1].alias("score"))

    return reduce(DataFrame.unionByName, in_parallel(one, _folds(data)))


def fit_apply(train: DataFrame, rows: DataFrame, features: Sequence[str], model: str) -> DataFrame:
    """``rows`` with ``score`` from a model fitted on ``train``; to teach from other rows, remove the overlap first."""
    train = train.withColumn("y", F.col("y").cast("double"))
    fitted = logistic(stored(weighed(train, features), "cells"), features) if model == "logistic" else MODELS[model](len(features)).fit(_assembled(train, features))
    scored = fitted.transform(_assembled(rows.drop("y"), features))
    return scored.select(*rows.drop("y").columns, vector_to_array("probability")[1].alias("score"))


def importances(df: DataFrame, features: Sequence[str]) -> list[tuple[str, float]]:
    fitted = MODELS["boosted"](len(features)).fit(_assembled(df.withColumn("y", F.col("y").cast("double")), features))
    return sorted(zip(features, fitted.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def platt(fit: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``calibrated``: a logistic fit of the label on the logit of the score."""
    scaled = lambda df: VectorAssembler(inputCols=["_z"], outputCol="_f").transform(df.withColumn("_z", logit(F.col("score"))))
    m = LogisticRegression(labelCol="y", featuresCol="_f").fit(scaled(fit.withColumn("y", F.col("y").cast("double"))))
    return rows.withColumn("calibrated", sigmoid(F.lit(float(m.coefficients[0])) * logit(F.col("score")) + F.lit(float(m.intercept))))


def supports_isotonic(fit: DataFrame, values: int = 200, rows: int = 2000) -> bool:
    """Whether a fit has rows and distinct scores enough for steps to mean something."""
    found = fit.agg(F.count_distinct("score"), F.count("*")).first()
    return found[0] >= values and found[1] >= rows


def isotonic(fit: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``calibrated``: the non-decreasing step fit of the label on the score; see ``supports_isotonic``."""
    m = IsotonicRegression(labelCol="y", featuresCol="score", predictionCol="calibrated").fit(fit.withColumn("y", F.col("y").cast("double")))
    return m.transform(rows)


def stack(scores: DataFrame, labels: DataFrame, models: Sequence[str]) -> DataFrame:
    """``(id, fold, y, score)``: a logistic fit on the models' logits, nested in the folds of ``labels``."""
    wide = scores.groupBy("id").pivot("model", list(models)).agg(F.first(logit(F.col("score"))))
    return out_of_fold(labels.join(wide, "id"), models, "logistic")


def residuals(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """``df`` with ``<target>_residual``: what the other columns, fitted on other folds, do not explain."""
    data = stored(_assembled(df, features), "assembled")

    def one(fold: int) -> DataFrame:
        m = GBTRegressor(labelCol=target, maxDepth=3, maxIter=10, seed=7, predictionCol="_p").fit(data.where(F.col("fold") != fold))
        return m.transform(data.where(F.col("fold") == fold)).withColumn(f"{target}_residual", F.col(target) - F.col("_p"))

    return reduce(DataFrame.unionByName, in_parallel(one, _folds(data))).drop("features", "_p")


def early_stopped(df: DataFrame, features: Sequence[str], most: int = 40, fold: str = "fold") -> tuple[DataFrame, int]:
    """``(id, fold, y, score)`` and the number of rounds: in each fold a boosted fit on the rows that are not ``is_es`` is
    watched on those that are; all folds are then fitted again, on all their rows, with the median of the best rounds.
    Trees read bins, rows of equal bins as one with a weight, and score bins instead of rows."""
    rows = stored(df.select("id", fold, F.col("y").cast("double").alias("y"), "is_es", *features), "rows")
    data = rows.withColumns(in_bins(rows, features))
    cells = stored(_assembled(weighed(data, features, [fold, "is_es"]), features), "cells")
    grown = lambda rounds: GBTClassifier(labelCol="y", maxDepth=3, maxIter=rounds, stepSize=0.2, seed=7, maxBins=ALL_BINS, weightCol="_w")

    def best(f: int) -> int:
        fitted = grown(most).fit(cells.where((F.col(fold) != f) & ~F.col("is_es")))
        losses = fitted.evaluateEachIteration(cells.where((F.col(fold) != f) & F.col("is_es")))
        return 1 + losses.index(min(losses))

    folds = sorted(r[0] for r in cells.select(fold).distinct().collect())
    rounds = int(median_high(in_parallel(best, folds)))

    def one(f: int) -> DataFrame:
        fitted = grown(rounds).fit(cells.where(F.col(fold) != f))
        own = cells.where(F.col(fold) == f).dropDuplicates(list(features))
        return fitted.transform(own).select(fold, *features, vector_to_array("probability")[1].alias("score"))

    scores = stored(reduce(DataFrame.unionByName, in_parallel(one, folds)), "scores")
    return met(data, scores, [fold, *features]).select("id", fold, F.col("y").cast("int"), "score"), rounds


def on_margin(df: DataFrame, reference: str, features: Sequence[str], share: float = 0.5) -> DataFrame:
    """``(id, fold, y, score)``: the logit of a reference score and one boosted step on what it leaves: y less the score,
    fitted on other folds by trees and added as ``share`` Newton steps. A step of 0 gives the reference back."""
    p = clip(F.col(reference), 1e-6, 1 - 1e-6)
    data = stored(_assembled(df.withColumns({"_left": (F.col("y") - p) / (p * (1 - p)), "_w": p * (1 - p)}), features), "assembled")

    def one(f: int) -> DataFrame:
        m = GBTRegressor(labelCol="_left", weightCol="_w", maxDepth=3, maxIter=10, seed=7, predictionCol="_step").fit(data.where(F.col("fold") != f))
        return m.transform(data.where(F.col("fold") == f)).select("id", "fold", "y", sigmoid(logit(F.col(reference)) + share * F.col("_step")).alias("score"))

    return reduce(DataFrame.unionByName, in_parallel(one, _folds(data)))


def multi_output(df: DataFrame, targets: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``(id, pred_<target>)``: each target predicted from ``features``, of which it is none, by a fit on other folds. Trees of
    squared loss hang on sums of a target alone, so they read rows of equal bins as one, with the mean of the target and their
    number as its weight, and score bins instead of rows. A row without a target does not teach it."""
    rows = stored(df.select("id", "fold", *targets, *features), "rows")
    data = rows.select("id", "fold", *targets, *in_bins(rows, features).values())
    means = {f"_n_{t}": F.count(t).cast("double") for t in targets} | {f"_y_{t}": F.avg(F.col(t).cast("double")) for t in targets}
    cells = stored(_assembled(data.groupBy("fold", *features).agg(*(v.alias(k) for k, v in means.items())), features), "cells")

    def one(fold: int, t: str):
        estimator = GBTRegressor(labelCol=f"_y_{t}", maxDepth=3, maxIter=8, seed=7, predictionCol=f"pred_{t}", maxBins=ALL_BINS, weightCol=f"_n_{t}")
        return estimator.fit(cells.where((F.col("fold") != fold) & (F.col(f"_n_{t}") > 0)))

    with ThreadPoolExecutor(8) as pool:
        fitted = {f: [pool.submit(one, f, t) for t in targets] for f in _folds(cells)}
    scores = []
    for f, of in fitted.items():
        out = reduce(lambda rows, model: model.result().transform(rows), of, cells.where(F.col("fold") == f))
        scores.append(out.select("fold", *features, *(f"pred_{t}" for t in targets)))
    scores = stored(reduce(DataFrame.unionByName, scores), "scores")
    return met(data, scores, ["fold", *features]).select("id", *(f"pred_{t}" for t in targets))


def teacher(other: DataFrame, rows: DataFrame, features: Sequence[str], model: str = "logistic") -> DataFrame:
    """``rows`` with ``score`` from a fit on another table, without its rows that equal one of ``rows`` in all features. If no
    row is left, as where features have few values and ``rows`` has them all, there is no teacher and scores are null."""
    taught = stored(other.join(rows.select(*features).distinct(), list(features), "left_anti"), "teachers")
    if taught.isEmpty():
        return rows.drop("y").withColumn("score", F.lit(None).cast("double"))
    return fit_apply(taught, rows, features, model)


def latent(fit: DataFrame, rows: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """``rows`` with ``latent``, their first k principal components as fitted on ``fit``; signs are arbitrary."""
    m = PCA(k=k, inputCol="features", outputCol="_l").fit(_assembled(fit, features))
    return m.transform(_assembled(rows, features)).withColumn("latent", vector_to_array("_l")).drop("features", "_l")


def centre_distances(fit: DataFrame, rows: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """``rows`` with ``distances`` to the k centres fitted on ``fit``."""
    m = KMeans(k=k, seed=7, maxIter=10).fit(_assembled(fit, features))
    point = F.array(*(F.col(c).cast("double") for c in features))
    to = [F.sqrt(F.aggregate(F.zip_with(point, F.array(*map(F.lit, map(float, c))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) for c in m.clusterCenters()]
    return rows.withColumn("distances", F.array(*to))


def indexed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with each text column as an alphabetical code, for tree fits on categories."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_code", stringOrderType="alphabetAsc", handleInvalid="keep") for c in columns]
    return Pipeline(stages=stages).fit(df).transform(df)
