"""Further tests, screens and gates, each a composition of folds, encodings, metrics and blends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import clip, logit
from quern.operators.metrics import auc, placements
from quern.operators.ordered import before, midrank, quantiles
from quern.sources.scratch import stored


def feature_screen(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, auc, strength)`` of each numeric feature alone; strength is the AUC in its better direction. All
    features are ranked in one pass over their unpivoted values."""
    long = df.select("y", F.explode(F.create_map(*(x for f in features for x in (F.lit(f), F.col(f).cast("double"))))).alias("feature", "v"))
    found = auc(long.where(F.col("v").isNotNull()), "v", ["feature"])
    return found.select("feature", "auc", F.greatest("auc", 1 - F.col("auc")).alias("strength"))


def row_credit(df: DataFrame, score: str) -> DataFrame:
    """``df`` with ``lost``: the pairs that a row of label 1 or 0 loses, ties half."""
    n = df.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    other = F.when(F.col("y") == 1, F.lit(n[1])).otherwise(F.lit(n[0]))
    return placements(df, score, "_v").withColumn("lost", (1 - F.col("_v")) * other).drop("_v")


def clean_auc(noisy: float, flips: float, rate: float) -> float:
    """The AUC against true labels that ``noise_ceiling`` turns into ``noisy``, by bisection; it rises with it."""
    p = rate * (1 - flips) + (1 - rate) * flips
    a, b = rate * (1 - flips) / p, rate * flips / (1 - p)
    seen = lambda x: a * (1 - b) * x + (1 - a) * b * (1 - x) + (a * b + (1 - a) * (1 - b)) / 2
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if seen(mid) < noisy else (low, mid)
    return (low + high) / 2


def cross_bucket_errors(df: DataFrame, score: str, bucket: str) -> DataFrame:
    """``(one, zero, pairs, errors)`` for each pair of buckets (ones of the first, zeros of the second): pairs, and those
    in which the zero is ranked above, ties half. Only counts by bucket and score value meet."""
    cells = stored(df.where("y is not null").groupBy(score, F.col(bucket).alias("_b"), "y").agg(F.count("*").alias("_n")), "cells")
    names = [r[0] for r in cells.select("_b").distinct().collect()]
    grid = cells.withColumn("zero", F.explode(F.array(*map(F.lit, names))))
    run = before(grid, score, {"_z": F.when((F.col("_b") == F.col("zero")) & (F.col("y") == 0), F.col("_n")).otherwise(0)}, ["zero"])
    ones = grid.where("y = 1").select(F.col("_b").alias("one"), "zero", score, "_n")
    met = ones.join(run, ["zero", score])
    above = F.col("_z_all") - F.col("_z_before") - F.col("_z") / 2
    return met.groupBy("one", "zero").agg(F.sum(F.col("_n") * F.col("_z_all")).alias("pairs"), F.sum(F.col("_n") * above).alias("errors"))


def noise_ceiling(auc_clean: Column, flips: Column, rate: Column) -> Column:
    """AUC against labels of which a share ``flips`` was turned at random, for a score of AUC ``auc_clean`` against the
    true ones, of which a share ``rate`` is 1."""
    p = rate * (1 - flips) + (1 - rate) * flips
    a, b = rate * (1 - flips) / p, rate * flips / (1 - p)
    return a * (1 - b) * auc_clean + (1 - a) * b * (1 - auc_clean) + (a * b + (1 - a) * (1 - b)) / 2


def draw_summary(draws: DataFrame, column: str) -> DataFrame:
    """One row on a figure over draws: mean, 5, 50 and 95 %, mean of the worst twentieth, share above 0."""
    n = draws.count()
    worst = draws.orderBy(column).limit(max(1, -(-n // 20))).agg(F.avg(column)).first()[0]
    return draws.agg(
        # A draw is one row, so there are few.
        F.avg(column).alias("mean"), *(F.percentile(column, q / 100).alias(f"p{q:02d}") for q in (5, 50, 95)), F.lit(worst).alias("worst"), F.avg((F.col(column) > 0).cast("double")).alias("positive")
    )


def group_offsets(df: DataFrame, score: str, group: str, penalty: float, rounds: int = 25) -> DataFrame:
    """``(group, offset)``: the shift of each group's logits that fits its labels best under a quadratic penalty.

    Labels are first summed by group and score, rounded to four digits of the logit, which bounds a group's cells
    whatever its rows; then each group's Newton steps run in one expression, with the gradient and curvature of the
    same penalty.
    """
    rows = df.select(F.col(group).alias("group"), "y", F.round(logit(F.col(score)), 4).alias("z")).groupBy("group", "z").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    packed = rows.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("z", "t", "n"))).alias("cells"))

    def step(d: Column) -> Column:
        p = lambda c: 1 / (1 + F.exp(-(c["z"] + d)))
        grad = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["t"] - c["n"] * p(c)) - penalty * d
        curve = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["n"] * p(c) * (1 - p(c))) + penalty
        return d + grad / curve

    newton = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0.0), lambda d, _: step(d))
    return packed.select("group", newton.alias("offset"))


def confident(df: DataFrame, score: str, share: float) -> DataFrame:
    """The most confident rows of either side with ``label``, as pseudo-labels: the top and the bottom ``share``."""
    ranked = midrank(df, score, "_r")
    label = F.when(F.col("_r") > F.col("_r_of") * (1 - share), 1).when(F.col("_r") <= F.col("_r_of") * share, 0)
    return ranked.withColumn("label", label).where(F.col("label").isNotNull()).drop("_r", "_r_of")


def near_tie_weights(df: DataFrame, score: str, share: float, weight: float) -> DataFrame:
    """``df`` with ``weight`` on the rows whose logit is nearest to 0, a share of all; 1 on others."""
    margin = F.abs(logit(F.col(score)))
    cut = quantiles(df.select(margin.alias("_m")), "_m", {"cut": share}).first()["cut"]
    return df.withColumn("weight", F.when(margin <= F.lit(cut + 1e-9), F.lit(weight)).otherwise(F.lit(1.0)))


def signatures(probabilities: Sequence[Column], actual: Column) -> dict[str, Column]:
    """Figures of a predicted distribution over 0, 1, 2 ... against the value seen: expected value, residual,
    surprisal, entropy, variance and mass in the upper half."""
    total: Column = sum(probabilities, F.lit(0.0))
    p = [clip(c / total, 1e-12, 1.0) for c in probabilities]
    mean: Column = sum((k * c for k, c in enumerate(p)), F.lit(0.0))
    seen = F.element_at(F.array(*p), actual.cast("int") + 1)
    return {
        "ev": mean, "residual": actual - mean, "surprisal": -F.log(seen), "entropy": -sum((c * F.log(c) for c in p), F.lit(0.0)),
        "variance": sum((c * (k - mean) * (k - mean) for k, c in enumerate(p)), F.lit(0.0)), "upper": sum(p[len(p) // 2 :], F.lit(0.0)),
    }


def soft_target(y: Column, teacher: Column, share: float) -> Column:
    return (1 - share) * y + share * clip(teacher, 1e-6, 1 - 1e-6)


def log_loss(df: DataFrame, score: str) -> DataFrame:
    p = clip(F.col(score), 1e-6, 1 - 1e-6)
    return df.agg((-F.avg(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("log_loss"))


def marginal_gain(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """``(model, auc_without, gain)``: what the mean of all models loses without each. The sum of all less a model's own
    score serves every model at once. Means are rounded to twelve digits, so that ties do not hang on the order of sums."""
    every = scores.groupBy("id").agg(F.sum("score").alias("_s"), F.count("*").alias("_n"))
    without = scores.join(every, "id").withColumn("score", F.round((F.col("_s") - F.col("score")) / (F.col("_n") - 1), 12))
    whole = auc(every.select("id", F.round(F.col("_s") / F.col("_n"), 12).alias("score")).join(labels, "id"), "score").first()["auc"]
    each = auc(without.join(labels, "id"), "score", ["model"])
    return each.select("model", F.col("auc").alias("auc_without"), (F.lit(whole) - F.col("auc")).alias("gain"))


def log_log_slope(df: DataFrame, x: str, y: str) -> DataFrame:
    lx, ly = F.log(F.col(x).cast("double")), F.log(F.col(y).cast("double"))
    return df.agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.regr_r2(ly, lx).alias("r2"))


def second_choice(draws: DataFrame) -> DataFrame:
    """One row from ``draws(draw, a, b)``: how often b beats a, and what the better of both gains over a on average."""
    return draws.agg(F.avg((F.col("b") > F.col("a")).cast("double")).alias("p_better"), F.avg(F.greatest(F.col("b") - F.col("a"), F.lit(0.0))).alias("gain"))
