"""Tie-exact ranking metrics. Scores are collapsed to distinct values, then summed in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import normal_tail
from quern.operators.ordered import before, met
from quern.sources.scratch import stored


def auc(df: DataFrame, score: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """``(*by, auc, errors, pairs)``: the share of (1, 0) pairs in right order, ties half; misordered pairs plus half of
    the tied ones; all pairs. Rows may have weights. One class alone gives a null AUC. Rows without a score or a label form
    no pair."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    found = before(df.where(F.col("y").isNotNull()), score, {"_p": w * F.col("y"), "_q": w * (1 - F.col("y"))}, by)
    good = F.sum(F.col("_p") * (F.col("_q_before") + F.col("_q") / 2))
    pairs = F.sum("_p") * F.sum("_q")
    out = found.groupBy(*by).agg(good.alias("_good"), pairs.alias("pairs"))
    return out.select(*by, (F.col("_good") / F.nullif("pairs", F.lit(0.0))).alias("auc"), (F.col("pairs") - F.col("_good")).alias("errors"), "pairs")


def auc_elsewhere(df: DataFrame, score: str, folds: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """``(but, *by, auc)``: for each of ``folds`` the AUC of the rows of all other folds. Rows are counted once by fold and score;
    the counts alone are repeated for the folds that they serve."""
    cells = stored(df.where(F.col("fold").isNotNull()).groupBy(*by, "fold", score, "y").agg(F.count("*").alias("_rows")), "cells")
    served = cells.withColumn("but", F.explode(F.filter(F.array(*map(F.lit, folds)), lambda f: f != F.col("fold"))))
    return auc(served, score, ["but", *by], F.col("_rows")).select("but", *by, "auc")


def placements(df: DataFrame, score: str, name: str) -> DataFrame:
    """``df`` with each row's share of the other class that it beats (ones) or that beats it (zeros), ties half; null for
    a row without a score or a label, which no other row meets."""
    found = before(df.where(F.col("y").isNotNull()), score, {"_p": F.col("y"), "_q": 1 - F.col("y")})
    below = (F.col("_q_before") + F.col("_q") / 2) / F.col("_q_all")
    above = (F.col("_p_all") - F.col("_p_before") - F.col("_p") / 2) / F.col("_p_all")
    placed = met(df, found.select(score, below.alias("_below"), above.alias("_above")), [score])
    return placed.withColumn(name, F.when(F.col("y") == 1, F.col("_below")).when(F.col("y") == 0, F.col("_above"))).drop("_below", "_above")


def delong(df: DataFrame, a: str, b: str) -> DataFrame:
    """Paired comparison of two scores: both AUCs, the difference, its standard error, a 95 % interval and the
    one-sided p that b is no better. Equal scores have error 0 and p 1. Rows without a label or one of the scores are
    left out."""
    df = stored(df.where(F.col("y").isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select("y", a, b), "scores")
    both = placements(placements(df, a, "_va"), b, "_vb").withColumn("_d", F.col("_vb") - F.col("_va"))
    one = both.groupBy("y").agg(F.avg("_va").alias("a"), F.avg("_vb").alias("b"), (F.var_samp("_d") / F.count("*")).alias("v"))
    row = one.agg(F.max(F.when(F.col("y") == 1, F.col("a"))).alias("auc_a"), F.max(F.when(F.col("y") == 1, F.col("b"))).alias("auc_b"), F.sqrt(F.sum("v")).alias("se"))
    delta = F.col("auc_b") - F.col("auc_a")
    p = F.when(F.col("se") > 0, normal_tail(delta / F.col("se"))).otherwise(F.when(delta > 0, 0.0).otherwise(1.0))
    return row.select("auc_a", "auc_b", delta.alias("delta"), "se", (delta - 1.959963984540054 * F.col("se")).alias("low"), (delta + 1.959963984540054 * F.col("se")).alias("high"), p.alias("p"))


def hanley_mcneil(auc: Column, ones: Column, zeros: Column) -> Column:
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return F.sqrt((auc * (1 - auc) + (ones - 1) * (q1 - auc * auc) + (zeros - 1) * (q2 - auc * auc)) / (ones * zeros))


def holm(df: DataFrame, p: str, id: str) -> DataFrame:
    """``df`` (one row for each hypothesis) with ``p_holm``, adjusted step-down."""
    order = Window.orderBy(p, id)
    n = F.count("*").over(Window.partitionBy())
    scaled = F.least(F.lit(1.0), (n - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("_s", scaled).withColumn("p_holm", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def total_variation(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: half the sum of differences between the shares of each value; null is a value."""
    share = lambda df, name: df.groupBy(F.col(column).alias("_v")).agg((F.count("*") / F.lit(max(1, df.count()))).alias(name))
    left, right = share(a, "_a"), share(b, "_b").withColumnRenamed("_v", "_u")
    both = left.join(right, F.col("_v").eqNullSafe(F.col("_u")), "full")
    return both.agg((F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))) / 2).alias("tv"))


def ks(df: DataFrame, value: str, side: str) -> DataFrame:
    """One row: the largest gap between the distribution functions of ``value`` where ``side`` is 1 and where it is 0."""
    found = before(df.where(F.col(value).isNotNull()), value, {"_p": F.col(side), "_q": 1 - F.col(side)})
    gap = F.abs((F.col("_p_before") + F.col("_p")) / F.col("_p_all") - (F.col("_q_before") + F.col("_q")) / F.col("_q_all"))
    return found.agg(F.max(gap).alias("ks"))


def ecdf(fit: DataFrame, rows: DataFrame, value: str, name: str, by: Sequence[str] = (), spare: bool = False) -> DataFrame:
    """``rows`` with the share of ``fit`` below a value, ties half, within ``by``; values need not occur in ``fit``. A null
    value has none. A segment that ``fit`` lacks has none either or, with ``spare``, the share of all of ``fit``."""
    keep = [*by, value]
    both = fit.select(*keep, F.lit(1).alias("_f")).unionByName(rows.select(*keep, F.lit(0).alias("_f")))
    found = before(both, value, {"_f": F.col("_f")}, by)
    share = (F.col("_f_before") + F.col("_f") / 2) / F.nullif(F.col("_f_all"), F.lit(0))
    out = met(rows, found.select(*keep, share.alias(name)), keep)
    if spare and by:
        out = ecdf(fit, out, value, "_spare").withColumn(name, F.coalesce(name, "_spare")).drop("_spare")
    return out


def near_tie_counts(df: DataFrame, score: str, margin: float) -> DataFrame:
    """One row: (1, 0) pairs whose scores differ by less than ``margin``, and pairs misordered by at least ``margin``.

    Zeros moved by the margin are counted against ones on the same axis: one pass over distinct values, no pairs.
    """
    scored = df.select("y", F.round(score, 9).alias("_s"))
    zeros = scored.where("y = 0")
    parts = scored.where("y = 1").select(F.col("_s").alias("_v"), F.lit(1).alias("_p"), F.lit(0).alias("_l"), F.lit(0).alias("_h"))
    parts = parts.unionByName(zeros.select(F.round(F.col("_s") + margin, 9).alias("_v"), F.lit(0).alias("_p"), F.lit(0).alias("_l"), F.lit(1).alias("_h")))
    parts = parts.unionByName(zeros.select(F.round(F.col("_s") - margin, 9).alias("_v"), F.lit(0).alias("_p"), F.lit(1).alias("_l"), F.lit(0).alias("_h")))
    found = before(parts, "_v", {"_p": F.col("_p"), "_l": F.col("_l"), "_h": F.col("_h")})
    above_low = F.col("_l_before")
    within = F.sum(F.col("_p") * (above_low - F.col("_h_before") - F.col("_h")))
    wrong = F.sum(F.col("_p") * (F.col("_l_all") - F.col("_l_before")))
    return found.agg(within.alias("near"), wrong.alias("confident_wrong"))
