"""Exact accounts of (1, 0) pairs under two scores, without forming a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.metrics import auc
from quern.operators.ordered import before, midrank
from quern.sources.scratch import stored


def joint_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """For each pair of scores ``(a, b)`` that rows of label 1 have, their number ``ones`` and the rows of label 0 by their place under
    both scores: ``ll`` (below it under a and under b), ``le``, ``lg``, ``el`` ... ``gg``. Rows without a label or a
    score form no pair.

    Rows of equal scores are one cell from the start. Two cells of different rank under a agree in the high bits of their
    ranks and first differ in one bit: the one with the lower rank has 0 there. So each cell joins one group for each
    bit, and within a group a running count over b gives the zeros below and level. That is n log n cells; large groups
    are summed by ranges.
    """
    known = df.where(F.col("y").isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = stored(known.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.sum("y").alias("_p"), F.sum(1 - F.col("y")).alias("_z")), "cells")
    sums = {"_z": F.col("_z"), "_i": F.lit(1)}
    under_a = stored(before(cells, "_a", sums).select("_a", F.col("_z_before").alias("_la"), F.col("_z_all").alias("_all"), F.col("_i_before").alias("_i")), "under")
    under_b = before(cells, "_b", {"_z": F.col("_z")}).select("_b", F.col("_z_before").alias("_lb"), F.col("_z").alias("_eb"))
    top = (under_a.agg(F.max("_i")).first()[0] or 0).bit_length()
    rows = cells.join(under_a.select("_a", F.col("_i").cast("bigint").alias("_r")), "_a")
    bits = rows.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(max(top - 1, 0)))))
    bits = bits.withColumns({"_side": F.call_function("shiftright", F.col("_r"), F.col("_bit")) % 2, "_group": F.call_function("shiftright", F.col("_r"), F.col("_bit") + 1)})
    # Ones count from the upper side of a group, zeros from the lower.
    bits = bits.where(F.when(F.col("_side") == 1, F.col("_p")).otherwise(F.col("_z")) > 0)
    low = before(bits, "_b", {"_z": F.when(F.col("_side") == 0, F.col("_z")).otherwise(0)}, ["_bit", "_group"])
    low = bits.where("_side = 1").join(low.drop("_z_all").withColumnRenamed("_z", "_e"), ["_bit", "_group", "_b"]).groupBy("_a", "_b").agg(F.sum("_z_before").alias("ll"), F.sum("_e").alias("le"))
    same = before(cells, "_b", {"_z": F.col("_z")}, ["_a"]).select("_a", "_b", F.col("_z_before").alias("el"), F.col("_z").alias("ee"), F.col("_z_all").alias("_ea"))
    ones = cells.where("_p > 0").select("_a", "_b", F.col("_p").alias("ones")).join(low, ["_a", "_b"], "left").na.fill(0, ["ll", "le"])
    c = ones.join(same, ["_a", "_b"]).join(under_a.drop("_i"), "_a").join(under_b, "_b")
    c = c.withColumns({"lg": F.expr("_la - ll - le"), "eg": F.expr("_ea - el - ee"), "gl": F.expr("_lb - ll - el"), "ge": F.expr("_eb - le - ee")})
    c = c.withColumn("gg", F.expr("_all - ll - le - lg - el - ee - eg - gl - ge"))
    return c.select(F.col("_a").alias(a), F.col("_b").alias(b), "ones", "ll", "le", "lg", "el", "ee", "eg", "gl", "ge", "gg")


def rescue_damage(df: DataFrame, old: str, new: str) -> DataFrame:
    """One row: pairs gained (``rescue``) and lost (``damage``) by the new score, ties half; pairs wrong under both, under
    one only; and the AUC of the better of both for each pair."""
    c = joint_counts(df, old, new)
    total = lambda e: F.sum(F.expr(f"ones * ({e})"))
    return c.agg(
        total("gl + 0.5D * ge + 0.5D * el").alias("rescue"),
        total("lg + 0.5D * le + 0.5D * eg").alias("damage"),
        total("gg").alias("both_wrong"),
        total("gl").alias("old_wrong"),
        total("lg").alias("new_wrong"),
        (total("ll + le + lg + el + gl + 0.5D * (ee + eg + ge)") / total("ll + le + lg + el + ee + eg + gl + ge + gg")).alias("oracle_auc"),
    )


def burden(df: DataFrame, a: str, b: str) -> DataFrame:
    """For each row of label 1: pairs it loses under both scores, under a only, under b only; null where a score is null."""
    found = joint_counts(df, a, b).select(a, b, F.col("gg").alias("both_scores"), F.col("gl").alias("a_only"), F.col("lg").alias("b_only"))
    return df.where("y = 1").select("id", a, b).join(found, [a, b], "left").drop(a, b)


def bucketed_errors(df: DataFrame, score: str, buckets: int) -> DataFrame:
    """For each equal-count bucket of the score: rows, AUC within, and its share of all misordered pairs."""
    df = stored(df.where(F.col(score).isNotNull()).select("y", score), "scores")
    ranked = midrank(df, score, "_r")
    placed = ranked.withColumn("bucket", F.least(F.floor((F.col("_r") - 1) * buckets / F.col("_r_of")), F.lit(buckets - 1)).cast("int"))
    inside = auc(placed, score, ["bucket"])
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    whole = auc(df, score).first()["errors"] or 1.0
    return counts.join(inside, "bucket").select("bucket", "n", "ones", "auc", (F.col("errors") / whole).alias("error_share"))
