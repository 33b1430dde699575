"""Deterministic folds and splits. Assignment hangs on hashes of ids, never on row order or on a random state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import uniform
from quern.operators.ordered import before, hashed_place, met


def stratified(df: DataFrame, k: int, seed: str, label: str = "y", id: str = "id") -> DataFrame:
    """``df`` with ``fold``: each label is dealt evenly to k folds, in the order of hashed ids."""
    placed = hashed_place(df, [label], seed, id)
    return placed.withColumn("fold", (F.col("place") % k).cast("int")).drop("place")


def hashed(k: int, seed: str, id: str = "id") -> Column:
    """A fold that knows nothing of the label."""
    return F.floor(uniform(seed, F.col(id)) * k).cast("int")


def blocks(df: DataFrame, n: int, id: str = "id") -> DataFrame:
    """``df`` with ``block``: contiguous runs of ids, of nearly equal counts."""
    found = before(df, id, {"_n": F.lit(1)})
    small, more = F.floor(F.col("_n_all") / n), F.col("_n_all") % n
    place = F.col("_n_before")
    block = F.when(place < more * (small + 1), F.floor(place / (small + 1))).otherwise(more + F.floor((place - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return met(df, found.select(id, block.cast("int").alias("block")), [id])


def report(df: DataFrame) -> DataFrame:
    """Rows and share of label 1 of each fold."""
    return df.groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("rate"))


def early_stop(df: DataFrame, share: float, seed: str) -> DataFrame:
    """``df`` with ``is_es``: in each fold and label, the first ``share`` of rows in hash order."""
    placed = hashed_place(df, ["fold", "y"], seed)
    counts = df.groupBy("fold", "y").agg(F.count("*").alias("_n"))
    return met(placed, counts, ["fold", "y"]).withColumn("is_es", F.col("place") < F.floor(F.col("_n") * share)).drop("place", "_n")


def overlap(a: DataFrame, b: DataFrame, id: str = "id") -> int:
    """Ids that both sides hold; 0 for a clean split."""
    return a.select(id).intersect(b.select(id)).count()


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: count and an order-free digest of the rows, to tell a changed table from an equal one. Each value goes in with
    its length before it and null as a mark that no value has, so rows of different values have different texts."""
    text = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    h = F.conv(F.substring(F.md5(F.concat(*(text(c) for c in columns))), 1, 12), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"))


def difficulty_weight(df: DataFrame, rank: str, n: str, strength: float, low: float, high: float) -> DataFrame:
    """``df`` with ``weight``: 1 + strength (2 r - 1) for the rank share r, clipped, then scaled to mean 1."""
    raw = F.least(F.greatest(1 + strength * (2 * F.col(rank) / F.col(n) - 1), F.lit(low)), F.lit(high))
    scored = df.withColumn("_w", raw)
    mean = scored.agg(F.avg("_w")).first()[0] or 1.0
    return scored.withColumn("weight", F.col("_w") / mean).drop("_w")
