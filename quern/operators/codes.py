"""Codes and bins that need the order of a whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ordered import numbered, quantiles


def codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with sorted integer codes from 0; null has -1. Distinct values are numbered range by range."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(numbered(values, column, name), column, "left").withColumn(name, F.coalesce(name, F.lit(-1)).cast("int"))


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Inner edges of equal-count bins, exact and without repeats."""
    found = quantiles(df, column, {f"q{i}": i / bins for i in range(1, bins)}).first()
    return sorted({v for v in found if v is not None}) if found else []


def median_filled(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """``df`` with the median of the column, in ``fit`` or in all of ``df``, in place of its nulls."""
    fit = df if fit is None else fit
    for c in columns:
        found = quantiles(fit, c, {"m": 0.5}).first()
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(found["m"] if found else None).cast("double")))
    return df
