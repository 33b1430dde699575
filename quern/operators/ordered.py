"""Order statistics without a single-partition sort: ranges of a column, and sums of all that stands before."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import stored

#: A range holds so many rows, or more where there would be over MAX_RANGES of them; fewer rows are one range.
RANGE_ROWS = 1 << 18
MAX_RANGES = 1 << 15


def met(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the other columns of ``other`` where all of ``on`` are equal; null meets null, so no row is lost."""
    renamed = other.withColumnsRenamed({c: f"_on_{c}" for c in on})
    return df.join(renamed, reduce(and_, (df[c].eqNullSafe(renamed[f"_on_{c}"]) for c in on)), how).drop(*(f"_on_{c}" for c in on))


def unique(df: DataFrame, id: str = "id") -> DataFrame:
    """``df``, if no id repeats: tables that are joined by id side by side would multiply such rows. Null is no id."""
    if not df.groupBy(id).count().where(F.col(id).isNotNull() & (F.col("count") > 1)).isEmpty():
        raise ValueError(f"{id} repeats")
    return df


def in_ranges(rows: DataFrame, order: str) -> tuple[DataFrame, int]:
    """``rows`` with ``_range``, which rises with ``order``, and the number of ranges, which grows with the rows. The rows are
    stored and counted, so that what they are made from runs once; Spark samples the cuts, and the ranges are stored too,
    for another run might cut elsewhere."""
    rows = stored(rows, "values")
    ranges = min(MAX_RANGES, max(1, -(-rows.count() // RANGE_ROWS)))
    if ranges == 1:
        return rows.withColumn("_range", F.lit(0)), 1
    return stored(rows.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()), "ranges"), ranges


def before(df: DataFrame, order: str, sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One row for each ``(*by, order)`` with the sums of its rows (``name``), of all rows before (``name_before``)
    and of all rows of ``by`` (``name_all``). Rows whose ``order`` is null stand nowhere and are left out; null is a
    value of ``by`` like others.

    Ties are collapsed first. Sums within a range run over that range only, sums of whole ranges over one row for each
    range and ``by``; so no task holds all values, however large a ``by`` is.
    """
    by = list(by)
    one = df.where(F.col(order).isNotNull()).groupBy(*by, order).agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    one, ranges = in_ranges(one, order)
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if ranges == 1:
        here, every = {f"{k}_before": F.coalesce(F.sum(k).over(inside), F.lit(0)) for k in sums}, Window.partitionBy(*by, "_range")
        return one.select(*by, order, *sums, *(v.alias(k) for k, v in here.items()), *(F.sum(k).over(every).alias(f"{k}_all") for k in sums))
    total = one.groupBy(*by, "_range").agg(*(F.sum(k).alias(f"_{k}") for k in sums))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    total = total.select(
        *by,
        "_range",
        *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}_earlier") for k in sums),
        *(F.sum(f"_{k}").over(whole).alias(f"{k}_all") for k in sums),
    )
    one = one.withColumns({f"_{k}_inside": F.coalesce(F.sum(k).over(inside), F.lit(0)) for k in sums})
    return met(one, total, [*by, "_range"], "inner").select(
        *by,
        order,
        *sums,
        *((F.col(f"_{k}_earlier") + F.col(f"_{k}_inside")).alias(f"{k}_before") for k in sums),
        *(f"{k}_all" for k in sums),
    )


def midrank(df: DataFrame, order: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the rank of ``order`` within ``by``, and ``<name>_of``, the number of ranked rows; equal values share the
    mean of their ranks. Null has no rank, and its row stays."""
    found = before(df, order, {"_n": F.lit(1)}, by)
    rank = found.select(*by, order, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name), F.col("_n_all").alias(name + "_of"))
    return met(df, rank, [*by, order])


def mid_percentile(df: DataFrame, order: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with (rank - 1/2) / n of ``order`` within ``by``."""
    ranked = midrank(df, order, "_mid", by)
    return ranked.withColumn(name, (F.col("_mid") - 0.5) / F.col("_mid_of")).drop("_mid", "_mid_of")


def quantiles(df: DataFrame, column: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row for each ``by`` with the quantile of ``column`` at each share, by name, linear between values. Exact, from
    running counts of distinct values: no buffer holds them all. Nulls are left out."""
    values = df.select(*by, F.col(column).cast("double").alias("_v"))
    found = before(values, "_v", {"_n": F.lit(1)}, by)
    out = []
    for name, share in shares.items():
        place = F.round((F.col("_n_all") - 1) * F.lit(share), 9)
        at = lambda k: F.max(F.when(F.col("_n_before").between(k - F.col("_n") + 1, k), F.col("_v")))
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return found.groupBy(*by).agg(*out)


def lowest_mean(df: DataFrame, column: str, k: int, name: str) -> DataFrame:
    """One row with the mean of the ``k`` lowest values of ``column``, of all if they are fewer; null without a value, or if
    ``k`` is 0. Values are counted by ranges, so no task holds all k; nulls are left out."""
    found = before(df.select(F.col(column).alias("_v")), "_v", {"_n": F.lit(1)})
    taken = F.greatest(F.least(F.col("_n"), F.lit(k) - F.col("_n_before")), F.lit(0))
    return found.agg(F.try_divide(F.sum(F.col("_v") * taken), F.sum(taken)).alias(name))


def numbered(values: DataFrame, column: str, name: str) -> DataFrame:
    """``values`` (distinct) with their place from 0 in the order of ``column``."""
    one, _ = in_ranges(values, column)
    total = one.groupBy("_range").agg(F.count("*").alias("_n"))
    total = total.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return one.withColumn(name, rank).join(total, "_range").withColumn(name, F.col("_first") + F.col(name)).drop("_range", "_first")


def hashed_place(df: DataFrame, by: Sequence[str], seed: str, id: str = "id", tasks: int | None = None) -> DataFrame:
    """``df`` with ``place``, a row's position from 0 within ``by`` in the order of MD5(seed:id); null is a value of ``by``,
    and a null id has a place like others.

    The first three hex digits of the hash split each ``by`` into 4096 ranges; a position is the count of earlier
    ranges plus the rank within the row's own. Ranges are dealt to ``tasks``, or to as many as Spark is set to.
    """
    by = list(by)
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id).cast("string"), F.lit(""))))
    rows = df.withColumn("_h", hashed).withColumn("_range", F.substring("_h", 1, 3))
    total = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*by, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"))
    rank = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_h", id)) - 1
    if tasks:
        rows = rows.repartition(tasks, *by, "_range")
    return met(rows.withColumn("_rank", rank), total, [*by, "_range"], "inner").select(*df.columns, (F.col("_earlier") + F.col("_rank")).alias("place"))
