"""Samples that hang on hashes of ids: they repeat exactly and need no shuffle to be drawn."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import uniform
from quern.operators.ordered import before, hashed_place, met
from quern.sources.scratch import stored

#: Rows that a task of ``class_bootstrap`` is dealt, on average.
TASK_ROWS = 1 << 18


def stratified(df: DataFrame, n: int, seed: str, by: str = "y") -> DataFrame:
    """The first n rows of each ``by`` in hash order, without replacement."""
    return hashed_place(df, [by], seed).where(F.col("place") < n).drop("place")


def weighted(df: DataFrame, n: int, seed: str, weight: str) -> DataFrame:
    """n rows, drawn without replacement with chances that follow ``weight``: the smallest of -ln(u) / w. Draws are counted by
    ranges, so n may be a share of all rows. Rows of one draw are taken in order of id; rows without a positive weight
    are never taken, and a null id draws like others."""
    draw = F.try_divide(-F.log(1 - uniform(seed, F.col("id"))), F.col(weight))
    rows = df.where(F.col(weight) > 0).withColumn("draw", draw)
    near = before(rows, "draw", {"_n": F.lit(1)}).where(F.col("_n_before") < n).select("draw", "_n_before")
    place = F.col("_n_before") + F.row_number().over(Window.partitionBy("draw").orderBy("id"))
    return rows.join(near, "draw").withColumn("_place", place).where(F.col("_place") <= n).select(*rows.columns)


def poisson(u: Column) -> Column:
    """Count with mean 1 from a uniform draw; 8 and more are 8 (chance below 1e-6)."""
    out, reach = F.lit(0), 0.0
    for k in range(8):
        reach += exp(-1) / factorial(k)
        out = out + F.when(u >= reach, 1).otherwise(0)
    return out


def bootstrap(df: DataFrame, draws: int, seed: str) -> DataFrame:
    """``df`` once for each draw it is in, with ``draw`` and ``times``: Poisson weights, so no row is moved to be drawn."""
    rows = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return rows.withColumn("times", poisson(uniform(seed, F.col("draw"), F.col("id")))).where(F.col("times") > 0)


def class_bootstrap(df: DataFrame, draws: int, seed: str, label: str = "y") -> DataFrame:
    """``df`` once for each draw it is in, with ``draw`` and ``times``: each draw takes as many rows of a label as it has,
    with replacement: a slot for each row, and in it the row at a hashed place of the same label.

    Slots are dealt to tasks by place, beside the rows that stand there, and tasks grow in number with both (TASK_ROWS): what
    one holds does not grow with the table."""
    tasks = lambda rows: max(1, -(-rows // TASK_ROWS))
    rows = df.count()
    placed = stored(hashed_place(df, [label], seed, tasks=tasks(rows)), "placed")
    n = placed.groupBy(label).agg(F.count("*").alias("_n"))
    slots = met(placed.select("id", label), n, [label]).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    taken = slots.select(label, F.floor(uniform(seed, F.col("draw"), F.col("id")) * F.col("_n")).alias("place"), "draw")
    own = placed.select(label, "place", F.lit(None).cast("int").alias("draw"), F.struct(*df.columns).alias("_row"))
    dealt = own.unionByName(taken, allowMissingColumns=True).repartition(tasks(rows * (draws + 1)), label, "place")
    here = Window.partitionBy(label, "place").orderBy(F.col("draw").asc_nulls_first())
    times = F.count("*").over(Window.partitionBy(label, "place", "draw"))
    nth = F.row_number().over(Window.partitionBy(label, "place", "draw").orderBy("place"))
    found = dealt.withColumns({"_row": F.first("_row", True).over(here), "times": times, "_nth": nth}).where("draw is not null and _nth = 1")
    return found.select(*(F.col("_row")[c].alias(c) for c in df.columns), "draw", "times")


def parts(df: DataFrame, draws: int, share: float, seed: str) -> DataFrame:
    """``df`` once for each draw, with ``draw`` and ``part``: 'public' for about ``share`` of rows, else 'private'."""
    rows = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return rows.withColumn("part", F.when(uniform(seed, F.col("draw"), F.col("id")) < share, "public").otherwise("private"))


def repeated(df: DataFrame, share: float, seed: str) -> DataFrame:
    """``df`` and, again, the rows of a hashed ``share``; ``copy`` counts from 0."""
    again = uniform(seed, F.col("id")) < share
    return df.withColumn("copy", F.explode(F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
