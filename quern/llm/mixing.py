"""Mixing sources to target weights by systematic sampling within each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stored

#: Weights of the sources in code point order, repeating; the most that a source is repeated.
WEIGHTS = (5, 2, 1)
LIMIT = 3
#: Size classes keep so many leading bits of a size, and each class is dealt to so many buckets.
CLASS_BITS = 7
BUCKETS = 256


def _source_key(source: Column) -> Column:
    """Joins on it match null with null only."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def _draw(text: Column) -> Column:
    """Uniform whole number below 2**32, set by the text alone."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = "mix") -> DataFrame:
    """One row for each source: ``source, source_size, target, _q_start`` and the join key ``_q_source``.

    All sizes together are shared by weight; a target stops at ``limit`` times its source's size and the excess is
    shared again. Sources in order of limit per weight stop one after the other, so running sums find the level at
    which the rest is shared. The windows run over one row for each source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("_q_k", F.row_number().over(order) - 1)
    by = by.withColumn("_q_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_q_k") % len(weights) + 1).cast("int")))
    by = by.withColumn("_q_cap", limit * F.col("source_size"))
    fill = Window.orderBy(F.col("_q_cap") / F.col("_q_w"), "_q_k")
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_q_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.withColumn("_q_level", left / F.sum("_q_w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("_q_full", F.col("_q_cap") <= F.col("_q_level") * F.col("_q_w"))
    level = F.max(F.when(~F.col("_q_full"), F.col("_q_level"))).over(every)
    key = _source_key(F.col("source"))
    return by.select(
        "source",
        "source_size",
        F.when(F.col("_q_full"), F.col("_q_cap").cast("double")).otherwise(level * F.col("_q_w")).alias("target"),
        (_draw(F.concat(F.lit(seed + ":"), key)) / 4294967296).alias("_q_start"),
        key.alias("_q_source"),
    )


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = "mix") -> DataFrame:
    """``sized`` (``doc_id``, ``source``, ``size`` and any other columns) with ``source_size``, ``target`` and
    ``copies``, the number of times that the mix takes the row, in place of any columns of these names.

    Each row of a source expects target / source_size copies. Within the source rows stand in order of size, so
    that the sum of sizes taken is off by about one document at most; their expected copies are summed from the front,
    one random start is added, and a row is taken once for each whole number its interval reaches.

    A row's place is the count before its (size class, bucket) plus its rank there: no window holds a whole source,
    and a third of all rows in one source and of one size is still dealt over BUCKETS tasks. Sources, doc_ids and
    sizes may be null (a null size counts 0 and is returned as 0; a null source is a source of its own, last in order).
    Draws hang on the doc_id or, where it is null, on a hash of the row's columns; rows of equal size and doc_id stand
    in order of that hash, so reruns agree, and only rows equal in every column are exchanged. Very long documents count
    like others, once up to ``limit`` times. An empty table gives an empty result. Columns may have any names.
    """
    added = ("source_size", "target", "copies")
    own = [c for c in sized.columns if c.lower() not in added]
    hashed = [F.col(f"`{c}`") for c, t in sized.select(*(f"`{c}`" for c in own)).dtypes if "map<" not in t]
    size = F.coalesce(F.col("size").cast("long"), F.lit(0))
    rows = sized.select(F.struct(*(size.alias(c) if c == "size" else F.col(f"`{c}`") for c in own)).alias("doc"), "doc_id", "source", size.alias("size"), F.xxhash64(*hashed).alias("_q_row"))
    step = F.greatest(F.length(F.bin("size")) - CLASS_BITS, F.lit(0))
    draw = F.coalesce(_draw(F.col("doc_id").cast("string")), F.pmod("_q_row", F.lit(1 << 32)))
    rows = rows.withColumns({"_q_source": _source_key(F.col("source")), "_q_draw": draw}).withColumns(
        {"_q_class": F.call_function("shiftleft", F.call_function("shiftright", F.col("size"), step), step), "_q_bucket": F.col("_q_draw") % BUCKETS}
    )
    cell = ["_q_source", "_q_class", "_q_bucket"]
    aims = stored(targets(rows, weights, limit, seed), "targets")
    before = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(rows.groupBy(cell).agg(F.count("*").alias("_q_n")), "cells")
    classes = cells.groupBy(cell[:2]).agg(F.sum("_q_n").alias("_q_n"))
    classes = classes.select(*cell[:2], F.coalesce(F.sum("_q_n").over(before(cell[:1], "_q_class")), F.lit(0)).alias("_q_first"))
    cells = cells.withColumn("_q_in", F.coalesce(F.sum("_q_n").over(before(cell[:2], "_q_bucket")), F.lit(0)))
    cells = cells.join(classes, cell[:2]).join(aims.drop("source"), "_q_source")
    cells = cells.select(*cell, (F.col("_q_first") + F.col("_q_in")).alias("_q_before"), "source_size", "target", "_q_start")
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("size", "_q_draw", "doc_id", "_q_row"))
    placed = rows.withColumn("_q_rank", rank).join(stored(cells, "cells"), cell)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("_q_before") + F.col("_q_rank")
    copies = F.floor(F.col("_q_start") + each * place) - F.floor(F.col("_q_start") + each * (place - 1))
    placed = placed.select("doc", "source_size", "target", F.least(copies, F.lit(limit).cast("long")).alias("copies"))
    return placed.select("doc.*", "source_size", "target", "copies")
