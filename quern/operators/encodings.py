"""Target encodings that never let a row see its own label.

Provenance of each: ``apply`` and ``external`` use the labels of other rows than those they encode; ``crossfit`` and
what is built on it use the labels of other folds only. Cross-fitting works by subtraction: sums by (key, fold), by key
and by fold are taken once, and a row's own fold is subtracted from both the key's sums and the prior. One aggregate and
one join serve all folds and all smoothings.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.keys import joined_key
from quern.operators.ordered import met, unique
from quern.sources.scratch import stored


def smoothed(total: Column, n: Column, prior: Column, smooth: float | Column) -> Column:
    return (total + smooth * prior) / (n + smooth)


def key_table(fit: DataFrame, key: str, min_count: int = 1) -> DataFrame:
    """Sum and count of the label by key; null keys give none."""
    by = fit.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("y").alias("_t"), F.count("y").alias("_n"))
    return by.where(F.col("_n") >= min_count) if min_count > 1 else by


def apply(fit: DataFrame, rows: DataFrame, key: str, smooths: Sequence[float], min_count: int = 1) -> DataFrame:
    """``rows`` with ``te_<smooth>`` for each smoothing and ``log_n``, from the labels of ``fit`` alone.

    Keys that ``fit`` has not, and null keys, get the prior. The table has one row a key; Spark broadcasts it if it is
    small and joins by shuffle if not.
    """
    prior = fit.agg(F.avg(F.col("y").cast("double"))).first()[0]
    table = key_table(fit, key, min_count)
    joined = rows.join(table, key, "left")
    out = {f"te_{s:g}": F.coalesce(smoothed(F.col("_t"), F.col("_n"), F.lit(prior), s), F.lit(prior)) for s in smooths}
    return joined.withColumns(out | {"log_n": F.log1p(F.coalesce("_n", F.lit(0)).cast("double"))}).drop("_t", "_n")


def crossfit(df: DataFrame, key: str, smooths: Sequence[float], fold: str = "fold", source: Column | None = None, min_count: int = 1, fit: DataFrame | None = None) -> DataFrame:
    """``df`` with ``te_<smooth>`` and its parts ``t_other, n_other, prior_other``, from the other folds. ``source`` says which rows give their
    labels (all, if None): rows that only stop a fit early are encoded, but teach nobody. A null label teaches nothing;
    where no other fold has a label, encodings and prior are null. ``fit`` is the same rows as they were before columns were added."""
    fit = df if fit is None else fit
    fit = fit if source is None else fit.where(source)
    cell = fit.groupBy(fold, key).agg(F.sum("y").alias("_ft"), F.count("y").alias("_fn"))
    folds = {r[0]: (r[1] or 0, r[2]) for r in fit.groupBy(fold).agg(F.sum("y"), F.count("y")).collect()}
    all_t, all_n = sum(t for t, _ in folds.values()), sum(n for _, n in folds.values())
    prior = F.lit(all_t / all_n if all_n else None)
    for f, (t, n) in folds.items():
        prior = F.when(F.col(fold) == f, F.lit((all_t - t) / (all_n - n) if all_n > n else None)).otherwise(prior)
    if source is None:  # every row has its cell, so the key's sums can stand there: rows are moved once
        line = Window.partitionBy(key)  # a row for each fold
        joined = df.join(cell.where(F.col(key).isNotNull()).withColumns({"_t": F.sum("_ft").over(line), "_n": F.sum("_fn").over(line)}), [fold, key], "left")
    else:
        keys = cell.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("_ft").alias("_t"), F.sum("_fn").alias("_n"))
        joined = df.join(keys, key, "left").join(cell, [fold, key], "left")
    t = F.coalesce(F.col("_t"), F.lit(0)) - F.coalesce(F.col("_ft"), F.lit(0))
    n = F.coalesce(F.col("_n"), F.lit(0)) - F.coalesce(F.col("_fn"), F.lit(0))
    enough = n >= min_count
    out = {f"te_{s:g}": F.when(enough, smoothed(t, n, prior, s)).otherwise(prior) for s in smooths}
    return joined.withColumns(out | {"t_other": t, "n_other": n, "prior_other": prior}).drop("_t", "_n", "_ft", "_fn")


def ordered_statistics(df: DataFrame, key: str, seed: str, prior: float = 0.5, weight: float = 1.0, id: str = "id", source: Column | None = None) -> DataFrame:
    """``df`` with ``ots``: the mean label of the rows of a row's key that stand before it in the order of MD5(seed:id), shrunk
    to ``prior`` by ``weight`` rows. No row sees itself or a later one. Rows outside of ``source`` (all, if None) teach nobody and
    see all rows that do, of whatever place; null labels teach nothing; null is a key like others, and equal ids stand in
    an order of their own.

    A key is many tasks: the first three hex digits of the hash are 4096 ranges, whose sums are added to those within one.
    """
    rows = df.withColumn("_h", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id).cast("string"), F.lit("")))))
    rows = rows.withColumns({"_range": F.substring("_h", 1, 3), "_in": F.col("y").isNotNull() & (F.lit(True) if source is None else F.coalesce(source, F.lit(False)))})
    rows = rows.withColumns({"_t": F.when(F.col("_in"), F.col("y")).otherwise(0).cast("double"), "_n": F.col("_in").cast("long")})
    total = rows.groupBy(key, "_range").agg(F.sum("_t").alias("_rt"), F.sum("_n").alias("_rn"))
    line = Window.partitionBy(key)
    earlier = line.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"_e{k}": F.coalesce(F.sum(f"_r{k}").over(earlier), F.lit(0)) for k in "tn"} | {f"_a{k}": F.sum(f"_r{k}").over(line) for k in "tn"}
    total = total.select(key, "_range", *(v.alias(k) for k, v in sums.items()))
    inside = Window.partitionBy(key, "_range").orderBy("_h", id).rowsBetween(Window.unboundedPreceding, -1)
    rows = met(rows.withColumns({f"_i{k}": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in "tn"}), total, [key, "_range"], "inner")
    teaches = F.lit(True) if source is None else F.coalesce(source, F.lit(False))
    t, n = (F.when(teaches, F.col(f"_e{k}") + F.col(f"_i{k}")).otherwise(F.col(f"_a{k}")) for k in "tn")
    return rows.select(*df.columns, ((t + weight * prior) / (n + weight)).alias("ots"))


def auto_smoothing(df: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """One row for each fold: the empirical-Bayes smoothing that the other folds imply.

    With labels 0 and 1, lambda is the variance within keys over the variance between key means, both weighted by
    rows; no spread between keys gives null, and then the prior is used alone. Sums over all keys are taken once; a fold
    changes them at its own keys only.
    """
    cell = df.where(F.col(key).isNotNull()).groupBy(fold, key).agg(F.sum("y").alias("t"), F.count("y").alias("n"))
    every = cell.groupBy(key).agg(F.sum("t").alias("_t"), F.sum("n").alias("_n"))
    # As decimals, so that what a fold takes off is taken off without a rest.
    square = lambda t, n: F.when(n > 0, F.round(t * t / n, 12)).otherwise(0.0).cast("decimal(38,12)")
    all_of = square(F.col("_t"), F.col("_n"))
    whole = every.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_t"), F.lit(0)), F.coalesce(F.sum(all_of), F.lit(0))).first()
    own = cell.join(every, key).groupBy(fold).agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum(square(F.col("_t") - F.col("t"), F.col("_n") - F.col("n")) - all_of).alias("b"))
    sums = own.select(fold, (F.lit(whole[0]) - F.col("n")).alias("_n"), (F.lit(whole[1]) - F.col("t")).alias("_t"), (F.lit(whole[2]) + F.col("b")).cast("double").alias("_b"))
    sums = sums.withColumn("_w", F.col("_t") - F.col("_b"))
    between = F.col("_b") / F.col("_n") - (F.col("_t") / F.col("_n")) * (F.col("_t") / F.col("_n"))
    return sums.select(fold, F.when(between > 1e-12, F.col("_w") / F.col("_n") / between).alias("smooth"))


def crossfit_auto(df: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """``df`` with ``te_auto``: cross-fitted, each fold at its own smoothing."""
    rows = crossfit(df, key, [], fold).join(auto_smoothing(df, key, fold), fold, "left")
    prior, smooth = F.col("prior_other"), F.col("smooth")
    te = F.when(smooth.isNull(), prior).otherwise(smoothed(F.col("t_other"), F.col("n_other"), prior, smooth))
    return rows.withColumn("te_auto", te).drop("smooth", "t_other", "n_other", "prior_other")


def neighbours(table: DataFrame, key: str, digits: int, base: int) -> DataFrame:
    """``(key, near)`` for each key and each key that differs in exactly one digit of base ``base``."""
    place, value = F.col("_p"), F.col("_v")
    powers = F.array(*(F.lit(base**i) for i in range(digits)))
    steps = table.select(key).distinct().withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(digits - 1)))).withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(base - 1))))
    own = F.pmod(F.floor(F.col(key) / F.element_at(powers, place + 1)), F.lit(base))
    return steps.where(own != value).select(key, (F.col(key) + (value - own) * F.element_at(powers, place + 1)).alias("near"))


def crossfit_nearest(df: DataFrame, key: str, digits: int, base: int, smooth: float = 30.0, min_count: int = 2, fold: str = "fold") -> DataFrame:
    """``df`` with ``te_near`` (shrunken mean label of keys at Hamming distance 1 in other folds), ``log_n_near`` and
    ``log_keys_near``. Keys with fewer than ``min_count`` labelled rows outside the fold do not count; where no other fold has a
    label, ``te_near`` is null.

    Sums by key are joined to their neighbours by equality on the neighbour's key: digits * (base - 1) rows a key, never a
    pair of rows. A fold's own rows are then taken off, at the neighbours that it has.
    """
    cell = stored(df.groupBy(fold, key).agg(F.sum("y").alias("_ft"), F.count("y").alias("_fn")), "cells")
    keys = cell.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("_ft").alias("_t"), F.sum("_fn").alias("_n"))
    near = neighbours(keys, key, digits, base)
    cell = cell.withColumn("_ft", F.coalesce("_ft", F.lit(0)))
    keys = keys.withColumn("_t", F.coalesce("_t", F.lit(0)))
    counts = lambda t, n: {k: F.when(n >= min_count, v).otherwise(0) for k, v in (("t", t), ("n", n), ("k", F.lit(1)))}
    total = near.join(keys.withColumnRenamed(key, "near"), "near").groupBy(key).agg(*(F.sum(v).alias(f"_{k}") for k, v in counts(F.col("_t"), F.col("_n")).items()))
    own = cell.join(keys, key).withColumnRenamed(key, "near")
    less, all_of = counts(F.col("_t") - F.col("_ft"), F.col("_n") - F.col("_fn")), counts(F.col("_t"), F.col("_n"))
    change = near.join(own, "near").groupBy(fold, key).agg(*(F.sum(less[k] - all_of[k]).alias(f"_d{k}") for k in "tnk"))
    whole = cell.groupBy(fold).agg(F.sum("_ft").alias("a"), F.sum("_fn").alias("b")).collect()
    ones, n = sum(r["a"] or 0 for r in whole), sum(r["b"] for r in whole)
    prior = F.lit(None).cast("double")
    for r in whole:
        prior = F.when(F.col(fold) == r[fold], F.lit((ones - (r["a"] or 0)) / (n - r["b"]) if n > r["b"] else None)).otherwise(prior)
    zero = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0)) + F.coalesce(F.col(f"_d{c}"), F.lit(0))
    rows = df.join(total, key, "left").join(change, [fold, key], "left")
    return rows.withColumns(
        {"te_near": smoothed(zero("t"), zero("n"), prior, smooth), "log_n_near": F.log1p(zero("n").cast("double")), "log_keys_near": F.log1p(zero("k").cast("double"))}
    ).drop("_t", "_n", "_k", "_dt", "_dn", "_dk")


def external(rows: DataFrame, other: DataFrame, keys: Sequence[Sequence[str]], smooth: float = 40.0, min_count: int = 1) -> DataFrame:
    """``rows`` with ``ext_<key>`` and ``ext_<key>_log_n`` for each key, looked up in another labelled table."""
    prior = other.agg(F.avg(F.col("y").cast("double"))).first()[0]
    for key in keys:
        name = "_".join(key)
        k = joined_key([F.col(c) for c in key])
        table = key_table(other.withColumn("_k", k), "_k", min_count)
        rows = rows.withColumn("_k", k).join(table, "_k", "left")
        rows = rows.withColumns(
            {f"ext_{name}": F.coalesce(smoothed(F.col("_t"), F.col("_n"), F.lit(prior), smooth), F.lit(prior)), f"ext_{name}_log_n": F.log1p(F.coalesce("_n", F.lit(0)).cast("double"))}
        ).drop("_k", "_t", "_n")
    return rows


def surfaces(rows: DataFrame, other: DataFrame, anchor: str, measures: Sequence[str]) -> DataFrame:
    """``rows`` with the other table's count, mean label, mean of each measure at the anchor, and own residuals."""
    means = {f"mean_{m}": F.avg(F.col(m).cast("double")) for m in measures}
    table = other.groupBy(anchor).agg(F.count("*").alias("at_n"), F.avg(F.col("y").cast("double")).alias("at_rate"), *(v.alias(k) for k, v in means.items()))
    joined = rows.join(table, anchor, "left")
    return joined.withColumns({f"res_{m}": F.col(m) - F.col(f"mean_{m}") for m in measures})


def log_likelihood_ratio(fit: DataFrame, rows: DataFrame, features: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """``rows`` with ``llr``: the sum over features of ln P(value | 1) - ln P(value | 0), counts smoothed by alpha.

    Features are unpivoted, so all tables come from one aggregate; unseen values count 0 in both classes.
    """
    long = lambda df, *more: df.select(*more, F.explode(F.create_map(*(x for f in features for x in (F.lit(f), F.col(f).cast("string")))))).withColumnsRenamed({"key": "f", "value": "v"})
    cell = long(fit, "y").groupBy("f", "v").agg(F.sum("y").alias("_p"), F.sum(1 - F.col("y")).alias("_q"))
    size = cell.groupBy("f").agg(F.count("*").alias("_k"), F.sum("_p").alias("_all_p"), F.sum("_q").alias("_all_q"))
    seen = long(rows, "id").join(size, "f").join(cell, ["f", "v"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    part = F.log((zero("_p") + alpha) / (F.col("_all_p") + alpha * F.col("_k"))) - F.log((zero("_q") + alpha) / (F.col("_all_q") + alpha * F.col("_k")))
    return rows.join(seen.groupBy("id").agg(F.sum(part).alias("llr")), "id")


def combinations_of(columns: Sequence[str], sizes: Sequence[int]) -> list[list[str]]:
    """All key lists of the given numbers of columns, in order."""
    return [list(c) for n in sizes for c in combinations(columns, n)]


def conditional_ordinal(df: DataFrame, ratings: Sequence[str], cell: str, smooth: float = 20.0, source: Column | None = None) -> DataFrame:
    """``(id, ord_<rating>)``: for each rating the cross-fitted mean label of its value within a row's cell. An id that repeats
    is an error."""
    out = unique(df).select("id")
    for r in ratings:
        one = crossfit(df.withColumn("_k", joined_key([F.col(r), F.col(cell)])), "_k", [smooth], source=source)
        out = out.join(one.select("id", F.col(f"te_{smooth:g}").alias(f"ord_{r}")), "id")
    return out


def default_keys(route: str, categories: Sequence[str], number: str, ratings: Sequence[str]) -> dict[str, list[Column]]:
    """Keys to encode by, as lists of columns: the route, each category and rating, the route with each category, all
    categories together, and the number in steps of 500 and 1000, by its remainder and with the first category."""
    c = F.col
    steps = {f"{number}_bin{n}": [F.floor(c(number) / n)] for n in (500, 1000)}
    keys = {route: [c(route)]} | {x: [c(x)] for x in (*categories, *ratings)} | {f"{route}_{x}": [c(route), c(x)] for x in categories}
    keys |= {"_".join(categories) + "_all": [c(x) for x in categories]} | steps | {f"{number}_m1000": [F.floor(c(number)) % 1000]}
    return keys | {f"{number}_bin1000_{categories[0]}": [*steps[f"{number}_bin1000"], c(categories[0])]}


def encoded_keys(df: DataFrame, keys: dict[str, list[Column]], smooth: float = 20.0) -> DataFrame:
    """``(id, te_<name>)``: the cross-fitted mean label of each key. An id that repeats is an error. Rows are stored once and take
    one encoding after the other, so no two tables of all rows are joined."""
    out = rows = unique(stored(df, "rows"))
    for name, columns in keys.items():
        te, parts = f"te_{smooth:g}", ("_k", "t_other", "n_other", "prior_other")
        one = crossfit(out.withColumn("_k", joined_key(columns)), "_k", [smooth], fit=rows.withColumn("_k", joined_key(columns)))
        out = one.withColumnRenamed(te, f"_te_{name}").drop(*parts)
    return out.where(F.col("id").isNotNull()).select("id", *(F.col(f"_te_{name}").alias(f"te_{name}") for name in keys))
