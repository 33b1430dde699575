"""Label-free profiles of tables and rows, and audits of one table against another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.metrics import auc
from quern.operators.ordered import met, midrank, quantiles


def columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row for each numeric column: nulls, distinct values, range, mean, deviation, whether all are whole. All
    columns are measured in one pass."""
    one = lambda c: F.struct(
        F.lit(c).alias("column"), F.sum(F.col(c).isNull().cast("int")).alias("nulls"), F.count_distinct(c).alias("distinct"), F.min(F.col(c).cast("double")).alias("low"),
        F.max(F.col(c).cast("double")).alias("high"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_pop(F.col(c).cast("double")).alias("sd"), F.bool_and(F.col(c) == F.floor(c)).alias("whole"),
    )
    return df.agg(F.array(*map(one, names)).alias("a")).select(F.inline("a"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """``(value, n, share)``; null is a value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(df.count()))


def top_share(df: DataFrame, column: str, tops: Sequence[int]) -> DataFrame:
    """One row: the share of rows that the most common values hold."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 1
    best = n.orderBy(F.desc("n"), column).limit(max(tops)).withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), column)))
    return best.agg(*((F.sum(F.when(F.col("k") <= t, F.col("n")).otherwise(0)) / total).alias(f"top_{t}") for t in tops))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Share of each value of ``column`` within each value of ``row``."""
    n = F.count("*")
    return df.groupBy(row).agg(*((F.sum((F.col(column) == v).cast("int")) / n).alias(f"share_{v}") for v in values))


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with size, mean, sample deviation, median and range of ``value`` at the row's key; null is a key. The group's
    figures come from aggregates that are joined back, so a large group is never gathered, not even for its median."""
    v = F.col(value).cast("double")
    stats = df.groupBy(key).agg(F.count("*").alias("g_n"), F.avg(v).alias("g_mean"), F.stddev_samp(v).alias("g_sd"), (F.max(v) - F.min(v)).alias("g_range"))
    stats = met(stats, quantiles(df, value, {"g_median": 0.5}, [key]), [key])
    return met(df, stats, [key])


def by_rate(df: DataFrame, column: str) -> DataFrame:
    """``(value, n, rate)``: size and mean label of each value, null included, highest rate first."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("rate")).orderBy(F.desc("rate"), "value")


def rate_surface(df: DataFrame, bins: Sequence[str]) -> DataFrame:
    """``(*bins, n, rate)``: the target's rate over a grid of binned columns."""
    return df.groupBy(*bins).agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("rate"))


def thresholds(df: DataFrame, columns: Sequence[str], share: float) -> DataFrame:
    """``df`` with ``above_<c>``: whether a value exceeds the ``share`` quantile of its column; null is not above."""
    for c in columns:
        cut = quantiles(df, c, {"_cut": share}).first()["_cut"]
        df = df.withColumn(f"above_{c}", F.coalesce(F.col(c) > F.lit(cut), F.lit(False)))
    return df


def exact_matches(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: distinct rows of ``a``, and how many rows of ``a`` stand in ``b`` with equal values (null is one)."""
    found = met(a.select(*columns), b.select(*columns).distinct().withColumn("_in", F.lit(1)), columns)
    return found.agg(F.count("*").alias("rows"), F.count("_in").alias("matched"), (F.count("_in") / F.count("*")).alias("rate"))


def subset_means(subsets: dict[str, Sequence[str]]) -> dict[str, Column]:
    """``mean_<name>``: row-wise mean of each named subset of columns."""
    return {f"mean_{k}": sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns) for k, columns in subsets.items()}


def rating_pairs(pairs: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """``gap_<a>_<b>`` and ``sum_<a>_<b>``."""
    return {f"{name}_{a}_{b}": e for a, b in pairs for name, e in (("gap", F.col(a) - F.col(b)), ("sum", F.col(a) + F.col(b)))}


def rating_features(ratings: Sequence[Column]) -> dict[str, Column]:
    """Row-wise figures over rating columns in which 0 means that the question did not apply."""
    a = F.array(*(r.cast("double") for r in ratings))
    given = F.filter(a, lambda x: x > 0)
    n = F.size(given)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    mean = F.when(n > 0, total(given) / n)
    ordered = F.array_sort(given)
    part = lambda k: F.when(n > 0, total(F.slice(ordered, k, F.least(n, F.lit(2)))) / F.least(n, F.lit(2)))
    at = lambda q: (n - 1) * q
    quantile = lambda q: F.get(ordered, F.floor(at(q)).cast("int")) + (at(q) - F.floor(at(q))) * (F.get(ordered, F.ceil(at(q)).cast("int")) - F.get(ordered, F.floor(at(q)).cast("int")))
    high = F.slice(ordered, F.greatest(n - 1, F.lit(1)), F.lit(2))
    out = {
        "r_n": n.cast("bigint"), "r_mean": mean, "r_low": F.array_min(given), "r_high": F.array_max(given),
        "r_sd": F.when(n > 0, F.sqrt(F.greatest(F.aggregate(given, F.lit(0.0), lambda s, v: s + v * v) / n - mean * mean, F.lit(0.0)))),
        "r_distinct": F.size(F.array_distinct(a)).cast("bigint"), "r_iqr": F.when(n > 0, quantile(0.75) - quantile(0.25)),
        "r_low2": part(1), "r_top2": F.when(n > 0, total(high) / F.size(high)),
        "r_le2": F.size(F.filter(given, lambda x: x <= 2)).cast("bigint"),
    }
    equal = lambda k: F.size(F.filter(a, lambda x: x == k)).cast("bigint")
    return out | {f"r_eq{k}": equal(k) for k in range(6)}


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """``df`` with ``is_duplicate``: whether another row has the same key."""
    keyed = df.withColumn("_k", key)
    n = keyed.groupBy("_k").agg((F.count("*") > 1).alias("is_duplicate"))
    return keyed.join(n, keyed["_k"].eqNullSafe(n["_k"])).select(*(keyed[c] for c in df.columns), "is_duplicate")


def key_report(df: DataFrame, key: str) -> DataFrame:
    """One row on a key's groups: count, median and 90 % size, share of rows in groups of 5 or fewer, of rows in
    groups of one label, and the scatter of group rates against chance (chi squared a degree of freedom)."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    whole = df.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    many = F.when(F.col("n") >= 2, 1)
    chi = F.sum(many * F.pow(F.col("t") - F.col("n") * whole, F.lit(2.0)) / (F.col("n") * F.lit(whole * (1 - whole))))
    rows = F.sum("n")
    return g.agg(
        F.count("*").alias("keys"), F.percentile("n", 0.5).alias("median_n"), F.percentile("n", 0.9).alias("p90_n"),
        (F.sum(F.when(F.col("n") <= 5, F.col("n")).otherwise(0)) / rows).alias("rows_in_small"),
        (F.sum(F.when((F.col("n") >= 2) & ((F.col("t") == 0) | (F.col("t") == F.col("n"))), F.col("n")).otherwise(0)) / rows).alias("rows_in_pure"),
        (chi / F.greatest(F.sum(many) - 1, F.lit(1))).alias("scatter"),
    )


def leave_one_out(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the mean label of the other rows of its key that have one; null where there is none. Null is a key."""
    g = df.groupBy(key).agg(F.sum("y").alias("_t"), F.count("y").alias("_n"))
    others, total = F.col("_n") - F.col("y").isNotNull().cast("int"), F.coalesce("_t", F.lit(0)) - F.coalesce("y", F.lit(0))
    return met(df, g, [key]).withColumn("loo", F.when(others > 0, total / others)).drop("_t", "_n")


def group_rate_auc(df: DataFrame, key: str) -> DataFrame:
    """One row: how well the mean label of a row's group ranks the labels, its own row included and left out."""
    rated = met(leave_one_out(df, key), df.groupBy(key).agg(F.avg(F.col("y").cast("double")).alias("_rate")), [key])
    one = lambda c, name: auc(rated.where(F.col(c).isNotNull()).withColumn(c, F.round(c, 9)), c).select(F.col("auc").alias(name))
    return one("_rate", "rate_auc").withColumn("_k", F.lit(1)).join(one("loo", "loo_auc").withColumn("_k", F.lit(1)), "_k").drop("_k")


def key_ladder(a: DataFrame, b: DataFrame, ladder: dict[str, Sequence[str]]) -> DataFrame:
    """For each set of columns: the share of rows of ``a`` whose values ``b`` has, of those that meet one row of
    ``b`` only, and of the latter with an equal label."""
    out = None
    for name, cols in ladder.items():
        table = b.groupBy(*cols).agg(F.count("*").alias("_n"), F.avg(F.col("y").cast("double")).alias("_y"))
        met = a.select(*cols, "y").join(table, list(cols), "left")
        one = F.col("_n") == 1
        row = met.agg(
            F.lit(name).alias("key"),
            F.avg(F.col("_n").isNotNull().cast("double")).alias("covered"),
            F.avg(F.coalesce(one, F.lit(False)).cast("double")).alias("unique"),
            F.avg(F.when(one, (F.col("_y") == F.col("y")).cast("double"))).alias("agrees"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def unseen(train: DataFrame, test: DataFrame, names: Sequence[str]) -> DataFrame:
    """For each column: distinct values of either side, values that only the test side has, and its rows with such."""
    out = None
    for c in names:
        left, right = train.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("a")), test.groupBy(F.col(c).alias("w")).agg(F.count("*").alias("b"))
        row = left.join(right, F.col("v").eqNullSafe(F.col("w")), "full").agg(
            F.lit(c).alias("column"), F.count("a").alias("train_values"), F.count("b").alias("test_values"),
            F.sum((F.col("a").isNull()).cast("int")).cast("bigint").alias("unseen_values"), F.coalesce(F.sum(F.when(F.col("a").isNull(), F.col("b"))), F.lit(0)).alias("unseen_rows"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def correlations(df: DataFrame, names: Sequence[str], ranks: bool = False) -> DataFrame:
    """``(a, b, r)`` for each pair of columns: Pearson, or Spearman with ``ranks``."""
    if ranks:
        for c in names:
            df = midrank(df, c, f"_{c}")
    col = (lambda c: f"_{c}") if ranks else (lambda c: c)
    one = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(col(a), col(b)).alias("r")) for i, a in enumerate(names) for b in names[i + 1 :]]
    return df.agg(F.array(*one).alias("x")).select(F.inline("x"))


def segments(df: DataFrame, masks: dict[str, Column], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows of ``df`` once for each overlapping segment they are in, for segments that hold ``low`` to ``high`` of all."""
    kept = df.agg(*(F.avg(F.coalesce(m, F.lit(False)).cast("double")).alias(k) for k, m in masks.items())).first()
    use = [k for k in masks if kept[k] is not None and low <= kept[k] <= high]
    return df.withColumn("segment", F.explode(F.array_compact(F.array(*(F.when(masks[k], F.lit(k)) for k in use), F.lit(None).cast("string")))))


def residual_bias(df: DataFrame, score: str, group: str, side: str) -> DataFrame:
    """One row: how the mean residual of groups agrees between the two sides (correlation, share of equal signs)."""
    g = df.groupBy(group).agg(*(F.avg(F.when(F.col(side) == s, F.col("y") - F.col(score))).alias(n) for s, n in ((0, "a"), (1, "b"))))
    both = g.where("a is not null and b is not null")
    return both.agg(F.count("*").alias("groups"), F.corr("a", "b").alias("r"), F.avg((F.signum(F.round("a", 9)) == F.signum(F.round("b", 9))).cast("double")).alias("same_sign"))
