"""Gradient boosting over histograms as Spark aggregates, with own losses and base margins; all folds grow side by side.

A row keeps its bins and one margin for each fold's model. A level of all models' trees is one aggregate: gradients and
curvatures are summed by (model, node, feature, bin), map side first, into cells whose number hangs on models, nodes,
features and bins only. Splits are chosen from cells; the driver gets one row for each node. Gradients are counted in whole
units of UNIT, so sums do not hang on their order, and neither a retry nor another cluster changes a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from statistics import fmean

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import clip, logit, uniform
from quern.operators.ordered import before
from quern.sources.scratch import forget, stored

UNIT = 1e-7
Split = tuple[int, int]


@dataclass(frozen=True)
class Loss:
    """``slopes(y, margin)`` gives gradient and curvature, ``value(y, margin)`` the loss of a row, ``start(mean)`` the margin
    of a constant prediction. ``jointly``, if given, makes them from all rows instead: it takes rows of ``(id, model, y,
    margin)`` and gives ``(id, model, g, h)``."""

    slopes: Callable[[Column, Column], tuple[Column, Column]] | None
    value: Callable[[Column, Column], Column]
    start: Callable[[Column], Column]
    jointly: Callable[[DataFrame], DataFrame] | None = None


def _probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-clip(margin, -35.0, 35.0)))


LOGISTIC = Loss(
    lambda y, s: (_probability(s) - y, _probability(s) * (1 - _probability(s))),
    lambda y, s: F.log1p(F.exp(-clip(s, -35.0, 35.0))) + (1 - y) * clip(s, -35.0, 35.0),
    lambda mean: logit(mean),
)
SQUARED = Loss(lambda y, s: (s - y, F.lit(1.0)), lambda y, s: (y - s) * (y - s) / 2, lambda mean: mean)


@dataclass
class Tree:
    """One model's tree: splits ``node -> (feature, bin)``, rows of a greater bin go to the right; children of node n are
    2n and 2n + 1, values stand at leaves."""

    splits: dict[int, Split] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def read(self, bins: Column, leaf: Callable[[int], Column], node: int = 1) -> Column:
        """``leaf(n)`` of the leaf n that a row's bins lead to."""
        if node not in self.splits:
            return leaf(node)
        f, b = self.splits[node]
        return F.when(F.get(bins, F.lit(f)) > b, self.read(bins, leaf, 2 * node + 1)).otherwise(self.read(bins, leaf, 2 * node))


@dataclass
class Boosted:
    """``rows(id, fold, y, margin)`` by each row's own fold's model, the trees by round and model, the watched loss after each
    round, and the ``table`` of all models' margins."""

    rows: DataFrame
    features: list[str]
    cuts: dict[str, list[float]]
    models: list[int]
    starts: dict[int, float]
    trees: list[dict[int, Tree]]
    losses: list[float]
    table: DataFrame


def cut_points(rows: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """At most ``bins - 1`` cuts of each feature: the values at places floor((n - 1) k / bins) of its n sorted ones. Labels have
    no part in them. Exact, from running counts of distinct values; nulls are left out."""
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features))))
    found = before(long, "v", {"_n": F.lit(1)}, ["f"])
    # Places below x: as many k from 1 to bins - 1 as have (n - 1) k < bins x.
    last = F.greatest(F.col("_n_all") - 1, F.lit(1))
    below = lambda x: F.least(F.greatest(F.call_function("div", x * bins + last - 1, last) - 1, F.lit(0)), F.lit(bins - 1))
    kept = found.where(below(F.col("_n_before") + F.col("_n")) > below(F.col("_n_before"))).select("f", "v").collect()
    return {f: sorted(r["v"] for r in kept if r["f"] == f) for f in features}


def bin_of(c: Column, cuts: Sequence[float]) -> Column:
    """1 and the number of cuts below a value, by nested halves; null stands before all, in bin 0."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1)
        middle = (low + high) // 2
        return F.when(c > F.lit(cuts[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return F.when(c.isNull() | F.isnan(c), 0).otherwise(search(0, len(cuts)))


def binned(rows: DataFrame, features: Sequence[str], cuts: dict[str, list[float]]) -> Column:
    return F.array(*(bin_of(F.col(f).cast("double"), cuts[f]) for f in features))


def best_splits(cells: DataFrame, ridge: float, least_rows: int, least_curvature: float) -> DataFrame:
    """``(model, node, f, b, g, h, left_g, left_h)``: for each node the split of most gain, ties by feature and bin, and the
    sums of the node and of its left side; f is null where no split is allowed or gains.

    ``cells(model, node, f, b, g, h, n)`` holds sums by bin; a split at b sends bins up to b to the left.
    """
    line = Window.partitionBy("model", "node", "f")
    left = line.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select("model", "node", "f", "b", *(F.sum(c).over(left).alias(f"left_{c}") for c in "ghn"), *(F.sum(c).over(line).alias(c) for c in "ghn"))
    part = lambda g, h: (g * UNIT) * (g * UNIT) / (h * UNIT + ridge)
    c = F.col
    gain = F.round((part(c("left_g"), c("left_h")) + part(c("g") - c("left_g"), c("h") - c("left_h")) - part(c("g"), c("h"))) / 2, 9)
    allowed = (F.least("left_n", c("n") - c("left_n")) >= least_rows) & (F.least("left_h", c("h") - c("left_h")) * UNIT >= least_curvature)
    sums = sums.withColumn("gain", F.when(allowed, gain))
    order = Window.partitionBy("model", "node").orderBy(F.desc_nulls_last("gain"), "f", "b")
    first = sums.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    real = c("gain") > 0
    return first.select("model", "node", F.when(real, c("f")).alias("f"), "b", "g", "h", "left_g", "left_h")


def _units(c: Column) -> Column:
    return F.floor(c / UNIT + 0.5)


def _slopes(data: DataFrame, loss: Loss, models: Sequence[int]) -> DataFrame:
    """``data`` with ``_slopes``: gradient and curvature in units for each model, null for one that a row does not teach."""
    teaches = lambda m: F.col("y").isNotNull() & F.col("fold").isNotNull() & (F.col("fold") != m) & ~F.col("_es")
    both = lambda g, h: F.struct(_units(F.col("_weight") * g).alias("g"), _units(F.col("_weight") * h).alias("h"))
    margin = lambda i: F.get("_margins", F.lit(i))
    if loss.jointly is None:
        return data.withColumn("_slopes", F.array(*(F.when(teaches(m), both(*loss.slopes(F.col("y"), margin(i)))) for i, m in enumerate(models))))
    taught = F.array(*(F.when(teaches(m), F.struct(F.lit(i).alias("model"), margin(i).alias("margin"))) for i, m in enumerate(models)))
    found = loss.jointly(data.select("id", "y", F.inline(taught)).where(F.col("model").isNotNull()))
    of = lambda i: F.max(F.when(F.col("model") == i, F.struct("g", "h"))).alias(f"_{i}")
    joined = data.join(found.groupBy("id").agg(*(of(i) for i in range(len(models)))), "id", "left")
    dense = F.array(*(F.when(F.col(f"_{i}").isNotNull(), both(F.col(f"_{i}.g"), F.col(f"_{i}.h"))) for i in range(len(models))))
    return stored(joined.select(*data.columns, dense.alias("_slopes")), "slopes")


def _grown(data: DataFrame, features: Sequence[Sequence[int]], depth: int, rate: float, ridge: float, least_rows: int, least_curvature: float) -> dict[int, Tree]:
    """One tree for each model from ``data(_bins, _slopes)``; ``features`` are those that each may split by."""
    n_models = len(features)
    allowed = F.array(*(F.array(*map(F.lit, fs)) for fs in features))
    trees, sums = {i: Tree() for i in range(n_models)}, {}
    for level in range(depth):
        open_nodes = range(1 << level, 2 << level)

        def one(i: int) -> Column:
            node = trees[i].read(F.col("_bins"), lambda n: F.lit(n) if n in open_nodes else F.lit(None).cast("int"))  # noqa: B023
            slope = F.get("_slopes", F.lit(i))
            return F.when(slope.isNotNull() & node.isNotNull(), F.struct(F.lit(i).alias("model"), node.alias("node"), slope["g"].alias("g"), slope["h"].alias("h")))

        rows = data.select("_bins", F.inline(F.array(*(one(i) for i in range(n_models))))).where(F.col("model").isNotNull())
        rows = rows.select("model", "node", "g", "h", F.posexplode("_bins").alias("f", "b")).where(F.array_contains(F.get(allowed, F.col("model")), F.col("f")))
        cells = rows.groupBy("model", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
        split = False
        for r in best_splits(cells, ridge, least_rows, least_curvature).collect():
            i, n = r["model"], r["node"]
            sums[i, n] = (r["g"], r["h"])
            if r["f"] is not None:
                trees[i].splits[n], split = (r["f"], r["b"]), True
                sums[i, 2 * n], sums[i, 2 * n + 1] = (r["left_g"], r["left_h"]), (r["g"] - r["left_g"], r["h"] - r["left_h"])
        if not split:
            break
    for (i, n), (g, h) in sums.items():
        if n not in trees[i].splits:
            trees[i].values[n] = -rate * (g * UNIT) / (h * UNIT + ridge)
    return trees


def _moved(margins: Column, bins: Column, trees: dict[int, Tree]) -> Column:
    """Margins after one more tree for each model."""
    step = lambda i: trees[i].read(bins, lambda n: F.lit(trees[i].values.get(n, 0.0)))
    return F.array(*(F.get(margins, F.lit(i)) + step(i) for i in trees))


def boost(
    rows: DataFrame, features: Sequence[str], *, loss: Loss = LOGISTIC, rounds: int = 10, depth: int = 3, rate: float = 0.1, ridge: float = 1.0, least_rows: int = 1,
    least_curvature: float = 1e-3, bins: int = 32, margin: str | None = None, weight: str | None = None, es: str | None = None, patience: int | None = None,
    share_rows: float = 1.0, share_features: float = 1.0, seed: str = "boost", watch: bool = False, only: Sequence[int] | None = None,
    turns: Sequence[dict[int, Sequence[str]] | Sequence[str]] | None = None, after: Boosted | None = None,
) -> Boosted:
    """Fit ``y`` by ``rounds`` trees for each fold of ``rows(id, fold, y, *features)``, on the rows of the other folds.

    Margins begin at column ``margin``, if given, else at the constant that fits best, and gradients are formed anew from
    them in each round: with 0 rounds a margin is given back. Rows of ``es`` do not teach; with ``watch`` the mean loss of
    those that do not (all, without ``es``) is noted after each round, on the models that they are no fold of, and with
    ``patience`` rounds without a lesser one the fit stops and gives the best round's margins. ``share_rows`` and
    ``share_features`` draw by hash for each round.

    With ``only``, models are fitted for those folds alone, and other rows get a null margin. ``turns`` says, for each round, by
    which features trees may split (by fold, or the same for all), in place of ``rounds``. ``after`` is a fit of the same rows and
    features that goes on: its table is read on, its trees come first.

    A null label, or a null fold, teaches nothing; a row of a null fold gets a null margin, as does one of a null base
    margin. Null features stand before all values. A fold that holds all rows has a model without a tree.
    Each round is a stored table, so a lost executor costs one round at most; earlier ones are deleted.
    """
    features = list(features)
    cuts = after.cuts if after else cut_points(rows, features, bins)
    known = rows.where(F.col("fold").isNotNull()).groupBy("fold").agg(F.sum("y").alias("t"), F.count("y").alias("n"))
    sums = {r["fold"]: (float(r["t"] or 0), r["n"]) for r in known.collect()}
    models = sorted(sums if only is None else set(sums) & set(only))
    mean = {}
    for m in models:
        t, n = (sum(v[k] for f, v in sums.items() if f != m) for k in (0, 1))
        mean[m] = t / n if n else None
    base = rows.sparkSession.range(1)
    starts = {m: base.select(loss.start(F.lit(v).cast("double"))).first()[0] if v is not None else 0.0 for m, v in mean.items()} if margin is None else {}
    margins = F.array(*((F.lit(starts[m]) if margin is None else F.col(margin).cast("double")) for m in models))
    data = rows.select(
        "id", "fold", F.col("y").cast("double").alias("y"), binned(rows, features, cuts).alias("_bins"), margins.alias("_margins"),
        (F.coalesce(F.col(es), F.lit(False)) if es else F.lit(False)).alias("_es"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_weight"),
    )
    data = best = after.table if after else stored(data, "boosted")
    starts, trees = (after.starts, list(after.trees)) if after else (starts, [])
    losses: list[float] = []
    for r in range((rounds if turns is None else len(turns)) if models else 0):
        draws = [i for i in range(len(features)) if _share(f"{seed}:{r}:{i}", base) < share_features] if share_features < 1 else list(range(len(features)))
        taught = _slopes(data if share_rows >= 1 else data.where(uniform(f"{seed}:{r}", F.col("id")) < share_rows), loss, models)
        of = lambda m: [features.index(f) for f in (turns[r][m] if isinstance(turns[r], dict) else turns[r])]  # noqa: E731, B023
        allowed = [draws or [r % len(features)] if turns is None else of(m) for m in models]
        grown = _grown(taught, allowed, depth, rate, ridge, least_rows, least_curvature)
        trees.append(grown)
        moved = stored(data.withColumn("_margins", _moved(F.col("_margins"), F.col("_bins"), grown)), "boosted")
        if loss.jointly is not None:
            forget(taught)
        if data is not best and not (after and data is after.table):
            forget(data)
        data = moved
        if watch or patience:
            losses.append(_watched(data, loss, models, es is not None))
            if losses[-1] == min(losses):
                if best is not data and not (after and best is after.table):
                    forget(best)
                best = data
            elif patience and r - losses.index(min(losses)) >= patience:
                break
    if not patience:
        best = data
    own = F.get("_margins", (F.array_position(F.array(*map(F.lit, models)), F.col("fold")) - 1).cast("int")) if models else F.lit(None).cast("double")
    kept = trees[: (len(after.trees) if after else 0) + losses.index(min(losses)) + 1] if patience and losses else trees
    return Boosted(best.select("id", "fold", "y", own.alias("margin")), features, cuts, models, starts, kept, losses, best)


def _share(text: str, base: DataFrame) -> float:
    return base.select(uniform(text)).first()[0]


def _watched(data: DataFrame, loss: Loss, models: Sequence[int], held: bool) -> float:
    """Mean over models of the mean loss of the rows that watch."""
    watches = F.col("_es") if held else F.lit(True)
    found = data.agg(*(F.avg(F.when(watches & (F.col("fold") != m), loss.value(F.col("y"), F.get("_margins", F.lit(i))))) for i, m in enumerate(models))).first()
    seen = [x for x in found if x is not None]
    return fmean(seen) if seen else 0.0


def apply(fitted: Boosted, rows: DataFrame, margin: str | None = None, per_table: int = 8) -> DataFrame:
    """``rows`` with ``margin``, the mean over the fold models; to score rows that are of no fold. After ``per_table`` rounds
    what is found so far is stored, so that expressions stay short."""
    start = F.array(*(F.lit(fitted.starts[m]) if margin is None else F.col(margin).cast("double") for m in fitted.models))
    data = rows.withColumns({"_bins": binned(rows, fitted.features, fitted.cuts), "_margins": start})
    for r, trees in enumerate(fitted.trees):
        data = data.withColumn("_margins", _moved(F.col("_margins"), F.col("_bins"), trees))
        if r % per_table == per_table - 1:
            data = stored(data, "applied")
    mean = F.aggregate("_margins", F.lit(0.0), lambda s, x: s + x) / len(fitted.models)
    return data.withColumn("margin", mean).drop("_bins", "_margins")
