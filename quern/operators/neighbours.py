"""Exact nearest neighbours by squared distance, in leaves of references that distance bounds exclude."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.keys import one_hot
from quern.functions.scalars import uniform
from quern.sources.scratch import stored

#: Rows of a block: queries and references of one task are two blocks.
BLOCK = 16384
#: Queries of a block whose products with all references of the other are held at once, and pairs that are measured at once.
ROWS, PAIRS = 128, 1 << 16
#: Pivots on the driver, pivots within one of their cells, and pivots that bound a leaf by rings, at most.
CELLS, LEAVES, RINGS = 256, 512, 16


def _matrix(v: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors without nulls as rows of a matrix; vectors of other lengths are an error."""
    values = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(v), len(values) // max(len(v), 1))


def _placed(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``df(id, v, _s, _a)`` with ``_d``, the distance to each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                d = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(d), pa.list_(pa.float64()))], [*b.schema.names, "_d"])

    return df.mapInArrow(run, "id long, v array<double>, _s string, _a string, _d array<double>")


def _leaf_of(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """``rows`` of one cell with ``_leaf``, the id of the cell's nearest pivot; null if it has none."""
    rows = rows.combine_chunks()
    if not rows.num_rows or not pivots.num_rows:
        return rows.append_column("_leaf", pa.nulls(rows.num_rows, pa.int64()))
    pivots = pivots.sort_by("id")
    x, y = _matrix(rows["v"]), _matrix(pivots["v"])
    near = np.concatenate([np.argmin(np.stack([((x[at : at + 1024] - p) ** 2).sum(axis=1) for p in y]), axis=0) for at in range(0, len(x), 1024)])
    return rows.append_column("_leaf", pa.array(pivots["id"].to_numpy()[near], pa.int64()))


def _with_leaf(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """``rows(id, v, _s, _a, _d, _c, _n)`` with ``_leaf``. A task holds a block of a cell's rows and the cell's pivots."""
    parts = F.greatest(F.ceil(F.col("_n") / BLOCK), F.lit(1)).cast("int")
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("id", F.lit(1)), parts).cast("int"))
    copied = pivots.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n")
    by = ["_s", "_c", "_part"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", _leaf long"
    return dealt.groupBy(*by).cogroup(copied.groupBy(*by)).applyInArrow(_leaf_of, schema).drop("_part")


def _best(k: int):
    """The k nearest references of a block for each query of another, as Arrow tables.

    One matrix product gives all squared distances of two blocks up to a known error. Only references that this error may put
    among the k nearest, and none beyond ``_top``, a squared distance within which k are known, are then measured exactly.
    """

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            qid, rid, top = left["id"].to_numpy(), right["id"].to_numpy(), left["_top"].to_numpy()
            order = np.argsort(rid, kind="stable")
            rid, x, y = rid[order], _matrix(left["v"]), _matrix(right["v"])[order]
            kinds = np.array(left["_a"].to_pylist() + right["_a"].to_pylist(), object)
            codes = np.unique(kinds, return_inverse=True)[1]
            qa, ra = np.where(kinds == "", -1, codes)[: len(x)], codes[len(x) :][order]
            with np.errstate(all="ignore"):
                middle = y.mean(axis=0)
                xc, yc = x - middle, y - middle
                nx, ny = (xc * xc).sum(axis=1), (yc * yc).sum(axis=1)
                xc, yc = np.column_stack([-2 * xc, np.ones(len(x))]), np.column_stack([yc, ny])
                slack = 4e-15 * (x.shape[1] + 16) * (nx + ny.max())
            sure = np.isfinite(slack).all()
            first, last = np.searchsorted(rid, qid, "left"), np.searchsorted(rid, qid, "right")
            for at in range(0, len(x), ROWS):
                part = slice(at, at + ROWS)
                d = xc[part] @ yc.T if sure else np.zeros((len(x[part]), len(y)))  # less the query's own square
                for i in np.nonzero(first[part] < last[part])[0]:
                    d[i, first[at + i] : last[at + i]] = np.inf
                for c in np.unique(qa[part]):
                    if c >= 0 and (own := ra == c).any():
                        d[np.ix_(qa[part] == c, own)] = np.inf
                most = top[part] - nx[part]
                if not sure:
                    most = np.zeros(len(d))
                elif (new := np.isnan(most)).any():
                    most[new] = np.partition(d[new], min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
                most = np.minimum(most + 2 * slack[part] if sure else most, np.finfo(float).max)
                rows, cols = np.nonzero(d <= most[:, None])
                with np.errstate(all="ignore"):
                    exact = [((x[at + rows[p : p + PAIRS]] - y[cols[p : p + PAIRS]]) ** 2).sum(axis=1) for p in range(0, len(rows), PAIRS)]
                exact = np.concatenate(exact) if exact else np.zeros(0)
                real = np.isfinite(exact)
                rows, cols, exact = rows[real], cols[real], exact[real]
                order = np.lexsort((cols, exact, rows))
                rows, cols, exact = rows[order], cols[order], exact[order]
                kept = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
                for o, v in zip(out, (qid[at + rows[kept]], rid[cols[kept]], exact[kept]), strict=True):
                    o.append(v)
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(np.concatenate(o) if o else [], t) for n, o, t in zip(("id", "ref", "d2"), out, types, strict=True)})

    return near


def _met(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """``(id, ref, d2)``: the k best of each block of the leaf ``(_s, _c, _leaf)`` that a row of ``queries`` names; ``_subs`` is the
    number of the leaf's blocks, ``_top`` a squared distance within which k are known, or null."""
    by = ["_s", "_c", "_leaf"]
    n = stored(queries.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n")), "counts")
    q = queries.select("id", "v", "_a", "_top", *by, F.explode(F.sequence(F.lit(0), F.col("_subs") - 1)).alias("_b"))
    q = q.join(n, by).withColumn("_q", F.pmod(F.xxhash64("id"), F.col("_n")))
    r = refs.join(n, by).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_n") - 1).cast("long"))))
    by, kept = [*by, "_b", "_q"], ["id", "v", "_a"]
    return q.select(*by, *kept, "_top").groupBy(*by).cogroup(r.select(*by, *kept).groupBy(*by)).applyInArrow(_best(k), "id long, ref long, d2 double")


def knn(queries: DataFrame, refs: DataFrame, k: int, vector: str = "v", same: str | None = None, apart: str | None = None, account: dict[str, int] | None = None) -> DataFrame:
    """``(id, ref, d2, rank)``: the k nearest other rows of ``refs`` for each row of ``queries``, ties by ref id.

    Both sides have ``id`` and an array of doubles; with ``same``, only rows of an equal value of that column count, and
    with ``apart``, only rows of another. A row without an id, or whose vector is null or has an element that is none, has
    no neighbours and is none.

    References stand in cells around pivots on the driver, as many as blocks of the largest value of ``same`` fit, CELLS at most, and within a cell in leaves
    around pivots of its own, one for a block, LEAVES at most; so leaves grow in number, not in size, with the table.
    A query meets the leaf of its nearest pivots first. The distance of its k-th neighbour there then excludes every
    leaf that lies farther off: by the cell's radius, or by the leaf's least and greatest distance to one of RINGS pivots,
    both by the triangle inequality. A task holds a block of queries and one of references, so memory is bounded by
    BLOCK, and what moves is the pairs of blocks that no bound excludes. ``account`` gets how many pairs of a query and a
    reference were met, of how many.
    """
    text = lambda c, none: F.lit(none) if c is None else F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    whole = F.col("id").isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    pick = lambda df: df.where(whole).select(F.col("id").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), text(same, "").alias("_s"), text(apart, "").alias("_a"))
    largest = pick(refs).groupBy("_s").count().agg(F.max("count")).first()[0] or 0
    cells = min(CELLS, largest // BLOCK + 1)
    pivots = np.array([r["v"] for r in pick(refs).orderBy(F.xxhash64("id")).limit(cells).select("v").collect()] or [[0.0]], float)
    near = F.array_min("_d")
    r = _placed(pick(refs), pivots).select("id", "v", "_s", "_a", "_d", (F.array_position("_d", near) - 1).cast("int").alias("_c"))
    r = stored(r, "refs")
    cell_sizes = stored(r.groupBy("_s", "_c").agg(F.count("*").alias("_n"), F.max(F.array_min("_d")).alias("radius")), "cells")
    # As many leaves as blocks fit; drawn by hash, so no cell is sorted.
    drawn = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 30)) < (1 << 30) * F.least(F.col("_n") / BLOCK, F.lit(LEAVES)) / F.col("_n")
    sized = r.join(cell_sizes.select("_s", "_c", "_n"), ["_s", "_c"])
    own = stored(sized.where((F.col("_n") > BLOCK) & drawn).select("_s", "_c", "_n", "id", "v"), "pivots")
    in_leaf = (lambda df: df.withColumn("_leaf", F.lit(None).cast("long"))) if own.isEmpty() else lambda df: _with_leaf(df, own)
    r = stored(in_leaf(sized), "refs")
    rings = range(min(RINGS, len(pivots)))
    ring = [f(F.get("_d", F.lit(j))).alias(f"_{n}{j}") for j in rings for n, f in (("lo", F.min), ("hi", F.max))]
    leaf = F.coalesce("_leaf", F.lit(-1).cast("long")).alias("_leaf")
    r = r.withColumn("_leaf", leaf)
    leaves = stored(r.groupBy("_s", "_c", "_leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_subs"), F.count("*").alias("_rows"), *ring), "leaves")
    r = r.drop("_d", "_n").join(leaves.select("_s", "_c", "_leaf", "_subs"), ["_s", "_c", "_leaf"]).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_subs")).cast("int")).drop("_subs")

    listed = cell_sizes.groupBy("_s").agg(F.collect_list(F.struct(F.col("_c").alias("cell"), "radius", "_n")).alias("_all"))  # CELLS at most
    q = _placed(pick(queries), pivots).join(listed, "_s")
    home = F.array_min(F.transform("_all", lambda c: F.struct(F.get("_d", c["cell"]).alias("d"), c["cell"].alias("cell"), c["_n"].alias("_n"))))
    q = stored(q.withColumns({"_home": home}).select("id", "v", "_s", "_a", "_d", "_all", F.col("_home.cell").alias("_c"), F.col("_home._n").alias("_n")), "queries")
    at_home = in_leaf(q.drop("_all")).withColumn("_leaf", leaf)
    at_home = at_home.withColumn("_top", F.lit(None).cast("double"))
    at_home = stored(at_home.select("id", "v", "_s", "_a", "_top", "_c", "_leaf").join(leaves.select("_s", "_c", "_leaf", "_subs", "_rows"), ["_s", "_c", "_leaf"]), "home")
    order = Window.partitionBy("id").orderBy("d2", "ref")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = _met(at_home, r, k)
    if account is not None:
        account |= {"met": at_home.agg(F.sum("_rows")).first()[0] or 0, "all": q.count() * r.count()}
    if leaves.groupBy("_s").count().where("count > 1").isEmpty():
        return best(first)
    first = stored(best(first).drop("rank"), "first")
    reach = first.groupBy(F.col("id").alias("_of")).agg(F.when(F.count("*") >= k, F.max("d2")).alias("_top"), F.when(F.count("*") >= k, F.sqrt(F.max("d2"))).alias("_reach"))
    # Distances are rounded: bounds give way by more than their error.
    within = lambda bound: F.col("_reach").isNull() | (bound * (1 - 1e-9) <= F.col("_reach") * (1 + 1e-9) + 1e-12)
    met_home = at_home.select(F.col("id").alias("_of2"), F.col("_c").alias("_hc"), F.col("_leaf").alias("_hl"))
    more = q.drop("_c", "_n").join(reach, q["id"] == reach["_of"], "left").join(met_home, F.col("id") == F.col("_of2"), "left")
    more = more.withColumn("_cell", F.explode(F.filter("_all", lambda c: within(F.get("_d", c["cell"]) - c["radius"])))).drop("_all")
    more = more.withColumn("_c", F.col("_cell.cell")).join(leaves, ["_s", "_c"])
    apart_by = [x for j in rings for x in (F.col(f"_lo{j}") - F.get("_d", F.lit(j)), F.get("_d", F.lit(j)) - F.col(f"_hi{j}"))]
    again = F.col("_c").eqNullSafe(F.col("_hc")) & F.col("_leaf").eqNullSafe(F.col("_hl"))
    more = more.where(within(F.greatest(*apart_by)) & ~again).select("id", "v", "_s", "_a", "_top", "_c", "_leaf", "_subs", "_rows")
    more = stored(more, "more")
    if account is not None:
        account["met"] += more.agg(F.sum("_rows")).first()[0] or 0
    return best(first.union(_met(more, r, k)))


def encode(near: DataFrame, labels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Features of each query from its neighbours' labels, for each k: weighted mean (weights 1 / (d + 0.001)), plain
    mean and mean distance. ``labels`` has ``id`` and ``y`` of the rows that may teach."""
    seen = near.join(labels.select(F.col("id").alias("ref"), F.col("y").cast("double").alias("_y")), "ref").withColumn("_d", F.sqrt("d2"))
    w = 1 / (F.col("_d") + 0.001)
    out = []
    for k in ks:
        own = lambda c: F.when(F.col("rank") <= k, c)  # noqa: E731, B023
        out += [(F.sum(own(w * F.col("_y"))) / F.sum(own(w))).alias(f"knn_w_{k}"), F.avg(own(F.col("_y"))).alias(f"knn_m_{k}"), F.avg(own(F.col("_d"))).alias(f"knn_d_{k}")]
    return seen.groupBy("id").agg(*out)


def standardised(fit: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with each column centred and scaled by the mean and population deviation of ``fit``; near-constant
    columns are only centred."""
    stats = fit.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scale: dict[str, Column] = {}
    for c in columns:
        s = stats[f"s_{c}"] or 0.0
        scale[c] = (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(s if s >= 1e-9 else 1.0)
    return rows.withColumns(scale)


def metric_space(fit: DataFrame, rows: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """``rows`` with ``v``, a vector to measure distances in: numbers standardised by ``fit``, then a 0/1 place for each
    category value of ``fit``; columns that are constant in ``fit`` are left out. Categories are few by nature: their values go
    through the driver."""
    levels = {c: sorted(r[0] for r in fit.select(c).distinct().collect() if r[0] is not None) for c in categories}
    spread = fit.agg(*(F.stddev_pop(c).alias(c) for c in numbers)).first() if numbers else {}
    kept = [c for c in numbers if (spread[c] or 0.0) >= 1e-9]
    places = [x.cast("double") for c in categories if len(levels[c]) > 1 for x in one_hot(F.col(c), levels[c])]
    copied = lambda df: df.withColumns({f"_s_{c}": F.col(c) for c in kept})
    scaled = standardised(copied(fit), copied(rows), [f"_s_{c}" for c in kept]) if kept else rows
    return scaled.withColumn("v", F.array(*(F.col(f"_s_{c}") for c in kept), *places)).drop(*(f"_s_{c}" for c in kept))


def between(rows: DataFrame, near: DataFrame, columns: Sequence[str], seed: str, whole: Sequence[str] = ()) -> DataFrame:
    """New rows between each row and its neighbour of each rank: ``columns`` are mixed by a hashed share, those of
    ``whole`` are rounded, all others are inherited from the row."""
    other = rows.select(F.col("id").alias("ref"), *(F.col(c).alias(f"_{c}") for c in columns))
    pairs = rows.join(near.select("id", "ref", "rank"), "id").join(other, "ref")
    share = uniform(seed, F.col("id"), F.col("ref"))
    mixed = {c: F.col(c) + share * (F.col(f"_{c}") - F.col(c)) for c in columns}
    return pairs.withColumns({c: F.round(v) if c in whole else v for c, v in mixed.items()}).drop("ref", *(f"_{c}" for c in columns))
