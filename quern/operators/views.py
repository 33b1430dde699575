"""Feature views: named blocks of columns with their provenance, joined by id.

A block is a function from the labelled table (id, y, fold, keys) to ``(id, *columns)``. Provenance says what a block
may have seen: ``static`` the row alone, ``transductive`` the values of all rows, ``external`` labels of another table,
``fold`` labels of other folds. A view is a list of blocks; its columns are exactly theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.keys import exact_label, joined_key
from quern.operators.codes import codes
from quern.operators.encodings import crossfit
from quern.operators.ordered import met, midrank, unique
from quern.operators.profiles import group_stats, rating_features, rating_pairs, subset_means

Make = Callable[[DataFrame], DataFrame]


class Block(NamedTuple):
    provenance: str
    make: Make


def value_counts(columns: Sequence[str]) -> Block:
    """``count_<c>``: how many rows share the value, nulls included."""

    def make(df: DataFrame) -> DataFrame:
        out = df.select("id", *columns)
        for c in columns:
            n = df.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias(f"count_{c}"))
            out = out.join(n, F.col(c).eqNullSafe(F.col("_v"))).drop("_v")
        return out.select("id", *(f"count_{c}" for c in columns))

    return Block("transductive", make)


def key_means(key: str, measures: Sequence[str]) -> Block:
    """``mean_<m>_by_<key>`` and ``gap_<m>_by_<key>``: mean of the key's rows, and the row's distance from it."""

    def make(df: DataFrame) -> DataFrame:
        means = df.groupBy(key).agg(*(F.avg(F.col(m).cast("double")).alias(f"mean_{m}_by_{key}") for m in measures))
        joined = met(df.select("id", key, *measures), means, [key])
        return joined.select("id", *(f"mean_{m}_by_{key}" for m in measures), *((F.col(m) - F.col(f"mean_{m}_by_{key}")).alias(f"gap_{m}_by_{key}") for m in measures))

    return Block("transductive", make)


def rank_shares(columns: Sequence[str]) -> Block:
    """``pct_<c>``: mid-rank over the number of rows."""

    def make(df: DataFrame) -> DataFrame:
        out = df.select("id", *columns)
        for c in columns:
            out = midrank(out, c, f"_{c}")
        return out.select("id", *((F.col(f"_{c}") / F.col(f"_{c}_of")).alias(f"pct_{c}") for c in columns))

    return Block("transductive", make)


def digits(column: str) -> Block:
    """Steps, last digit, length and zero flag of a number's whole part."""

    def make(df: DataFrame) -> DataFrame:
        v = F.floor(F.col(column)).cast("bigint")
        parts = {"step_250": F.floor(v / 250), "step_1000": F.floor(v / 1000), "last": F.pmod(v, F.lit(10)), "length": F.length(v.cast("string")), "is_zero": (v == 0).cast("int")}
        return df.select("id", *(e.alias(f"{column}_{k}") for k, e in parts.items()))

    return Block("static", make)


def ratings(columns: Sequence[str]) -> Block:
    """Row-wise figures over rating columns."""
    return Block("static", lambda df: df.select("id", *(e.alias(k) for k, e in rating_features([F.col(c) for c in columns]).items())))


_ratings = ratings


def masks(columns: Sequence[str], group: str, values: Sequence) -> Block:
    """Whether a rating does not apply, and whether that meets each value of a group: all values, not the first few."""

    def make(df: DataFrame) -> DataFrame:
        no = {c: (F.col(c) == 0).cast("int") for c in columns}
        crossed = {f"na_{c}_{group}_{i}": no[c] * F.coalesce((F.col(group) == v).cast("int"), F.lit(0)) for c in columns for i, v in enumerate(values)}
        return df.select("id", *(e.alias(f"na_{c}") for c, e in no.items()), *(e.alias(k) for k, e in crossed.items()))

    return Block("static", make)


def category_codes(columns: Sequence[str]) -> Block:
    """``code_<c>``: sorted codes of the values."""

    def make(df: DataFrame) -> DataFrame:
        out = df.select("id", *columns)
        for c in columns:
            out = codes(out, c, f"code_{c}")
        return out.select("id", *(f"code_{c}" for c in columns))

    return Block("transductive", make)


def encoded(keys: Sequence[Sequence[str]], smooth: float = 20.0) -> Block:
    """``te_<key>``: cross-fitted mean label of each key."""

    def make(df: DataFrame) -> DataFrame:
        out = df.select("id")
        for key in keys:
            one = crossfit(df.withColumn("_k", joined_key([F.col(c) for c in key])), "_k", [smooth])
            out = out.join(one.select("id", F.col(f"te_{smooth:g}").alias("te_" + "_".join(key))), "id")
        return out

    return Block("fold", make)


def plain(columns: Sequence[str]) -> Block:
    """The columns themselves."""
    return Block("static", lambda df: df.select("id", *columns))


def domain(a: str, b: str, per: str) -> Block:
    """Of two amounts: sum, difference, logarithms, whether both are 0, and the sum for each thousand of ``per``, one at least.
    A null amount is 0; a null ``per`` is one thousand."""

    def make(df: DataFrame) -> DataFrame:
        x, y = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (a, b))
        units = F.greatest(F.coalesce(F.col(per) / 1000.0, F.lit(1.0)), F.lit(1.0))
        parts = {"total": x + y, "gap": y - x, "both_zero": ((x == 0) & (y == 0)).cast("int"), f"log_{a}": F.log1p(x), f"log_{b}": F.log1p(y), "per_unit": (x + y) / units}
        return df.select("id", *(e.alias(f"dom_{k}") for k, e in parts.items()))

    return Block("static", make)


def gaps(pairs: Sequence[tuple[str, str]]) -> Block:
    """Gaps and sums of fixed pairs of ratings."""
    return Block("static", lambda df: df.select("id", *(e.alias(k) for k, e in rating_pairs(pairs).items())))


def code_products(pairs: Sequence[tuple[str, str]]) -> Block:
    """``ix_<a>_<b>``: the sorted code of a category times a number; a null number counts -1."""

    def make(df: DataFrame) -> DataFrame:
        out = df.select("id", *dict.fromkeys(c for p in pairs for c in p))
        for a in dict.fromkeys(a for a, _ in pairs):
            out = codes(out, a, f"_code_{a}")
        return out.select("id", *((F.col(f"_code_{a}") * F.coalesce(F.col(b), F.lit(-1))).alias(f"ix_{a}_{b}") for a, b in pairs))

    return Block("transductive", make)


def twins(columns: Sequence[str]) -> Block:
    """``cat_<c>``: a number's exact value as a sorted category code."""

    def make(df: DataFrame) -> DataFrame:
        out = df.select("id", *columns)
        for c in columns:
            out = codes(out.withColumn("_label", exact_label(F.col(c))), "_label", f"cat_{c}").drop("_label")
        return out.select("id", *(f"cat_{c}" for c in columns))

    return Block("transductive", make)


def crossed(ratings: Sequence[str], backgrounds: Sequence[str]) -> Block:
    """``cat_<rating>_<background>``: sorted codes of the pairs of values."""

    def make(df: DataFrame) -> DataFrame:
        out = df.select("id", *ratings, *backgrounds)
        for r in ratings:
            for b in backgrounds:
                out = codes(out.withColumn("_pair", joined_key([F.col(r), F.col(b)], "|")), "_pair", f"cat_{r}_{b}").drop("_pair")
        return out.select("id", *(f"cat_{r}_{b}" for r in ratings for b in backgrounds))

    return Block("transductive", make)


def key_spread(key: str, measures: Sequence[str]) -> Block:
    """``sd_<m>_by_<key>``, ``median_...`` and ``range_...``: how a measure spreads over the rows of a key."""

    def make(df: DataFrame) -> DataFrame:
        out = df.select("id", key, *measures)
        for m in measures:
            found = group_stats(df.select("id", key, m), key, m).select("id", F.col("g_sd").alias(f"sd_{m}_by_{key}"), F.col("g_median").alias(f"median_{m}_by_{key}"), F.col("g_range").alias(f"range_{m}_by_{key}"))
            out = out.join(found, "id")
        return out.drop(key, *measures)

    return Block("transductive", make)


def outside_means(other: DataFrame, key: str, measures: Sequence[str]) -> Block:
    """``out_<m>_by_<key>``: mean of a measure in another table at the row's key; its labels are not read."""

    def make(df: DataFrame) -> DataFrame:
        means = other.groupBy(key).agg(*(F.avg(F.col(m).cast("double")).alias(f"out_{m}_by_{key}") for m in measures))
        return met(df.select("id", key), means, [key]).drop(key)

    return Block("static", make)


def enrichment(other: DataFrame, route: str, segment: str, amounts: Sequence[str], ratings: Sequence[str], subsets: dict[str, Sequence[str]], pairs: Sequence[tuple[str, str]]) -> list[Block]:
    """The label-free enrichment: spread of amounts by route, shares of equal values, gaps of ratings, row-wise figures and
    means of subsets of ratings, and means in another table by route and segment."""
    named = Block("static", lambda df: df.select("id", *(e.alias(k) for k, e in subset_means(subsets).items())))
    return [key_spread(route, amounts), rank_shares(amounts), gaps(pairs), _ratings(ratings), named, outside_means(other, route, amounts), outside_means(other, segment, amounts)]


def compact(numbers: Sequence[str], amounts: tuple[str, str], ratings: Sequence[str], backgrounds: Sequence[str], pairs: Sequence[tuple[str, str]], keys: Sequence[Sequence[str]]) -> list[Block]:
    """The compact recipe: raw numbers and ratings, arithmetic on two amounts, gaps and row-wise figures of ratings,
    categorical twins of numbers, ratings crossed with backgrounds, and a few encoded keys."""
    return [plain([*numbers, *ratings]), domain(*amounts, numbers[0]), gaps(pairs), _ratings(ratings), category_codes(backgrounds), twins(numbers), crossed(ratings, backgrounds), encoded(keys)]


def assemble(df: DataFrame, blocks: Sequence[Block], allowed: Sequence[str] = ("static", "transductive", "external", "fold")) -> DataFrame:
    """``(id, y, fold)`` and the columns of all blocks; a block of another provenance than ``allowed``, a repeated
    column or a repeated id is an error."""
    out = unique(df).select("id", "y", "fold")
    for b in blocks:
        if b.provenance not in allowed:
            raise ValueError(f"a {b.provenance} block is not allowed here")
        part = b.make(df)
        if again := set(part.columns) & set(out.columns) - {"id"}:
            raise ValueError(f"columns of two blocks: {sorted(again)}")
        out = out.join(part, "id")
    return out
