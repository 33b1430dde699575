"""Queries on feature views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import models, views
from quern.operators.metrics import auc
from quern.plans.base import BASE, FOLDED, folded, query, r6

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
COMPACT = (views.digits("price"), views.value_counts(["cust", "pri"]), views.rank_shares(["price"]), views.category_codes(["pri"]), views.encoded([["cust"], ["r0", "pri"]]))


@query(f"with {BASE} select id, count(*) over (partition by cust) as count_cust, count(*) over (partition by pri) as count_pri from base")
def t18_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.value_counts(["cust", "pri"]).make(folded(spark, sf_dir))


@query(f"with {BASE} select id, round(avg(price) over (partition by pri), 4) as mean_price_by_pri, round(price - avg(price) over (partition by pri), 4) as gap_price_by_pri from base")
def t18_key_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.key_means("pri", ["price"]).make(folded(spark, sf_dir))
    return out.select("id", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in out.columns[1:]))


@query(f"with {BASE}, v as (select id, floor(price)::bigint as v from base) select id, floor(v / 250)::bigint as price_step_250, floor(v / 1000)::bigint as price_step_1000, v % 10 as price_last, length(v::varchar)::int as price_length, (v = 0)::int as price_is_zero from v")
def t18_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.digits("price").make(folded(spark, sf_dir))


@query(f"with {BASE} select id, (r0 = 0)::int as na_r0, " + ", ".join(f"((r0 = 0) and pri = '{p}')::int as na_r0_pri_{i}" for i, p in enumerate(PRIORITIES)) + " from base")
def k19_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crosses all values of the group; the reference used its first three codes."""
    return views.masks(["r0"], "pri", PRIORITIES).make(folded(spark, sf_dir))


@query(
    f"""with {FOLDED}, v as (select *, floor(price)::bigint as v, (r0 || chr(31) || pri) as pair from folded), tot as (select sum(y) as t, count(*) as n from folded),
    p as (select fold, ((select t from tot) - sum(y)) / ((select n from tot) - count(*))::double as prior from folded group by fold),
    s as (select *, sum(y) over (partition by cust) - sum(y) over (partition by cust, fold) as ct, count(*) over (partition by cust) - count(*) over (partition by cust, fold) as cn,
                 sum(y) over (partition by pair) - sum(y) over (partition by pair, fold) as pt, count(*) over (partition by pair) - count(*) over (partition by pair, fold) as pn from v)
    select id, y, fold, floor(v / 250)::bigint as price_step_250, floor(v / 1000)::bigint as price_step_1000, v % 10 as price_last, length(v::varchar)::int as price_length, (v = 0)::int as price_is_zero,
           count(*) over (partition by cust) as count_cust, count(*) over (partition by pri) as count_pri,
           round((rank() over (order by price) + (count(*) over (partition by price) - 1) / 2.0::double) / count(*) over (), 6) as pct_price, (dense_rank() over (order by pri) - 1)::int as code_pri,
           round((ct + 20 * prior) / (cn + 20), 6) as te_cust, round((pt + 20 * prior) / (pn + 20), 6) as te_r0_pri
    from s join p using (fold)"""
)
def t30_compact_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(views.assemble(folded(spark, sf_dir), COMPACT))


@query()
def g6_view_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold AUC of a logistic fit on the compact view."""
    view = views.assemble(folded(spark, sf_dir), COMPACT)
    scored = models.out_of_fold(view, [c for c in view.columns if c not in ("id", "y", "fold")], "logistic")
    return r6(auc(scored, "score", ["fold"]).select("fold", "auc", "pairs"))
