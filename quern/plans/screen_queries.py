"""Queries on screens, gates and further tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import metrics, sampling, screens
from quern.plans.base import BASE, FOLDED, auc_sql, base, folded, query, r6, ranked_sql, u_sql
from quern.plans.blend_queries import LONG, long_scores
from quern.sources.tables import table

_FEATURES = ("a", "b", "r0", "r1", "cust")


@query(
    f"""with {BASE}, long as (select y, unnest([{', '.join(f"'{f}'" for f in _FEATURES)}]) as feature, unnest([{', '.join(f'{f}::double' for f in _FEATURES)}]) as v from base), {auc_sql('long', 'v', 'feature')}
    select feature, round(good / pairs, 6) as auc, round(greatest(good / pairs, 1 - good / pairs), 6) as strength from auc"""
)
def m29_feature_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(screens.feature_screen(base(spark, sf_dir), _FEATURES))


@query(
    f"""with {BASE}, n as (select y, a, count(*) as n from base group by all), lost as (
        select o.a, 1 as y, sum(case when z.a > o.a then z.n when z.a = o.a then z.n / 2.0::double else 0 end) as lost from (select distinct a from base where y = 1) o, n z where z.y = 0 group by o.a
        union all select z.a, 0, sum(case when o.a < z.a then o.n when o.a = z.a then o.n / 2.0::double else 0 end) from (select distinct a from base where y = 0) z, n o where o.y = 1 group by z.a)
    select id, round(lost, 4) as lost from base join lost using (a, y)"""
)
def m13_row_error_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screens.row_credit(base(spark, sf_dir), "a")
    return out.select("id", F.round(F.col("lost") + 1e-9, 4).alias("lost"))


@query(
    f"""with {BASE}, n as (select y, r0, a, count(*) as n from base group by all)
    select o.r0 as one, z.r0 as zero, sum(o.n * z.n)::bigint as pairs, sum(o.n * z.n * case when o.a < z.a then 1.0::double when o.a = z.a then 0.5::double else 0 end) as errors
    from n o, n z where o.y = 1 and z.y = 0 group by all"""
)
def m20_cross_bucket_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in wrong order; the reference counted those in right order."""
    return screens.cross_bucket_errors(base(spark, sf_dir), "a", "r0")


@query("select p_size, round(a * (1 - b) * 0.9::double + (1 - a) * b * 0.1::double + (a * b + (1 - a) * (1 - b)) / 2, 6) as ceiling from (select p_size, 0.4::double * (1 - f) / (0.4::double * (1 - f) + 0.6::double * f) as a, 0.4::double * f / (1 - (0.4::double * (1 - f) + 0.6::double * f)) as b from (select distinct p_size, p_size / 200.0::double as f from part))")
def m21_noise_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    return r6(sizes.select("p_size", screens.noise_ceiling(F.lit(0.9), F.col("p_size") / 200.0, F.lit(0.4)).alias("ceiling")))


_DRAWS = f"""drawn as (select y, a, b, draw, {u_sql("'split:' || draw || ':' || id")} < 0.2::double as public from base, range(8) r(draw))"""


def _draw_auc(s: str) -> str:
    return f"""(select draw, sum(case when o.s > z.s then o.n * z.n when o.s = z.s then o.n * z.n / 2.0::double else 0 end) / sum(o.n * z.n) as auc
        from (select draw, {s} as s, count(*) as n from drawn where public and y = 1 group by all) o join (select draw, {s} as s, count(*) as n from drawn where public and y = 0 group by all) z using (draw) group by draw)"""


@query(
    f"""with {BASE}, {_DRAWS}, d as (select x.auc as a, w.auc as b, w.auc - x.auc as delta from {_draw_auc('a')} x join {_draw_auc('b')} w using (draw))
    select round(avg(delta), 6) as mean, round(quantile_cont(delta, 0.05), 6) as p05, round(quantile_cont(delta, 0.5), 6) as p50, round(quantile_cont(delta, 0.95), 6) as p95, round(min(delta), 6) as worst,
    round(avg((delta > 0)::int), 6) as positive from d"""
)
def m22_draw_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampling.parts(base(spark, sf_dir), 8, 0.2, "split").where("part = 'public'")
    a, b = (metrics.auc(drawn, s, ["draw"]).select("draw", F.col("auc").alias(s)) for s in ("a", "b"))
    return r6(screens.draw_summary(a.join(b, "draw").withColumn("delta", F.col("b") - F.col("a")), "delta"))


@query(
    f"""with {BASE}, {_DRAWS}, d as (select x.auc as a, w.auc as b from {_draw_auc('a')} x join {_draw_auc('b')} w using (draw))
    select round(avg((b > a)::int), 6) as p_better, round(avg(greatest(b - a, 0)), 6) as gain from d"""
)
def b18_second_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampling.parts(base(spark, sf_dir), 8, 0.2, "split").where("part = 'public'")
    a, b = (metrics.auc(drawn, s, ["draw"]).select("draw", F.col("auc").alias(s)) for s in ("a", "b"))
    return r6(screens.second_choice(a.join(b, "draw")))


@query(
    f"""with recursive {BASE}, cells as (select pri, round (ln(greatest(least(a, 0.999999::double), 1e-6::double) / (1 - greatest(least(a, 0.999999::double), 1e-6::double))), 4 ) as z, sum(y)::double as t, count(*)::double as n from base group by all),
    steps as (select 0 as k, pri, 0.0::double as d from (select distinct pri from cells) union all
        select k + 1, s.pri, d + (sum(t - n / (1 + exp(-(z + d)))) - 5 * d) / (sum(n / (1 + exp(-(z + d))) * (1 - 1 / (1 + exp(-(z + d))))) + 5) from steps s join cells c on c.pri = s.pri where k < 25 group by k, s.pri, d)
    select pri as "group", round(d, 6) as "offset" from steps where k = 25"""
)
def m28_group_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newton steps by group."""
    return r6(screens.group_offsets(base(spark, sf_dir), "a", "pri", 5.0))


@query(
    f"""with {BASE}, ranked as (select id, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0::double as r, count(*) over () as n from base)
    select id, (case when r > n * 0.95::double then 1 else 0 end)::int as label from ranked where r > n * 0.95::double or r <= n * 0.05::double"""
)
def w11_confident_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.confident(base(spark, sf_dir), "a", 0.05).select("id", "label")


_Z = "abs(ln(greatest(least(a, 0.999999::double), 1e-6::double) / (1 - greatest(least(a, 0.999999::double), 1e-6::double))))"


@query(f"with {BASE}, c as (select quantile_cont({_Z}, 0.3) as c from base) select id, case when {_Z} <= c + 1e-9 then 3.0::double else 1.0::double end as weight from base, c")
def x2_near_tie_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.near_tie_weights(base(spark, sf_dir), "a", 0.3, 3.0).select("id", "weight")


_P = [f"(p{k} / (p0 + p1 + p2))" for k in range(3)]


@query(
    f"""with {BASE}, raw as (select id, r0 % 3 as k, a + 0.1::double as p0, b + 0.1::double as p1, 0.5::double as p2 from base), p as (select id, k, {', '.join(f'{x} as q{i}' for i, x in enumerate(_P))} from raw),
    m as (select *, q1 + 2 * q2 as ev from p)
    select id, round(ev, 6) as ev, round(k - ev, 6) as residual, round(-ln([q0, q1, q2][k + 1]), 6) as surprisal, round(-(q0 * ln(q0) + q1 * ln(q1) + q2 * ln(q2)), 6) as entropy,
           round(q0 * ev * ev + q1 * (1 - ev) * (1 - ev) + q2 * (2 - ev) * (2 - ev), 6) as variance, round(q1 + q2, 6) as upper from m"""
)
def t22_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screens.signatures([F.col("a") + 0.1, F.col("b") + 0.1, F.lit(0.5)], F.col("r0") % 3)
    return r6(base(spark, sf_dir).select("id", *(v.alias(k) for k, v in found.items())))


@query(f"with {BASE}, p as (select y, greatest(least(0.7::double * y + 0.3::double * a, 0.999999::double), 1e-6::double) as p from base) select round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) as log_loss from p")
def b15_soft_target_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir).withColumn("s", 0.7 * F.col("y") + 0.3 * F.col("a"))
    return r6(screens.log_loss(df, "s"))


@query(
    f"""with {BASE}, {LONG}, e as (select id, sum(score) as t, count(*) as n from long group by id), w as (select model, y, round ((t - score) / (n - 1), 12) as s from long join e using (id) join base using (id)),
    whole as (select 'all' as model, y, round (t / n, 12) as s from e join base using (id)), {ranked_sql("without", "w")}, {ranked_sql("every", "whole")}
    select without.model, round(without.auc, 6) as auc_without, round(every.auc - without.auc, 6) as gain from without, every"""
)
def x15_marginal_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir)
    return r6(screens.marginal_gain(long_scores(df), df.select("id", "y")))


@query(f"with {FOLDED}, g as (select r0 + 1 as x, avg(price) as v from folded group by r0) select round(regr_slope(ln(v), ln(x)), 6) as slope, round(regr_intercept(ln(v), ln(x)), 6) as intercept, round(regr_r2(ln(v), ln(x)), 6) as r2 from g")
def x17_log_log_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = folded(spark, sf_dir).groupBy("r0").agg(F.avg("price").alias("v")).withColumn("x", F.col("r0") + 1)
    return r6(screens.log_log_slope(g, "x", "v"))


@query(f"with {BASE}, {LONG} select id, round(avg(score), 6) as score from long group by id")
def b17_member_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(long_scores(base(spark, sf_dir)).groupBy("id").agg(F.avg("score").alias("score")))
