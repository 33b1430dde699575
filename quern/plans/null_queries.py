"""Queries over a labelled table with nulls in label, keys and values: no row is lost, and each null has a defined result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import codes, encodings, folds, metrics, neighbours, pairs, profiles, screens, views
from quern.operators.ordered import hashed_place, midrank, quantiles
from quern.plans.base import BASE, base, query, r6
from quern.sources.tables import table


def holey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table with nulls at ids that numbers divide."""
    holes = {"y": 13, "pri": 7, "a": 11, "cust": 9}
    return base(spark, sf_dir).withColumns({c: F.when(F.col("id") % n != 0, F.col(c)) for c, n in holes.items()})


HOLEY = f"{BASE}, holey as (select id, case when id % 13 <> 0 then y end as y, case when id % 7 <> 0 then pri end as pri, case when id % 11 <> 0 then a end as a, case when id % 9 <> 0 then cust end as cust, price, b, r0, r1, day from base)"
_RANK = "case when a is not null then rank() over (partition by {0}a is null order by a) + (count(*) over (partition by {0}a) - 1) / 2.0::double end"


@query(f"with {HOLEY} select id, {_RANK.format('pri, ')} as r, case when a is not null then count(a) over (partition by pri) end as n from holey")
def nulls_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return midrank(holey(spark, sf_dir), "a", "r", ["pri"]).select("id", "r", F.col("r_of").alias("n"))


@query(f"with {HOLEY} select id, ((row_number() over (partition by y order by md5('holes:' || id), id) - 1) % 5)::int as fold from holey")
def nulls_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified(holey(spark, sf_dir), 5, "holes").select("id", "fold")


@query(f"with {HOLEY}, g as (select cust, count(*) as g_n, avg(a) as g_mean, stddev_samp(a) as g_sd, quantile_cont(a, 0.5) as g_median, max(a) - min(a) as g_range from holey group by cust) select id, g_n, round(g_mean, 6) as g_mean, round(g_sd, 6) as g_sd, round(g_median, 6) as g_median, round(g_range, 6) as g_range from holey h join g on h.cust is not distinct from g.cust")
def nulls_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(profiles.group_stats(holey(spark, sf_dir), "cust", "a").select("id", "g_n", "g_mean", "g_sd", "g_median", "g_range"))


@query(f"with {HOLEY} select id, round((coalesce(sum(y) over (partition by cust), 0) - coalesce(y, 0)) / nullif(count(y) over (partition by cust) - (y is not null)::int, 0)::double, 6) as loo from holey")
def nulls_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(profiles.leave_one_out(holey(spark, sf_dir), "cust").select("id", "loo"))


@query(f"with {HOLEY} select id, round(avg(a) over (partition by pri), 6) as mean_a_by_pri, round(a - avg(a) over (partition by pri), 6) as gap_a_by_pri from holey")
def nulls_key_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(views.key_means("pri", ["a"]).make(holey(spark, sf_dir)))


@query(f"with {HOLEY} select id, round({_RANK.format('')} / nullif(count(a) over (), 0), 6) as pct_a from holey")
def nulls_rank_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(views.rank_shares(["a"]).make(holey(spark, sf_dir)))


@query(
    f"""with {HOLEY}, n as (select y, a, count(*) as n from holey where y is not null and a is not null group by all), one as (
        select o.a, 1 as y, sum(case when z.a < o.a then z.n when z.a = o.a then z.n / 2.0::double else 0 end) / sum(z.n) as v from (select distinct a from n where y = 1) o, n z where z.y = 0 group by o.a
        union all select z.a, 0, sum(case when o.a > z.a then o.n when o.a = z.a then o.n / 2.0::double else 0 end) / sum(o.n) from (select distinct a from n where y = 0) z, n o where o.y = 1 group by z.a)
    select id, round(v, 6) as v from holey left join one using (a, y)"""
)
def nulls_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.placements(holey(spark, sf_dir), "a", "v").select("id", "v"))


@query(
    f"""with {HOLEY}, fit as (select pri, a, count(*) as n from holey where day < date '1996-01-01' and a is not null and pri is distinct from '5-LOW' group by all), v as (select distinct pri, a from holey where day >= date '1996-01-01' and a is not null),
    own as (select v.pri, v.a, sum(case when f.a < v.a then f.n when f.a = v.a then f.n / 2.0::double else 0 end) / sum(f.n) as cdf from v join fit f on f.pri is not distinct from v.pri group by v.pri, v.a),
    every as (select v.a, sum(case when f.a < v.a then f.n when f.a = v.a then f.n / 2.0::double else 0 end) / sum(f.n) as spare from (select distinct a from v) v, fit f group by v.a)
    select id, round(coalesce(cdf, spare), 6) as cdf from holey h left join own on own.pri is not distinct from h.pri and own.a = h.a left join every on every.a = h.a where day >= date '1996-01-01'"""
)
def nulls_segment_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that the fit side lacks fall back to all of it; a null segment is one."""
    df = holey(spark, sf_dir)
    fit = df.where("day < '1996-01-01'").where(~F.col("pri").eqNullSafe("5-LOW"))
    return r6(metrics.ecdf(fit, df.where("day >= '1996-01-01'"), "a", "cdf", ["pri"], spare=True).select("id", "cdf"))


@query(f"with {HOLEY} select pri, round(quantile_cont(a, 0.05), 6) as low, round(quantile_cont(a, 0.5), 6) as mid, round(quantile_cont(a, 0.9), 6) as high from holey group by pri")
def nulls_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(quantiles(holey(spark, sf_dir), "a", {"low": 0.05, "mid": 0.5, "high": 0.9}, ["pri"]))


@query(f"with {HOLEY}, k as (select cust, row_number() over (order by cust) - 1 as k from (select distinct cust from holey where cust is not null)) select id, coalesce(k, -1)::int as code from holey left join k using (cust)")
def nulls_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(holey(spark, sf_dir), "cust", "code").select("id", "code")


@query(f"with {HOLEY}, known as (select * from holey where y is not null and a is not null), n as (select y, a, count(*) as n from known group by all) select round(sum(case when o.a > z.a then o.n * z.n when o.a = z.a then o.n * z.n / 2.0::double else 0 end) / sum(o.n * z.n), 6) as auc, sum(o.n * z.n)::double as pairs from n o, n z where o.y = 1 and z.y = 0")
def nulls_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.auc(holey(spark, sf_dir), "a").select("auc", "pairs"))


@query(f"with {HOLEY}, k as (select {_RANK.format('')} as x, case when b is not null then rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0::double end as z from holey) select 'a' as a, 'b' as b, round(corr(x, z), 6) as r from k")
def nulls_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(profiles.correlations(holey(spark, sf_dir), ["a", "b"], ranks=True))


@query(
    f"""with {HOLEY}, f as (select *, (id % 5)::int as fold from holey), p as (select fold, ((select sum(y) from f) - coalesce(sum(y), 0)) / ((select count(y) from f) - count(y))::double as prior from f group by fold),
    s as (select *, coalesce(sum(y) over (partition by cust), 0) - coalesce(sum(y) over (partition by cust, fold), 0) as t, count(y) over (partition by cust) - count(y) over (partition by cust, fold) as n from f)
    select id, round(case when cust is null then prior else (t + 20 * prior) / (n + 20) end, 6) as te_20 from s join p using (fold)"""
)
def nulls_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null key gets the prior; a row without a label teaches nobody."""
    df = holey(spark, sf_dir).withColumn("fold", (F.col("id") % 5).cast("int"))
    return r6(encodings.crossfit(df, "cust", [20]).select("id", "te_20"))


@query(f"with {HOLEY}, ranked as (select id, {_RANK.format('')} as r, count(a) over () as n from holey) select id, (r > n * 0.95::double)::int as label from ranked where r > n * 0.95::double or r <= n * 0.05::double")
def nulls_confident_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.confident(holey(spark, sf_dir), "a", 0.05).select("id", "label")


@query(f"with {HOLEY} select pri as value, count(*) as n, round(avg(y), 6) as rate from holey group by pri")
def a2_rates_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(profiles.by_rate(holey(spark, sf_dir), "pri"))


@query(f"with {HOLEY}, m as (select quantile_cont(a, 0.5) as m from holey) select id, round(coalesce(a, m), 6) as a from holey, m")
def r8_median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(codes.median_filled(holey(spark, sf_dir), ["a"]).select("id", "a"))


_UNTAUGHT = f"""{HOLEY}, r as (select id, y, a, b, cust, r0 * 7776 + r1 as k, (row_number() over (order by md5('holes:' || id), id) - 1) % 3 as fold from holey),
    f as (select id, fold, k, case when fold = 2 then y end as y from r), cell as (select k, fold, sum(y) as t, count(y) as n from f group by all),
    own as (select fold, coalesce((select sum(y) from f x where x.fold <> g.fold), 0) as t, (select count(y) from f x where x.fold <> g.fold) as n from (select distinct fold from f) g),
    other as (select o.fold, k, coalesce(sum(c.t), 0) as t, coalesce(sum(c.n), 0) as n from own o join cell c on c.fold <> o.fold group by o.fold, k)"""


def untaught(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in three folds of which one alone has labels."""
    h = holey(spark, sf_dir).withColumn("one", F.lit(1))
    placed = hashed_place(h, ["one"], "holes").withColumn("fold", (F.col("place") % 3).cast("int"))
    return placed.withColumns({"y": F.when(F.col("fold") == 2, F.col("y")), "k": F.col("r0") * 7776 + F.col("r1")})


@query(f"with {_UNTAUGHT} select id, round(case when own.n > 0 then case when coalesce(x.n, 0) >= 1 then (x.t + 10 * own.t / own.n::double) / (x.n + 10) else own.t / own.n::double end end, 6) as te_10 from f join own using (fold) left join other x on x.fold = f.fold and x.k = f.k")
def nulls_crossfit_untaught(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds without a label are encoded by the one that has some; that one has nobody to learn from."""
    return r6(encodings.crossfit(untaught(spark, sf_dir), "k", [10], min_count=1).select("id", "te_10"))


@query(
    f"""with {_UNTAUGHT}, steps as (select distinct k, p, v, (k // [1, 6, 36, 216, 1296, 7776][p + 1]) % 6 as own from f, range(6) t(p), range(6) w(v)),
    near as (select k, k + (v - own) * [1, 6, 36, 216, 1296, 7776][p + 1] as near from steps where v <> own), sums as (select o.fold, near.k, sum(o.t) as t, sum(o.n) as n from near join other o on o.k = near.near where o.n >= 2 group by all)
    select id, round(case when own.n > 0 then (coalesce(s.t, 0) + 30 * own.t / own.n::double) / (coalesce(s.n, 0) + 30) end, 6) as te_near from f join own using (fold) left join sums s on s.fold = f.fold and s.k = f.k"""
)
def nulls_nearest_untaught(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(encodings.crossfit_nearest(untaught(spark, sf_dir), "k", 6, 6).select("id", "te_near"))


@query(f"with {HOLEY} select id, null::double as te_10, null::double as te_near from holey")
def nulls_one_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in one fold: nobody teaches."""
    df = holey(spark, sf_dir).withColumns({"fold": F.lit(0), "k": F.col("r0") * 7776 + F.col("r1")})
    near = encodings.crossfit_nearest(df, "k", 6, 6).select("id", "te_near")
    return encodings.crossfit(df, "k", [10]).select("id", "te_10").join(near, "id")


@query(
    """with v as (select vec_id as id, case when vec_id % 5 > 0 then embedding::double[] end as v from embeddings), d as (
        select q.id, r.id as ref, list_sum(list_transform(list_zip(q.v, r.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as d2 from v q join v r on q.id <> r.id where q.v is not null and r.v is not null)
    select id, ref, (row_number() over (partition by id order by d2, ref))::int as rank from d qualify rank <= 3"""
)
def nulls_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of null vectors have no neighbours and are none."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 5 > 0, F.col("embedding").cast("array<double>")).alias("v"))
    return neighbours.knn(v, v, 3).select("id", "ref", "rank")


@query(
    f"""with {HOLEY}, ones as (select id, a, b from holey where y = 1), grid as (select a, b, count(*) as n from holey where y = 0 and a is not null group by all), cells as (select distinct a, b from ones where a is not null), each as (
        select o.a, o.b, sum(case when z.a > o.a and z.b > o.b then n else 0 end)::bigint as both_scores, sum(case when z.a > o.a and z.b < o.b then n else 0 end)::bigint as a_only,
               sum(case when z.a < o.a and z.b > o.b then n else 0 end)::bigint as b_only from cells o cross join grid z group by o.a, o.b)
    select id, both_scores, a_only, b_only from ones left join each using (a, b)"""
)
def nulls_row_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row whose score is null stays, and has null burdens."""
    return pairs.burden(holey(spark, sf_dir), "a", "b")
