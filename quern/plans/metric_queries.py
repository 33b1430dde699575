"""Queries on ranking metrics, tests and pair accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import metrics, pairs, profiles, sampling
from quern.operators.ordered import midrank
from quern.plans.base import BASE, FOLDED, auc_sql, base, folded, query, r6, u_sql


@query(f"with {FOLDED}, {auc_sql('folded', 'a', 'fold')} select fold, round(good / pairs, 6) as auc, pairs - good as errors, pairs from auc")
def m1_auc_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.auc(folded(spark, sf_dir), "a", ["fold"]).select("fold", "auc", "errors", "pairs"))


@query(f"with {BASE}, weighed as (select *, 1 + r0 as w from base), {auc_sql('weighed', 'a', weight='w')} select round(good / pairs, 6) as auc, pairs from auc")
def m2_weighted_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.auc(base(spark, sf_dir), "a", weight=1 + F.col("r0")).select("auc", "pairs"))


@query(
    f"""with {FOLDED}, one as (select fold, avg(case when win > 0 then 1.0::double when win = 0 then 0.5::double else 0 end) as a_auc from (
        select p.fold, sign(p.a - q.a) as win from folded p join folded q on p.fold = q.fold where p.y = 1 and q.y = 0) group by fold),
    two as (select fold, avg(case when win > 0 then 1.0::double when win = 0 then 0.5::double else 0 end) as b_auc from (
        select p.fold, sign(p.b - q.b) as win from folded p join folded q on p.fold = q.fold where p.y = 1 and q.y = 0) group by fold)
    select fold, round(a_auc, 6) as a_auc, round(b_auc, 6) as b_auc, round(b_auc - a_auc, 6) as delta from one join two using (fold)"""
)
def m3_fold_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded(spark, sf_dir)
    one = metrics.auc(df, "a", ["fold"]).select("fold", F.col("auc").alias("a_auc"))
    two = metrics.auc(df, "b", ["fold"]).select("fold", F.col("auc").alias("b_auc"))
    return r6(one.join(two, "fold").withColumn("delta", F.col("b_auc") - F.col("a_auc")))


_SEGMENTS = """segmented as (
    select id, y, fold, a, unnest(list_filter([case when price < 100000 then 'cheap' end, case when price >= 300000 then 'dear' end, case when pri = '1-URGENT' then 'urgent' end, case when r0 = r1 then 'twin' end], lambda x: x is not null)) as segment
    from folded)"""


@query(f"with {FOLDED}, {_SEGMENTS}, {auc_sql('segmented', 'a', 'segment, fold')} select segment, fold, round(good / pairs, 6) as auc from auc")
def m4_segment_fold_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = {"cheap": F.col("price") < 100000, "dear": F.col("price") >= 300000, "urgent": F.col("pri") == "1-URGENT", "twin": F.col("r0") == F.col("r1")}
    return r6(metrics.auc(profiles.segments(folded(spark, sf_dir), masks), "a", ["segment", "fold"]).select("segment", "fold", "auc"))


def _placed(s: str) -> str:
    return f"""(select id, y, case when y = 1 then (coalesce(sum(1 - y) over (order by {s} range between unbounded preceding and current row), 0) - sum(1 - y) over (partition by {s}) / 2.0::double) / sum(1 - y) over ()
        else (sum(y) over () - sum(y) over (order by {s} range between unbounded preceding and current row) + sum(y) over (partition by {s}) / 2.0::double) / sum(y) over () end as v from base)"""


_TAIL = "(exp(-z * z / 2) / 2.5066282746310002::double * (t * (0.319381530::double + t * (-0.356563782::double + t * (1.781477937::double + t * (-1.821255978::double + t * 1.330274429::double))))))"


@query(
    f"""with {BASE}, va as {_placed("a")}, vb as {_placed("b")}, each as (
        select y, avg(va.v) as a, avg(vb.v) as b, var_samp(vb.v - va.v) / count(*) as v from va join vb using (id, y) group by y
    ), row as (
        select max(case when y = 1 then a end) as auc_a, max(case when y = 1 then b end) as auc_b, sqrt(sum(v)) as se from each
    ), tail as (
        select *, auc_b - auc_a as delta, (auc_b - auc_a) / se as z0, abs((auc_b - auc_a) / se) as z, 1 / (1 + 0.2316419::double * abs((auc_b - auc_a) / se)) as t from row)
    select round(auc_a, 6) as auc_a, round(auc_b, 6) as auc_b, round(delta, 6) as delta, round(se, 6) as se, round(delta - 1.959963984540054::double * se, 6) as low,
           round(delta + 1.959963984540054::double * se, 6) as high, round(case when z0 >= 0 then {_TAIL} else 1 - {_TAIL} end, 6) as p from tail"""
)
def m5_delong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.delong(base(spark, sf_dir), "a", "b"))


@query(
    f"""with {FOLDED}, {auc_sql("folded", "a", "fold")}, n as (select fold, sum(y)::double as p, sum(1 - y)::double as q from folded group by fold),
    x as (select fold, good / pairs as a, p, q from auc join n using (fold))
    select fold, round(sqrt((a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (q - 1) * (2 * a * a / (1 + a) - a * a)) / (p * q)), 6) as se from x"""
)
def m7_hanley_mcneil(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded(spark, sf_dir)
    n = df.groupBy("fold").agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("q"))
    both = metrics.auc(df, "a", ["fold"]).join(n, "fold")
    return r6(both.select("fold", metrics.hanley_mcneil(F.col("auc"), F.col("p"), F.col("q")).alias("se")))


@query(
    f"""with {BASE}, p as (select r0 as test, avg(y) / 10 as p from base group by r0), s as (
        select test, p, least(1.0::double, (count(*) over () - row_number() over (order by p, test) + 1) * p) as x from p)
    select test, round(p, 6) as p, round(max(x) over (order by p, test rows between unbounded preceding and current row), 6) as p_holm from s"""
)
def m9_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = base(spark, sf_dir).groupBy(F.col("r0").alias("test")).agg((F.avg(F.col("y").cast("double")) / 10).alias("p"))
    return r6(metrics.holm(tests, "p", "test"))


_AB = "sides as (select *, case when day < date '1996-01-01' then 1 else 0 end as early from base)"


@query(
    f"""with {BASE}, {_AB}, l as (select pri, count(*)::double / (select count(*) from sides where early = 1) as s from sides where early = 1 group by pri),
    r as (select pri, count(*)::double / (select count(*) from sides where early = 0) as s from sides where early = 0 group by pri)
    select round(sum(abs(coalesce(l.s, 0) - coalesce(r.s, 0))) / 2, 6) as tv from l full join r using (pri)"""
)
def m10_total_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir)
    return r6(metrics.total_variation(df.where("day < '1996-01-01'"), df.where("day >= '1996-01-01'"), "pri"))


@query(
    f"""with {BASE}, {_AB}, g as (
        select abs(sum(early) over (order by price range between unbounded preceding and current row) / (sum(early) over ())::double
                   - sum(1 - early) over (order by price range between unbounded preceding and current row) / (sum(1 - early) over ())::double) as gap from sides)
    select round(max(gap), 6) as ks from g"""
)
def m11_kolmogorov_smirnov(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = (F.col("day") < "1996-01-01").cast("int")
    return r6(metrics.ks(base(spark, sf_dir).withColumn("early", side), "price", "early"))


@query(
    f"""with {BASE}, grid as (select y, (round(a * 100, 0))::int as s from base), n as (select s, sum(y) as p, sum(1 - y) as q from grid group by s)
    select sum(case when abs(o.s - z.s) < 5 then o.p * z.q else 0 end)::bigint as near, sum(case when z.s - o.s >= 5 then o.p * z.q else 0 end)::bigint as confident_wrong
    from n o cross join n z""".replace("round(a * 100, 0)", "floor(a * 100 + 0.5::double)")
)
def m14_near_tie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.near_tie_counts(base(spark, sf_dir), "a", 0.05)


_JOINT = """grid as (select y, a, b, count(*) as n from base group by all), pairs as (
    select sign(o.a - z.a) as da, sign(o.b - z.b) as db, o.n * z.n as n from grid o cross join grid z where o.y = 1 and z.y = 0)"""


@query(
    f"""with {BASE}, {_JOINT}
    select sum(n * greatest(0, (db - da) / 2.0::double)) as rescue, sum(n * greatest(0, (da - db) / 2.0::double)) as damage,
           sum(case when da < 0 and db < 0 then n else 0 end)::bigint as both_wrong, sum(case when da < 0 and db > 0 then n else 0 end)::bigint as old_wrong,
           sum(case when da > 0 and db < 0 then n else 0 end)::bigint as new_wrong, round(sum(n * (greatest(da, db) + 1) / 2.0::double) / sum(n), 6) as oracle_auc
    from pairs"""
)
def m15_rescue_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all pairs of the table: the SQL joins distinct score pairs, the Spark plan none."""
    return r6(pairs.rescue_damage(base(spark, sf_dir), "a", "b"))


@query(
    f"""with {BASE}, grid as (select y, a, b, count(*) as n from base where y = 0 group by all), ones as (select distinct a, b from base where y = 1), each as (
        select o.a, o.b, sum(case when z.a > o.a and z.b > o.b then n else 0 end)::bigint as both_scores, sum(case when z.a > o.a and z.b < o.b then n else 0 end)::bigint as a_only,
               sum(case when z.a < o.a and z.b > o.b then n else 0 end)::bigint as b_only from ones o cross join grid z group by o.a, o.b)
    select id, both_scores, a_only, b_only from base join each using (a, b) where y = 1"""
)
def m16_row_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.burden(base(spark, sf_dir), "a", "b")


@query(
    f"""with {BASE}, ranked as (select y, a, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0::double as r, count(*) over () as n from base),
    placed as (select y, a, least(floor((r - 1) * 8 / n), 7)::int as bucket from ranked), {auc_sql("placed", "a", "bucket")},
    whole as (select sum(o.n * z.n * case when o.a < z.a then 1 when o.a = z.a then 0.5::double else 0 end) as e from (select a, count(*) as n from base where y = 1 group by a) o, (select a, count(*) as n from base where y = 0 group by a) z)
    select bucket, count(*) as n, sum(y)::bigint as ones, round(max(good / pairs), 6) as auc, round(max((pairs - good) / e), 6) as error_share from placed join auc using (bucket), whole group by bucket"""
)
def m19_bucketed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(pairs.bucketed_errors(base(spark, sf_dir), "a", 8))


_P = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
_TIMES = " + ".join(f"(case when u >= {p!r}::double then 1 else 0 end)" for p in _P)


@query(
    f"""with {BASE}, drawn as (
        select draw, y, a, {u_sql("'boot:' || draw || ':' || id")} as u from base, range(5) d(draw)
    ), timed as (
        select draw::int as draw, y, a, {_TIMES} as w from drawn), {auc_sql("timed", "a", "draw", "w")} select draw, round(good / pairs, 6) as auc from auc"""
)
def m8_bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampling.bootstrap(base(spark, sf_dir), 5, "boot")
    return r6(metrics.auc(drawn, "a", ["draw"], F.col("times")).select("draw", "auc"))


@query(
    f"""with {BASE}, fit as (select a, count(*) as n from base where day < date '1996-01-01' group by a), t as (select sum(n) as n from fit),
    v as (select distinct a from base where day >= date '1996-01-01'),
    e as (select v.a, (coalesce(sum(case when f.a < v.a then f.n end), 0) + coalesce(sum(case when f.a = v.a then f.n end), 0) / 2.0::double) / max(t.n) as cdf from v cross join fit f cross join t group by v.a)
    select id, round(cdf, 6) as cdf from base join e using (a) where day >= date '1996-01-01'"""
)
def w6_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir)
    return r6(metrics.ecdf(df.where("day < '1996-01-01'"), df.where("day >= '1996-01-01'"), "a", "cdf").select("id", "cdf"))


@query(
    f"""with {BASE}, fit as (select pri, a, count(*) as n from base where day < date '1996-01-01' group by all), v as (select distinct pri, a from base where day >= date '1996-01-01'),
    e as (select v.pri, v.a, (coalesce(sum(case when f.a < v.a then f.n end), 0) + coalesce(sum(case when f.a = v.a then f.n end), 0) / 2.0::double) / sum(f.n) as cdf from v join fit f on f.pri = v.pri group by v.pri, v.a)
    select id, round(cdf, 6) as cdf from base join e using (pri, a) where day >= date '1996-01-01'"""
)
def w7_segment_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir)
    return r6(metrics.ecdf(df.where("day < '1996-01-01'"), df.where("day >= '1996-01-01'"), "a", "cdf", ["pri"]).select("id", "cdf"))


@query(f"with {BASE} select id, rank() over (partition by pri order by a) + (count(*) over (partition by pri, a) - 1) / 2.0::double as r, round((rank() over (partition by pri order by a) + (count(*) over (partition by pri, a) - 1) / 2.0::double) / count(*) over (partition by pri), 6) as pct from base")
def w4_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = midrank(base(spark, sf_dir), "a", "r", ["pri"])
    return r6(ranked.select("id", "r", (F.col("r") / F.col("r_of")).alias("pct")))


@query(f"with {BASE}, best as (select cust, id, a, row_number() over (partition by cust order by a desc, id) as k from base) select cust, id, a from best where k = 1")
def w12_best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of the highest score of each key, as an aggregate: no group is sorted."""
    top = F.max_by(F.struct("id", "a"), F.struct(F.col("a"), -F.col("id"))).alias("top")
    return base(spark, sf_dir).groupBy("cust").agg(top).select("cust", "top.id", "top.a")


@query(f"with {BASE} select id, round(avg(a) over (partition by cust), 6) as mean_a, count(*) over (partition by cust) as n from base")
def w1_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("cust")
    return r6(base(spark, sf_dir).select("id", F.avg("a").over(w).alias("mean_a"), F.count("*").over(w).alias("n")))


@query(
    f"""with {FOLDED}, g as (select cust, avg(case when fold < 2 then y - a end) as l, avg(case when fold >= 2 then y - a end) as r from folded group by cust)
    select count(*) as groups, round(corr(l, r), 6) as r, round(avg((sign(round(l, 9)) = sign(round(r, 9)))::int), 6) as same_sign from g where l is not null and r is not null"""
)
def m27_residual_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded(spark, sf_dir).withColumn("side", (F.col("fold") >= 2).cast("int"))
    return r6(profiles.residual_bias(df, "a", "cust", "side"))
