"""Queries on keys, scalars, profiles, audits, row sets and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import keys, scalars
from quern.operators import codes, neighbours, profiles, sampling
from quern.operators.ordered import lowest_mean, quantiles
from quern.plans.base import BASE, DIGITS, FOLDED, base, folded, query, r6, u_sql
from quern.sources import tables
from quern.sources.store import latest_status
from quern.sources.tables import table

_PROFILE = " union all ".join(
    f"select '{c}' as \"column\", sum(({c} is null)::int)::bigint as nulls, count(distinct {c}) as distinct_values, round(min({c})::double, 6) as low, round(max({c})::double, 6) as high, round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as sd, bool_and({c} = floor({c})) as whole from lineitem"
    for c in ("l_quantity", "l_discount", "l_partkey")
)


@query(_PROFILE)
def a11_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.columns(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_partkey"]).withColumnRenamed("distinct", "distinct_values")
    return r6(found.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("mean", "sd")}))


@query(f"with {BASE} select pri as value, count(*) as n, round(count(*) / (sum(count(*)) over ())::double, 6) as share from base group by pri")
def a3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(profiles.shares(base(spark, sf_dir), "pri"))


@query("with n as (select l_partkey, count(*) as n, row_number() over (order by count(*) desc, l_partkey) as k from lineitem group by l_partkey) select round(sum(case when k <= 1 then n else 0 end) / sum(n)::double, 6) as top_1, round(sum(case when k <= 10 then n else 0 end) / sum(n)::double, 6) as top_10 from n")
def a12_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(profiles.top_share(table(spark, sf_dir, "lineitem"), "l_partkey", [1, 10]))


@query("select l_returnflag, round(avg((l_linestatus = 'F')::int), 6) as \"share_F\", round(avg((l_linestatus = 'O')::int), 6) as \"share_O\" from lineitem group by l_returnflag")
def a4_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(profiles.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"]))


@query(f"with {BASE}, g as (select cust, count(*) as g_n, avg(a) as g_mean, stddev_samp(a) as g_sd, quantile_cont(a, 0.5) as g_median, max(a) - min(a) as g_range from base group by cust) select id, g_n, round(g_mean, 6) as g_mean, round(g_sd, 6) as g_sd, round(g_median, 6) as g_median, round(g_range, 6) as g_range from base join g using (cust)")
def a5_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups' figures are given to every row of the group; the reference's own version dropped or misplaced them."""
    return r6(profiles.group_stats(base(spark, sf_dir), "cust", "a").select("id", "g_n", "g_mean", "g_sd", "g_median", "g_range"))


_RATED = f"{BASE}, rated as (select id, [{', '.join(f'r{i}' for i in range(DIGITS))}] as a from base), given as (select id, a, list_sort(list_filter(a, lambda x: x > 0)) as g from rated)"


@query(
    f"""with {_RATED} select id, len(g)::bigint as r_n, round(list_avg(g), 6) as r_mean, list_min(g)::double as r_low, list_max(g)::double as r_high, round(list_stddev_pop(g), 6) as r_sd,
    len(list_distinct(a))::bigint as r_distinct, round(list_aggregate(g, 'quantile_cont', 0.75) - list_aggregate(g, 'quantile_cont', 0.25), 6) as r_iqr,
    round(list_avg(g[1:2]), 6) as r_low2, round(list_avg(g[greatest(len(g) - 1, 1):]), 6) as r_top2, len(list_filter(g, lambda x: x <= 2))::bigint as r_le2,
    {", ".join(f"len(list_filter(a, lambda x: x = {k}))::bigint as r_eq{k}" for k in range(6))} from given"""
)
def a8_rating_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``r_le2`` counts ratings of 1 and 2, as its name says; the reference's formula did not."""
    out = profiles.rating_features([F.col(f"r{i}") for i in range(DIGITS)])
    return r6(base(spark, sf_dir).select("id", *(v.alias(k) for k, v in out.items())))


@query(
    f"""with {BASE}, g as (select cust, count(*) as n, sum(y) as t from base group by cust), w as (select avg(y) as m from base)
    select count(*) as keys, round(quantile_cont(n, 0.5), 6) as median_n, round(quantile_cont(n, 0.9), 6) as p90_n, round(sum(case when n <= 5 then n else 0 end) / sum(n)::double, 6) as rows_in_small,
    round(sum(case when n >= 2 and (t = 0 or t = n) then n else 0 end) / sum(n)::double, 6) as rows_in_pure,
    round(sum(case when n >= 2 then (t - n * m) * (t - n * m) / (n * (m * (1 - m))) end) / greatest(sum(case when n >= 2 then 1 end) - 1, 1)::double, 6) as scatter from g, w"""
)
def a13_key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares are of rows, and pure means all of one label; the reference mixed rows with groups and tested for half."""
    return r6(profiles.key_report(base(spark, sf_dir), "cust"))


@query(f"with {BASE} select id, round((sum(y) over (partition by cust) - y) / nullif(count(*) over (partition by cust) - 1, 0)::double, 6) as loo from base")
def a15_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(profiles.leave_one_out(base(spark, sf_dir), "cust").select("id", "loo"))


@query("select is_duplicate, count(*) as n from (select count(*) over (partition by l_orderkey, l_linenumber) > 1 as is_duplicate from lineitem) group by 1")
def a16_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = keys.joined_key([F.col("l_orderkey"), F.col("l_linenumber")])
    return profiles.duplicates(table(spark, sf_dir, "lineitem"), key).groupBy("is_duplicate").agg(F.count("*").alias("n"))


@query(f"with {BASE} select round(quantile_cont(price, 0.05), 4) as p05, round(quantile_cont(price, 0.5), 4) as p50, round(quantile_cont(price, 0.95), 4) as p95, round((select avg(a) from (select a, row_number() over (order by a, id) as k, count(*) over () as n from base) where k <= floor(n * 0.05::double)), 6) as worst_5 from base")
def a17_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir)
    n = df.count()
    worst = lowest_mean(df, "a", int(n * 0.05), "worst_5")
    q = quantiles(df, "price", {"p05": 0.05, "p50": 0.5, "p95": 0.95}).select(*(F.round(F.col(k) + 1e-9, 4).alias(k) for k in ("p05", "p50", "p95")))
    return r6(q.withColumn("k", F.lit(1)).join(worst.withColumn("k", F.lit(1)), "k").drop("k"))


_CORR = " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({{0}}{a}, {{0}}{b}), 6) as r from {{1}}" for a, b in (("a", "b"), ("a", "price"), ("b", "price")))
_RANKED = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as k_{c}" for c in ("a", "b", "price"))


@query(f"with {BASE} " + _CORR.format("", "base"))
def a19_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(profiles.correlations(base(spark, sf_dir), ["a", "b", "price"]))


@query(f"with {BASE}, ranked as (select {_RANKED} from base) " + _CORR.format("k_", "ranked"))
def a20_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(profiles.correlations(base(spark, sf_dir), ["a", "b", "price"], ranks=True))


def _rung(name: str, cols: str) -> str:
    return f"""select '{name}' as key, round(avg((n is not null)::int), 6) as covered, round(avg(coalesce(n = 1, false)::int), 6) as "unique", round(avg(case when n = 1 then (t.m = x.y)::int end), 6) as agrees
    from (select * from base where day >= date '1998-01-01') x left join (select {cols}, count(*) as n, avg(y) as m from base where day < date '1998-01-01' group by {cols}) t using ({cols})"""


@query(f"with {BASE} {_rung('cust', 'cust')} union all {_rung('cust_pri', 'cust, pri')} union all {_rung('a_pri', 'a, pri')}")
def j4_key_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir)
    return r6(profiles.key_ladder(df.where("day >= '1998-01-01'"), df.where("day < '1998-01-01'"), {"cust": ["cust"], "cust_pri": ["cust", "pri"], "a_pri": ["a", "pri"]}))


def _unseen(c: str) -> str:
    return f"""select '{c}' as "column", count(n) as train_values, count(m) as test_values, sum((n is null)::int)::bigint as unseen_values, coalesce(sum(case when n is null then m end), 0)::bigint as unseen_rows
    from (select {c} as v, count(*) as n from base where day < date '1998-01-01' group by 1) l full join (select {c} as v, count(*) as m from base where day >= date '1998-01-01' group by 1) r using (v)"""


@query(f"with {BASE} " + " union all ".join(map(_unseen, ("cust", "price", "pri"))))
def m24_unseen_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir)
    parts = df.where("day < '1998-01-01'"), df.where("day >= '1998-01-01'")
    return profiles.unseen(*(p.select(*(F.col(c).cast("string").alias(c) for c in ("cust", "price", "pri"))) for p in parts), ["cust", "price", "pri"])


@query("select c_custkey, c_acctbal from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def r12_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(dear, "c_custkey", "left_semi").select("c_custkey", "c_acctbal")


@query("select c_custkey, c_acctbal from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def r13_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(dear, "c_custkey", "left_anti").select("c_custkey", "c_acctbal")


@query("with a as (select distinct l_partkey as k from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey as k from lineitem where l_returnflag = 'A') select (select count(*) from a) as left_n, (select count(*) from b) as right_n, (select count(*) from a where k in (select k from b)) as common, (select count(*) from a where k not in (select k from b)) as left_only")
def s4_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a set comparison from one aggregate over the union."""
    part = table(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'A')").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("l"), F.bool_or(F.col("l_returnflag") == "A").alias("r"))
    n = lambda c, name: F.count_if(c).alias(name)
    return part.agg(n(F.col("l"), "left_n"), n(F.col("r"), "right_n"), n(F.col("l") & F.col("r"), "common"), n(F.col("l") & ~F.col("r"), "left_only"))


@query(f"with {BASE} select segment, count(*) as n, round(avg(y), 6) as rate from (select y, unnest(list_filter([case when price < 100000 then 'cheap' end, case when price < 0 then 'none' end, case when r0 = r1 then 'twin' end, case when price > 1 then 'all' end], lambda x: x is not null)) as segment from base) where segment not in ('none', 'all') group by segment")
def r3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping segments; those of under 1 % or over 99 % of rows are left out."""
    masks = {"cheap": F.col("price") < 100000, "none": F.col("price") < 0, "twin": F.col("r0") == F.col("r1"), "all": F.col("price") > 1}
    out = profiles.segments(base(spark, sf_dir), masks, 0.01, 0.99)
    return r6(out.groupBy("segment").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("rate")))


@query("select event_id, try_cast(case when event_id % 3 = 0 then 'n/a' else value::varchar end as double) as number, round(least(greatest(coalesce(case when event_id % 3 <> 0 then value end, -999), 0), 50), 6) as clipped from events")
def r5_coerce_and_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    number = scalars.to_number(F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string")))
    out = e.select("event_id", number.alias("number"), F.round(scalars.clip(scalars.finite(number), 0.0, 50.0) + 1e-9, 6).alias("clipped"))
    return out


@query("with m as (select quantile_cont(nullif(l_quantity, 1), 0.5) as m from lineitem) select l_orderkey, l_linenumber, round(avg(coalesce(nullif(l_quantity, 1), m)), 6) as quantity, count(*) as n from lineitem, m group by 1, 2")
def r7_median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("q", F.nullif("l_quantity", F.lit(1.0)))
    return r6(codes.median_filled(li, ["q"]).groupBy("l_orderkey", "l_linenumber").agg(F.avg("q").alias("quantity"), F.count("*").alias("n")))


@query(f"with {BASE} select id, (dense_rank() over (order by pri) - 1)::int as code from base")
def k1_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(base(spark, sf_dir), "pri", "code").select("id", "code")


@query(f"with {BASE} select id, case when r0 = 0 then '__NA__' else r0::varchar end as exact, concat_ws(chr(31), coalesce(nullif(r0, 0)::varchar, '__NA__'), trim(pri)) as joined, '[\"' || r1 || '\",\"' || pri || '\"]' as json, (r0 + 6 * r1 + 36 * r2)::bigint as position from base")
def k3_key_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r0 = F.nullif("r0", F.lit(0))
    return base(spark, sf_dir).select(
        "id", keys.exact_label(r0.cast("double")).alias("exact"), keys.joined_key([r0, keys.category_label(F.col("pri"))]).alias("joined"),
        keys.json_key([F.col("r1"), F.col("pri")]).alias("json"), keys.positional([F.col(c) for c in ("r0", "r1", "r2")], 6).alias("position"),
    )


@query(f"with {BASE}, e as (select list_sort(list_distinct([quantile_cont(a, 0.25), quantile_cont(a, 0.5), quantile_cont(a, 0.75)])) as e from base) select id, len(list_filter(e, lambda x: a > x))::int as bin, floor(price / 250)::bigint as step, (price::bigint % 10)::int as digit from base, e".replace("(price::bigint % 10)", "(floor(price)::bigint % 10)"))
def k11_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir)
    edges = codes.quantile_edges(df, "a", 4)
    return df.select("id", keys.bin_of(F.col("a"), edges).alias("bin"), F.floor(F.col("price") / 250).alias("step"), (F.floor("price") % 10).cast("int").alias("digit"))


@query(f"with {BASE} select id, round(ln(greatest(least(a, 0.999999::double), 1e-6::double) / (1 - greatest(least(a, 0.999999::double), 1e-6::double))), 6) as z, round(1 / (1 + exp(-4 * a)), 6) as s, round(greatest(a - 0.5::double, 0), 6) as hinge, round(ln(1 + price), 6) as log_price from base")
def k16_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return r6(base(spark, sf_dir).select("id", scalars.logit(a).alias("z"), scalars.sigmoid(4 * a).alias("s"), scalars.hinges(a, (0.5,))[1].alias("hinge"), F.log1p("price").alias("log_price")))


@query(f"with {FOLDED}, s as (select avg(price) as m, stddev_pop(price) as d, avg(a) as am, stddev_pop(a) as ad from folded where fold <> 0) select id, round((price - m) / d, 6) as price, round((a - am) / ad, 6) as a from folded, s where fold = 0")
def k23_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded(spark, sf_dir)
    return r6(neighbours.standardised(df.where("fold <> 0"), df.where("fold = 0"), ["price", "a"]).select("id", "price", "a"))


@query("select p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as alias from part")
def k21_alias_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", keys.alias_name(F.col("p_name")).alias("alias"))


@query(f"with {BASE}, p as (select id, y, row_number() over (partition by y order by md5('draw:' || id), id) as k from base) select id, y from p where k <= 500")
def s5_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(base(spark, sf_dir), 500, "draw").select("id", "y")


@query(f"with {BASE} select id, round(-ln(1 - {u_sql(chr(39) + 'heavy:' + chr(39) + ' || id')}) / (r0 + 1), 6) as draw from base order by -ln(1 - {u_sql(chr(39) + 'heavy:' + chr(39) + ' || id')}) / (r0 + 1), id limit 300")
def s5_weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(sampling.weighted(base(spark, sf_dir).withColumn("w", F.col("r0") + 1), 300, "heavy", "w").select("id", "draw"))


@query(f"with {BASE}, d as (select y, draw::int as draw, case when {u_sql(chr(39) + 'split:' + chr(39) + ' || draw || ' + chr(39) + ':' + chr(39) + ' || id')} < 0.2::double then 'public' else 'private' end as part from base, range(4) r(draw)) select draw, part, count(*) as n, round(avg(y), 6) as rate from d group by draw, part")
def s8_partition_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampling.parts(base(spark, sf_dir), 4, 0.2, "split")
    return r6(drawn.groupBy("draw", "part").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("rate")))


@query(f"with {BASE} select id, 0::int as copy from base union all select id, 1 from base where {u_sql(chr(39) + 'twice:' + chr(39) + ' || id')} < 0.1::double")
def s9_repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.repeated(base(spark, sf_dir), 0.1, "twice").select("id", "copy")


@query(f"with {BASE} select 'score in 0..1' as rule, count(*) filter (not (a between 0 and 1)) as rows from base union all select 'id known', count(*) filter (id is null) from base union all select 'cheap', count(*) filter (not price < 100000) from base")
def io16_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"score in 0..1": F.col("a").between(0, 1), "id known": F.col("id").isNotNull(), "cheap": F.col("price") < 100000}
    return tables.violations(base(spark, sf_dir), rules)


@query("select user_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def io15_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return latest_status(e, "user_id", "at").select("user_id", "event_type", "ts")
