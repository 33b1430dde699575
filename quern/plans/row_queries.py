"""Queries on row sets, keys, scalars, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import keys, scalars
from quern.operators import blending, folds, metrics, neighbours, profiles, sampling, screens, views
from quern.operators.ordered import before, mid_percentile, numbered
from quern.plans.base import BASE, FOLDED, auc_sql, base, folded, query, r6, u_sql
from quern.plans.blend_queries import LONG, _LOGIT, _RANK, long_scores
from quern.sources import tables
from quern.sources.tables import table


@query("select p_brand as brand, p_partkey as id, p_name as name from part")
def r1_select_and_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return tables.require_columns(p.withColumnsRenamed({"p_partkey": "id", "p_name": "name", "p_brand": "brand"}), ["brand", "id", "name"])


@query("select event_id, coalesce(case when event_id % 3 <> 0 then value end, -1) as value from events")
def r6_fill_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return e.na.fill({"value": -1.0}).select("event_id", "value")


@query("select event_id, case event_id % 4 when 0 then -999 when 1 then 1e9 when 2 then -1e9 else value end as value from events")
def r9_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id") % 4
    odd = F.when(at == 0, float("nan")).when(at == 1, float("inf")).when(at == 2, float("-inf")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", scalars.finite(odd).alias("value"))


@query(f"with {BASE}, placed as (select id, y, row_number() over (order by id) - 1 as place from base), picks as (select distinct l_linenumber * 7 as place from lineitem) select id, y from placed where place in (select place from picks)")
def r11_rows_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at positions of another table, in the order of ids."""
    df = base(spark, sf_dir)
    picks = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 7).cast("bigint").alias("place")).distinct()
    return df.join(numbered(df.select("id"), "id", "place"), "id").join(picks, "place", "left_semi").select("id", "y")


_SETS = "a as (select distinct l_suppkey as k from lineitem where l_quantity > 45), b as (select distinct l_suppkey as k from lineitem where l_discount > 0.08)"


@query(f"with {_SETS} select 'both' as part, k from a where k in (select k from b) union all select 'left', k from a where k not in (select k from b) union all select 'right', k from b where k not in (select k from a)")
def r14_set_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and both differences of two sets of keys, from one grouping."""
    li = table(spark, sf_dir, "lineitem")
    sides = li.groupBy(F.col("l_suppkey").alias("k")).agg(F.bool_or(F.col("l_quantity") > 45).alias("a"), F.bool_or(F.col("l_discount") > 0.08).alias("b"))
    return sides.where("a or b").select(F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "left").otherwise("right").alias("part"), "k")


@query(f"with {BASE} select id, a as score from base where r0 > 2")
def r16_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir)
    return tables.aligned(df.where("r0 > 2"), df.select("id", F.col("a").alias("score")))


@query("select c_custkey as id, c_acctbal as amount, c_mktsegment as segment from customer")
def r17_resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of another schema found by aliases in any spelling."""
    c = table(spark, sf_dir, "customer")
    found = keys.resolved(c.columns, {"id": ["C CustKey", "c_custkey"], "amount": ["C-AcctBal"], "segment": ["C_MKTSEGMENT"]})
    return c.select(*(F.col(v).alias(k) for k, v in found.items()))


@query(f"with {FOLDED} select id, case fold when 0 then a when 1 then b else -1 end as v from folded")
def r18_scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded(spark, sf_dir)
    parts = [df.where("fold = 0").select("id", F.col("a").alias("v")), df.where("fold = 1").select("id", F.col("b").alias("v"))]
    return tables.scattered(df.select("id"), parts, "v", -1.0)


@query(f"with {BASE}, o as (select distinct cust, pri, r0 from base where day < date '1996-01-01'), n as (select b.cust, b.pri, b.r0, o.cust is not null as m from (select * from base where day >= date '1996-01-01') b left join o on b.cust = o.cust and b.pri = o.pri and b.r0 = o.r0) select count(*) as rows, count(*) filter (m) as matched, round(avg(m::int), 6) as rate from n")
def j3_exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir)
    return r6(profiles.exact_matches(df.where("day >= '1996-01-01'"), df.where("day < '1996-01-01'"), ["cust", "pri", "r0"]))


@query("select 'customer' as side, c_custkey as id, c_acctbal as amount from customer union all select 'supplier', s_suppkey, s_acctbal from supplier")
def j10_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, p: table(spark, sf_dir, name).select(F.lit(name).alias("side"), F.col(f"{p}_{'cust' if p == 'c' else 'supp'}key").alias("id"), F.col(f"{p}_acctbal").alias("amount"))
    return one("customer", "c").unionByName(one("supplier", "s"))


@query(f"with {BASE} select id, round((r0 + r1 + r2) / 3, 6) as mean_low, round((r3 + r4) / 2, 6) as mean_high from base")
def a9_subset_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(base(spark, sf_dir).select("id", *(e.alias(k) for k, e in profiles.subset_means({"low": ["r0", "r1", "r2"], "high": ["r3", "r4"]}).items())))


@query(
    f"""with {BASE}, g as (select y, avg(y) over (partition by cust) as rate, (sum(y) over (partition by cust) - y) / nullif(count(*) over (partition by cust) - 1, 0)::double as loo from base),
    one as (select y, round(rate, 9) as s, count(*) as n from g group by 1, 2), two as (select y, round(loo, 9) as s, count(*) as n from g where loo is not null group by 1, 2)
    select (select round(sum(o.n * z.n * case when o.s > z.s then 1 when o.s = z.s then 0.5::double else 0 end) / sum(o.n * z.n), 6) from one o, one z where o.y = 1 and z.y = 0) as rate_auc,
           (select round(sum(o.n * z.n * case when o.s > z.s then 1 when o.s = z.s then 0.5::double else 0 end) / sum(o.n * z.n), 6) from two o, two z where o.y = 1 and z.y = 0) as loo_auc"""
)
def a14_group_rate_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(profiles.group_rate_auc(base(spark, sf_dir), "cust"))


@query(f"with {BASE}, q as (select quantile_cont(price, 0.95) as p, quantile_cont(a, 0.95) as a from base) select id, price > q.p as above_price, base.a > q.a as above_a from base, q")
def a18_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.thresholds(base(spark, sf_dir), ["price", "a"], 0.95).select("id", "above_price", "above_a")


@query(f"with {BASE} select r0, floor(price / 50000)::bigint as step, count(*) as n, round(avg(y), 6) as rate from base group by 1, 2")
def m25_rate_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir).withColumn("step", F.floor(F.col("price") / 50000))
    return r6(profiles.rate_surface(df, ["r0", "step"]))


@query(f"with {FOLDED}, {auc_sql('folded', 'b', 'fold')} select fold, pairs - good as errors, pairs from auc")
def m12_error_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(folded(spark, sf_dir), "b", ["fold"]).select("fold", "errors", "pairs")


@query(f"with {BASE} select id, round((rank() over (partition by pri order by a) + (count(*) over (partition by pri, a) - 1) / 2.0::double - 0.5::double) / count(*) over (partition by pri), 6) as mid from base")
def w5_mid_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(mid_percentile(base(spark, sf_dir), "a", "mid", ["pri"]).select("id", "mid"))


@query(f"with {BASE} select pri, a, count(*) as n, sum(count(*)) over (partition by pri order by a rows unbounded preceding)::bigint as upto from base group by pri, a")
def w8_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = before(base(spark, sf_dir), "a", {"n": F.lit(1)}, ["pri"])
    return found.select("pri", "a", "n", (F.col("n_before") + F.col("n")).alias("upto"))


@query(f"with {BASE} select price, row_number() over (order by price) - 1 as place from (select distinct price from base)")
def s1_sorted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct value's place in sorted order, without a sort in one task."""
    return numbered(base(spark, sf_dir).select("price").distinct(), "price", "place")


@query(
    f"""with {BASE}, placed as (select id, y, row_number() over (partition by y order by md5('class:' || id), id) - 1 as place, count(*) over (partition by y) as n from base),
    slots as (select draw::int as draw, y, floor({u_sql("'class:' || draw || ':' || id")} * n)::bigint as place from placed, range(3) r(draw)), times as (select draw, y, place, count(*) as times from slots group by all)
    select draw, id, times from times join placed using (y, place)"""
)
def s7_class_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.class_bootstrap(base(spark, sf_dir), 3, "class").select("draw", "id", "times")


@query(
    f"with {BASE} select id, md5(concat_ws(chr(31), (floor(a * 100) / 100)::varchar, r0::varchar, coalesce(nullif(pri, '5-LOW'), '__NA__'))) as digest, coalesce(trim(nullif(pri, '5-LOW')), '__NA__') as category, r0 || '|' || pri as piped, "
    "'[\"' || r0 || '\",\"' || pri || '\"]' as json, (r0 + 6 * r1 + 36 * r2 + 216 * r3)::bigint as base6, (r0 + 8 * r1 + 64 * r2)::bigint as base8 from base"
)
def k2_digests_and_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pri = F.nullif("pri", F.lit("5-LOW"))
    whole = F.floor(F.col("a") * 100) / 100
    cols = lambda n: [F.col(f"r{i}") for i in range(n)]
    return base(spark, sf_dir).select(
        "id", F.md5(keys.joined_key([F.round(whole, 6), F.col("r0"), pri])).alias("digest"), keys.category_label(pri).alias("category"), keys.joined_key([F.col("r0"), F.col("pri")], "|").alias("piped"),
        keys.json_key([F.col("r0"), F.col("pri")]).alias("json"), keys.positional(cols(4), 6).alias("base6"), keys.positional(cols(3), 8).alias("base8"),
    )


@query("select md5(concat_ws(chr(31), p_size::varchar, p_brand)) as digest, count(*) as n from part group by 1")
def k2_row_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.md5(keys.joined_key([F.col("p_size"), F.col("p_brand")])).alias("digest")).agg(F.count("*").alias("n"))


@query(f"with {BASE} select id, case when price <= 1000 then 0 when price <= 100000 then 1 when price <= 250000 then 2 else 3 end::int as bin from base")
def k12_open_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", keys.bin_of(F.col("price"), [1000, 100000, 250000]).alias("bin"))


@query("select p_partkey, ceil(length(p_size::varchar || p_partkey::varchar) / 2)::int as tokens, substr(p_size::varchar || p_partkey::varchar, 1, 2) as first_token, substr(p_size::varchar || p_partkey::varchar, ((ceil(length(p_size::varchar || p_partkey::varchar) / 2) - 1) * 2 + 1)::int, 2) || '_' || length(p_size::varchar || p_partkey::varchar) as last_token from part")
def k14_number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed pieces of two digits stand for the pieces of a trained vocabulary, which tokenizers here are not to be."""
    number = F.concat(F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).cast("bigint")
    return table(spark, sf_dir, "part").select("p_partkey", *(e.alias(k) for k, e in keys.number_tokens(number).items()))


@query(f"with {BASE}, d as (select id, coalesce(nullif(a, 0.5::double), 0) as x, b as z, greatest(price / 1000, 1) as u from base) select id, round(x + z, 6) as dom_total, round(z - x, 6) as dom_gap, (x = 0 and z = 0)::int as dom_both_zero, round(ln(1 + x), 6) as dom_log_a, round(ln(1 + z), 6) as dom_log_b, round((x + z) / u, 6) as dom_per_unit from d")
def k17_domain_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir).withColumn("a", F.nullif("a", F.lit(0.5)))
    return r6(views.domain("a", "b", "price").make(df))


@query(f"with {BASE} select id, r0 - r1 as gap_r0_r1, r0 + r1 as sum_r0_r1, r2 - r3 as gap_r2_r3, r2 + r3 as sum_r2_r3 from base")
def k18_rating_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.gaps([("r0", "r1"), ("r2", "r3")]).make(base(spark, sf_dir))


@query(f"with {BASE}, k as (select id, r0, nullif(r1, 3) as r1, (dense_rank() over (order by pri) - 1)::int as code from base) select id, code * r0 as ix_pri_r0, code * coalesce(r1, -1) as ix_pri_r1 from k")
def k20_code_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir).withColumn("r1", F.nullif("r1", F.lit(3)))
    return views.code_products([("pri", "r0"), ("pri", "r1")]).make(df)


@query(f"with {BASE} select id, (pri = '1-URGENT')::int as urgent, (pri = '2-HIGH')::int as high, (r0 is not null and r0 = 0)::int as none from base")
def k22_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = keys.one_hot(F.col("pri"), ["1-URGENT", "2-HIGH"]) + keys.one_hot(F.col("r0"), [0])
    return base(spark, sf_dir).select("id", *(h.alias(n) for h, n in zip(hot, ("urgent", "high", "none"), strict=True)))


@query(f"with {BASE} select id, a as h0, round(greatest(a - 0.25::double, 0), 6) as h1, round(greatest(a - 0.75::double, 0), 6) as h2 from base")
def k25_hinges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir).select("id", *(h.alias(f"h{i}") for i, h in enumerate(scalars.hinges(F.col("a"), (0.25, 0.75)))))
    return df.select("id", "h0", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("h1", "h2")))


@query("select o_orderkey as id, case o_orderstatus when 'F' then 1 when 'O' then 0 end::int as label from orders")
def k26_binary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), scalars.binary_label(F.concat(F.lit(" "), F.col("o_orderstatus")), ("f",), ("o",)).alias("label"))


@query(f"with {BASE}, s as (select pri, avg(price) as m, stddev_pop(price) as d from base group by pri) select id, round((price - (select avg(price) from base)) / (select stddev_pop(price) from base), 6) as v0, (pri = '1-URGENT')::int::double as v1, (pri = '5-LOW')::int::double as v5 from base")
def t31_metric_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers standardised and categories one-hot, as a vector; a constant column has no place in it."""
    df = base(spark, sf_dir).withColumn("same", F.lit(7.0))
    v = neighbours.metric_space(df, df, ["price", "same"], ["pri"])
    return r6(v.select("id", F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1"), F.col("v")[5].alias("v5")))


@query(f"with {BASE}, {LONG} select id, model, score as prob, round({_LOGIT.format('score')}, 6) as logit, round({_RANK}, 6) as rank from long")
def b1_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = long_scores(base(spark, sf_dir))
    scaled = [blending.transformed(long, how).withColumnRenamed("score", how) for how in ("prob", "logit", "rank")]
    return r6(scaled[0].join(scaled[1], ["id", "model"]).join(scaled[2], ["id", "model"]).select("id", "model", "prob", "logit", "rank"))


@query(f"with {BASE}, {LONG}, ranked as (select id, model, {_RANK} as r from long) select id, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 6) as iqr from ranked group by id")
def m26_interquartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(blending.dispersion(long_scores(base(spark, sf_dir))).select("id", "iqr"))


@query(f"with {BASE}, {LONG}, ranked as (select id, model, {_RANK} as r from long), f as (select id, case model when 'c' then 'y' else 'x' end as f, avg(r) as m from ranked group by all) select id, round(max(m) - min(m), 6) as family_spread from f group by id")
def m26_family_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(blending.family_spread(long_scores(base(spark, sf_dir)), {"a": "x", "b": "x", "c": "y"}))


@query(
    f"""with {BASE}, {LONG}, c as (select id, model, greatest(least(score, 0.999999::double), 1e-6::double) as s, score from long)
    select id, round(1 / (1 + exp(-avg(ln(s / (1 - s))))), 6) as logit_mean, round(avg(score), 6) as prob_mean, round(exp(avg(ln(s))), 6) as geometric, round(quantile_cont(score, 0.5), 6) as median,
           round(arg_max(score, (abs(score - 0.5::double), model)), 6) as extreme from c group by id"""
)
def b9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = long_scores(base(spark, sf_dir))
    names = {"logit": "logit_mean", "prob": "prob_mean", "geometric": "geometric", "median": "median", "extreme": "extreme"}
    out = base(spark, sf_dir).select("id")
    for rule, name in names.items():
        out = out.join(blending.combined(long, rule).withColumnRenamed("score", name), "id")
    return r6(out)


@query(
    f"""with {FOLDED}, {LONG}, fit as (select long.*, fold from long join folded using (id)), v as (select distinct model, score from fit where fold = 0),
    cdf as (select v.model, v.score, sum(case when f.score < v.score then f.n when f.score = v.score then f.n / 2.0::double else 0 end) / sum(f.n) as c from v join (select model, score, count(*) as n from fit where fold <> 0 group by all) f using (model) group by v.model, v.score)
    select id, round(avg(c), 6) as score from fit join cdf using (model, score) where fold = 0 group by id"""
)
def b9_fit_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of one fold by their place among the scores of the others."""
    df = folded(spark, sf_dir)
    long = long_scores(df)
    inside = df.where("fold <> 0").select("id")
    return r6(blending.combined(long.join(inside, "id", "left_anti"), "cdf", long.join(inside, "id", "left_semi")))


@query(f"with {BASE}, {LONG}, k as (select long.id, pri, model, score from long join base using (id)), p as (select id, (rank() over (partition by model, pri order by score) + (count(*) over (partition by model, pri, score) - 1) / 2.0::double - 0.5::double) / count(*) over (partition by model, pri) as p from k) select id, round(exp(avg(ln(p))), 6) as score from p group by id")
def b10_rank_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir)
    return r6(blending.rank_geometry(long_scores(df), df, "pri"))


@query("select p_size, round(0.5::double + p_size / 250.0::double, 6) as back from (select distinct p_size from part)")
def m21_inverse_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise ceiling of a true AUC, turned back into it by bisection."""
    sizes = sorted(r[0] for r in table(spark, sf_dir, "part").select("p_size").distinct().collect())  # 50 sizes in all
    seen = lambda x: 0.27 / 0.34 * (1 - 0.03 / 0.66) * x + (1 - 0.27 / 0.34) * 0.03 / 0.66 * (1 - x) + (0.27 / 0.34 * 0.03 / 0.66 + (1 - 0.27 / 0.34) * (1 - 0.03 / 0.66)) / 2
    rows = [(s, screens.clean_auc(seen(0.5 + s / 250.0), 0.1, 0.3)) for s in sizes]
    return r6(spark.createDataFrame(rows, "p_size int, back double"))


@query(f"with {FOLDED}, other as (select id, floor({u_sql("'other:' || id")} * 5)::int as fold from folded) select f.fold, count(*) filter (o.fold = f.fold) as shared, 0::bigint as within from folded f join other o using (id) group by f.fold")
def v8_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that each fold shares with the same fold of another scheme, and with the next fold of its own: none."""
    df = folded(spark, sf_dir).select("id", "fold")
    other = df.select("id", folds.hashed(5, "other").alias("fold"))
    part = lambda d, k: d.where(F.col("fold") == k)
    rows = [(k, folds.overlap(part(df, k), part(other, k)), folds.overlap(part(df, k), part(df, (k + 1) % 5))) for k in range(5)]
    return spark.createDataFrame(rows, "fold int, shared long, within long")
