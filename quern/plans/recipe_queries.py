"""Queries on key recipes, enrichment, compact views, and further fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.keys import joined_key
from quern.operators import encodings, folds, gates, models, views
from quern.operators.metrics import auc
from quern.plans.base import BASE, ES, FOLDED, auc_sql, base, folded, query, r6
from quern.plans.blend_queries import _COLUMNS, _features, long_scores
from quern.plans.encoding_queries import _CUT
from quern.sources.scratch import stored

_RATINGS = ["r0", "r1", "r2"]


def _te(key: str, n: str = "20") -> str:
    """Cross-fitted mean label of a key over ``folded`` as one expression; ``p0`` is the prior of the other folds."""
    t = f"(sum(y) over (partition by {key}) - sum(y) over (partition by {key}, fold))"
    c = f"(count(*) over (partition by {key}) - count(*) over (partition by {key}, fold))"
    return f"({t} + {n} * p0) / ({c} + {n})"


_PRIOR = "tot as (select sum(y) as t, count(*) as n from folded), pri0 as (select fold, ((select t from tot) - sum(y)) / ((select n from tot) - count(*))::double as p0 from folded group by fold), f as (select * from folded join pri0 using (fold))"
_DEFAULT = {
    "cust": "cust", "pri": "pri", "r0": "r0", "r1": "r1", "cust_pri": "cust, pri", "cust_r0": "cust, r0", "pri_r0_all": "pri, r0", "price_bin500": "floor(price / 500)",
    "price_bin1000": "floor(price / 1000)", "price_m1000": "floor(price)::bigint % 1000", "price_bin1000_pri": "floor(price / 1000), pri",
}


@query(f"with {FOLDED}, {_PRIOR} select id, " + ", ".join(f"round({_te(v)}, 6) as te_{k}" for k, v in _DEFAULT.items()) + " from f")
def t4_default_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = encodings.default_keys("cust", ["pri", "r0"], "price", ["r1"])
    return r6(encodings.encoded_keys(folded(spark, sf_dir), keys))


@query(
    f"with {ES}, tot as (select sum(y) as t, count(*) as n from es where not is_es), pri0 as (select fold, ((select t from tot) - sum(y)) / ((select n from tot) - count(*))::double as p0 from es where not is_es group by fold), "
    "f as (select *, case when is_es then 0 else y end as ty, case when is_es then 0 else 1 end as tn from es join pri0 using (fold)) select id, "
    + ", ".join(f"round((sum(ty) over (partition by {r}, pri) - sum(ty) over (partition by {r}, pri, fold) + 20 * p0) / (sum(tn) over (partition by {r}, pri) - sum(tn) over (partition by {r}, pri, fold) + 20), 6) as ord_{r}" for r in _RATINGS)
    + " from f"
)
def t9_conditional_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rating within its segment; rows that stop a fit early teach nobody."""
    df = folds.early_stop(folded(spark, sf_dir), 0.1, "stop")
    return r6(encodings.conditional_ordinal(df, _RATINGS, "pri", source=~F.col("is_es")))


@query(f"with {FOLDED}, {_PRIOR} select id, round({_te('r0, r1, r2, r3, pri', '10')}, 6) as te_10 from f")
def t10_tuple_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ratings and the category as one key."""
    df = folded(spark, sf_dir).withColumn("k", joined_key([F.col(c) for c in ("r0", "r1", "r2", "r3", "pri")]))
    return r6(encodings.crossfit(df, "k", [10]).select("id", "te_10"))


@query(
    f"with {FOLDED}, {_PRIOR}, te as (select fold, y, {_te('r0, r1', '10')} as te_10, {_te('r0, r1', '100')} as te_100 from f), long as (select fold, y, unnest(['te_10', 'te_100']) as smooth, round(unnest([te_10, te_100]), 9) as s from te), "
    + auc_sql("long", "s", "smooth, fold")
    + " select smooth, fold, round(good / pairs, 6) as auc from auc"
)
def t11_auc_by_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's AUC in each fold, at two smoothings."""
    df = folded(spark, sf_dir).withColumn("k", joined_key([F.col("r0"), F.col("r1")]))
    te = encodings.crossfit(df, "k", [10, 100])
    long = te.select("fold", "y", F.inline(F.array(*(F.struct(F.lit(c).alias("smooth"), F.round(c, 9).alias("s")) for c in ("te_10", "te_100")))))
    return r6(auc(long, "s", ["smooth", "fold"]).select("smooth", "fold", "auc"))


_SPECS = encodings.combinations_of(["r0", "r1", "pri"], [2, 3])


@query(
    f"with {BASE}, o as (select * from base where day < date '{_CUT}'), p as (select avg(y) as prior from o), "
    + ", ".join(f"k{i} as (select {', '.join(s)}, sum(y) as t, count(*) as n from o group by all having count(*) >= 3)" for i, s in enumerate(_SPECS))
    + " select id, "
    + ", ".join(f"round(coalesce((k{i}.t + 30 * prior) / (k{i}.n + 30), prior), 6) as ext_{'_'.join(s)}, round(ln(1 + coalesce(k{i}.n, 0)), 6) as ext_{'_'.join(s)}_log_n" for i, s in enumerate(_SPECS))
    + " from base "
    + " ".join(f"left join k{i} using ({', '.join(s)})" for i, s in enumerate(_SPECS))
    + f", p where day >= date '{_CUT}'"
)
def t16_pair_and_triple_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs and triples of three keys, looked up in another table; keys of under three rows there are not used."""
    df = base(spark, sf_dir)
    out = encodings.external(df.where(F.col("day") >= _CUT), df.where(F.col("day") < _CUT), _SPECS, 30.0, 3)
    return r6(out.select("id", *(f"ext_{'_'.join(s)}{e}" for s in _SPECS for e in ("", "_log_n"))))


@query(
    f"""with {BASE}, rows as (select * from base where day >= date '{_CUT}'), o as (select * from base where day < date '{_CUT}'),
    g as (select cust, stddev_samp(a) as sd, quantile_cont(a, 0.5) as med, max(a) - min(a) as ran from rows group by cust), oc as (select cust, avg(a) as m from o group by cust), op as (select pri, avg(a) as m from o group by pri),
    l as (select id, [r0, r1, r2] as v, list_sort(list_filter([r0, r1, r2], lambda x: x > 0)) as q from rows)
    select rows.id, round(sd, 6) as sd_a_by_cust, round(med, 6) as median_a_by_cust, round(ran, 6) as range_a_by_cust,
           round((rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0::double) / count(*) over (), 6) as pct_a, r0 - r1 as gap_r0_r1, r0 + r1 as sum_r0_r1,
           round(list_avg(q), 6) as r_mean, round(list_aggregate(q, 'quantile_cont', 0.75) - list_aggregate(q, 'quantile_cont', 0.25), 6) as r_iqr, round(list_avg(q[greatest(len(q) - 1, 1):]), 6) as r_top2,
           round((r0 + r2) / 2, 6) as mean_ends, round(oc.m, 6) as out_a_by_cust, round(op.m, 6) as out_a_by_pri
    from rows join g using (cust) join l on l.id = rows.id left join oc using (cust) left join op using (pri)"""
)
def t19_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir).withColumn("fold", F.lit(0))
    rows, other = df.where(F.col("day") >= _CUT), df.where(F.col("day") < _CUT)
    blocks = views.enrichment(other, "cust", "pri", ["a"], _RATINGS, {"ends": ["r0", "r2"]}, [("r0", "r1")])
    out = views.assemble(rows, blocks)
    return r6(out.select("id", "sd_a_by_cust", "median_a_by_cust", "range_a_by_cust", "pct_a", "gap_r0_r1", "sum_r0_r1", "r_mean", "r_iqr", "r_top2", "mean_ends", "out_a_by_cust", "out_a_by_pri"))


@query(f"with {BASE} select id, (dense_rank() over (order by case when a = floor(a) then a::bigint::varchar else a::varchar end) - 1)::int as cat_a, (dense_rank() over (order by r0::varchar) - 1)::int as cat_r0 from base")
def t20_categorical_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.twins(["a", "r0"]).make(base(spark, sf_dir))


_CROSSED = ", ".join(f"(dense_rank() over (order by {r} || '|' || pri) - 1)::int as cat_{r}_pri" for r in ("r0", "r1"))


@query(
    f"""with {FOLDED}, {_PRIOR}, l as (select id, list_sort(list_filter([r0, r1], lambda x: x > 0)) as q from folded)
    select f.id, y, fold, price, r0, r1, round(a + b, 6) as dom_total, round(b - a, 6) as dom_gap, (a = 0 and b = 0)::int as dom_both_zero, round(ln(1 + a), 6) as dom_log_a, round((a + b) / greatest(price / 1000, 1), 6) as dom_per_unit,
           r0 - r1 as gap_r0_r1, len(q)::bigint as r_n, round(list_avg(q), 6) as r_mean, (dense_rank() over (order by pri) - 1)::int as code_pri, {_CROSSED},
           round({_te('cust')}, 6) as te_cust, round({_te('r0, pri')}, 6) as te_r0_pri from f join l on l.id = f.id"""
)
def t21_compact_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = views.compact(["price"], ("a", "b"), ["r0", "r1"], ["pri"], [("r0", "r1")], [["cust"], ["r0", "pri"]])
    out = views.assemble(folded(spark, sf_dir), blocks)
    names = ["id", "y", "fold", "price", "r0", "r1", "dom_total", "dom_gap", "dom_both_zero", "dom_log_a", "dom_per_unit", "gap_r0_r1", "r_n", "r_mean", "code_pri", "cat_r0_pri", "cat_r1_pri", "te_cust", "te_r0_pri"]
    return r6(out.select(*names))


@query()
def t24_teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of later rows from a fit on earlier ones without their twins."""
    df = base(spark, sf_dir).select("id", "y", "day", "a", "b", F.col("r0").cast("double").alias("r0"))
    out = models.teacher(df.where(F.col("day") < _CUT).drop("day"), df.where(F.col("day") >= _CUT).drop("day"), ["a", "b", "r0"])
    return r6(out.select("id", "score"))


@query()
def t28_multi_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ratings predicted from other columns, on other folds."""
    df = _features(spark, sf_dir)
    return r6(models.multi_output(df, ["r0", "r1"], ["te_20", "log_price"]))


def _by_fold(scored: DataFrame) -> DataFrame:
    return r6(auc(scored, "score", ["fold"]).select("fold", "auc", "pairs"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).select("id", "y", "fold", "a", "b", "pri", F.col("r0").cast("double").alias("r0"))


@query()
def b5_nested_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stored(folded(spark, sf_dir).select("id", "y", "fold", "a", "b"), "folded")
    return _by_fold(gates.nested_greedy(long_scores(df), df.select("id", "y", "fold"), 3))


@query()
def b9_confidence_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_fold(gates.confidence_stack(_numbers(spark, sf_dir), "a", "b"))


@query(f"with {FOLDED} select count(distinct a) >= 200 and count(*) >= 2000 as supported from folded where fold <> 0")
def b14_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = folded(spark, sf_dir).where("fold <> 0").select("y", F.col("a").alias("score"))
    return spark.createDataFrame([(models.supports_isotonic(fit),)], "supported boolean")


@query()
def g6_early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits watched on carved rows, then fitted again with the median of the best rounds."""
    df = folds.early_stop(stored(_numbers(spark, sf_dir), "numbers"), 0.1, "stop")
    return _by_fold(models.early_stopped(df, ["a", "b", "r0"], 8)[0])


@query(f"with {FOLDED} select id, round(greatest(least(a, 0.999999::double), 1e-6::double), 6) as score from folded")
def g7_identity_of_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of share 0 on a base margin gives the margin back."""
    return r6(models.on_margin(_numbers(spark, sf_dir), "a", ["b", "r0"], 0.0).select("id", "score"))


@query()
def g7_residual_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_fold(models.on_margin(_numbers(spark, sf_dir), "a", ["b", "r0"]))


@query()
def g9_native_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest over indexed categories beside numbers."""
    df = models.indexed(_numbers(spark, sf_dir), ["pri"])
    return _by_fold(models.out_of_fold(df, ["a", "r0", "pri_code"], "forest"))


@query(f"with {BASE} select id, (dense_rank() over (order by pri) - 1)::double as pri_code from base")
def g9_indexed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.indexed(base(spark, sf_dir), ["pri"]).select("id", "pri_code")


@query()
def g10_perceptron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest that MLlib has to a tabular network."""
    return _by_fold(models.out_of_fold(_numbers(spark, sf_dir), ["a", "b", "r0"], "perceptron"))


@query()
def x7_spline_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_fold(gates.spline_fit(_numbers(spark, sf_dir), {"a": [0.25, 0.5, 0.75], "b": [0.5], "r0": []}))


@query()
def x8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_fold(models.out_of_fold(_numbers(spark, sf_dir), ["a", "b", "r0"], "factor"))


@query()
def x9_additive_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_fold(models.out_of_fold(_numbers(spark, sf_dir), _COLUMNS[2:3] + ["a", "b"], "stumps"))

