"""Queries on compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import compositions, models, neighbours
from quern.operators.blending import blend
from quern.operators.metrics import auc
from quern.plans.base import BASE, FOLDED, auc_sql, folded, query, r6, ranked_sql
from quern.plans.blend_queries import _RANK, LONG, _vectors, long_scores
from quern.sources.scratch import stored

_NEAR = """v as (select vec_id as id, embedding::double[] as v, label, label % 2 as y from embeddings), d as (
    select q.id, r.id as ref, r.y, q.label, list_sum(list_transform(list_zip(q.v, r.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as d2 from v q join v r on {on}
), near as (select *, row_number() over (partition by id order by d2, ref) as rank from d qualify rank <= {k})"""
_FEATURES = ["a", "b", "r0", "r1"]


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("r0", "r1")})


def _by_fold(scored: DataFrame) -> DataFrame:
    return r6(auc(scored, "score", ["fold"]).select("fold", "auc", "pairs"))


@query(
    f"""with {_NEAR.format(k=8, on="q.id % 5 <> r.id % 5 and r.id % 11 <> 0")} select id, round(sum(y / (sqrt(d2) + 0.001::double)) / sum(1 / (sqrt(d2) + 0.001::double)), 6) as knn_w_8,
    round(avg(y), 6) as knn_m_8, round(avg(sqrt(d2)), 6) as knn_d_8 from near group by id"""
)
def t14_fold_safe_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumn("fold", (F.col("id") % 5).cast("int"))
    near = compositions.fold_safe_knn(v, 8, F.col("id") % 11 != 0)
    return r6(neighbours.encode(near, v, [8]))


@query(
    f"""with {_NEAR.format(k=10, on="q.id <> r.id and q.label = r.label")}, far as (select id, label, max(d2) as far from near group by id, label), h as (select label, quantile_cont(sqrt(far), 0.5) as h from far group by label)
    select id, round(sum(exp(-d2 / (h * h)) * (ref % 2)) / sum(exp(-d2 / (h * h))), 6) as score from near join h using (label) group by id"""
)
def x6_kernel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumn("y", F.col("id") % 2)
    return r6(compositions.kernel_scores(v, neighbours.knn(v, v, 10, same="label"), "label"))


@query(
    f"""with {_NEAR.format(k=20, on="q.id % 2 = 1 and r.id % 2 = 0")}, far as (select id, sqrt(max(d2)) as d from near group by id)
    select id, round(d, 6) as d, round(greatest(least(1 - d / (select quantile_cont(d, 0.95) from far), 1), 0), 6) as w from far"""
)
def x10_transfer_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return r6(compositions.transfer_weights(neighbours.knn(v.where("id % 2 = 1"), v.where("id % 2 = 0"), 20)))


@query(
    f"""with {FOLDED}, p as (select fold, ((select sum(r0) from folded) - sum(r0)) / ((select count(*) from folded) - count(*))::double as p0, ((select sum(r1) from folded) - sum(r1)) / ((select count(*) from folded) - count(*))::double as p1 from folded group by fold),
    s as (select *, sum(r0) over (partition by pri) - sum(r0) over (partition by pri, fold) as t0, sum(r1) over (partition by pri) - sum(r1) over (partition by pri, fold) as t1, count(*) over (partition by pri) - count(*) over (partition by pri, fold) as n from folded)
    select id, round((t0 + 20 * p0) / (n + 20), 6) as pred_r0, round((t1 + 20 * p1) / (n + 20), 6) as pred_r1 from s join p using (fold)"""
)
def t23_crossfit_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(compositions.crossfit_targets(folded(spark, sf_dir), "pri", ["r0", "r1"]))


@query(
    f"""with {BASE}, m as (select *, case when r0 > 0 then price end as x from base), med as (select quantile_cont(x, 0.5) as med from m),
    f as (select id, dense_rank() over (order by pri) - 1 as code, (x is null)::int as missing_x, ln(1 + greatest(coalesce(x, (select med from med)), 0)) as l from m)
    select id, code::int as code_pri, round((l - avg(l) over ()) / greatest(stddev_pop(l) over (), 1e-6::double), 6) as z_x, missing_x from f"""
)
def k24_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded(spark, sf_dir).withColumn("x", F.when(F.col("r0") > 0, F.col("price")))
    return r6(compositions.prepared(df, ["pri"], ["x"], ["x"]))


@query(
    f"with {BASE}, {LONG}, grown as (select id, unnest(range(place, 3 + 1)) as members, score from (select *, case model when 'b' then 1 when 'a' then 2 else 3 end as place from long)), "
    f"means as (select members, id, round (avg(score), 12) as score from grown group by members, id), scored as (select members, means.score, y from means join base using (id)), {auc_sql('scored', 'score', 'members')} "
    "select members::int as members, round(good / pairs, 6) as auc from auc"
)
def x19_averaging_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded(spark, sf_dir)
    return r6(compositions.averaging_curve(long_scores(df), df, ["b", "a", "c"]))


@query(
    f"with {FOLDED}, grown as (select y, a, unnest(range(fold, 5)) as upto from folded), {auc_sql('grown', 'a', 'upto')}, curve as (select (select count(*) from grown g where g.upto = auc.upto) as n, good / pairs as v from auc), "
    "last as (select max(n) as n1, arg_max(v, n) as v1, min(n) as n0, arg_min(v, n) as v0 from (select * from curve order by n desc limit 2)) select round((v1 - v0) / ln(n1 / n0) * ln(2), 6) as slope from last"
)
def x18_slope_per_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of a score over a growing number of folds; the two largest sizes give the slope."""
    grown = folded(spark, sf_dir).withColumn("upto", F.explode(F.sequence("fold", F.lit(4))))
    curve = auc(grown, "a", ["upto"]).join(grown.groupBy("upto").agg(F.count("*").alias("n")), "upto")
    return r6(compositions.slope_per_doubling(curve, "n", "auc"))


def _worst(k: int, before: str) -> str:
    """One step of the maximin choice: every model that is not chosen beside those that are."""
    joins = " ".join(f"join (select id, z as z{i}, l.model as m{i} from l join best{i} using (model)) p{i} using (id)" for i in range(1, k))
    where = " where " + " and ".join(f"l.model <> m{i}" for i in range(1, k)) if k > 1 else ""
    return f"""c{k} as (select l.model, fold, y, round ((z{before}) / {k}, 12) as s from l {joins}{where}),
    {ranked_sql(f"auc{k}", f"c{k}", "model, fold")}, best{k} as (select model, min(auc) as worst_{k} from auc{k} group by model order by min(auc) desc, model limit 1)"""


@query(
    f"""with {FOLDED}, {LONG}, l as (select id, model, fold, y, round (score, 12) as z from long join folded using (id)), {_worst(1, "")}, {_worst(2, " + z1")}, {_worst(3, " + z1 + z2")}
    select 0 as step, model from best1 union all select 1, best2.model from best1, best2 where worst_2 > worst_1 + 1e-9 union all
    select 2, best3.model from best1, best2, best3 where worst_2 > worst_1 + 1e-9 and worst_3 > worst_2 + 1e-9"""
)
def x5_maximin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models in the order in which they join."""
    df = folded(spark, sf_dir)
    chosen = compositions.maximin(long_scores(df), df, 3)
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, chosen))).alias("step", "model"))


@query()
def x16_top_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded(spark, sf_dir)
    return _by_fold(compositions.top_stack(long_scores(df), df.select("id", "y", "fold"), 2))


@query(
    f"""with {FOLDED}, {LONG}, ranks as (select id, model, {_RANK} as s from long), anchor as (select id, '' as model, round (avg(s), 12) as s from ranks group by id),
    places as (select id, (rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double) / count(*) over () as r from anchor),
    rows as (select e.id, model, s, least(floor(r * 4), 3)::int as region, y, fold from (select * from ranks union all select * from anchor) e join places using (id) join folded using (id)),
    fs as (select distinct fold as f from folded), tried as (select f, region, model, s, y from rows, fs where fold <> f), {ranked_sql("local", "tried", "f, region, model")},
    best as (select f, region, model from local where auc is not null and not isnan(auc) qualify row_number() over (partition by f, region order by auc desc, (model = '') desc, model desc) = 1),
    own as (select r.fold, r.y, r.s from rows r left join best b on b.f = r.fold and b.region = r.region where r.model = coalesce(b.model, '')), {auc_sql("own", "s", "fold")}
    select fold, round(good / pairs, 6) as auc, pairs from auc"""
)
def b12_region_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded(spark, sf_dir)
    return _by_fold(compositions.region_gate(long_scores(df), df, 4))


@query()
def x3_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_fold(compositions.corrected(_numbers(spark, sf_dir), "a", ["b", "r0"], "logistic"))


@query()
def x4_subspace_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _numbers(spark, sf_dir)
    return _by_fold(blend(compositions.subspace_scores(df, _FEATURES, 3, 2, "part"), how="logit").join(df.select("id", "fold", "y"), "id"))


@query()
def g16_voted_subspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _numbers(spark, sf_dir)
    return _by_fold(compositions.voted(compositions.subspace_scores(df, _FEATURES, 3, 2, "vote"), df.select("id", "fold", "y")))


@query()
def x11_specialists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_fold(compositions.specialists(_numbers(spark, sf_dir), "pri", ["a", "b"]))


@query()
def x14_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _numbers(spark, sf_dir)
    return compositions.leaves(df.where("fold <> 0"), df.where("fold = 0").select("id", *_FEATURES), _FEATURES, 4).select("id", "leaves")


@query()
def x22_with_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _numbers(spark, sf_dir)
    return _by_fold(compositions.with_external(df.where("day >= '1996-01-01'"), df.where("day < '1996-01-01'"), ["a", "b"], 0.3))


@query()
def g18_pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC on fold 0 of fits on folds 2 to 4, and with pseudo-labels of fold 1 or as many repeated rows."""
    df = stored(_numbers(spark, sf_dir).select("id", "y", "fold", "a", "b"), "numbers")
    fit, other, test = df.where("fold > 1"), df.where("fold = 1"), df.where("fold = 0").withColumn("truth", F.col("y"))
    pseudo = stored(models.fit_apply(fit, other, ["a", "b"], "logistic"), "pseudo")
    arms = {"plain": fit, "pseudo": compositions.pseudo_labelled(fit, pseudo, "score", 0.1, "g18"), "repeated": compositions.pseudo_labelled(fit, pseudo, "score", 0.1, "g18", True)}
    out = None
    for name, rows in arms.items():
        scored = models.fit_apply(rows, test, ["a", "b"], "logistic").withColumnRenamed("truth", "y")
        row = auc(scored, "score").select(F.lit(name).alias("arm"), "auc")
        out = row if out is None else out.unionByName(row)
    return r6(out)


@query()
def x21_permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of AUC on fold 0 when a column's values are moved to other rows."""
    df = _numbers(spark, sf_dir)
    fit, test = df.where("fold <> 0"), df.where("fold = 0").withColumn("truth", F.col("y"))
    out = None
    for c in (None, "a", "b"):
        rows = test if c is None else compositions.shuffled(test, c, "moved")
        row = auc(models.fit_apply(fit, rows, ["a", "b"], "logistic").withColumnRenamed("truth", "y"), "score").select(F.lit(c or "").alias("moved"), "auc")
        out = row if out is None else out.unionByName(row)
    return r6(out)
