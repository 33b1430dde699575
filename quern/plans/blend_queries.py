"""Queries on blends, neighbours and model fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import blending, encodings, models, neighbours
from quern.operators.metrics import auc
from quern.plans.base import BASE, FOLDED, auc_sql, base, folded, query, r6, ranked_sql, u_sql
from quern.sources.scratch import stored
from quern.sources.tables import table


def long_scores(df: DataFrame) -> DataFrame:
    """Two scores of each row and their mean of squares, in long form."""
    third = (F.col("a") * F.col("a") + F.col("b") * F.col("b")) / 2
    pairs = F.array(*(F.struct(F.lit(m).alias("model"), s.alias("score")) for m, s in (("a", F.col("a")), ("b", F.col("b")), ("c", third))))
    return df.select("id", F.inline(pairs))


LONG = "long as (select id, 'a' as model, a as score from base union all select id, 'b', b from base union all select id, 'c', (a * a + b * b) / 2 from base)"
_LOGIT = "ln(greatest(least({0}, 0.999999::double), 1e-6::double) / (1 - greatest(least({0}, 0.999999::double), 1e-6::double)))"
_RANK = "(rank() over (partition by model order by score) + (count(*) over (partition by model, score) - 1) / 2.0::double) / count(*) over (partition by model)"


@query(f"with {BASE}, {LONG} select id, round(avg({_LOGIT.format('score')}), 6) as score from long group by id")
def b2_logit_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(blending.blend(long_scores(base(spark, sf_dir)), how="logit"))


@query(f"with {BASE}, {LONG}, ranked as (select id, model, {_RANK} as score from long) select id, round(sum(score * case model when 'a' then 0.5::double when 'b' then 0.3::double else 0.2::double end), 6) as score from ranked group by id")
def b2_weighted_rank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(blending.blend(long_scores(base(spark, sf_dir)), {"a": 0.5, "b": 0.3, "c": 0.2}, "rank"))


@query(f"with {BASE}, {LONG}, ranked as (select id, model, {_RANK} as score from long) select id, round(max(score) - min(score), 6) as spread, round(stddev_pop(score), 6) as sd from ranked group by id")
def m26_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(blending.dispersion(long_scores(base(spark, sf_dir))).select("id", "spread", "sd"))


@query(
    f"""with {FOLDED}, blended as (select *, (a + b) / 2 as m from folded), one as (
        select fold, sum(case when p.a > q.a then p.n * q.n when p.a = q.a then p.n * q.n / 2.0::double else 0 end) / sum(p.n * q.n) as v
        from (select fold, a, count(*) as n from blended where y = 1 group by all) p join (select fold, a, count(*) as n from blended where y = 0 group by all) q using (fold) group by fold
    ), two as (
        select fold, sum(case when p.m > q.m then p.n * q.n when p.m = q.m then p.n * q.n / 2.0::double else 0 end) / sum(p.n * q.n) as v
        from (select fold, m, count(*) as n from blended where y = 1 group by all) p join (select fold, m, count(*) as n from blended where y = 0 group by all) q using (fold) group by fold
    ), d as (select two.v - one.v as delta from one join two using (fold))
    select round(avg(delta), 6) as mean, round(stddev_samp(delta) / sqrt(count(*)), 6) as se, sum((delta > 0)::int)::bigint as positive,
           avg(delta) >= 1e-4::double and avg(delta) >= stddev_samp(delta) / sqrt(count(*)) and sum((delta > 0)::int) >= 4 as admitted from d"""
)
def b7_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded(spark, sf_dir)
    labels = df.select("id", "y", "fold")
    deltas = blending.fold_deltas(df.select("id", F.col("a").alias("score")), df.select("id", ((F.col("a") + F.col("b")) / 2).alias("score")), labels)
    return r6(blending.admission(deltas, 1e-4, 1.0, 4))


@query(
    f"""with {FOLDED}, tried as (select fold, y, w, w * a + (1 - w) * b as s from folded, (select unnest([0.0::double, 0.25::double, 0.5::double, 0.75::double, 1.0::double]) as w)), {auc_sql("tried", "s", "fold, w")},
    best as (select fold, w, good / pairs as auc, row_number() over (partition by fold order by good / pairs desc, w) as k from auc)
    select fold, w as weight, round(auc, 6) as auc from best where k = 1"""
)
def b11_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded(spark, sf_dir)
    scores = long_scores(df).where("model in ('a', 'b')")
    return r6(blending.weight_grid(scores, df.select("id", "y", "fold"), "a", "b", [0.0, 0.25, 0.5, 0.75, 1.0], ["fold"]))


@query(f"with {BASE}, {LONG}, ranked as (select id, model, {_RANK} as r from long), top as (select id, model from ranked where r > 0.9::double) select count(*) as common, round(count(*) / (select count(*) from top where model = 'a')::double, 6) as share from top x join top z using (id) where x.model = 'a' and z.model = 'b'")
def x20_top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of either top tenth; the reference compared ranks of the first tenth of rows."""
    return r6(blending.top_overlap(long_scores(base(spark, sf_dir)), "a", "b", 0.1))


def _step(k: int, before: str) -> str:
    """One step of the hill climb: every model beside those of the steps before."""
    return f"""c{k} as (select l.model, y, round ((z{before}) / {k}, 12) as s from l {' '.join(f"join (select id, z as z{i} from l join best{i} using (model)) p{i} using (id)" for i in range(1, k))}),
    {ranked_sql(f"auc{k}", f"c{k}")}, best{k} as (select model, auc as auc_{k} from auc{k} order by auc desc, model limit 1)"""


@query(
    f"""with {BASE}, {LONG}, l as (select id, model, y, {_LOGIT.format("score")} as z from long join base using (id)), {_step(1, "")}, {_step(2, " + z1")}, {_step(3, " + z1 + z2")}
    select 0 as step, model from best1 union all select 1, best2.model from best1, best2 where auc_2 > auc_1 union all select 2, best3.model from best1, best2, best3 where auc_2 > auc_1 and auc_3 > auc_2"""
)
def b4_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models in the order in which they join the blend."""
    df = base(spark, sf_dir)
    chosen = blending.greedy(long_scores(df), df.select("id", "y"), 3)
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, chosen))).alias("step", "model"))


_FAMILY = "case model when 'a' then 'x' when 'b' then 'x' else 'y' end"


@query(
    f"""with {BASE}, {LONG}, w as (select model, exp((v - 0.6::double) / 0.1::double) / sum(exp((v - 0.6::double) / 0.1::double)) over (partition by {_FAMILY}) / 2 as w from (values ('a', 0.6::double), ('b', 0.5::double), ('c', 0.6::double)) q(model, v))
    select id, round(sum(w * score), 6) as score from long join w using (model) group by id"""
)
def b3_family_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = blending.family_weights({"a": 0.6, "b": 0.5, "c": 0.6}, {"a": "x", "b": "x", "c": "y"}, 0.1)
    return r6(blending.blend(long_scores(base(spark, sf_dir)), weights))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label", (F.col("label") % 2).alias("y"))


_NEAR = """v as (select vec_id as id, embedding::double[] as v, label, label % 2 as y from embeddings), d as (
    select q.id, r.id as ref, r.y, list_sum(list_transform(list_zip(q.v, r.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as d2 from v q join v r on q.id <> r.id {more}
), near as (select *, row_number() over (partition by id order by d2, ref) as rank from d qualify rank <= {k})"""


@query(f"with {_NEAR.format(k=5, more='')} select id, ref, rank::int as rank, round(d2, 4) as d2 from near")
def j6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return neighbours.knn(v, v, 5).select("id", "ref", "rank", F.round(F.col("d2") + 1e-9, 4).alias("d2"))


@query(f"with {_NEAR.format(k=2, more='and q.label = r.label')} select id, ref, rank::int as rank from near")
def j7_same_class_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return neighbours.knn(v, v, 2, same="label").select("id", "ref", "rank")


@query(
    f"""with {_NEAR.format(k=16, more='')} select id, round(sum(case when rank <= 4 then y / (sqrt(d2) + 0.001::double) end) / sum(case when rank <= 4 then 1 / (sqrt(d2) + 0.001::double) end), 6) as knn_w_4,
    round(avg(case when rank <= 4 then y end), 6) as knn_m_4, round(avg(case when rank <= 4 then sqrt(d2) end), 6) as knn_d_4,
    round(sum(y / (sqrt(d2) + 0.001::double)) / sum(1 / (sqrt(d2) + 0.001::double)), 6) as knn_w_16, round(avg(y), 6) as knn_m_16, round(avg(sqrt(d2)), 6) as knn_d_16 from near group by id"""
)
def t13_knn_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return r6(neighbours.encode(neighbours.knn(v, v, 16), v, [4, 16]))


_SHARE = u_sql("'mix:' || near.id || ':' || near.ref")


@query(
    f"with {_NEAR.format(k=2, more='and q.label = r.label')}, f as (select id, v[1] as x, v[2] as z from v) "
    f"select near.id, rank::int as rank, round(p.x + {_SHARE} * (q.x - p.x), 6) as x, round(p.z + {_SHARE} * (q.z - p.z), 6) as z from near join f p on p.id = near.id join f q on q.id = near.ref"
)
def t32_local_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rank uses the neighbour of that rank; the reference always took the nearest."""
    v = _vectors(spark, sf_dir)
    rows = v.select("id", F.col("v")[0].cast("double").alias("x"), F.col("v")[1].cast("double").alias("z"))
    out = neighbours.between(rows, neighbours.knn(v, v, 2, same="label"), ["x", "z"], "mix")
    return r6(out.select("id", "rank", "x", "z"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stored(folded(spark, sf_dir).select("id", "y", "fold", "cust", "price", "r0", "r1", "pri"), "folded")
    te = encodings.crossfit(df, "cust", [20])
    return te.select("id", "y", "fold", "te_20", F.log1p("price").alias("log_price"), F.col("r0").cast("double").alias("r0"), F.col("r1").cast("double").alias("r1"), "pri")


_COLUMNS = ["te_20", "log_price", "r0", "r1"]


def _fitted(model: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = models.out_of_fold(_features(spark, sf_dir), _COLUMNS, model)
        return r6(auc(scored, "score", ["fold"]).select("fold", "auc", "pairs"))

    run.__name__ = f"g_{model}_oof_auc"
    run.__doc__ = f"Out-of-fold AUC of the {model} model."
    return query()(run)


for _m in ("boosted", "forest", "logistic"):
    _fitted(_m)


@query()
def b6_nested_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of a logistic stack."""
    df = folded(spark, sf_dir)
    return r6(models.stack(long_scores(df), df.select("id", "y", "fold"), ["a", "b", "c"]))


@query()
def b14_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of one fold, calibrated on the others in two ways."""
    df = folded(spark, sf_dir).select("id", "y", "fold", F.col("a").alias("score"))
    fit, rows = df.where("fold <> 0"), df.where("fold = 0")
    both = models.platt(fit, rows).withColumnRenamed("calibrated", "platt").join(models.isotonic(fit, rows).select("id", F.col("calibrated").alias("isotonic")), "id")
    return r6(both.select("id", "platt", "isotonic"))


@query()
def t25_rating_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(models.residuals(_features(spark, sf_dir), "r0", ["te_20", "log_price", "r1"]).select("id", "r0_residual"))


@query()
def t26_latent_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _features(spark, sf_dir)
    out = models.latent(df.where("fold <> 0"), df.where("fold = 0"), _COLUMNS, 2)
    return r6(out.select("id", F.abs(F.col("latent")[0]).alias("p0"), F.abs(F.col("latent")[1]).alias("p1")))


@query()
def t27_centre_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _features(spark, sf_dir)
    out = models.centre_distances(df.where("fold <> 0"), df.where("fold = 0"), _COLUMNS, 3)
    return r6(out.select("id", F.array_min("distances").alias("nearest"), F.array_max("distances").alias("farthest")))
