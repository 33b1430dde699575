"""Queries on selections and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import gates
from quern.operators.metrics import auc
from quern.plans.base import BASE, FOLDED, base, folded, query, r6
from quern.plans.blend_queries import long_scores
from quern.plans.metric_queries import _placed
from quern.plans.view_queries import PRIORITIES


@query(f"with {BASE}, v as {_placed('a')}, e as (select y, avg(v) as m, var_samp(v) / count(*) as s from v group by y) select round(avg(m), 6) as auc, round(sqrt(sum(s)), 6) as se from e")
def m6_auc_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(gates.auc_error(base(spark, sf_dir), "a"))


@query(
    f"""with {BASE}, p as (select *, row_number() over (partition by y order by md5('pairs:' || id), id) - 1 as place from base), z as (select * from p where y = 0),
    o as (select *, unnest(range(place * 3, place * 3 + 3)) as at from p where y = 1), m as (
        select sign(o.a - z.a) as da, sign(o.b - z.b) as db from o join z on o.at % (select count(*) from z) = z.place)
    select count(*) as pairs, round(avg((da > 0 and db > 0)::int), 6) as both_right, round(avg((da < 0 and db > 0)::int), 6) as rescued, round(avg((da > 0 and db < 0)::int), 6) as damaged, round(avg((da < 0 and db < 0)::int), 6) as both_wrong from m"""
)
def m18_sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = gates.sampled_pairs(base(spark, sf_dir), 3, "pairs")
    share = lambda c, name: F.avg(c.cast("double")).alias(name)
    a, b = F.signum(F.col("a1") - F.col("a0")), F.signum(F.col("b1") - F.col("b0"))
    return r6(p.agg(F.count("*").alias("pairs"), share((a > 0) & (b > 0), "both_right"), share((a < 0) & (b > 0), "rescued"), share((a > 0) & (b < 0), "damaged"), share((a < 0) & (b < 0), "both_wrong")))


@query(f"with {FOLDED}, bags as (select unnest(range(1, 5)) as bag) select bag::int as bag, count(*) as n, round(avg(y), 6) as rate from folded, bags where fold <> 0 and fold <> bag group by bag")
def v7_bag_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit rows (all but fold 0) without one part each."""
    fit = folded(spark, sf_dir).where("fold <> 0").withColumn("bag", F.explode(F.array(*map(F.lit, range(1, 5))))).where("fold <> bag")
    return r6(fit.groupBy("bag").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("rate")))


@query()
def m23_domain_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir).select("id", "day", "a", "b", F.col("r0").cast("double").alias("r0"))
    return r6(gates.domain_auc(df.where("day < '1996-01-01'"), df.where("day >= '1996-01-01'"), ["a", "b", "r0"]))


@query()
def b8_forward_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models in the order in which they are admitted."""
    df = folded(spark, sf_dir)
    chosen = gates.forward(long_scores(df), df.select("id", "y", "fold"), "a", ["a", "b", "c"], 1e-5, 0.5, 3)
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, chosen))).alias("step", "model"))


@query()
def b13_learned_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folded(spark, sf_dir).select("id", "y", "fold", "a", "b", F.col("r0").cast("double").alias("r0"))
    return r6(auc(gates.learned_gate(df, "a", "b", ["a", "b", "r0"]), "score", ["fold"]).select("fold", "auc"))


@query()
def b16_group_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(gates.group_calibration(folded(spark, sf_dir), "a", "pri", PRIORITIES, (-1.0, 1.0)).select("id", "score"))


@query()
def g17_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(gates.learning_curve(folded(spark, sf_dir), ["a", "b"], [0.25, 0.5, 1.0], "curve"))
