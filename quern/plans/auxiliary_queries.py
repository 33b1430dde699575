"""Queries on predicted ratings and on tokens of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import auxiliary, screens, tokens
from quern.plans.base import FOLDED, folded, query, r6
from quern.sources.tables import table

_INPUTS = ["r0", "r1", "r2", "pri"]
_BAYES = f"""{FOLDED}, long as ({' union all '.join(f"select id, fold, r0, r1, {i} as i, {c}::varchar as v from folded" for i, c in enumerate(_INPUTS))}),
    kinds as (select i, count(distinct v) as kinds from long group by i), cs as (select unnest(range(6)) as c), fs as (select distinct fold as f from folded),
    targets as (select id, fold, 0 as t, r0 as c from folded union all select id, fold, 1, r1 from folded),
    sizes as (select f, t, c, count(*) as n from targets, fs where fold <> f group by all),
    cells as (select f, t, l.i, l.v, x.c, count(*) as n from long l join targets x using (id), fs where l.fold <> f and l.i <> x.t group by all),
    scored as (select l.id, s.t, s.c, sum(ln((coalesce(x.n, 0) + 1) / (s.n + kinds)::double)) as part from long l join sizes s on s.f = l.fold and l.i <> s.t join kinds using (i)
               left join cells x on x.f = l.fold and x.t = s.t and x.i = l.i and x.v = l.v and x.c = s.c group by all),
    logs as (select id, t, c, part + ln((s.n + 1) / (sum(s.n) over (partition by id, t) + 6)::double) as l from scored join folded using (id) join sizes s using (t, c) where s.f = folded.fold),
    probs as (select id, t, c, exp(l - max(l) over (partition by id, t)) as w from logs), shares as (select id, t, c, w / sum(w) over (partition by id, t) as p from probs)"""


@query(f"with {_BAYES} select id, " + ", ".join(f"round(max(case when t = {t} and c = {c} then p end), 6) as p_r{t}_{c}" for t in (0, 1) for c in range(6)) + " from shares group by id")
def t23_class_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ratings as distributions, each from all other columns and other folds."""
    found = auxiliary.class_distributions(folded(spark, sf_dir), ["r0", "r1"], ["r2", "pri"])
    return r6(found.select("id", *(F.get(f"p_r{t}", F.lit(c)).alias(f"p_r{t}_{c}") for t in (0, 1) for c in range(6))))


@query(
    f"with {_BAYES}, e as (select id, sum(c * p) as ev, -sum(case when p > 0 then p * ln(p) else 0 end) as entropy, sum(case when c = r0 then -ln(p) end) as surprisal, min(r0) as r0 from shares join folded using (id) where t = 0 group by id) "
    "select id, round(ev, 6) as ev, round(r0 - ev, 6) as residual, round(entropy, 6) as entropy, round(surprisal, 6) as surprisal from e"
)
def t23_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a predicted distribution says of the rating that is there."""
    df = folded(spark, sf_dir)
    found = auxiliary.class_distributions(df, ["r0", "r1"], ["r2", "pri"]).join(df.select("id", "r0"), "id")
    marks = screens.signatures([F.get("p_r0", F.lit(c)) for c in range(6)], F.col("r0"))
    return r6(found.select("id", *(marks[k].alias(k) for k in ("ev", "residual", "entropy", "surprisal"))))


@query(
    f"""with {FOLDED}, fs as (select distinct fold as f from folded), ms as (select f as m from fs), x as (select id, fold, r0::double as t1, r1::double as t2, ln(1 + price) as x, a as u from folded),
    c1 as (select m, f, regr_slope(t1, x) as b, regr_intercept(t1, x) as a from x, ms, fs where fold <> m and fold <> f group by all),
    p1 as (select id, m, fold, t1, t2, u as x, a + b * x as z from x join c1 on f = fold),
    s2 as (select m, f, var_pop(x) as xx, var_pop(z) as zz, covar_pop(x, z) as xz, covar_pop(x, t2) as xt, covar_pop(z, t2) as zt, avg(x) as mx, avg(z) as mz, avg(t2) as mt from p1, fs where fold <> m and fold <> f group by all),
    c2 as (select *, (xt * zz - zt * xz) / (xx * zz - xz * xz) as bx, (zt * xx - xt * xz) / (xx * zz - xz * xz) as bz from s2)
    select id, round(z, 6) as pred_r0, round(mt + bx * (x - mx) + bz * (z - mz), 6) as pred_r1 from p1 join c2 using (m) where f = fold and fold = m"""
)
def t28_linear_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ratings in a chain: the second is fitted on predictions of the first."""
    df = folded(spark, sf_dir).withColumn("x", F.log1p("price"))
    return r6(auxiliary.linear_chain(df, {"r0": ["x"], "r1": ["a"]}, ridge=0.0))


@query()
def k14_vocabulary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last token and their number, for keys and prices of parts, from a public vocabulary."""
    return tokens.number_tokens(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_partkey", "p_retailprice"]).drop("p_retailprice")
