"""Queries on boosting with own losses, margins and objectives over pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalars import logit
from quern.operators import additive, boosting, compositions, encodings, folds, forests, objectives
from quern.operators.metrics import auc
from quern.operators.neighbours import standardised
from quern.plans.base import FOLDED, base, folded, query, r6, u_sql
from quern.sources.scratch import stored
from quern.sources.tables import table

DOCUMENT_FEATURES = ["chars", "words", "lines", "digits", "capitals", "marks"]


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled documents as rows ``(id, fold, y, *DOCUMENT_FEATURES)``: the quality label, logs of counts and shares of
    kinds of characters."""
    labels = table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    text = F.coalesce(F.col("text"), F.lit(""))
    share = lambda kind: F.regexp_count(text, F.lit(kind)) / (F.length(text) + 1)
    counts = {"chars": F.length(text), "words": F.regexp_count(text, F.lit(r"\S+")), "lines": F.regexp_count(text, F.lit(r"\n"))}
    features = {k: F.log1p(v.cast("double")) for k, v in counts.items()} | {"digits": share("[0-9]"), "capitals": share("[A-Z]"), "marks": share("[#*$%&|<>]")}
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *(v.alias(k) for k, v in features.items()))
    return folds.stratified(labels.join(docs, "id"), 5, "primary")

_FEATURES = ["price", "a", "b", "r0", "r1"]
_LONG = ", ".join(f"({i}, {f}::double)" for i, f in enumerate(_FEATURES))


def boost_sql(start: str, slopes: str, rounds: int, depth: int, rate: float, ridge: float, bins: int, source: str = FOLDED, features: list[str] = _FEATURES, turns: list[int] | None = None) -> str:
    """CTEs that end with ``margins<rounds>(id, m, fold, y, s)``: boosting as in ``boosting.boost``. ``start`` is the first
    margin for ``r`` (a row) and the mean ``p`` of model m; ``slopes`` are gradient and curvature of y and the margin s; round k may
    split by all features, or by that of ``turns[k]`` alone."""
    long = " union all ".join(f"select id, {i} as f, {f}::double as v from folded" for i, f in enumerate(features))
    out = f"""{source}, long as ({long}),
    sorted as (select f, list(v order by v) as l from long where v is not null group by f),
    cuts as (select distinct f, l[(len(l) - 1) * k // {bins} + 1] as cut from sorted, range(1, {bins}) t(k)),
    cut_lists as (select f, list_sort(list(cut)) as c from cuts group by f),
    bins as (select id, f, case when v is null then 0 else 1 + len(list_filter(c, lambda x: x < v)) end as b from long join cut_lists using (f)),
    ms as (select distinct fold as m from folded),
    means as (select m, avg(y) as p from folded, ms where fold <> m group by m),
    margins0 as (select r.id, m, fold, y, ({start})::double as s from folded r, means)"""
    for k in range(rounds):
        out += f""", grads{k} as (select id, m, fold, y, s, floor(g / 1e-7 + 0.5)::bigint as g, floor(h / 1e-7 + 0.5)::bigint as h from (select *, {slopes} from margins{k})),
        nodes{k}_0 as (select id, m, fold, 1 as node from grads{k})"""
        for d in range(depth):
            side = lambda g, h: f"(({g}) * 1e-7) * (({g}) * 1e-7) / (({h}) * 1e-7 + {ridge})"
            gain = f"({side('lg', 'lh')} + {side('tg - lg', 'th - lh')} - {side('tg', 'th')}) / 2"
            out += f""", cells{k}_{d} as (select m, node, f, b, sum(g)::bigint as g, sum(h)::bigint as h, count(*) as n from nodes{k}_{d} join grads{k} using (id, m, fold) join bins using (id) where fold <> m{f" and f = {turns[k]}" if turns else ""} group by all),
            sums{k}_{d} as (select m, node, f, b, sum(g) over w as lg, sum(h) over w as lh, sum(n) over w as ln, sum(g) over v as tg, sum(h) over v as th, sum(n) over v as tn from cells{k}_{d}
                            window w as (partition by m, node, f order by b rows between unbounded preceding and current row), v as (partition by m, node, f)),
            best{k}_{d} as (select m, node, f, b from (select *, case when least(ln, tn - ln) >= 1 and least(lh, th - lh) * 1e-7 >= 1e-3 then floor(({gain}) * 1e9 + 0.5) / 1e9 end as gain from sums{k}_{d})
                            qualify row_number() over (partition by m, node order by gain desc nulls last, f, b) = 1 and gain > 0),
            nodes{k}_{d + 1} as (select n.id, n.m, n.fold, 2 * n.node + coalesce((x.b > s.b)::int, 0) as node from nodes{k}_{d} n left join best{k}_{d} s using (m, node) left join bins x on x.id = n.id and x.f = s.f)"""
        out += f""", leaves{k} as (select m, node, -{rate} * (sum(g) * 1e-7) / (sum(h) * 1e-7 + {ridge}) as step from nodes{k}_{depth} join grads{k} using (id, m, fold) where fold <> m group by m, node),
        margins{k + 1} as (select id, m, fold, y, s + coalesce(step, 0) as s from grads{k} join nodes{k}_{depth} using (id, m, fold) left join leaves{k} using (m, node))"""
    return out


_LOGISTIC = "1 / (1 + exp(-s)) - y as g, 1 / (1 + exp(-s)) * (1 - 1 / (1 + exp(-s))) as h"


@query("with " + boost_sql("ln(p / (1 - p))", _LOGISTIC, 2, 2, 0.3, 1.0, 16) + " select id, round(1 / (1 + exp(-s)), 9) as score from margins2 where fold = m")
def g2_histogram_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of trees of two levels in each fold, second order."""
    fitted = boosting.boost(folded(spark, sf_dir), _FEATURES, rounds=2, depth=2, rate=0.3, bins=16)
    return fitted.rows.select("id", F.round(1 / (1 + F.exp(-F.col("margin"))), 9).alias("score"))


_MARGIN = "ln(greatest(least(a, 1 - 1e-6), 1e-6) / (1 - greatest(least(a, 1 - 1e-6), 1e-6)))"


@query("with " + boost_sql(_MARGIN, _LOGISTIC, 1, 2, 0.5, 1.0, 16) + " select id, round(s, 9) as margin from margins1 where fold = m")
def g7_margin_first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round on the margin of another score."""
    df = folded(spark, sf_dir).withColumn("margin", logit(F.col("a")))
    fitted = boosting.boost(df, _FEATURES, rounds=1, depth=2, rate=0.5, bins=16, margin="margin")
    return fitted.rows.select("id", F.round("margin", 9).alias("margin"))


@query(f"with {FOLDED} select id, round({_MARGIN}, 9) as margin from folded")
def g7_margin_without_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No round gives the margin back."""
    fitted = boosting.boost(folded(spark, sf_dir).withColumn("margin", logit(F.col("a"))), _FEATURES, rounds=0, margin="margin")
    return fitted.rows.select("id", F.round("margin", 9).alias("margin"))


@query("with " + boost_sql("p", "s - y as g, 1.0 as h", 1, 3, 0.5, 1.0, 16, FOLDED.replace("(o_orderstatus = 'F')::int as y", "(o_custkey % 6)::int as y"), ["price", "a", "r1"]) + " select id, round(s, 9) as margin from margins1 where fold = m")
def g5_squared_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round of three levels on a target of six values, by squares."""
    df = folds.stratified(base(spark, sf_dir).withColumn("y", F.col("r0")), 5, "primary")
    return boosting.boost(df, ["price", "a", "r1"], loss=boosting.SQUARED, rounds=1, depth=3, rate=0.5, bins=16).rows.select("id", F.round("margin", 9).alias("margin"))


@query()
def g5_early_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC by fold of a fit on labelled documents that rows held back stop."""
    df = folds.early_stop(labelled_documents(spark, sf_dir), 0.2, "stop")
    fitted = boosting.boost(df, DOCUMENT_FEATURES, rounds=8, depth=2, rate=0.5, es="is_es", patience=2)
    return r6(auc(fitted.rows, "margin", ["fold"]).select("fold", "auc", "pairs"))


@query()
def g7_losses_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log loss of the rows that teach, after each of ten rounds on a margin of 0."""
    df = labelled_documents(spark, sf_dir).withColumn("margin", F.lit(0.0))
    losses = boosting.boost(df, DOCUMENT_FEATURES, rounds=10, depth=2, rate=0.3, margin="margin", watch=True).losses
    return r6(spark.createDataFrame(list(enumerate(losses)), "round int, loss double"))


@query(
    f"""with {FOLDED}, models as (select m, id, y, a from folded, (select distinct fold as m from folded) where fold <> m),
    p as (select m, a as s, count(*) as n, sum(count(*)) over (partition by m) as t from models where y = 1 group by m, a), q as (select m, a as s, count(*) as n, sum(count(*)) over (partition by m) as t from models where y = 0 group by m, a),
    pairs as (select p.m, p.s as ps, q.s as qs, p.n as pn, q.n as qn, greatest(0.25 - p.s + q.s, 0) as gap, (p.t + q.t) / (p.t * q.t)::double as scale from p join q using (m)),
    one as (select m, ps as s, -2 * sum(qn * gap * scale) as g, 2 * sum(case when ps - 0.25 < qs then qn else 0 end * scale) as h from pairs group by all),
    zero as (select m, qs as s, 2 * sum(pn * gap * scale) as g, 2 * sum(case when ps - 0.25 < qs then pn else 0 end * scale) as h from pairs group by all)
    select id, models.m as model, round(g, 6) as g, round(h, 6) as h from models join (select *, 1 as y from one union all select *, 0 as y from zero) x on x.m = models.m and x.s = models.a and x.y = models.y"""
)
def x1_pair_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients over all pairs in each fold's rows; the SQL forms the pairs of distinct scores."""
    df = folded(spark, sf_dir)
    models = df.select("fold").distinct().withColumnRenamed("fold", "model")
    long = df.select("id", "fold", "y", "a").crossJoin(F.broadcast(models)).where("fold <> model")  # five rows
    return r6(objectives.pair_slopes(long, "a", gap=0.25).select("id", "model", "g", "h"))


@query()
def x1_linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC by fold of a linear score that all pairs of the other folds have fitted, and of its start."""
    df = labelled_documents(spark, sf_dir)
    scaled = standardised(df, df, DOCUMENT_FEATURES)
    scored, _ = objectives.linear_pair_fit(scaled, DOCUMENT_FEATURES)
    return r6(auc(scored, "score", ["fold"]).select("fold", "auc", F.lit(0.5).alias("start")))


@query()
def x1_boosted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC by fold of trees that all pairs of the other folds have grown."""
    fitted = boosting.boost(labelled_documents(spark, sf_dir), DOCUMENT_FEATURES, loss=objectives.PAIRS, rounds=3, depth=2, rate=0.5)
    return r6(auc(fitted.rows, "margin", ["fold"]).select("fold", "auc", "pairs"))


@query(
    f"""with {FOLDED}, o as (select *, md5('ots:' || id) as h from folded), t as (select id, coalesce(sum(case when fold <> 0 then y end) over (partition by pri order by h, id rows between unbounded preceding and 1 preceding), 0) as bt,
    count(case when fold <> 0 then y end) over (partition by pri order by h, id rows between unbounded preceding and 1 preceding) as bn,
    coalesce(sum(case when fold <> 0 then y end) over (partition by pri), 0) as total, count(case when fold <> 0 then y end) over (partition by pri) as an, fold from o)
    select id, round((case when fold <> 0 then bt else total end + 0.5) / (case when fold <> 0 then bn else an end + 1), 9) as ots from t"""
)
def g3_ordered_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category's mean label from rows before a row's own; the rows of one fold see all others."""
    return encodings.ordered_statistics(folded(spark, sf_dir), "pri", "ots", source=F.col("fold") != 0).select("id", F.round("ots", 9).alias("ots"))


@query()
def g3_ordered_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC by fold of boosted trees on numbers and on ordered statistics of categories, for each of two folds."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source").dropDuplicates(["id"])
    df = labelled_documents(spark, sf_dir).join(docs, "id")
    return r6(auc(compositions.ordered_boost(df, DOCUMENT_FEATURES, ["lang", "source"], only=[0, 1], rounds=3, depth=2, rate=0.5), "margin", ["fold"]).select("fold", "auc", "pairs"))


def _forest_sql(depth: int) -> str:
    """CTEs that end with ``at<depth>(id, m, fold, node)`` and ``leaves(m, node, value)`` for one tree a fold."""
    features = ["price", "a", "b"]
    long = " union all ".join(f"select id, {i} as f, {f}::double as v from folded" for i, f in enumerate(features))
    entropy = lambda k, n: f"(case when {k} > 0 then -({k}) * ln(({k}) / ({n})) else 0 end + case when {n} - ({k}) > 0 then -({n} - ({k})) * ln(({n} - ({k})) / ({n})) else 0 end)"
    out = f"{FOLDED}, long as ({long}), ms as (select distinct fold as m from folded), at0 as (select id, m, fold, y, 1 as node from folded, ms)"
    for d in range(depth):
        out += f""", here{d} as (select a.id, m, node, y::double as y, f, v from at{d} a join long using (id) where fold <> m and node >= {1 << d} and {u_sql("'extra:draw:' || m || ':' || node || ':' || f")} < 0.7),
        cuts{d} as (select m, node, f, min(v) + {u_sql("'extra:' || m || ':' || node || ':' || f")} * (max(v) - min(v)) as cut from here{d} group by m, node, f having max(v) > min(v)),
        sums{d} as (select m, node, f, cut, count(*)::double as n, sum(y) as t, count(*) filter (v <= cut)::double as ln, coalesce(sum(y) filter (v <= cut), 0) as lt from here{d} join cuts{d} using (m, node, f) group by all),
        best{d} as (select m, node, f, cut from (select *, floor(({entropy("t", "n")} - {entropy("lt", "ln")} - {entropy("(t - lt)", "(n - ln)")}) * 1e9 + 0.5) / 1e9 as gain from sums{d} where least(ln, n - ln) >= 4)
                    where gain > 0 qualify row_number() over (partition by m, node order by gain desc, f) = 1),
        at{d + 1} as (select a.id, a.m, fold, y, case when s.f is null then a.node else 2 * a.node + (v > cut)::int end as node from at{d} a left join best{d} s on s.m = a.m and s.node = a.node left join long l on l.id = a.id and l.f = s.f)"""
    return out + f", leaves as (select m, node, avg(y) as value from at{depth} where fold <> m group by m, node)"


@query(f"with {_forest_sql(2)} select id, round(value, 9) as score from at2 join leaves using (m, node) where fold = m")
def g4_extra_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree of two levels a fold, of drawn thresholds."""
    df = folded(spark, sf_dir)
    forest = forests.grow(df, ["price", "a", "b"], trees=1, depth=2, share=0.7)
    return forests.score(forest, df, ["price", "a", "b"]).select("id", F.round("score", 9).alias("score"))


@query()
def g4_extra_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC by fold of 40 trees each. Texts are read once for growing and scoring."""
    df = stored(labelled_documents(spark, sf_dir), "documents")
    return r6(auc(forests.score(forests.grow(df, DOCUMENT_FEATURES, depth=3), df, DOCUMENT_FEATURES), "score", ["fold"]).select("fold", "auc", "pairs"))


_SHAPES = boost_sql("ln(p / (1 - p))", _LOGISTIC, 3, 2, 0.3, 1.0, 16, features=["price", "a", "r0"], turns=[0, 1, 2])


@query(f"with {_SHAPES} select id, round(s, 9) as margin from margins3 where fold = m")
def x9_shape_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn of three features, each a tree of its own."""
    names = ["price", "a", "r0"]
    fitted = boosting.boost(folded(spark, sf_dir), names, turns=[[f] for f in names], depth=2, rate=0.3, bins=16)
    return fitted.rows.select("id", F.round("margin", 9).alias("margin"))


@query(
    f"""with {_SHAPES}, slopes as (select id, m, floor(g / 1e-7 + 0.5)::bigint as g, floor(h / 1e-7 + 0.5)::bigint as h from (select *, {_LOGISTIC} from margins3) where fold <> m),
    cells as (select m, x.f as f1, z.f as f2, sum(g)::bigint as g, sum(h)::bigint as h from slopes join bins x using (id) join bins z using (id) where x.f < z.f group by m, x.f, z.f, x.b // 4, z.b // 4),
    gains as (select m, f1, f2, round((sum((g * 1e-7) * (g * 1e-7) / (h * 1e-7 + 1)) - (sum(g) * 1e-7) * (sum(g) * 1e-7) / (sum(h) * 1e-7 + 1)) / 2, 6) as gain from cells group by all)
    select m as fold, ['price', 'a', 'r0'][f1 + 1] as f1, ['price', 'a', 'r0'][f2 + 1] as f2, gain, (row_number() over (partition by m order by gain desc, gains.f1, gains.f2))::int as rank from gains"""
)
def x9_pair_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by what they would take off the loss that one turn has left."""
    names = ["price", "a", "r0"]
    fitted = boosting.boost(folded(spark, sf_dir), names, turns=[[f] for f in names], depth=2, rate=0.3, bins=16)
    return additive.pair_gains(fitted)


@query()
def x9_additive_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC by fold of shapes of single features, and of those with the best pairs."""
    single, both, _ = additive.fit(labelled_documents(spark, sf_dir), DOCUMENT_FEATURES, cycles=1, pairs=1, pair_cycles=1)
    rows = [f.rows.select("fold", "y", "margin", F.lit(n).alias("kind")) for n, f in (("single", single), ("pairs", both))]
    return r6(auc(rows[0].union(rows[1]), "margin", ["kind", "fold"]).select("kind", "fold", "auc"))
