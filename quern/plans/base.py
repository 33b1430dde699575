"""What the queries share: the registry, the labelled table made of ``orders``, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.keys import digits_of
from quern.operators import folds
from quern.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with its SQL, in which ``round(x, digits)`` stands for the rounding of ``r6``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("round(", "round((").replace(", 9)", "), 9)").replace(", 6)", ") + 1e-9, 6)").replace(", 4)", ") + 1e-9, 4)")
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles at six digits. Both engines add 1e-9 first: exact halves and signed zeros then round alike."""
    return df.select(*(rounded(c, 6) if t == "double" else c for c, t in df.dtypes))


def rounded(c: str, digits: int = 4) -> Column:
    return F.round(F.col(c) + 1e-9, digits).alias(c)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a labelled table: id, label y, keys, two scores with ties, and rating digits of the customer."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderpriority").alias("pri"),
        price.alias("price"),
        F.col("o_orderdate").cast("date").alias("day"),
        (F.floor((price % 1000) / 10) / 100.0).alias("a"),
        (F.floor((price % 777) / 7.77) / 100.0).alias("b"),
        *(d.alias(f"r{i}") for i, d in enumerate(digits_of(F.col("o_custkey"), 6, DIGITS))),
    )


def folded(spark: SparkSession, sf_dir: str, k: int = 5, seed: str = "primary") -> DataFrame:
    return folds.stratified(base(spark, sf_dir), k, seed)


_DIGITS_SQL = ", ".join(f"((o_custkey // {6**i}) % 6)::int as r{i}" for i in range(DIGITS))
BASE = f"""base as (
    select o_orderkey as id, (o_orderstatus = 'F')::int as y, o_custkey as cust, o_orderpriority as pri, o_totalprice as price, o_orderdate::date as day,
           floor((o_totalprice % 1000) / 10) / 100.0::double as a, floor((o_totalprice % 777) / 7.77::double) / 100.0::double as b, {_DIGITS_SQL}
    from orders)"""
FOLDED = (
    BASE
    + """, folded as (
    select *, ((row_number() over (partition by y order by md5('primary:' || id), id) - 1) % 5)::int as fold from base)"""
)
ES = (
    FOLDED
    + """, es as (
    select *, row_number() over (partition by fold, y order by md5('stop:' || id), id) - 1 < floor(count(*) over (partition by fold, y) * 0.1::double) as is_es from folded)"""
)


def u_sql(text: str) -> str:
    """The draw of ``functions.scalars.uniform`` for a SQL text."""
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0::double)"


def ranked_sql(name: str, source: str, by: str = "model") -> str:
    """CTE ``name(*by, auc)`` of tie-exact AUCs of ``source(*by, y, s)``, with two more before it."""
    return f"""{name}_n as (select {by}, s, sum(y)::double as p, sum(1 - y)::double as q from {source} group by all),
    {name}_o as (select *, coalesce(sum(q) over (partition by {by} order by s rows between unbounded preceding and 1 preceding), 0) as q_before from {name}_n),
    {name} as (select {by}, sum(p * (q_before + q / 2)) / (sum(p) * sum(q)) as auc from {name}_o group by {by})"""


def auc_sql(source: str, score: str, by: str = "", weight: str = "1") -> str:
    """CTEs ``counts`` and ``auc`` of a tie-exact AUC."""
    part, keys = (f"partition by {by}", f"{by}, ") if by else ("", "")
    return f"""counts as (
        select {keys}{score} as s, sum({weight} * y)::double as p, sum({weight} * (1 - y))::double as q from {source} group by {keys}{score}
    ), ordered as (
        select *, coalesce(sum(q) over ({part} order by s rows between unbounded preceding and 1 preceding), 0) as q_before from counts
    ), auc as (
        select {keys}sum(p * (q_before + q / 2)) as good, sum(p) * sum(q) as pairs from ordered {"group by " + by if by else ""})"""
