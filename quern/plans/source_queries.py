"""Queries that go through files: readers, caches, the score store, the ledger and the fold registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import folds
from quern.operators.ordered import numbered
from quern.plans.base import BASE, FOLDED, base, folded, query, r6
from quern.sources import tables
from quern.sources.scratch import new_path
from quern.sources.store import FoldRegistry, Ledger, ScoreStore, fingerprint
from quern.sources.tables import table


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def io1_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as CSV with a header, read again by a schema."""
    path = new_path(spark, "csv")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    s.write.option("header", True).csv(path)
    return tables.read(spark, path, "csv", s.schema)


@query("select substr(sha256('r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',' || r_name || chr(10), '' order by r_regionkey)), 1, 16) as hash, 2 as files from region")
def io1_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of equal content have equal hashes of 16 digits, whatever they are called."""
    path = new_path(spark, "hash")
    for name in ("one", "two"):
        table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").coalesce(1).write.option("header", True).csv(f"{path}/{name}")
    return tables.content_hash(spark, f"{path}/*/*.csv").groupBy("hash").agg(F.count("*").cast("int").alias("files"))


@query("select c_custkey, c_mktsegment from customer")
def io2_cached_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file is converted on first use; the second read finds the cache, and reads two of its columns."""
    path = new_path(spark, "cache")
    c = table(spark, sf_dir, "customer")
    c.write.option("header", True).csv(path + "/csv")
    tables.cached_parquet(spark, path + "/csv", path + "/parquet", c.schema)
    return tables.cached_parquet(spark, path + "/none", path + "/parquet", c.schema).select("c_custkey", "c_mktsegment")


@query(f"with {BASE} select id, 'csv' as model, a as score from base union all select id, 'parquet', b from base")
def io4_score_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score files of two kinds as one table."""
    path, df = new_path(spark, "pool"), base(spark, sf_dir)
    df.select("id", F.col("a").alias("p")).write.option("header", True).csv(path + "/csv")
    df.select("id", F.col("b").alias("q")).write.parquet(path + "/parquet")
    return tables.score_pool(spark, {"csv": (path + "/csv", "csv"), "parquet": (path + "/parquet", "parquet")})


@query(f"with {BASE}, p as (select id, row_number() over (order by id) - 1 as place from base) select id, 'plain' as model, place / 8.0::double as score from p union all select id, 'many/half', place / 2.0::double from p union all select id, 'many/zero', 0.0::double from p")
def io4_numpy_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of NumPy files, aligned with sorted ids."""
    path, ids = new_path(spark, "npy"), base(spark, sf_dir).select("id")
    n = ids.count()
    tables.save_npy(spark, f"{path}/plain.npy", n, lambda place: place / 8)
    tables.save_npy(spark, f"{path}/many.npz", n, {"half": lambda place: place / 2, "zero": lambda place: place * 0.0})
    return tables.npy_members(spark, path, ids)


@query(f"with {BASE} select id, r0 + r1 as both from base")
def io5_feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made once; the second call reads the table and its names."""
    path = new_path(spark, "features")
    tables.cached_features(spark, path, lambda: base(spark, sf_dir).select("id", (F.col("r0") + F.col("r1")).alias("both")))
    return tables.cached_features(spark, path, lambda: base(spark, sf_dir).select("id").limit(0))


@query("select count(*) as orders, max(o_orderpriority) as priority from orders")
def io6_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "json")
    row = table(spark, sf_dir, "orders").agg(F.count("*"), F.max("o_orderpriority")).first()
    tables.save_json(spark, path, {"orders": row[0], "priority": row[1]})
    found = tables.load_json(spark, path)
    return spark.createDataFrame([(found["orders"], found["priority"])], "orders bigint, priority string")


_ENTRIES = f"""{BASE}, entries as (select 'c' || o_custkey as exp_id, case o_orderstatus when 'F' then 'done' when 'O' then 'running' else 'failed' end as status, 'f' || (o_custkey % 97) as fingerprint,
    floor((o_totalprice % 1000) / 10) / 100.0::double as auc, strftime(o_orderdate, '%Y-%m-%d') || '#' || lpad(o_orderkey::varchar, 12, '0') as utc from orders),
    latest as (select * from entries qualify row_number() over (partition by exp_id order by utc desc) = 1)"""


def _ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """Orders as a ledger: a customer's orders are the runs of an experiment."""
    ledger, o = Ledger(spark, new_path(spark, "ledger")), table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    utc = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("#"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    ledger.extend(
        o.select(
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("exp_id"), status.alias("status"), F.concat(F.lit("f"), (F.col("o_custkey") % 97).cast("string")).alias("fingerprint"),
            (F.floor((F.col("o_totalprice") % 1000) / 10) / 100.0).alias("auc"), F.lit("").alias("note"), utc.alias("utc"),
        )
    )
    return ledger


@query(f"with {_ENTRIES} select exp_id, status, auc from entries")
def io7_ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).rows().select("exp_id", "status", "auc")


@query(f"with {_ENTRIES}, p as (select fingerprint, not bool_or(status in ('done', 'running')) as may_run from latest group by fingerprint) select exp_id, status, may_run from latest join p using (fingerprint)")
def io8_latest_and_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest status of each experiment, and whether its inputs may run again."""
    ledger = _ledger(spark, sf_dir)
    return ledger.latest().join(ledger.policy(), "fingerprint").select("exp_id", "status", "may_run")


@query(
    f"""with {_ENTRIES}, done as (select * from latest where status = 'done')
    select 'best' as kind, (select exp_id from done order by auc desc, utc, exp_id limit 1) as exp_id union all select 'crowned', (select min(exp_id) from done)"""
)
def io18_champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger(spark, sf_dir)
    best = ledger.champion()
    ledger.crown(ledger.latest().where("status = 'done'").agg(F.min("exp_id")).first()[0])
    return spark.createDataFrame([("best", best), ("crowned", ledger.champion())], "kind string, exp_id string")


def _store(spark: SparkSession, sf_dir: str) -> ScoreStore:
    df = base(spark, sf_dir)
    store = ScoreStore(spark, new_path(spark, "store"))
    for exp, column in (("m1", "a"), ("m2", "b"), ("m3", "a")):
        store.save(exp, df.select("id", F.col(column).alias("score")))
    return store


@query(f"with {BASE} select id, b as score from base")
def io10_stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as they come back, digest checked."""
    return _store(spark, sf_dir).load("m2")


def _digest(c: str) -> str:
    return f"(select sum(('0x' || substr(md5(length(id::varchar) || ':' || id || length({c}::varchar) || ':' || {c}), 1, 12))::bigint)::varchar from base)"


@query(f"with {BASE} select e as exp_id, (select count(*) from base) as n, d as digest, t as duplicate_of from (values ('m1', {_digest('a')}, null), ('m2', {_digest('b')}, null), ('m3', {_digest('a')}, 'm1')) v(e, d, t)")
def io12_store_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).index()


@query(f"with {BASE} select id, 'm1' as model, a as score from base union all select id, 'm2', b from base")
def io11_pool_without_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).pool()


@query("""select sha256('{"config":{"k":5,"seed":7},"data":"abc","folds":"' || (select count(*) from region) || '"}') as fingerprint""")
def io14_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = fingerprint(folds=str(table(spark, sf_dir, "region").count()), data="abc", config={"seed": 7, "k": 5})
    return spark.createDataFrame([(mark,)], "fingerprint string")


@query(
    f"""with {BASE}, one as (select a, y, count(*) as n from base group by all), two as (select b, y, count(*) as n from base group by all),
    x as (select sum(o.n * z.n * case when o.a > z.a then 1 when o.a = z.a then 0.5::double else 0 end) / sum(o.n * z.n) as v from one o, one z where o.y = 1 and z.y = 0),
    w as (select sum(o.n * z.n * case when o.b > z.b then 1 when o.b = z.b then 0.5::double else 0 end) / sum(o.n * z.n) as v from two o, two z where o.y = 1 and z.y = 0)
    select round(w.v - x.v, 6) as delta, (select round(corr(a, b), 6) from base) as r from x, w"""
)
def io19_logged_against_champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain over the champion and correlation with it, as logged."""
    df, store = base(spark, sf_dir).select("id", "y"), _store(spark, sf_dir)
    ledger = Ledger(spark, new_path(spark, "ledger"))
    ledger.log_scores("m1", store, df)
    ledger.log_scores("m2", store, df)
    note = ledger.rows().where("exp_id = 'm2'").select(F.from_json("note", "delta double, corr double").alias("n"))
    return r6(note.select("n.delta", F.col("n.corr").alias("r")))


@query(f"with {FOLDED} select id, fold from folded")
def v2_fold_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered folds as they come back; the same folds again are accepted."""
    registry, df = FoldRegistry(spark, new_path(spark, "folds")), folded(spark, sf_dir)
    for _ in range(2):
        registry.register("primary", df)
    return registry.load("primary")


@query(f"with {FOLDED} select bool_or(fold <> (fold + 1) % 5) as refused, count(*) as n, count(*) filter (fold = 0) as first_fold from folded")
def v2_refused_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other folds under a registered name are refused, and what is registered stays as it was."""
    registry, df = FoldRegistry(spark, new_path(spark, "folds")), folded(spark, sf_dir)
    registry.register("primary", df)
    try:
        registry.register("primary", df.withColumn("fold", (F.col("fold") + 1) % 5))
        refused = False
    except ValueError:
        refused = True
    kept = registry.load("primary")
    return kept.agg(F.lit(refused).alias("refused"), F.count("*").alias("n"), F.count_if(F.col("fold") == 0).alias("first_fold"))


@query(f"with {BASE} select id, (row_number() over (order by id) - 1) as place from base")
def k1_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(base(spark, sf_dir).select("id"), "id", "place")


@query(f"with {FOLDED} select fold, count(*) as n, sum(('0x' || substr(md5(length(id::varchar) || ':' || id || length(a::varchar) || ':' || a), 1, 12))::bigint)::varchar as digest from folded group by fold")
def io13_digest_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = folded(spark, sf_dir), None
    for f in range(5):
        part = folds.digest(df.where(F.col("fold") == f), ["id", "a"]).withColumn("fold", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out
