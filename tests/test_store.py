"""What is stored stays, and changed files are found."""

import glob

import pytest

from quern.functions import keys, scalars
from quern.operators import encodings, views
from quern.operators.folds import digest
from quern.sources import scratch, tables
from quern.sources.store import FoldRegistry, Ledger, ScoreStore, fingerprint
from pyspark.sql import functions as F


@pytest.fixture
def scores(spark):
    return spark.createDataFrame([(1, 0.25), (2, 0.5)], "id long, score double")


def test_store_is_immutable(spark, tmp_path, scores):
    store = ScoreStore(spark, f"file://{tmp_path}/s")
    first = store.save("a", scores)
    assert store.save("a", scores.repartition(2)) == first
    with pytest.raises(ValueError, match="other content"):
        store.save("a", scores.withColumn("score", F.lit(0.1)))
    store.save("b", scores)
    assert [(r["exp_id"], r["duplicate_of"]) for r in store.index().collect()] == [("a", None), ("b", "a")]
    assert store.pool().count() == 2
    assert sorted(r["score"] for r in store.load("a").collect()) == [0.25, 0.5]
    scores.withColumn("score", F.lit(0.9)).write.mode("overwrite").parquet(f"{tmp_path}/s/scores/exp_id=a")
    with pytest.raises(ValueError, match="changed"):
        store.load("a")


def test_an_interrupted_save_can_be_done_again(spark, tmp_path, scores):
    """Files without an index entry, whole or not, do not block their id."""
    scores.where("id = 1").write.parquet(f"{tmp_path}/s/scores/exp_id=x")
    store = ScoreStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(KeyError):
        store.load("x")
    store.save("x", scores)
    assert store.load("x").count() == 2


def test_folds_cannot_be_changed(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, fold int")
    registry = FoldRegistry(spark, f"file://{tmp_path}/f")
    assert registry.register("p", df) == registry.register("p", df.repartition(3))
    with pytest.raises(ValueError, match="other content"):
        registry.register("p", df.withColumn("fold", 2 - F.col("fold")))
    assert sorted(map(tuple, registry.load("p").collect())) == [(i, i % 3) for i in range(9)]


def test_a_crowned_champion_stays(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.champion() is None and ledger.may_run("f")
    ledger.log("a", "done", "f", 0.7)
    ledger.log("b", "done", "g", 0.6)
    ledger.crown("b")
    assert ledger.champion() == "b"
    with pytest.raises(ValueError, match="not finished"):
        ledger.crown("c")


def test_features_are_made_again_if_unreadable(spark, tmp_path, scores):
    path, calls = f"{tmp_path}/features", []
    make = lambda: calls.append(1) or scores
    for _ in range(2):
        assert tables.cached_features(spark, path, make).count() == 2
    assert len(calls) == 1
    tables.save_json(spark, path + "/names", ["id"])
    assert tables.cached_features(spark, path, make).columns == ["id", "score"] and len(calls) == 2


def test_what_an_application_stored_is_in_one_folder(spark, scores):
    kept = scratch.stored(scores, "kept")
    assert kept.count() == 2 and all(f"/quern/{spark.sparkContext.applicationId}/kept-" in f for f in kept.inputFiles())


def test_names_are_resolved_once(spark):
    assert keys.resolved(["Cust Id", "AMOUNT "], {"id": ["cust-id"], "amount": []}) == {"id": "Cust Id", "amount": "AMOUNT "}
    with pytest.raises(ValueError, match="one column is needed"):
        keys.resolved(["a", "A"], {"a": []})


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    run = fingerprint(seed=1, data="d")
    assert run == fingerprint(data="d", seed=1) != fingerprint(data="d", seed=2)
    ledger.log("a", "running", run)
    assert not ledger.may_run(run)
    ledger.log("a", "failed", run)
    assert ledger.may_run(run)
    ledger.log("b", "done", "f", 0.7)
    ledger.log("c", "done", "g", 0.8)
    assert ledger.champion() == "c"
    with pytest.raises(ValueError, match="status"):
        ledger.log("a", "perhaps")


def test_alignment_refuses_repeats_and_gaps(spark, scores):
    ids = scores.select("id")
    assert tables.aligned(ids, scores).count() == 2
    with pytest.raises(ValueError, match="repeat"):
        tables.aligned(ids, scores.union(scores))
    with pytest.raises(ValueError, match="no score"):
        tables.aligned(ids, scores.where("id = 1"))


def test_checks_fail_loudly(spark, scores):
    assert tables.checked(scores, {"ok": F.col("score") < 1}).count() == 2
    with pytest.raises(Exception, match="breaks the rule: low"):
        tables.checked(scores, {"low": F.col("score") < 0.3}).collect()


def test_score_pool_of_several_kinds(spark, tmp_path, scores):
    scores.write.parquet(f"{tmp_path}/p")
    scores.write.option("header", True).csv(f"{tmp_path}/c")
    pool = tables.score_pool(spark, {"p": (f"{tmp_path}/p", "parquet"), "c": (f"{tmp_path}/c", "csv")})
    assert sorted(map(tuple, pool.collect())) == [(1, "c", 0.25), (1, "p", 0.25), (2, "c", 0.5), (2, "p", 0.5)]


def test_csv_is_converted_once(spark, tmp_path, scores):
    scores.write.option("header", True).csv(f"{tmp_path}/c")
    read = lambda: tables.cached_parquet(spark, f"{tmp_path}/c", f"{tmp_path}/q", "id long, score double")
    assert read().count() == 2
    files = glob.glob(f"{tmp_path}/q/*.parquet")
    assert read().count() == 2 and glob.glob(f"{tmp_path}/q/*.parquet") == files


def test_exact_values_stay_apart(spark):
    df = spark.createDataFrame([(1.0000000001,), (1.0000000002,), (761.0,), (761.5,), (None,)], "v double")
    got = [r[0] for r in df.select(keys.exact_label(F.col("v"))).collect()]
    assert len(set(got)) == 5 and got[2] == "761" and got[4] == "__NA__"


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.sigmoid(scalars.logit(F.lit(0.3))), scalars.normal_tail(F.lit(1.6448536)), scalars.finite(F.lit(float("inf"))), scalars.to_number(F.lit("x")),
        scalars.binary_label(F.lit(" Yes "), ("yes",), ("no",)),
    ).first()
    assert abs(row[0] - 0.3) < 1e-12 and abs(row[1] - 0.05) < 1e-7 and tuple(row[2:]) == (1e9, None, 1)


def test_digests_tell_values_apart(spark):
    one = lambda rows: digest(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first()["digest"]
    found = [one([r]) for r in (("a|b", "c"), ("a", "b|c"), (None, "x"), ("~", "x"), ("-", "x"), ("", "x"), ("1:-", "x"), (None, "-x"))]
    assert len(set(found)) == len(found)
    assert one([("a", "b"), ("c", None)]) == one([("c", None), ("a", "b")])


def test_a_change_of_any_size_is_refused(spark, tmp_path):
    store = ScoreStore(spark, f"file://{tmp_path}/s")
    scores = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id long, score double")
    store.save("e", scores)
    store.save("e", scores)
    with pytest.raises(ValueError):
        store.save("e", scores.withColumn("score", scores["score"] + 1e-14))


def test_many_entries_at_once(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    rows = [("a", "running", "f", None, "", "1"), ("a", "failed", "f", None, "", "2"), ("b", "done", "g", 0.5, "", "1")]
    with pytest.raises(ValueError):
        ledger.extend(spark.createDataFrame([*rows, ("c", "odd", "h", None, "", "1")], Ledger.SCHEMA))
    assert ledger.rows().count() == 0
    ledger.extend(spark.createDataFrame(rows, Ledger.SCHEMA))
    assert {r["fingerprint"]: r["may_run"] for r in ledger.policy().collect()} == {"f": True, "g": False}


def test_repeated_ids_are_refused(spark):
    df = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 0, "b"), (2, 0, 1, "a")], "id long, fold int, y int, c string")
    for make in (lambda: encodings.encoded_keys(df, {"c": [df["c"]]}), lambda: encodings.conditional_ordinal(df, ["y"], "c"), lambda: views.assemble(df, [])):
        with pytest.raises(ValueError, match="repeats"):
            make()
