"""Several encodings or fits over one table move its rows once, not once for each."""

from pyspark.sql import functions as F

from quern.operators import encodings


def test_default_keys_join_no_two_tables_of_all_rows(spark):
    df = spark.range(400).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") % 7).alias("k"), F.when(F.col("id") % 11 > 0, F.col("id") % 11).alias("l"))
    got = encodings.encoded_keys(df, {"k": [F.col("k")], "l": [F.col("l")], "kl": [F.col("k"), F.col("l")]})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 3  # each key's sums once, before: 3 for each key
    for name, key in (("k", ["k"]), ("l", ["l"]), ("kl", ["k", "l"])):
        one = encodings.crossfit(df.withColumn("_k", encodings.joined_key([F.col(c) for c in key])), "_k", [20], source=F.lit(True))
        want = {r["id"]: r["te_20"] for r in one.collect()}
        assert all(abs(r[f"te_{name}"] - want[r["id"]]) < 1e-12 for r in got.collect())
