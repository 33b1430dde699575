"""A view holds exactly what its blocks declare, and labels stay within their provenance."""

import pytest
from pyspark.sql import functions as F

from quern.operators import folds, views


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, i % 2, i % 7, "ab"[i % 2] if i % 5 else None, float(i * i % 97)) for i in range(80)]
    return folds.stratified(spark.createDataFrame(rows, "id long, y int, k long, g string, v double"), 4, "s").persist()


BLOCKS = [views.value_counts(["g"]), views.digits("v"), views.key_means("k", ["v"]), views.category_codes(["g"]), views.encoded([["k"], ["k", "g"]])]


def test_columns_are_those_of_the_blocks(df):
    view = views.assemble(df, BLOCKS)
    assert view.columns[:3] == ["id", "y", "fold"]
    assert set(view.columns[3:]) == {"count_g", "v_step_250", "v_step_1000", "v_last", "v_length", "v_is_zero", "mean_v_by_k", "gap_v_by_k", "code_g", "te_k", "te_k_g"}
    assert view.count() == 80


def test_only_fold_blocks_read_labels(df):
    turned = df.withColumn("y", 1 - F.col("y"))
    for b in BLOCKS:
        one, two = (sorted(map(str, b.make(d).collect())) for d in (df, turned))
        assert (one == two) == (b.provenance != "fold")


def test_provenance_and_repeats_are_refused(df):
    with pytest.raises(ValueError, match="fold block"):
        views.assemble(df, BLOCKS, allowed=("static", "transductive"))
    with pytest.raises(ValueError, match="two blocks"):
        views.assemble(df, [BLOCKS[0], BLOCKS[0]])
