"""Arrays of NumPy files pass through driver and tasks in pieces."""

import io
import tracemalloc

import numpy as np
import pytest

from quern.plans import source_queries
from quern.sources import tables


def test_the_driver_holds_a_piece_of_an_array(spark, monkeypatch):
    n = 2_000_000
    monkeypatch.setattr(source_queries, "base", lambda spark, sf_dir: spark.range(n))
    tracemalloc.start()
    out = source_queries.io4_numpy_members(spark, "")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * n * 8 / 2  # before: all arrays at once, and their files
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "strategy=merge" in plan  # before: a file was a value of one row
    got = {r[0]: tuple(r[1:]) for r in out.groupBy("model").agg({"score": "sum", "*": "count", "id": "max"}).select("model", "sum(score)", "count(1)", "max(id)").collect()}
    total = n * (n - 1) / 2
    assert got == {"plain": (total / 8, n, n - 1), "many/half": (total / 2, n, n - 1), "many/zero": (0.0, n, n - 1)}


def test_arrays_are_dealt_in_spans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "CHUNK", 100)
    monkeypatch.setattr(tables, "SPAN", 250)
    tables.save_npy(spark, f"file://{tmp_path}/a b.npz", 1000, {"half": lambda p: p / 2, "zero": lambda p: p * 0.0})
    with np.load(f"{tmp_path}/a b.npz") as found:
        assert found.files == ["half", "zero"] and (found["half"] == np.arange(1000) / 2).all() and not found["zero"].any()
    content = (tmp_path / "a b.npz").read_bytes()
    spans = list(tables._spans(io.BytesIO(content), "x/a b.npz"))
    assert [(s[0], s[4], s[5]) for s in spans] == [(m, i * 250, 250) for m in ("a b/half", "a b/zero") for i in range(4)]
    found = [b for s in spans for b in tables._values(io.BytesIO(content), *s)]
    assert max(b.num_rows for b in found) == 100 and [x for b in found for x in b["score"].to_pylist()] == [i / 2 for i in range(1000)] + [0.0] * 1000
    half = content.index((np.arange(500, 510) / 2).tobytes())
    with pytest.raises(Exception, match="CRC"):
        list(tables._spans(io.BytesIO(content[:half] + b"x" + content[half + 1 :]), "x.npz"))


@pytest.mark.parametrize("arrow", [True, False])
def test_arrays_of_all_kinds(spark, tmp_path, monkeypatch, arrow):
    if not arrow:  # a file system that only Spark can open
        monkeypatch.setattr(tables, "_by_arrow", lambda spark, path: None)
    np.savez_compressed(tmp_path / "packed%20.npz", q=np.arange(4), r=np.array([True, False]))
    np.save(tmp_path / "big end.npy", np.array([1, np.nan, 3], ">f4"))
    np.save(tmp_path / "none.npy", np.zeros(0))
    tables.save_npy(spark, f"file://{tmp_path}/made.npy", 5, lambda p: p + 0.5)
    got = tables.npy_members(spark, f"file://{tmp_path}", spark.range(9, 6, -1).union(spark.range(8, 9)))
    assert sorted((r["model"], r["id"], r["score"]) for r in got.collect()) == [
        ("big end", 7, 1.0), ("big end", 8, None), ("big end", 9, 3.0), ("made", 7, 0.5), ("made", 8, 1.5), ("made", 9, 2.5),
        ("packed%20/q", 7, 0.0), ("packed%20/q", 8, 1.0), ("packed%20/q", 9, 2.0), ("packed%20/r", 7, 1.0), ("packed%20/r", 8, 0.0),
    ]
    np.save(tmp_path / "wide.npy", np.zeros((2, 2)))
    with pytest.raises(Exception, match="one dimension"):
        tables.npy_members(spark, f"file://{tmp_path}", spark.range(3)).collect()
