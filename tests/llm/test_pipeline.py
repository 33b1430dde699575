"""The pipeline against a plain Python version of its stages, and the queries against their SQL."""

import hashlib
import os
import random
import re
from collections import Counter
from math import floor

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quern.llm import quality
from quern.llm.common import new_path
from quern.llm.queries import QUERIES, SQL
from .test_operators import fill, prose, roots, simhash_by_hand

DATA = "/root/testdata/sf0.001"


def draw(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def mixed_by_hand(rows):
    """doc_id -> copies, one row after the other in the order of the operator."""
    size = {i: len(t.split()) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    target, out = fill(sizes), Counter()
    for s in sizes:
        start = draw("mix:" + ("-" if s is None else "=" + s)) / 4294967296
        each = target[s] / sizes[s] if sizes[s] else 0.0

        def place(i):
            step = max(0, len(f"{size[i]:b}") - 7)
            return size[i] >> step << step, draw(str(i)) % 256, size[i], draw(str(i)), i

        for k, i in enumerate(sorted((i for i, _, x in rows if x == s), key=place), 1):
            out[i] = min(3, floor(start + each * k) - floor(start + each * (k - 1)))
    return out


def test_pipeline(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(30, 120)) + "." for _ in range(200)]
    texts += texts[:20] + [t.upper().replace(" ", "!! ") for t in texts[20:60]]
    item = prose(rng, 25)
    texts[5] += " " + item
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(texts)]
    labels = [(i, int(i < 220)) for i in range(len(rows))]
    path = new_path(spark, "sf")
    spark.createDataFrame([(*r, "en", len(r[1])) for r in rows], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    docs, marks = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, marks)
    left = [r for r in rows if model.probability(r[1].encode()) >= 0.7]
    assert {r[0] for r in left} == set(range(220))
    fps = [simhash_by_hand(t) for _, t, _ in left]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    first = roots(len(fps), links)
    left = [r for k, r in enumerate(left) if first[k] == k]
    norm = " ".join(re.findall(r"\w+", item))
    left = [r for r in left if norm not in " ".join(re.findall(r"\w+", r[1].lower()))]
    assert {r[0] for r in left} == set(range(200)) - {5} | {205}
    want = mixed_by_hand(left)

    got = corpus_pipeline.run(spark, path).collect()
    assert Counter(r["doc_id"] for r in got) == +want
    text = {i: t for i, t, _ in rows}
    assert all(r["text"] == text[r["doc_id"]] for r in got)
    total = sum(len(r["text"]) + 1 for r in got)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += len(r["text"]) + 1
    assert all(abs(s - total / 16) < 900 for s in sizes.values())
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got)


def test_pipeline_of_awkward_rows(spark):
    """Nulls in every column, blank and very long texts, repeated ids and rows, clashing names; and empty tables."""
    rng = random.Random(13)
    texts = [prose(rng, 60) + "." for _ in range(30)] + [None, "", " \n", "word " * 60_000 + "."]
    rows = [(i, t, f"s{i % 3}", "en") for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None), (5, texts[6], "s1", "en"), (7, texts[7], "s1", "en"), (40, prose(rng, 60), None, None), (40, prose(rng, 61), None, None)]
    schema = "doc_id long, text string, source string, lang string, _q_row string, doc string"
    path = new_path(spark, "sf")
    spark.createDataFrame([(*r, "clash", None) for r in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[2].split()[:25])), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    one = corpus_pipeline.one_of_each_group(spark, docs, path).collect()
    key = lambda found: sorted(((r["doc_id"], (r["text"] or "").strip()) for r in found), key=str)
    want = [(5 if i == 6 else i, t) for i, t in enumerate(texts) if i not in (31, 32)] + [r[:2] for r in rows[-2:]]
    assert key(one) == sorted(((i, (t or "").strip()) for i, t in want), key=str)
    clean = corpus_pipeline.without_benchmark(spark, docs, path).collect()
    assert key(clean) == sorted(((r[0], (r[1] or "").strip()) for r in rows if r[0] != 2), key=str)
    got = corpus_pipeline.run(spark, path)
    assert got.columns == [*docs.columns, "shard", "slot"]
    found = got.collect()
    assert {r["doc_id"] for r in found} <= {i for i, _ in want} and 2 not in {r["doc_id"] for r in found}
    assert len({(r["shard"], r["slot"]) for r in found}) == len(found) > 20 and {r["_q_row"] for r in found} == {"clash"}
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{path}/none").count() == 0


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    want = con.sql(SQL[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda df: sorted(tuple("" if v is None or str(v) in ("<NA>", "NaT", "nan") else f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert text(got) == text(want)
