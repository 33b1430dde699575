"""Every operator on awkward tables: nulls, empty and long texts, repeats, clashing columns, no rows."""

import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, licenses, line_dedup, mixing, quality, quality_rules, sharding, simhash, url_filter, warc

LONG = "\n".join(f"Line {i} holds word{i} and more words than the last one did." for i in range(5000))
TEXTS = [None, "", " \n\t", "One short line.", "One short line.", "A.\nB.\nC.\nD.", LONG, LONG, "Ünïcode – texts, 漢字 too.", "x" * 100_000]
DOCS = [(i if i != 3 else None, t, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "s2")]
CLASH = (
    "size", "shard", "score", "fp", "h", "g", "n", "p", "spans", "copies", "target", "digest", "rule", "units", "line", "doc", "first", "a", "b", "slot", "clean", "refers_to",
    "_q_row", "_q_t", "_q_url", "_q_tokens", "_q_id", "_q_text", "_q_lines", "_q_spans", "_q_h", "_q_d", "_q_r", "_q_size", "_q_range", "_q_rank", "_q_source", "_q_draw",
    "_q_class", "_q_bucket", "_q_first", "_q_maybe", "_q_item", "_q_before", "Text2",
)


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "HTTP://Host.ORG", LONG), (4, "http://a/b\n?q#f", LONG), (None, "x://y", LONG), (4, "http://a/b\n?q#f", LONG)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (1, 1, 0), (6, 1, 0), (9, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "short line"), (None, "Line 7 holds word7 and more words than the last one did."), (3, "short line")], "item_id long, text string")


def results(docs, pages, labels, benchmark):
    sized = docs.select("doc_id", "source", F.length("text").alias("size"), "copies", "target")
    return {
        "url": (url_filter.judge(pages, labels), "pages"),
        "lines": (line_dedup.dedup(docs), "docs"),
        "rules": (quality_rules.clean(docs), "docs"),
        "warc": (warc.round_trip(pages), "pages"),
        "licenses": (licenses.scan(docs), "docs"),
        "simhash": (simhash.near_duplicates(docs), "docs"),
        "quality": (quality.judge(docs, labels), "docs"),
        "sharding": (sharding.shard(docs), "docs"),
        "mixing": (mixing.mix(sized), "docs"),
        "leaks": (decontaminate.contaminated(docs, benchmark), None),
        "good": (quality.keep_good(docs, labels), None),
        "one": (simhash.keep_one(docs), None),
        "clean": (decontaminate.keep_clean(docs, benchmark), None),
    }


def test_awkward_rows_give_one_result_each(docs, pages, labels, benchmark):
    n = {"docs": len(DOCS), "pages": 6}
    found = {}
    for name, (df, of) in results(docs, pages, labels, benchmark).items():
        rows = found[name] = df.collect()
        if of:
            assert len(rows) == n[of], name
        if name in ("good", "one", "clean"):
            assert df.columns == docs.columns, name
            assert {r["_q_row"] for r in rows} <= {"clash"}, name
    by = lambda name, *cols: sorted((tuple(r[c] for c in cols) for r in found[name]), key=str)
    same = lambda got, want: got == sorted(want, key=str)
    assert same(by("simhash", "doc_id", "component_id"), [(0, 0), (1, 0), (2, 0), (None, 4), (4, 4), (5, 5), (5, 5), (6, 6), (7, 6), (8, 8), (9, 9)])
    assert same(by("one", "doc_id"), [(i,) for i in (0, 4, 5, 6, 8, 9)])
    assert same(by("lines", "doc_id", "n_lines", "clean"), [
        (0, 0, None), (1, 0, ""), (2, 0, " \n\t"), (None, 1, ""), (4, 1, TEXTS[4]), (5, 4, TEXTS[5]), (5, 4, TEXTS[5]), (6, 5000, LONG), (7, 5000, ""), (8, 1, TEXTS[8]), (9, 1, TEXTS[9]),
    ])
    assert same(by("rules", "doc_id", "n_words", "kept"), [(i, len((t or "").split()), False) for i, t, _ in DOCS])  # the long text repeats itself
    assert same(by("warc", "page_id", "payload_bytes", "record_type", "refers_to"), [
        (1, 0, "response", None), (2, 0, "response", None), (3, len(LONG), "response", None), (4, len(LONG), "revisit", 3), (4, len(LONG), "revisit", 3), (None, len(LONG), "revisit", 3),
    ])
    assert {(r["license"], r["n_notices"]) for r in found["licenses"]} == {(None, 0)}
    assert same(by("url", "page_id", "host", "path", "verdict"), [(1, "", "", "allow"), (2, "", "", "allow"), (3, "host.org", "", "allow"), (4, "a", "/b\n", "allow"), (4, "a", "/b\n", "allow"), (None, "y", "", "allow")])
    assert all(0 <= r["score"] <= 1 and not (r["held_out"] and r["doc_id"] is None) for r in found["quality"])
    assert same(by("sharding", "doc_id", "size"), [(i, len((t or "").encode()) + 1) for i, t, _ in DOCS])
    assert len({(r["shard"], r["slot"]) for r in found["sharding"]}) == len(DOCS)
    assert same(by("mixing", "doc_id", "size"), [(i, len(t or "")) for i, t, _ in DOCS])
    assert same(by("leaks", "doc_id", "item_id"), [(None, 3), (4, 3), (6, None), (7, None)])
    assert same(by("clean", "doc_id"), [(i,) for i, t, _ in DOCS if t != LONG and t != TEXTS[3]])


def test_placed_rows_keep_their_columns(docs):
    out = sharding.shard_rows(docs, 3)
    assert out.columns == [*(c for c in docs.columns if c not in ("shard", "slot")), "shard", "slot"]
    rows = out.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == sorted(((i, t) for i, t, _ in DOCS), key=str) and {r["_q_h"] for r in rows} == {"clash"}


def test_empty_tables(docs, pages, labels, benchmark):
    for name, (df, _) in results(*(x.limit(0) for x in (docs, pages, labels, benchmark))).items():
        assert df.count() == 0, name


def test_no_labels_and_no_benchmark(docs, labels, benchmark):
    assert quality.keep_good(docs, labels.limit(0)).count() == len(DOCS)
    assert decontaminate.keep_clean(docs, benchmark.limit(0)).count() == len(DOCS)
