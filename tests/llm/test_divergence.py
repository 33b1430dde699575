"""Divergences between sources, held against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quern.llm import divergence

WORDS = [f"{a}{b}" for a in "abcdefghij" for b in ("ah", "éo", "ZU", "漢")]


def by_hand(rows):
    rows = [tuple(x or "" for x in r) for r in rows]
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    terms = [(g, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(low))) for g, s, t in rows]
    docs, every, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for g, s, ws in terms:
        docs[g].update(set(ws))
        every[g].update(ws)
        own[g, s].update(ws)
    share = lambda n, total, v: 1 + 10**9 * (n + 2) // (total + 2 * v)
    out = []
    for (g, s), counts in own.items():
        kept = [w for w, n in docs[g].items() if n >= 10]
        p = {x: {w: share(own[g, x][w], sum(own[g, x][k] for k in kept), len(kept)) for w in kept} for h, x in own if h == g}
        q = {w: share(every[g][w], sum(every[g][k] for k in kept), len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(x, sum(f(p[s][w], p[x][w]) for w in kept)) for x in p if x != s]
        tops = [(w, f(p[s][w], q[w])) for w in kept if counts[w] and p[s][w] > q[w]]
        for part, items, most in (("pair", pairs, None), ("term", tops, 10)):
            items.sort(key=lambda i: (-i[1], i[0].encode()))
            out += [(g, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    found = [("en", f"s{k % 7}", " ".join(rng.choices(WORDS[k % 5 :], k=rng.randint(1, 60)))) for k in range(300)]
    found += [("de", "only", "Ein Haus. " * 3)] * 12 + [(None, None, None), ("en", "none", "1 2 3 !"), ("fr", "a", "x"), ("fr", "b", "y"), ("fr", None, ""), ("en", "s1", "ah\x00eo\x7fZU" * 9)]
    return found


def audited(spark, rows):
    df = spark.createDataFrame([(i, *r, "clash", 7) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int").repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df).collect())


def test_audit_is_that_of_plain_python(spark, rows):
    assert audited(spark, rows) == by_hand(rows)


def test_many_blocks_and_shards_change_nothing(spark, rows, monkeypatch):
    want = by_hand(rows)
    for name, value in (("SHARD_TERMS", 5), ("SHARD_SOURCES", 2), ("SLICE_BYTES", 100), ("HELD_ROWS", 50)):
        monkeypatch.setattr(divergence, name, value)
    assert audited(spark, rows) == want


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_counts_beyond_64_bits_of_product(spark):
    df = spark.createDataFrame([(9 * 10**15, 10**16, 5)], "n long, t long, v long")
    got = df.select(divergence._share(df["n"], df["t"], df["v"]).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (9 * 10**15 + 2) // (10**16 + 10)
