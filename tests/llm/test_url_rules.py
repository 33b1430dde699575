"""Mined rules may hold several folders, parts of the host and query pairs, and say what all combinations of tokens say."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quern.llm import url_filter


def tokens_of(df):
    return df.select(url_filter.tokens(F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("tokens"), "bad")


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_say_what_all_combinations_say(spark, seed):
    rng = random.Random(seed)
    pick = lambda *of: rng.choice(of)
    rows = []
    for _ in range(500):
        a, b, q, m = pick("x", "y"), pick("u", "v"), pick("", "k=z", "k=w", "k=z&m=n"), pick("a", "b.a", "c.a")
        odd = (a == "x") == (b == "u") and m != "a"  # neither folder tells alone
        rows.append((f"http://{m}.org/{a}/{b}/p.html?{q}", rng.random() < (0.9 if odd else 0.2)))
    seen = [(set(r["tokens"]), r["bad"]) for r in tokens_of(spark.createDataFrame(rows, "url string, bad boolean")).collect()]
    rules = url_filter.mine(tokens_of(spark.createDataFrame(rows, "url string, bad boolean")), min_support=0.02).collect()
    assert any(sum(p[0].startswith("dir") for p in r["parts"]) == 2 for r in rules)
    counts = {}
    for t, bad in seen:
        for k in range(1, len(t) + 1):
            for c in combinations(sorted(t), k):
                counts.setdefault(c, [0, 0])[bad] += 1
    n_bad, least = sum(b for _, b in seen), max(5, 0.02 * len(seen))
    n_good = len(seen) - n_bad
    blocks = [set(c) for c, (g, b) in counts.items() if b >= least and b * n_good >= 4 * g * n_bad]
    allows = [set(c) for c, (g, b) in counts.items() if g >= least and g * n_bad >= 2 * b * n_good]
    assert blocks and allows
    for t in {frozenset(t) for t, _ in seen}:
        own = {r["verdict"] for r in rules if all(set(p) & t for p in r["parts"])}
        assert ("block" in own) == any(c <= t for c in blocks)
        assert ("allow" in own) == any(c <= t for c in allows)
