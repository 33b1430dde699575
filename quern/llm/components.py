"""Connected components of an undirected graph, as joins and aggregates in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import forget, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, root)`` for every node of ``edges(a, b)``; the root is the component's smallest node.

    Alternates large-star and small-star rounds: each links the neighbours of a node to the smallest of
    them, until every node hangs on its root. The minimum of a node is pre-aggregated before its shuffle, and
    joined back by key, so a node with very many neighbours never meets in one task: the join's large side can be
    split. Each round is a table in the shared folder, so a lost executor costs one round at most.
    Loops, nulls and repeated edges are ignored; an empty graph gives an empty result.
    """
    known = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    for _ in range(max_rounds):
        both = known.union(known.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        small = stored(small, "edges")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(known)
        known = small
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return known.select(F.col("u").alias("node"), F.col("v").alias("root")).union(known.select("v", "v").distinct())
