"""Line dedup: three-line windows that appeared before are removed, wherever they appeared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stored

WINDOW = 3


def _lines(text: Column) -> Column:
    """Lines with a word, trimmed of ASCII white space."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    return F.filter(trimmed, lambda x: x != "")


def dedup(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``n_lines``, ``spans`` (first and last line removed) and ``clean``, the text left, in
    place of any columns of these names.

    A window is WINDOW consecutive lines with a word, trimmed, known by 128 bits of hash. The first window of its
    kind, by doc_id (null last), text hash and position, stays; the lines of every other are covered, covered
    positions are merged into spans, and spans are removed. A text without spans stays as it is; otherwise its blank
    lines go, too. The lines of a text of fewer than WINDOW are one window together, which meets texts of as many lines
    only, so copies of short texts go, too; a null, empty or blank text has no line and stays. A passage that repeats
    within one long line, or in runs of fewer than WINDOW lines of longer texts, is not seen. Rows that repeat doc_id
    and text are one document and get the same result: a window counts as repeated if it stands at two places. An empty
    table gives an empty result; a very long text has as many windows as lines. Other columns may have any names.

    Counts and first places are pre-aggregated, so a very common window is one row when it meets its like; it is joined
    back by hash, where Spark may split a large group. A document's spans are bounded by its own lines.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "spans", "clean")]
    keyed = docs.select(F.struct(*own).alias("doc"), F.col("doc_id").cast("long").alias("_q_id"), F.xxhash64(F.col("text").cast("string")).alias("_q_text"))
    rows = keyed.withColumn("_q_lines", _lines(F.col("doc.text"))).where(F.size("_q_lines") > 0)
    at = F.sequence(F.lit(0), F.greatest(F.size("_q_lines") - WINDOW, F.lit(0)))
    # Beyond the last line stands null, and the number of lines counts, so a short text meets its like only.
    window = lambda i: [F.least(F.size("_q_lines"), F.lit(WINDOW)), *(F.get("_q_lines", i + k) for k in range(WINDOW))]
    hashes = F.transform(at, lambda i: F.struct(F.xxhash64(*window(i)).alias("a"), F.xxhash64(F.lit(1), *window(i)).alias("b")))
    windows = rows.select("_q_id", "_q_text", F.posexplode(hashes).alias("p", "h")).select("_q_id", "_q_text", "p", "h.a", "h.b")
    windows = stored(windows, "windows")
    place = F.struct(F.col("_q_id").isNull(), "_q_id", "_q_text", "p")
    repeated = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(repeated, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    found = later.groupBy("_q_id", "_q_text").agg(F.array_sort(F.collect_set("p")).alias("p"))
    edge = lambda step: F.filter("p", lambda x, i: F.coalesce(F.abs(F.get("p", i + step) - x) > WINDOW, F.lit(True)))
    before = F.filter("p", lambda x, i: (i == 0) | (x - F.get("p", i - 1) > WINDOW))
    spans = F.zip_with(before, edge(1), lambda a, b: F.struct(a.alias("first"), (b + (WINDOW - 1)).alias("last")))
    found = found.select(F.col("_q_id").alias("_q_of"), F.col("_q_text").alias("_q_hash"), spans.alias("_q_spans"))
    joined = keyed.join(found, F.col("_q_id").eqNullSafe(F.col("_q_of")) & (F.col("_q_text") == F.col("_q_hash")), "left").withColumn("_q_lines", _lines(F.col("doc.text")))
    left = F.filter("_q_lines", lambda x, i: ~F.exists("_q_spans", lambda s: i.between(s["first"], s["last"])))
    ends = F.transform("_q_spans", lambda s: F.struct(s["first"].alias("first"), F.least(s["last"], F.size("_q_lines") - 1).alias("last")))
    text = F.when(F.col("_q_spans").isNull(), F.col("doc.text")).otherwise(F.array_join(left, "\n"))
    out = joined.select("doc", F.size("_q_lines").alias("n_lines"), ends.alias("spans"), text.alias("clean"))
    return out.select("doc.*", "n_lines", "spans", "clean")
