"""How far the sources of a language stand apart: exact divergences between their term frequencies.

Terms are counted by Arrow kernels inside tasks (lower case, split by a pattern, dictionary, hash aggregate); Spark adds
up the partial counts; shards of the vocabulary, as columns of numbers, then give partial divergences that add up too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stored

#: All that is no ASCII letter and no character beyond ASCII, after A-Z are lower-cased, parts terms.
BETWEEN = r"[\x00-\x60\x7B-\x7F]+"
#: Documents of a language that must hold a term; shares are in parts of SCALE, counts are smoothed by SMOOTH.
LEAST_DOCS, SCALE, SMOOTH, TOP = 10, 1_000_000_000, 2, 10
#: Bytes of text that a task turns into terms at once, partial counts that it holds, and the sides of a shard.
SLICE_BYTES, HELD_ROWS, SHARD_TERMS, SHARD_SOURCES = 8 << 20, 1 << 19, 4096, 64

_KEYS = ["lang", "source", "term"]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most SLICE_BYTES of text, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _summed(parts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(parts).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])


def _counted(rows: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each (lang, source, term), and a row without a term for each (lang, source)."""
    lang, source, text = (pc.fill_null(rows.column(c), "") for c in ("lang", "source", "text"))
    words = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    row, word = pc.list_parent_indices(words), pc.list_flatten(words)
    real = pc.not_equal(word, "")
    word = word.filter(real).dictionary_encode()
    each = pa.table({"row": row.filter(real), "code": word.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    each = pa.table({"lang": langs.indices.take(each["row"].combine_chunks()), "source": sources.indices.take(each["row"].combine_chunks()), "code": each["code"], "n": each["count_all"]})
    found = each.group_by(["lang", "source", "code"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    terms = pa.table(
        {
            "lang": langs.dictionary.take(found["lang"].combine_chunks()),
            "source": sources.dictionary.take(found["source"].combine_chunks()),
            "term": word.dictionary.take(found["code"].combine_chunks()),
            "n": found["n_sum"],
            "docs": found["count_all"],
        }
    )
    groups = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"], use_threads=False).aggregate([])
    zero = pa.array(np.zeros(groups.num_rows, np.int64))
    return pa.concat_tables([terms, pa.table({"lang": groups["lang"], "source": groups["source"], "term": pa.nulls(groups.num_rows, pa.string()), "n": zero, "docs": zero})])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        for rows in _slices(batch):
            held.append(_counted(rows))
            if sum(t.num_rows for t in held) > HELD_ROWS:
                held = [_summed(held)]
                if held[0].num_rows > HELD_ROWS // 2:
                    yield from held.pop().to_batches()
    if held:
        yield from _summed(held).to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term and the documents that hold it; a null term stands for
    the group itself. A task holds HELD_ROWS partial counts at most, then hands them on; equal ones meet in one sum."""
    texts = docs.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    found = texts.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    return found.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (n + SMOOTH) / (total + SMOOTH v)); the product is a decimal, so that no count is too large."""
    product = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)")
    return F.when(v > 0, 1 + F.call_function("div", product, (total + SMOOTH * v).cast("decimal(20,0)")))


def _diverging(key: tuple, shard: pa.Table) -> pa.Table:
    """Partial sums for all pairs of one or two blocks of sources over one shard of terms, and each source's top terms in
    it. Rows without a term are the blocks' sources with the share of a term that they lack."""
    lang, left, right = key[0].as_py(), key[1].as_py(), key[2].as_py()
    shard = shard.combine_chunks()
    member = pc.is_null(shard["term"])
    members, terms = shard.filter(member).sort_by("place"), shard.filter(pc.invert(member))
    names, places, block = members["source"].to_pylist(), members["place"].to_numpy(), members["block"].to_numpy()
    codes = terms["term"].combine_chunks().dictionary_encode()
    at, row, own = codes.indices.to_numpy(), np.searchsorted(places, terms["place"].to_numpy()), terms["p"].to_numpy()
    shares = np.repeat(members["p"].fill_null(0).to_numpy()[:, None], len(codes.dictionary), axis=1)
    shares[row, at] = own
    out: list[tuple] = []
    for i in np.flatnonzero(block == left):
        others = np.flatnonzero((block == right) & (places > places[i]))
        gap = shares[others] - shares[i]
        for j, value in zip(others, (gap * gap // (shares[others] + shares[i])).sum(axis=1).tolist(), strict=True):
            out += [(names[i], "pair", names[j], value), (names[j], "pair", names[i], value)]
    if left == right:
        every = terms["q"].to_numpy()
        gap = own - every
        value, words = gap * gap // (own + every), codes.dictionary.to_pylist()
        for i in range(len(names)):
            mine = np.flatnonzero((row == i) & (gap > 0))
            if len(mine) > TOP:
                mine = mine[value[mine] >= np.partition(value[mine], -TOP)[-TOP]]
            best = sorted((-int(value[k]), words[at[k]]) for k in mine)[:TOP]
            out += [(names[i], "term", word, -less) for less, word in best]
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array([lang] * len(out), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: in part ``pair`` the divergence of a source from each other source of
    its language over all kept terms, in part ``term`` its TOP terms that are more frequent than in the language.

    Null text, lang and source are read as empty; a group whose texts hold no term takes part with the shares of a source
    that lacks all; a language without a kept term has divergences of 0 and no terms; a language of one source has no
    pairs. Repeated rows and ids count each. An empty table gives no rows. Other columns are not read.

    Nothing but names and totals of groups is ever together: a task holds at most SHARD_TERMS terms or so of two blocks
    of SHARD_SOURCES sources. All numbers are integers, so order of sums is of no matter.
    """
    counts = stored(term_counts(docs), "term_counts")
    of_term = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    kept = stored(of_term.where(F.col("docs") >= LEAST_DOCS).drop("docs"), "kept_terms")
    found = stored(counts.select(*_KEYS, "n").join(kept, ["lang", "term"]), "kept_counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_n", "v", "lang_n"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumns({"place": place, "blocks": F.ceil(F.count("*").over(Window.partitionBy("lang")) / SHARD_SOURCES).cast("int")})
    groups = stored(groups.withColumns({"block": F.floor(F.col("place") / SHARD_SOURCES).cast("int"), "shards": F.greatest(F.ceil(F.col("v") / SHARD_TERMS), F.lit(1)).cast("int")}), "groups")

    n, none = F.col("n"), F.lit(None)
    terms = found.join(groups, ["lang", "source"]).withColumns(
        {"shard": F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"), "p": _share(n, F.col("group_n"), F.col("v")), "q": _share(F.col("all_n"), F.col("lang_n"), F.col("v"))}
    )
    members = groups.withColumns(
        {"shard": F.explode(F.sequence(F.lit(0), F.col("shards") - 1)), "term": none.cast("string"), "p": _share(F.lit(0), F.col("group_n"), F.col("v")), "q": none.cast("long")}
    )
    columns = ["lang", "source", "shard", "term", "p", "q", "place", "block", "blocks"]
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = terms.select(*columns).union(members.select(*columns)).withColumn("other", other)
    rows = rows.select(F.col("lang").alias("_lang"), F.least("block", "other").alias("_left"), F.greatest("block", "other").alias("_right"), F.col("shard").alias("_shard"), "source", "term", "p", "q", "place", "block")
    parts = rows.groupBy("_lang", "_left", "_right", "_shard").applyInArrow(_diverging, "lang string, source string, part string, item string, value long")
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= TOP))
