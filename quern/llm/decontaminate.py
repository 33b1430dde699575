"""Benchmark decontamination: the rarest shingles of each item find its candidates, exact weighted shingles of item-sized windows decide."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import fsum
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stored

SHINGLE = 5
SIMILARITY = 0.8
#: Words of benchmark items that one index holds, and so what is broadcast at once. A larger benchmark is dealt to
#: several indexes, each run over all documents.
INDEX_WORDS = 2_000_000
_BITMAP = 1 << 22
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores in lower case: marks and case hide no passage."""
    return _WORD.findall((text or "").lower())


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hash of each word; ``known`` keeps those of earlier words."""
    if len(known) > 500_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of the k words from each place on."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Item(NamedTuple):
    item_id: int | None
    n_words: int
    shingles: np.ndarray
    weights: np.ndarray
    total: float


class Index:
    """Items, and postings of their rarest shingles: in order of falling weight, those that weigh more than
    1 - SIMILARITY of the item together. A window without any of them lacks too much weight to match, so the items
    posted under the shingles of a text are all that it can hold.

    ``rows`` are (item_id, number of words, weight of each distinct shingle).
    """

    def __init__(self, rows: list[tuple[int | None, int, dict[int, float]]]) -> None:
        self.items: list[Item] = []
        posted: dict[int, tuple[list[int], list[int]]] = {}
        for i, (item_id, n, own) in enumerate(rows):
            shingles = np.array(sorted(own), np.uint64)
            weights = np.array([own[s] for s in shingles.tolist()])
            total = fsum(weights)
            self.items.append(Item(item_id, n, shingles, weights, total))
            order = np.argsort(-weights, kind="stable")
            enough = int(np.searchsorted(np.cumsum(weights[order]), ((1 - SIMILARITY) + 1e-9) * total, side="right")) + 1
            keys, at = posted.setdefault(min(SHINGLE, n), ([], []))
            keys += shingles[order[:enough]].tolist()
            at += [i] * len(order[:enough])
        #: Shingles by their number of words: an item of fewer than SHINGLE words is one shingle.
        self.postings, self.bitmap = {}, {}
        for k, (keys, at) in posted.items():
            order = np.argsort(np.array(keys, np.uint64), kind="stable")
            own, first = np.unique(np.array(keys, np.uint64)[order], return_index=True)
            self.postings[k] = own, np.append(first, len(order)), np.array(at, np.int64)[order]
            self.bitmap[k] = np.zeros(_BITMAP, bool)
            self.bitmap[k][(own & np.uint64(_BITMAP - 1)).astype(np.int64)] = True

    def candidates(self, s: np.ndarray, k: int) -> list[int]:
        """Items of shingles of k words that have one of their rarest among ``s``."""
        own, first, items = self.postings[k]
        maybe = np.unique(s[self.bitmap[k][(s & np.uint64(_BITMAP - 1)).astype(np.int64)]])
        at = np.searchsorted(own, maybe).clip(max=len(own) - 1)
        found = at[own[at] == maybe]
        return np.unique(np.concatenate([items[first[j] : first[j + 1]] for j in found])).tolist() if len(found) else []

    def matches(self, h: np.ndarray) -> dict[int | None, tuple[float, int, int]]:
        """Best (similarity, first word negated, words) of each item found in a text of these word hashes."""
        best: dict[int | None, tuple[float, int, int]] = {}
        for k in self.postings:
            s = shingle_hashes(h, k)
            found = self.candidates(s, k)
            if not found:
                continue
            order = np.argsort(s, kind="stable")
            ranked = s[order]
            for item in map(self.items.__getitem__, found):
                hit = best_window(item, ranked, order, min(item.n_words, len(h)), len(h), k)
                if hit:
                    best[item.item_id] = max(best.get(item.item_id, (0.0, 0, 0)), hit)
        return best


def best_window(item: Item, ranked: np.ndarray, order: np.ndarray, width: int, n: int, k: int) -> tuple[float, int, int] | None:
    """(similarity, first word negated, words) of the first of the best windows of ``width`` words in a text of n words
    with these shingles, sorted, and their places; None below SIMILARITY."""
    left, right = np.searchsorted(ranked, item.shingles, "left"), np.searchsorted(ranked, item.shingles, "right")
    counts = right - left
    if fsum(item.weights[counts > 0]) < SIMILARITY * item.total * (1 - 1e-9):
        return None
    which = np.repeat(np.arange(len(counts)), counts)
    begins = np.cumsum(counts) - counts
    places = order[np.arange(len(which)) - np.repeat(begins - left, counts)]  # rising within a shingle
    reach = width - k + 1  # shingles of a window
    since = np.maximum(places - reach + 1, 0)  # windows from here to ``until`` hold the shingle at this place, and not before
    again = np.r_[False, which[1:] == which[:-1]]
    since[again] = np.maximum(since[again], places[:-1][again[1:]] + 1)
    until = np.minimum(places, n - width)
    since, until, which = (x[since <= until] for x in (since, until, which))
    # Weights as whole numbers, so that windows of equal weight compare equal; they change at ``edges`` only.
    whole = np.rint(item.weights * (1 << 32)).astype(np.int64)[which]
    edges, at = np.unique(np.r_[since, until + 1], return_inverse=True)
    change = np.zeros(len(edges), np.int64)
    np.add.at(change, at, np.r_[whole, -whole])
    first = int(edges[np.argmax(np.cumsum(change))])
    share = fsum(item.weights[which[(since <= first) & (first <= until)]]) / item.total
    return (share, -first, width) if share >= SIMILARITY - 1e-9 else None


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """``(_q_item, item_id, n, s, weight)`` for each distinct shingle of each item with a word, n the item's words. A
    shingle weighs more the fewer of all items hold it: ln(1 + items / items with it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, item, text in zip(*(b.column(c).to_pylist() for c in ("_q_item", "item_id", "text")), strict=True):
                h = word_hashes(words_of(text), {})
                if len(h):
                    s = np.unique(shingle_hashes(h, min(SHINGLE, len(h)))).view(np.int64)
                    n = len(s)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array([item] * n, pa.int64()), pa.array([len(h)] * n, pa.int32()), pa.array(s)], ["_q_item", "item_id", "n", "s"])

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    items = items.select(F.xxhash64("item_id", "text").alias("_q_item"), "item_id", "text")
    own = items.mapInArrow(run, "_q_item long, item_id long, n int, s long")
    share = own.groupBy("s").agg(F.count("*").alias("df"))
    total = own.select("_q_item").distinct().count()
    return own.join(share, "s").withColumn("weight", F.log1p(F.lit(float(total)) / F.col("df")))


def _indexes(benchmark: DataFrame, index_words: int) -> tuple[int, Iterator[Index]]:
    """How many indexes hold the benchmark, and each of them in turn; the driver holds one at a time."""
    rows = item_shingles(benchmark).groupBy("_q_item", "item_id", "n").agg(F.collect_list(F.struct("s", "weight")).alias("own"))
    rows = stored(rows, "items")
    parts = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // index_words))

    def each() -> Iterator[Index]:
        for p in range(parts):
            part = rows.where(F.pmod("_q_item", F.lit(parts)) == p).orderBy("_q_item").collect()
            yield Index([(r["item_id"], r["n"], {s & (1 << 64) - 1: w for s, w in r["own"]}) for r in part])

    return parts, each()


def contaminated(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)``: for each document and each benchmark item in it, the best
    window. Documents without an item have no row.

    A window as long as the item, in words, starts at every word. The weight of the item's distinct shingles of five
    words that it holds, of the weight of all of them, is SIMILARITY or more. Only items that have one of their rarest
    shingles in the document are held against it, as no other can match (see ``Index``); no match is lost. Words are
    letters and digits in lower case, of the whole text, however long; a run of letters without spaces, as in Chinese or
    Japanese, is one word, so a passage inside a longer run is not seen. A null or empty text, of either side, matches
    nothing; a text shorter than an item is one window, however short; it is passed over only if all its shingles weigh
    too little. Of windows of equal similarity the first is reported. Rows that repeat a doc_id are judged one by one,
    and rows of the benchmark that repeat id and text are one item; of several texts under one item_id the best counts.
    An empty table of either side gives no rows. Other columns are ignored, whatever their names. The documents are not
    shuffled. A benchmark of more than ``index_words`` words is taken in parts, each broadcast, run over all documents,
    written and released before the next.
    """
    parts, indexes = _indexes(benchmark, index_words)
    if parts == 1:
        return _against(docs, next(indexes))[0]
    out = []
    for index in indexes:
        found, shared = _against(docs, index)
        out.append(stored(found, "found"))
        shared.destroy()
    return reduce(DataFrame.union, out)


def _against(docs: DataFrame, index: Index) -> tuple[DataFrame, Broadcast[Index]]:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                found = shared.value.matches(word_hashes(words_of(text.as_py()), known))
                out += [(doc_id, item, sim, -first, width) for item, (sim, first, width) in found.items()]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return kept.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words int"), shared


def keep_clean(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, judged as in ``contaminated``, with all their columns. Each part of
    a large benchmark leaves a table that the next one reads."""
    parts, indexes = _indexes(benchmark, index_words)
    for k, index in enumerate(indexes, 1):
        docs, shared = _without(docs, index)
        if k < parts:
            docs = stored(docs, "clean")
            shared.destroy()
    return docs


def _without(docs: DataFrame, index: Index) -> tuple[DataFrame, Broadcast[Index]]:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            texts = b.column(b.schema.names.index("text")).cast(pa.string())
            yield b.filter(pa.array([not shared.value.matches(word_hashes(words_of(t.as_py()), known)) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema), shared
