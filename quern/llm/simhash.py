"""SimHash near-duplicates by a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import marked, stored
from quern.llm.components import components

#: First bit and width of the five blocks. Of 3 differing bits, two blocks at least see none.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
MAX_BITS = 3
FANOUT = 8
#: Fingerprints that one tree of the index holds at most; how many trees there are follows from it.
GROUP = 1 << 16
#: Runs that lead the Gray orders. Of MAX_BITS differing bits, one run at least sees none.
RUNS = MAX_BITS + 1


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash over the XXH64 (seed 42) of word shingles, repeats included; no words give 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    spans = zip((ends - lens)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return kept.mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Position of a 64-bit word in the reflected Gray code: neighbours in this order differ in few bits."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The integers of all ranges, one after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - start, count)


def _child_pairs(i: np.ndarray, j: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of node i and a child of node j, the first not after the second."""
    ni, nj = np.minimum(FANOUT, below - i * FANOUT), np.minimum(FANOUT, below - j * FANOUT)
    left = np.repeat(_ranges(i * FANOUT, ni), np.repeat(nj, ni))
    right = _ranges(np.repeat(j * FANOUT, ni), np.repeat(nj, ni))
    keep = left <= right
    return left[keep], right[keep]


def index_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(i, root)`` that join exactly the fingerprints within ``max_bits`` of each other.

    ``fps`` are distinct and in Gray order. Each node of the tree covers FANOUT nodes below it and holds the bits
    that all of them share (mask) with their values (pattern). A pair of nodes is dropped with all that stand below
    it once the bits that both share differ in more than ``max_bits`` places.
    """
    levels = [(fps, np.full(len(fps), ~np.uint64(0)))]
    ands, ors = fps, fps
    while len(ands) > 1:
        cut = np.arange(0, len(ands), FANOUT)
        ands, ors = np.bitwise_and.reduceat(ands, cut), np.bitwise_or.reduceat(ors, cut)
        levels.append((ands, ~(ands ^ ors)))
    label = np.arange(len(fps))
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        if len(i) > 4096:
            todo += [(level, i[4096:], j[4096:])]
            i, j = i[:4096], j[:4096]
        if level == 0:
            _merge(label, i[i < j], j[i < j])
            continue
        i, j = _child_pairs(i, j, len(levels[level - 1][0]))
        pattern, mask = levels[level - 1]
        near = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= max_bits
        if near.any():
            todo.append((level - 1, i[near], j[near]))
    far = np.flatnonzero(label != np.arange(len(fps)))
    return far, label[far]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give both ends of each link the smaller label, until all links agree."""
    while True:
        a, b = label[i], label[j]
        if not (apart := a != b).any():
            return
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (jump := label[label]).tobytes() != label.tobytes():
            label[:] = jump


def _links_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (free, fixed, Gray rank). A group may span batches, so the last one waits for more."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        a, b = [], []
        for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            group = np.ascontiguousarray(rows[at : at + size, 2])
            i, root = index_links(group.view(np.uint64))
            a.append(group[i])
            b.append(group[root])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cat(a)), pa.array(cat(b))], ["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("free", "fixed", "fp")], axis=1)
        last = int(np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])[-1])
        if held and (last or (held[-1][-1, :2] != rows[0, :2]).any()):
            yield links(np.concatenate([*held, rows[:last]]))
            held = []
        elif last:
            yield links(rows[:last])
        held.append(rows[last:])
    if held:
        yield links(np.concatenate(held))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def narrower(free: int, parts: int = RUNS, width: int = 64) -> list[int]:
    """The mask without each of ``parts`` runs of its bits, of ``width`` bits at most. Of MAX_BITS differing bits, one
    run at least sees none."""
    bits = [k for k in range(64) if free >> k & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [free & ~sum(1 << k for k in bits[a:b][-width:]) for a, b in zip(cuts, cuts[1:], strict=False)]


def dealt(fps: DataFrame, most: int = GROUP) -> DataFrame:
    """Rows ``(fp, free, fixed)``: each fingerprint in the trees that hold it; a tree's fingerprints agree in all bits but
    those of ``free``. Any two within MAX_BITS of each other share a tree.

    Up to ``most`` fingerprints stand in one tree. More are put in Gray order RUNS times, each time with another run of
    bits in front; the run is just so wide that nodes of that depth hold ``most`` / 4 or so each, and a node is the top
    of a tree. So each fingerprint is copied RUNS times whatever the input, and trees stay as deep as one task can climb.

    A node of more than ``most`` all the same, such as that of a very large family of near copies, is taken apart: its
    fingerprints are dealt again by two of five blocks of bits and then by each of four runs of the free bits, until
    groups are small or so few bits are free that distinct fingerprints cannot be more.
    """
    every = (1 << 64) - 1
    n = fps.count()
    masks = narrower(every, RUNS, min(16, (n - 1).bit_length() - most.bit_length() + 3)) if n > most else [every]
    with_fixed = lambda rows: rows.withColumn("fixed", F.col("fp").bitwiseAND(F.bitwise_not("free")))
    over = lambda rows: stored(rows.groupBy("free", "fixed").agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n"), "large")
    rows = with_fixed(fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("free")))
    large = over(rows)
    if large.isEmpty():
        return rows
    done = [rows.join(large, ["free", "fixed"], "left_anti")]
    masks = [every & ~sum(((1 << width) - 1) << at for at, width in pair) for pair in combinations(BLOCKS, 2)]
    hot = rows.join(large, ["free", "fixed"], "left_semi").select("fp").distinct()
    rows = stored(with_fixed(hot.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("free"))), "groups")
    while max(m.bit_count() for m in masks) >= most.bit_length():
        large = over(rows)
        found = {r["free"] for r in large.select("free").distinct().collect()}  # at most 640 masks
        if not found:
            break
        done.append(rows.join(large, ["free", "fixed"], "left_anti"))
        next_masks = {m: narrower(m) for m in masks if _signed(m) in found}
        choice = F.create_map(*(x for m, own in next_masks.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(o)) for o in own)))))
        again = rows.join(large, ["free", "fixed"], "left_semi").select("fp", F.explode(F.element_at(choice, F.col("free"))).alias("free"))
        rows, masks = stored(with_fixed(again.distinct()), "groups"), sorted({o for own in next_masks.values() for o in own})
    return reduce(DataFrame.union, (r.select("fp", "free", "fixed") for r in [*done, rows]))


def near_links(fps: DataFrame, most: int = GROUP) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints, enough of them to join all that differ in MAX_BITS at most.

    ``dealt`` spreads the tops of the index over the cluster; below each stands a tree of the fingerprints in Gray order.
    """
    rows = dealt(fps, most).withColumn("rank", gray_rank(F.col("fp")))
    rows = rows.repartition("free", "fixed").sortWithinPartitions("free", "fixed", "rank").select("free", "fixed", "fp")
    return rows.mapInArrow(_links_of_groups, "a long, b long")


def _components(rows: DataFrame) -> DataFrame:
    """``(fp, first, node)`` for each fingerprint of ``rows(doc_id, fp)``: the smallest doc_id of its component, and the
    fingerprint that names the component."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_links(distinct.select("fp")))
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "root")
    linked = known.where("root is not null")
    lowest = linked.groupBy("root").agg(F.min("first").alias("first"))
    linked = linked.drop("first").join(lowest, "root").select("fp", "first", F.col("root").alias("node"))
    # Stored, so that rows meet it in a join of two plain shuffles, of which Spark may split a fingerprint of very many rows.
    return stored(linked.union(known.where("root is null").select("fp", "first", F.col("fp").alias("node"))), "components")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs``, of which only doc_id and text are read.

    Rows link when their fingerprints differ in MAX_BITS at most; ``component_id`` is the smallest doc_id that a row
    reaches. Copies meet as one fingerprint before anything is linked, so neither repeated rows nor very large groups
    of copies meet in one task; repeated rows stay. A null, empty or blank text has fingerprint 0; a text of any length
    is hashed whole; a null doc_id takes part but never names a component, which is null if it has no other. An empty
    table gives an empty result; other columns, whatever their names, are ignored.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    found = _components(rows).select("fp", F.col("first").alias("component_id"))
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of each component of near copies, with all columns of ``docs``.

    Rows are told apart by doc_id and text, so a doc_id that stands for several texts loses none that resembles nothing
    else. The row that stays has the smallest doc_id of its component (null last), then the smallest fingerprint and
    text hash; of rows that repeat both, one stays, chosen by a hash of all its columns. Null, empty and blank texts
    share fingerprint 0 and so are copies of each other. Columns may have any names.
    """
    key = lambda text: [F.xxhash64(text), F.xxhash64(F.lit(1), text)]  # noqa: E731  # 128 bits: the second is seeded before the text
    own = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    packed = docs.select(F.struct(*own).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), *(k.alias(n) for k, n in zip(key(text), ("h", "g"), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64)), b.column("h"), b.column("g")], ["doc_id", "fp", "h", "g"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns(dict(zip(("h", "g"), key(F.col("text")), strict=True)))
    rows = stored(slim.mapInArrow(run, "doc_id long, fp long, h long, g long"), "fingerprints")
    keyed = rows.join(_components(rows.select("doc_id", "fp")).select("fp", "node"), "fp")
    keyed = stored(keyed.groupBy("node", "fp", "doc_id", "h", "g").agg(F.count("*").alias("n")), "keys")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "h", "g")
    first = keyed.groupBy("node").agg(F.min(place).alias("p")).select("node", F.col("p.doc_id").alias("i"), F.col("p.h").alias("a"), F.col("p.g").alias("b"))
    first = stored(first, "first")  # both sides of the join are plain shuffles, of which Spark may split a large group
    same = keyed["doc_id"].eqNullSafe(first["i"]) & (keyed["h"] == first["a"]) & (keyed["g"] == first["b"])
    judged = keyed.join(first, "node").select(keyed["doc_id"].alias("i"), keyed["h"].alias("a"), keyed["g"].alias("b"), same.alias("stays"), "n")
    judged = stored(judged.where("n > 1 or not stays"), "copies")
    tested = marked(packed, F.xxhash64("doc_id", "h", "g"), judged, F.xxhash64("i", "a", "b"))
    some = tested.where("_q_maybe")
    found = some.join(judged, some["doc_id"].eqNullSafe(judged["i"]) & (some["h"] == judged["a"]) & (some["g"] == judged["b"]), "left")
    once = found.where("stays").groupBy("doc_id", "h", "g").agg(F.min_by("doc", F.xxhash64(F.to_json("doc"))).alias("doc"))
    kept = tested.where("not _q_maybe").select("doc").union(found.where("stays is null").select("doc")).union(once.select("doc"))
    return kept.select("doc.*")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
