"""Shards of near-equal bytes by sampled splitters."""

from __future__ import annotations

import json
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stored

SHARDS = 16
#: A shard is made of RANGES ranges or more, so that none is meant to hold more than RANGE_BYTES, up to MAX_RANGES in
#: all. DRAWS sampled keys are expected for each range: that is all that reaches the driver.
RANGES = 64
RANGE_BYTES = 256 << 20
MAX_RANGES = 1 << 14
DRAWS = 8
#: A range of more than so many times its share is divided again, in so many rounds at most.
OVERFULL = 2
ROUNDS = 8
#: A cut moves so far (as a share of a shard) to leave a group of equal texts whole.
SLACK = 0.02
LEAST = -(1 << 63)
Key = tuple[int, int, int]


def keys(text: Column, doc_id: Column) -> list[Column]:
    """``_q_size`` (bytes of the text and 1) and the key of a row: hash of the text, doc_id (null first), and a number of
    the row, so that rows which repeat both can be told apart and divided. Equal texts are neighbours in this order."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    return [
        (F.length(raw) + 1).cast("long").alias("_q_size"),
        F.xxhash64(raw).alias("_q_h"),
        F.coalesce(doc_id.cast("long"), F.lit(LEAST)).alias("_q_d"),
        F.monotonically_increasing_id().alias("_q_r"),
    ]


def _literal(found: list[Key]) -> Column:
    return F.from_json(F.lit(json.dumps([dict(zip("hdr", k, strict=True)) for k in found])), "array<struct<h:bigint,d:bigint,r:bigint>>")


def range_of(cuts: list[Key]) -> Column:
    """Number of cuts at or below a row's key, by a search in two steps."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    key = F.struct(F.col("_q_h").alias("h"), F.col("_q_d").alias("d"), F.col("_q_r").alias("r"))
    upto = lambda found: F.size(F.filter(found, lambda c: c <= key))
    coarse = upto(_literal(cuts[::width]))
    at = F.greatest(coarse - 1, F.lit(0)) * width
    return at + upto(F.slice(_literal(cuts), at + 1, F.lit(width)))


def _quantiles(rows: DataFrame, share: float, draws: int, seed: int) -> list[Key]:
    """Keys at every ``share`` bytes of ``rows``, from a sample in which a row's chance grows with its size."""
    unit = share / draws
    chance = F.shiftrightunsigned(F.xxhash64("_q_h", "_q_d", "_q_r", F.lit(seed)), 11) / float(1 << 53)
    drawn = rows.where(chance < F.col("_q_size") / unit).select("_q_h", "_q_d", "_q_r", "_q_size").collect()
    cuts, filled = [], 0.0
    for *key, size in sorted(drawn):
        if filled >= share:
            cuts.append(tuple(key))
            filled -= share * (filled // share)
        filled += max(size, unit)
    return cuts


def _whole(cuts: list[Key]) -> list[Key]:
    """A group of equal texts with one cut only is small: the cut moves to its front. Of a group with more cuts, the
    first does."""
    out: list[Key] = []
    for key in sorted(set(cuts)):
        out.append(key if out and out[-1][0] == key[0] else (key[0], LEAST, LEAST))
    return out


def splitters(rows: DataFrame, shards: int = SHARDS) -> list[Key]:
    """The cuts between ranges of ``rows``; ranges over OVERFULL times their share are sampled and cut again."""
    total = rows.agg(F.sum("_q_size")).first()[0] or 0
    if not total:
        return []
    each = min(MAX_RANGES // shards, max(RANGES, -(-total // shards // RANGE_BYTES)))
    share = max(1.0, total / (shards * each))
    cuts = _whole(_quantiles(rows, share, DRAWS, 0))
    for attempt in range(1, ROUNDS):
        sums = rows.groupBy(range_of(cuts).alias("r")).agg(F.sum("_q_size").alias("size"), F.count("*").alias("n"))
        full = [r["r"] for r in sums.where((F.col("n") > 1) & (F.col("size") > OVERFULL * share)).collect()]
        more = _quantiles(rows.where(range_of(cuts).isin(full)), share, 4 * DRAWS, attempt) if full else []
        if not set(more) - set(cuts):
            break
        cuts = _whole([*cuts, *more])
    return cuts


def plan(cuts: list[Key], sizes: list[int], counts: list[int], shards: int) -> list[tuple[int, int]]:
    """For each range its shard and the rows before it in its shard. A shard ends at the cut nearest to its even part of all
    bytes; a cut between texts is taken before one within a group of equal texts, if it is within SLACK."""
    ends, aim = list(accumulate(sizes)), sum(sizes) / shards
    firsts = []
    for k in range(1, shards):
        best = min(range(len(cuts)), key=lambda i: abs(ends[i] - k * aim), default=None)
        if best is not None and cuts[best][1] != LEAST:
            near = [i for i in range(bisect_left(ends, (k - SLACK) * aim), len(cuts)) if ends[i] <= (k + SLACK) * aim and cuts[i][1] == LEAST]
            best = min(near, key=lambda i: abs(ends[i] - k * aim), default=best)
        firsts.append(len(sizes) if best is None else best + 1)
    out, shard, before = [], 0, 0
    for r, n in enumerate(counts):
        while shard < shards - 1 and firsts[shard] <= r:
            shard, before = shard + 1, 0
        out.append((shard, before))
        before += n
    return out


def _placed(rows: DataFrame, cuts: list[Key], shards: int) -> DataFrame:
    """``rows`` (with a key and anything else) and ``shard`` and ``slot``.

    One shuffle brings each range to a task, which ranks it; the ranked rows are a table, and the counts that slots begin
    at are those of this table, so that slots are gapless whatever happens to executors.
    """
    rank = F.row_number().over(Window.partitionBy("_q_range").orderBy("_q_h", "_q_d", "_q_r")) - 1
    ranked = stored(rows.withColumn("_q_range", range_of(cuts)).withColumn("_q_rank", rank), "ranked")
    found = {r: (size, n) for r, size, n in ranked.groupBy("_q_range").agg(F.sum("_q_size"), F.count("*")).collect()}
    sizes, counts = zip(*(found.get(r, (0, 0)) for r in range(len(cuts) + 1)), strict=True)
    listed = json.dumps([{"r": r, "s": s, "n": n} for r, (s, n) in enumerate(plan(cuts, list(sizes), list(counts), shards))])
    ranges = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<r:int,s:int,n:bigint>>")))
    ranges = ranges.select(F.col("r").alias("_q_range"), F.col("s").alias("shard"), F.col("n").alias("_q_before"))
    return ranked.join(F.broadcast(ranges), "_q_range").withColumn("slot", F.col("_q_before") + F.col("_q_rank"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row of ``docs`` as ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``bytes``: shards are runs of key ranges, cut where the sum of sizes comes nearest to equal parts. Equal
    texts share a shard unless their group is large or lies across a cut that cannot move. A group that holds a large
    part of all bytes has many cuts inside, by doc_id and then by row, so that even rows which repeat both are divided.
    Slots count from 0 in key order: the rows of earlier ranges plus the rank within a range, so a window holds one
    range. A null text counts as an empty one of size 1; a text of any length is hashed whole and counts by its bytes, so one
    text may be larger than a shard; a null doc_id comes first among its copies; repeated rows get slots of their own;
    an empty table gives an empty result. Columns other than doc_id and text are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text).alias("text_crc32"), *keys(F.col("text"), F.col("doc_id"))), "keys")
    out = _placed(rows, splitters(rows, shards), shards)
    return out.select("doc_id", F.col("_q_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, in place of any columns of these names; places follow the rules of ``shard``.
    The rows are moved once, to the task of their range, and leave it in order of their slots."""
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    packed = docs.select(F.struct(*own).alias("doc"), *keys(F.col("text"), F.col("doc_id")))
    cuts = splitters(stored(packed.drop("doc"), "keys"), shards)
    return _placed(packed, cuts, shards).select("doc.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``docs`` and their slots as Parquet, a folder for each shard."""
    shard_rows(docs, shards).write.partitionBy("shard").parquet(path)
