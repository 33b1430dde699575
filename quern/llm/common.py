"""What the operators of this subpackage share: the word rule and tables in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.scratch import forget, new_path, shared_dir, stored

__all__ = ["BITMAP_BITS", "WORD", "ascii_lower", "forget", "marked", "n_words", "new_path", "shared_dir", "stored", "table"]

#: A word is a run of anything but ASCII white space. ``bytes.split()`` follows the same rule.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bits of a map of hashes (32 MB), at most.
BITMAP_BITS = 1 << 28


def marked(rows: DataFrame, by: Column, keys: DataFrame, of: Column) -> DataFrame:
    """``rows`` with ``_q_maybe``: false only if the hash ``by`` is none of the hashes ``of`` in ``keys``.

    The hashes are a bitmap of 32 bits for each key, BITMAP_BITS at most, which is broadcast as rows of 4 KB: a bounded
    size whatever the keys. Where keys are more than it can tell apart, more rows pass. So wide rows that meet no key
    need not be moved to be joined.
    """
    bits = min(BITMAP_BITS, max(1 << 15, 1 << (32 * keys.count()).bit_length()))
    bucket, place = lambda h: F.floor(F.pmod(h, F.lit(bits)) / 32768).cast("long"), lambda h: F.pmod(h, F.lit(32768))
    found = keys.select(bucket(of).alias("_q_bucket"), place(of).alias("p")).groupBy("_q_bucket").agg(F.bitmap_construct_agg("p").alias("_q_bits"))
    byte = F.conv(F.hex(F.substring("_q_bits", (place(by) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    maybe = F.coalesce(F.call_function("shiftright", byte, (place(by) % 8).cast("int")) % 2 == 1, F.lit(False))
    joined = rows.withColumn("_q_bucket", bucket(by)).join(F.broadcast(stored(found, "bitmap")), "_q_bucket", "left")
    return joined.withColumn("_q_maybe", maybe).drop("_q_bucket", "_q_bits")
