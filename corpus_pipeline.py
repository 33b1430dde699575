"""The corpus pipeline: from all documents to shards of a cleaned, mixed corpus.

Every stage judges all rows that its predecessor kept. None fails on nulls in any column, empty or very long texts, ties,
repeated rows or repeated doc_ids, empty tables, or columns of any further names, which all stages carry along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, mixing, quality, sharding, simhash
from quern.llm.common import n_words, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, does not reject. A null text is scored as an empty one;
    without labels of both kinds all rows share a score, that is without any label all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id (null last), then fingerprint and text hash. Rows are
    told apart by doc_id and text; null, empty and blank texts are copies of each other."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and empty texts hold none; an empty benchmark leaves all rows."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is a source of its own; a document without a word has
    size 0 and is taken like the others of its source."""
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    taken = mixing.mix(sized).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, texts included, in order of their shards, with ``shard`` and ``slot``. Copies of one document are
    rows of their own."""
    return sharding.shard_rows(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs


#: Fingerprints by XXH64 and a trained model are not for SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None
