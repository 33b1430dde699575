"""Features of numbers from the tokens of a public vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The last token's feature is its id and this times the number of tokens.
PER_TOKEN = 100_000


def default_ranks() -> str:
    """The file of ranks on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("numbers", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def number_tokens(df: DataFrame, columns: Sequence[str], ranks: str | None = None) -> DataFrame:
    """``df`` with ``tok1_<c>, tokL_<c>, tokN_<c>`` for each number column: the first token of the text of its whole part after
    a blank, the last with PER_TOKEN times their number, and their number; -1, -1 and 0 where it is null or no whole part fits
    in 64 bits.

    Only distinct numbers of all columns are encoded, and each once. ``ranks`` is a file of a byte-level vocabulary's ranks
    on every machine; nothing is trained.
    """
    whole = lambda c: F.expr(f"try_cast(try_cast(`{c}` as double) as bigint)") if df.schema[c].dataType.simpleString() in ("double", "float") else F.col(f"`{c}`").try_cast("bigint")
    numbers = reduce(DataFrame.union, (df.select(whole(c).alias("_number")) for c in columns)).where("_number is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks or default_ranks())
        for b in batches:
            found = [encoding.encode_ordinary(f" {n}") for n in b.column(0).to_pylist()]
            arrays = [[x[0] for x in found], [x[-1] + PER_TOKEN * len(x) for x in found], [len(x) for x in found]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(a, pa.int64()) for a in arrays)], ["_number", "_tok1", "_tokL", "_tokN"])

    encoded = numbers.mapInArrow(run, "_number long, _tok1 long, _tokL long, _tokN long")
    for c in columns:
        named = encoded.withColumnsRenamed({f"_{k}": f"_{k}_new" for k in ("tok1", "tokL", "tokN")} | {"_number": "_n_new"})
        joined = df.withColumn("_whole", whole(c)).join(named, F.col("_whole") == F.col("_n_new"), "left")
        df = joined.withColumns({f"{k}_{c}": F.coalesce(F.col(f"_{k}_new"), F.lit(none)) for k, none in (("tok1", -1), ("tokL", -1), ("tokN", 0))}).drop("_whole", "_n_new", "_tok1_new", "_tokL_new", "_tokN_new")
    return df
