"""Keys and codes made of columns. Nothing here looks at a label."""

from __future__ import annotations

from collections.abc import Sequence
from re import sub

from pyspark.sql import Column
from pyspark.sql import functions as F

NA = "__NA__"
UNIT = "\u001f"


def exact_label(c: Column) -> Column:
    """Exact value of a number as text: whole numbers without a fraction, others in full, null as NA."""
    whole = (c == F.floor(c)) & (F.abs(c) < 9e15)
    return F.when(c.isNull(), NA).when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("double").cast("string"))


def category_label(c: Column) -> Column:
    """Trimmed text, null as NA."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(NA))


def joined_key(columns: Sequence[Column], separator: str = UNIT) -> Column:
    """Values side by side; nulls become NA first, so no value is left out."""
    return F.concat_ws(separator, *(F.coalesce(c.cast("string"), F.lit(NA)) for c in columns))


def json_key(columns: Sequence[Column]) -> Column:
    """Values as a JSON list, so that no separator can occur in a value unescaped."""
    return F.to_json(F.array(*(c.cast("string") for c in columns)))


def row_digest(columns: Sequence[Column], digits: int = 6) -> Column:
    """MD5 over exact values; doubles are rounded first so that equal rows meet."""
    return F.md5(joined_key([F.round(c, digits) for c in columns]))


def positional(columns: Sequence[Column], base: int) -> Column:
    """Digits as one whole number, the first column the lowest."""
    total = F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        total = total + c.cast("bigint") * base**i
    return total


def digits_of(value: Column, base: int, n: int) -> list[Column]:
    """The n lowest digits of a whole number, lowest first."""
    return [F.pmod(F.floor(value / F.lit(base**i)), F.lit(base)).cast("int") for i in range(n)]


def bin_of(c: Column, edges: Sequence[float]) -> Column:
    """Number of edges below a value, so bins are closed on the right and the first and last are open; null has -1."""
    return sum((F.when(c > e, 1).otherwise(0) for e in edges), F.when(c.isNull(), -1).otherwise(0))


def alias_name(c: Column) -> Column:
    """Column names of other schemas, made comparable: lower case, runs of other characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def resolved(columns: Sequence[str], aliases: dict[str, Sequence[str]]) -> dict[str, str]:
    """For each name of a schema, the column of another that stands for it: the one whose normalised name is the name's or
    one of its aliases'. Two candidates, or none, are an error."""
    normal = lambda c: sub("^_+|_+$", "", sub("[^a-z0-9]+", "_", c.strip().lower()))
    out = {}
    for name, others in aliases.items():
        wanted = {normal(x) for x in (name, *others)}
        found = [c for c in columns if normal(c) in wanted]
        if len(found) != 1:
            raise ValueError(f"{name}: one column is needed, found {found}")
        out[name] = found[0]
    return out


def number_tokens(c: Column, size: int = 2) -> dict[str, Column]:
    """Token features of a number's text in fixed pieces of ``size`` digits from the left: how many, the first, and the
    last with the text's length."""
    text = exact_label(c)
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    piece = lambda k: F.substring(text, ((k - 1) * size + 1).cast("int"), F.lit(size))
    return {"tokens": n, "first_token": piece(F.lit(1)), "last_token": F.concat_ws("_", piece(n), F.length(text).cast("string"))}


def one_hot(c: Column, values: Sequence) -> list[Column]:
    """A 0/1 column for each value; null and other values are 0 in all."""
    return [F.coalesce((c == v).cast("int"), F.lit(0)) for v in values]
