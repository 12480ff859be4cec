"""Row identity and column safety shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word rules, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"


def row_key(doc_id="doc_id", text="text") -> list[Column]:
    """Two 64-bit keys of a row's id and text.

    They are computed again wherever they are needed, so a lost executor cannot change them. Rows with equal id
    and text share their keys, and every decision.
    """
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, doc_id, F.lit(7)).alias("k2")]


def text_key(text="text") -> list[Column]:
    """Two 64-bit keys of a text alone; copies share them."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(7)).alias("t2")]


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input cannot clash with an operator's own."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def packed(df: DataFrame, *extra: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside ``extra``; :func:`unpacked` restores it."""
    return df.select(F.struct(*(F.col(f"`{n}`") for n in df.columns)).alias("row"), *extra)


def unpacked(df: DataFrame, columns, **changed: Column) -> DataFrame:
    """The columns of ``row`` in their order, some of them replaced."""
    return df.select(*((changed[n] if n in changed else F.col("row").getField(n)).alias(n) for n in columns))


def words(text) -> Column:
    """Words of a text as an array; null has none."""
    parts = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE + "+")
    return F.array_remove(parts, "")
