"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.rows import plain


def held_out(doc_id="doc_id") -> Column:
    """Rows that no classifier learns from: crc32 of the id as text leaves 1 when divided by 3. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def sample(documents: DataFrame, labels: DataFrame, label: str, *, most: int, most_chars: int = 100_000) -> DataFrame:
    """At most ``most`` labelled documents (text, y) that are not held out, picked by a hash of their ids.

    Ids with more than one label count with the smaller; of several texts of one id the one with the smallest hash is taken. Texts of
    more than ``most_chars`` characters are not learned from, so both parameters together bound what is sent to the tasks and to the
    driver.
    """
    known = plain(labels, "doc_id", label).where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    order = F.xxhash64("doc_id", F.lit(11))
    # a draw by hash first, so that tasks send few rows to be ordered however many labels there are
    drawn = known.where(F.pmod(order, F.lit(1 << 30)) < min(1.0, 4 * most / max(1, known.count())) * (1 << 30))
    picked = drawn.orderBy(order, "doc_id").limit(most)
    texts = plain(documents, "doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.length("text") <= most_chars)
    return texts.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "y")
