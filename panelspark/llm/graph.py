"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import cut_lineage


def _parents(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("least"))
    return _parents(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return _parents(edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v"))))


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v, of one orderable type) that is not the smallest of its component.

    A node with very many neighbours is a key of a join with one row on the other side, which adaptive execution can split, and of
    a pre-aggregated minimum. Rounds grow with the logarithm of the longest path; each is written to the checkpoint folder.
    """
    edges = cut_lineage(_parents(edges))
    mark = _mark(edges)
    while mark[0]:
        edges = cut_lineage(_small(_large(edges)))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
