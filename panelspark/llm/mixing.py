"""Mixing sources to target weights by systematic sampling.

Every source gets a target, every document of a source the same expected number of copies. The expected copies are summed up along
an order of the source's documents, one random offset is added, and a document is emitted once for each whole number its stretch
of the sum crosses. The order runs through bands of sizes first, so long and short documents are drawn alike and the taken words come
near the target, and within a band by a hash of the id. The running sum of a source is split into slices of bounded size: sums per slice, offsets from a running sum over
slices, then sums within slices; no source is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.rows import packed, plain, unpacked, words
from panelspark.session import cut_lineage

#: Documents of a slice of the running sum, about.
SLICE_ROWS = 20_000


def size_of(text: str = "text") -> Column:
    """Number of words of a text; null and empty have none."""
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, *, weights=(5, 2, 1), most: float = 3) -> DataFrame:
    """One row per source: source, n_rows, source_size, target.

    ``sizes`` has ``source`` and ``size``. Sources in the order of their code points, null last, take ``weights`` in turn and share
    the sum of all sizes; no target exceeds ``most`` times its source's size, and what lies above is shared by weight among the
    others until none is above. A source without words has the target 0. One row per source is ordered in one task: the number
    of sources, not of documents, bounds it.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.get(F.array(*(F.lit(w) for w in weights)), (F.row_number().over(turn) - 1) % len(weights)).cast("long"))
    # targets are level * weight up to each cap; the sources whose caps lie lowest per weight are the capped ones
    per = per.withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    up_to, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # the level if this source and all after it were free
        .withColumn("level", (F.col("total") - F.col("caps_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("first_level", F.min(F.when(F.col("free"), F.struct(F.col("weight_before").alias("at"), F.col("level").alias("level")))).over(everything)["level"])
    )
    target = F.when(F.col("first_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("first_level") * F.col("weight")))
    return per.select("source", "n_rows", "source_size", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)).alias("target"))


def _ordering(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _band(size: Column) -> Column:
    """Quarter of the octave that holds size + 1: equal in every engine, as it needs whole numbers only."""
    octave = F.length(F.bin(size + 1)) - 1
    return (octave * 4 + (size + 1) * 4 / F.pow(F.lit(2.0), octave)).cast("int")


def copies(rows: DataFrame, targets: DataFrame, *, seed: int = 0, slice_rows: int = SLICE_ROWS, most: float = 3) -> DataFrame:
    """``rows`` (source, size, doc_id and more) with source_size, target and ``copies``, the times the mix takes each row.

    Rows with equal size and doc_id stand together in the order and are drawn alike; which of them is first does not matter.
    """
    whole = rows.join(targets.withColumnRenamed("source", "of").select("of", "n_rows", "source_size", "target"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    # the first digits of the ordering name the slice, so slices follow the order
    n_slices = F.least(F.greatest(F.ceil(F.col("n_rows") / slice_rows), F.lit(1)), F.lit(1 << 24))
    part = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * n_slices / (1 << 32)).cast("long")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = (whole.withColumn("band", _band(F.col("size"))).withColumn("place", _ordering(F.col("doc_id"), seed)).withColumn("rate", rate)
             .withColumn("part", part).withColumn("source_key", F.xxhash64("source")))
    slices = whole.groupBy("source_key", "band", "part").agg(F.count(F.lit(1)).alias("n_slice"))
    ahead = Window.partitionBy("source_key").orderBy("band", "part").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source_key", "band", "part", F.coalesce(F.sum("n_slice").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source_key", "band", "part").orderBy("place", "size")
    # every document of a source expects the same number of copies, so its sum is its position times that rate
    position = F.col("ahead") + F.row_number().over(within)
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("offset"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    crossed = F.floor(F.col("rate") * position + offset) - F.floor(F.col("rate") * (position - 1) + offset)
    mixed = whole.join(slices, ["source_key", "band", "part"]).withColumn("copies", F.least(crossed, F.lit(int(most))).cast("int"))
    return mixed.drop("source_key", "band", "part", "place", "rate", "ahead", "n_rows")


def mixture(documents: DataFrame, *, weights=(5, 2, 1), most: float = 3, seed: int = 0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken, the words the mix takes of it (repeats counted)."""
    # sizes are read three times; texts should be only once
    sized = cut_lineage(plain(documents, "doc_id", "source", "text").select("doc_id", "source", size_of().alias("size")))
    targets = source_targets(sized, weights=weights, most=most)
    return copies(sized, targets, seed=seed, slice_rows=slice_rows, most=most).select(
        "doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def mix(documents: DataFrame, *, weights=(5, 2, 1), most: float = 3, seed: int = 0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, columns unchanged.

    Texts without words have size 0; they are drawn at their source's rate like all others. Null sources are one source.
    """
    rows = packed(documents, F.col("doc_id"), F.col("source"), size_of().alias("size"))
    targets = source_targets(rows, weights=weights, most=most)
    taken = copies(rows, targets, seed=seed, slice_rows=slice_rows, most=most).where("copies > 0")
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))), documents.columns)
