"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is a set of windows (runs of item words), a window a set of shingles (runs of fewer words). A window occurs in a
document only if all its shingles do, so one necessary shingle per window is joined: the one that is rarest in the documents. Its
place bounds where the window must start and end in the document's run of shared shingles; the words there are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import bitmap
from panelspark.llm import wordhash as wh
from panelspark.llm.rows import packed, plain, row_key, unpacked
from panelspark.session import cut_lineage

#: The word rule as a Java class of what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARED = "k1 long, k2 long, doc_id {kind}, n_words long, runs array<struct<at:long,words:array<string>>>"


def _fold(text):
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows (``words``) and the items (``items``, as strings) they are in."""
    words = F.filter(F.split(_fold(F.col("text")), SEPARATORS), lambda w: w != "")
    items = plain(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    span = F.least(F.size("w"), F.lit(window))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - span + 1), lambda i: F.slice("w", i, span))
    return items.select("item", F.explode(F.array_distinct(each)).alias("words")).groupBy("words").agg(F.collect_set("item").alias("items"))


def _shingles(words, width: int):
    """(offset, hash) of every shingle of a word array of at least that size."""
    span = F.least(F.size(words), F.lit(width))
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - span),
        lambda i: F.struct(i.alias("offset"), F.xxhash64(F.slice(words, i + 1, span)).alias("shingle")),
    )


def _window_hashes(windows: DataFrame, width: int) -> DataFrame:
    """The shingles of all windows as the hashes that :mod:`wordhash` gives, with their widths."""

    def hashes(batches):
        for batch in batches:
            n, out = [], []
            for words in wh.groups(batch.column(0), wh.BY_SYMBOL):
                text = words.text
                for k in range(1, width + 1):
                    ok = wh.whole(text, k)
                    if k < width:  # only a window as short as this is looked for by so short a shingle
                        ok &= words.counts[text[: len(ok)]] == k
                    got = wh.grams(words.hash, k)[ok]
                    n.append(np.full(len(got), k, np.int32))
                    out.append(got.view(np.int64))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(n), pa.int32()), pa.array(np.concatenate(out), pa.int64())], ["width", "hash"])

    return windows.select(F.array_join("words", " ").alias("text")).mapInArrow(hashes, "width int, hash long").distinct()


def shared_runs(documents: DataFrame, windows: DataFrame, *, width: int, bits: int) -> DataFrame:
    """Per document its number of words and the runs of words that some window's shingles cover."""
    hashes = cut_lineage(_window_hashes(windows, width))
    widths = [r.width for r in hashes.select("width").distinct().collect()]  # at most ``width`` numbers
    filters = bitmap.build(hashes, "hash", bits)
    kind = documents.schema["doc_id"].dataType

    def runs(batches):
        known = filters.value
        for batch in batches:
            size = batch.num_rows
            n_words, at, length, count, found = np.zeros(size, np.int64), [], [], np.zeros(size, np.int32), []
            for words in wh.groups(batch.column("text"), wh.BY_SYMBOL):
                text, bounds = words.text, words.bounds
                n_words[words.first : words.first + len(words.counts)] = words.counts
                edge = np.zeros(len(text) + 1, np.int32)
                for k in widths:
                    hit = np.flatnonzero(wh.whole(text, k) & bitmap.contains(known, wh.grams(words.hash, k)))
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + k, -1)
                covered = np.cumsum(edge[:-1]) > 0
                first = covered.copy()
                first[1:] &= ~covered[:-1] | (text[1:] != text[:-1])
                last = covered.copy()
                last[:-1] &= ~covered[1:] | (text[1:] != text[:-1])
                for s, e in zip(np.flatnonzero(first), np.flatnonzero(last) + 1):
                    t = text[s]
                    at.append(s - bounds[t])
                    length.append(e - s)
                    count[words.first + t] += 1
                    piece = words.data[words.start[s] : words.end[e - 1]]
                    found.append((piece, words.start[s:e] - words.start[s], words.end[s:e] - words.start[s]))
            flat = [x for piece, s, e in found for x in _cut(piece, s, e)]
            each = pa.StructArray.from_arrays([pa.array(np.asarray(at, np.int64)), wh.lists(flat, np.asarray(length, np.int32), pa.string())], ["at", "words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), batch.column("doc_id"), pa.array(n_words), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), each)],
                ["k1", "k2", "doc_id", "n_words", "runs"],
            )

    source = plain(documents, "doc_id", "text").select(*row_key(), "doc_id", "text")
    return source.mapInArrow(runs, SHARED.format(kind=kind.simpleString()))


def _cut(piece, starts, ends):
    text = piece.tobytes().translate(_LOWER)
    return [text[s:e].decode("utf-8", "replace") for s, e in zip(starts, ends)]


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def occurrences(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, width: int = 5, bits: int = bitmap.BITS) -> DataFrame:
    """One row per document: k1, k2, doc_id, n_words, n_hit and items (sorted strings).

    A document word counts as hit if it lies inside any occurrence of a window of ``window`` item words (of all words, for a
    shorter item). Null and empty texts have no words and are never hit; items without words have no window; repeated rows get
    equal results; an empty benchmark hits nothing. ``width`` and ``bits`` change the cost only, never the result.
    """
    windows = cut_lineage(item_windows(benchmark, window))
    numbered = cut_lineage(shared_runs(documents, windows, width=width, bits=bits).withColumn("row_id", F.monotonically_increasing_id()))
    runs = numbered.select("row_id", F.explode("runs").alias("run")).select("row_id", "run.at", "run.words")

    # how often each shingle occurs in the documents; a window with a shingle that never does cannot occur
    widths = windows.select(F.least(F.size("words"), F.lit(width)).alias("w")).distinct().collect()  # at most ``width`` numbers
    empty = F.array().cast("array<struct<offset:int,shingle:bigint>>")
    back = window  # words of context on either side of a shingle that a window around it can reach
    each = runs.select(
        "row_id", "at", "words",
        F.explode(F.concat(empty, *(F.when(F.size("words") >= r.w, _shingles(F.col("words"), r.w)).otherwise(empty) for r in sorted(widths)))).alias("s"),
    ).select(
        "row_id", F.col("s.shingle").alias("shingle"), (F.col("at") + F.col("s.offset")).alias("at"),
        F.least(F.col("s.offset"), F.lit(back)).alias("before"),
        F.slice("words", F.greatest(F.col("s.offset") - back, F.lit(0)) + 1, F.lit(2 * back)).alias("near"),
    )
    frequency = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    needed = (
        windows.select("words", "items", F.xxhash64("words").alias("window_id"), F.explode(_shingles(F.col("words"), width)).alias("s"))
        .select("words", "items", "window_id", "s.offset", "s.shingle")
        .join(frequency, "shingle", "left")
        .groupBy("words").agg(
            F.first("items").alias("items"), F.min(F.coalesce("n", F.lit(0))).alias("least"),
            F.min_by(F.struct("shingle", "offset"), F.struct(F.coalesce("n", F.lit(0)), "shingle", "offset")).alias("prefix"),
        )
        .where("least > 0").select("words", "items", "prefix.shingle", "prefix.offset")
    )
    start = F.col("before") - F.col("offset")  # of the window in ``near``, from 0
    hits = (
        each.join(needed.withColumnRenamed("words", "wanted"), "shingle")
        .where((start >= 0) & (start + F.size("wanted") <= F.size("near")))
        .where(F.slice("near", start + 1, F.size("wanted")) == F.col("wanted"))
        .select("row_id", (F.col("at") - F.col("offset")).alias("at"), F.size("wanted").alias("size"), "items")
        .groupBy("row_id").agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.collect_set("items").alias("items"))
    )
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))
    hits = hits.select("row_id", F.size(F.array_distinct(places)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    none = F.array().cast("array<string>")
    return numbered.join(hits, "row_id", "left").select("k1", "k2", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents without any hit, all columns unchanged; see :func:`occurrences`."""
    bad = occurrences(documents, benchmark, **settings).where("n_hit > 0").select("k1", "k2").distinct()
    kept = packed(documents, *row_key()).join(bad, ["k1", "k2"], "left_anti")
    return unpacked(kept, documents.columns)
