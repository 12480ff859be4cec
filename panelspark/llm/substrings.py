"""Substring deduplication: words that lie in a window of fixed length which also starts earlier in the corpus.

Every window of ``width`` consecutive words has a Rabin-Karp hash, taken from prefix sums of word hashes times powers of a base. A
window can only repeat where the inner run of half its length with the smallest hash repeats too, and neighbouring windows mostly
share that run; so these runs are counted first, one row for several windows, and only windows over a run that two documents hold
go on to be counted themselves. A window that a smaller doc_id holds too is removed; removed windows merge into maximal intervals.

Whatever a piece of a few megabytes can settle alone is settled there and gets a key of its own, so a passage that a third of all
documents carry reaches the count of its hash only once for each piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import wordhash as wh
from panelspark.llm.rows import plain, row_key, text_key

#: Rank of a null id: behind all others.
LAST = (1 << 63) - 1
SPAN = "array<struct<start: bigint, end: bigint>>"


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` words: sum of word * base^(its place in the run) modulo 2^64, scrambled."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = wh._Powers.of(len(hashes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])))
    return wh.scramble((sums[width:] - sums[:n]) * down[:n] + np.uint64(width))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest value, the first of equal ones, in every run of ``span`` values."""
    at, width = np.arange(len(values)), 1
    while width < span:
        step = min(width, span - width)
        later = values[step:] < values[:-step]
        values, at = np.where(later, values[step:], values[:-step]), np.where(later, at[step:], at[:-step])
        width += step
    return at


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where consecutive rows of sorted columns begin a new group."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _place(key: np.ndarray, own: np.ndarray, settled: np.ndarray) -> np.ndarray:
    """Where rows meet: those of one key together, settled ones each at a place of its own row."""
    return np.where(settled, wh.scramble(key ^ wh.scramble(own.view(np.uint64))), key).view(np.int64)


def _rank() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank")


def _rows(documents: DataFrame) -> DataFrame:
    """Every row with a 64-bit key of its id and text; the joins below shuffle this frame by the key, once."""
    return plain(documents, "doc_id", "text").select(row_key()[0], "doc_id", "text")


def _copies(documents: DataFrame) -> DataFrame:
    """(k1) of rows whose whole text stands in a row with a smaller doc_id."""
    each = plain(documents, "doc_id", "text").select(row_key()[0], _rank(), *text_key()).where("text is not null")
    first = each.groupBy("t1", "t2").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).where("least < most").drop("most")
    return each.join(first, ["t1", "t2"]).where("rank > least").select("k1").distinct()


def stretches(documents: DataFrame, *, width: int) -> DataFrame:
    """(k1, start, n): stretches of windows of one row whose inner run is also in another row."""
    inner = max(1, width // 3)

    def runs(batches):
        for batch in batches:
            k1 = batch.column("k1").to_numpy()
            for words in wh.groups(batch.column("text"), wh.BY_SPACE_CASED):
                text, small = words.text, rolling(words.hash, inner)
                n = len(words.hash) - width + 1
                if n <= 0:
                    continue
                inside = np.flatnonzero(text[:n] == text[width - 1 :])
                at = _least(small, width - inner + 1)[inside]
                begin = _firsts(at, text[inside], inside - np.arange(len(inside)))
                if not len(begin):
                    continue
                start, run, owner = inside[begin], small[at[begin]], text[inside[begin]]
                order = np.argsort(run, kind="stable")  # texts stay in order
                first = _firsts(run[order])
                of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
                low, high = owner[order][first], owner[order][np.append(first[1:], len(order)) - 1]
                shared, leads = np.empty(len(run), bool), np.empty(len(run), bool)
                shared[order], leads[order] = (low < high)[of], owner[order] == low[of]
                own = k1[words.first + owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_place(run, own, shared & ~leads)), pa.array(own), pa.array((start - words.bounds[owner]).astype(np.int32)),
                     pa.array(np.diff(np.append(begin, len(inside))).astype(np.int32)), pa.array(shared)], ["place", "k1", "start", "n", "shared"])

    found = _rows(documents).select("k1", "text").mapInArrow(runs, "place long, k1 long, start int, n int, shared boolean")
    same = Window.partitionBy("place")
    return found.withColumn("many", F.min("k1").over(same) < F.max("k1").over(same)).where("shared or many").select("k1", "start", "n")


def removed_windows(documents: DataFrame, *, width: int) -> DataFrame:
    """(k1, copy, starts): rows whose text a smaller doc_id has, and first windows of their hash in a row that a smaller doc_id holds too.

    Further windows of the same hash in a row are left out.
    """
    listed = stretches(documents, width=width).groupBy("k1").agg(F.collect_list(F.struct("start", "n")).alias("some"))
    # copies of a text have no windows that its first row has not
    joined = _rows(documents).join(listed.join(_copies(documents), "k1", "left_anti"), "k1").select("k1", _rank(), "text", F.col("some.start").alias("start"), F.col("some.n").alias("n"))

    def windows(batches):
        for batch in batches:
            k1, rank = (batch.column(c).to_numpy() for c in ("k1", "rank"))
            cuts, begin, count = batch.column("start").offsets.to_numpy(), batch.column("start").flatten().to_numpy(), batch.column("n").flatten().to_numpy()
            cuts = cuts - cuts[0]
            for words in wh.groups(batch.column("text"), wh.BY_SPACE_CASED):
                some = cuts[words.first : words.first + len(words.counts) + 1]
                owner = np.repeat(np.arange(len(words.counts)), np.diff(some))
                base, n = words.bounds[owner] + begin[some[0] : some[-1]], count[some[0] : some[-1]]
                owner = np.repeat(owner, n)
                at = np.repeat(base - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
                key = rolling(words.hash, width)[at]
                row = words.first + owner
                order = np.lexsort((at, row, rank[row], key))
                key, row, at, owner = key[order], row[order], at[order], owner[order]
                one = _firsts(key, row)  # the first window of a hash in a row
                key, row, at, owner = key[one], row[one], at[one], owner[one]
                first = _firsts(key)
                settled = rank[row] > np.repeat(rank[row[first]], np.diff(np.append(first, len(key))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_place(key, k1[row], settled)), pa.array(rank[row]), pa.array(k1[row]), pa.array((at - words.bounds[owner]).astype(np.int32)), pa.array(settled)],
                    ["place", "rank", "k1", "start", "settled"])

    counted = joined.mapInArrow(windows, "place long, rank long, k1 long, start int, settled boolean")
    late = counted.withColumn("least", F.min("rank").over(Window.partitionBy("place"))).where("settled or rank > least")
    starts = late.groupBy("k1").agg(F.collect_list("start").alias("starts"))
    return starts.select("k1", F.lit(False).alias("copy"), "starts").unionByName(_copies(documents).select("k1", F.lit(True).alias("copy"), F.array().cast("array<int>").alias("starts")))


def deduplicate_substrings(documents: DataFrame, *, width: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed [start, end) in words, maximal) and kept, the other words joined by one space.

    Words are separated by white space and compared as they are. A window is removed if its words also start earlier in the same
    text or in a document with a smaller doc_id; windows are judged on the input. Null and empty texts and texts shorter than
    ``width`` lose nothing. Rows with one doc_id do not precede each other, so repeated rows get equal results; null ids come last.
    Windows and rows are told apart by 64-bit hashes.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    found = removed_windows(documents, width=width)
    none = F.array().cast("array<int>")
    rows = _rows(documents).join(found, "k1", "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("starts", none).alias("starts"))

    def kept(batches):
        for batch in batches:
            cuts, starts = batch.column("starts").offsets.to_numpy(), batch.column("starts").flatten().to_numpy()
            cuts, copy = cuts - cuts[0], batch.column("copy").to_numpy(zero_copy_only=False)
            for words in wh.groups(batch.column("text"), wh.BY_SPACE_CASED):
                yield _shortened(batch.column("doc_id").slice(words.first, len(words.counts)), words, copy, cuts, starts, width)

    return rows.mapInArrow(kept, f"doc_id {kind}, n_words long, n_removed long, spans {SPAN}, kept string")


def _shortened(ids, words: wh.Words, copy: np.ndarray, cuts: np.ndarray, starts: np.ndarray, width: int) -> pa.RecordBatch:
    """Results of one group of texts; ``starts`` from cuts[i] to cuts[i + 1] are the i-th text's removed windows, and a copy loses all its windows."""
    bounds, text, n = words.bounds, words.text, len(words.hash)
    some = cuts[words.first : words.first + len(words.counts) + 1]
    given = np.repeat(bounds[:-1], np.diff(some)) + starts[some[0] : some[-1]]
    windows = rolling(words.hash, width)
    inside = np.flatnonzero(text[: len(windows)] == text[len(text) - len(windows) :]) if len(windows) else np.zeros(0, np.int64)
    order = inside[np.lexsort((windows[inside], text[inside]))]  # stable: equal windows of a text stay in order
    later = np.ones(len(order), bool)
    later[_firsts(windows[order], text[order]) if len(order) else []] = False
    change = np.zeros(n + 1, np.int64)
    for at in (given, order[later]):
        np.add.at(change, at, 1)
        np.add.at(change, at + width, -1)
    whole = copy[words.first : words.first + len(words.counts)] & (words.counts >= width)
    gone = (np.cumsum(change[:n]) > 0) | whole[text]
    edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    if len(bounds) > 2:  # an interval ends where its text ends
        inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < n)]
        split = np.unique(inner[gone[inner] & gone[inner - 1]])
    else:
        split = np.zeros(0, np.int64)
    begin, end = np.sort(np.append(np.flatnonzero(edge == 1), split)), np.sort(np.append(np.flatnonzero(edge == -1), split))
    owner = text[begin] if len(begin) else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(begin - bounds[owner], pa.int64()), pa.array(end - bounds[owner], pa.int64())], ["start", "end"])
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(words.counts) + 1)), pa.int32()), spans)
    # kept words with the byte behind each but a text's last one, which becomes a space
    keep = np.flatnonzero(~gone)
    last = np.ones(len(keep), bool)
    last[:-1] = text[keep[1:]] != text[keep[:-1]]
    lo, hi = (int(words.start[0]), int(words.end[-1])) if n else (0, 0)
    data = words.data[lo:hi].copy()
    begin, end = words.start[keep] - lo, words.end[keep] - lo
    data[end[~last]] = 32
    change = np.zeros(hi - lo + 1, np.int8)
    change[begin] += 1
    stop = end + ~last
    np.add.at(change, stop, -1)
    kept = np.cumsum(change[:-1], dtype=np.int8) > 0
    lengths = np.bincount(text[keep], weights=stop - begin, minlength=len(words.counts)).astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(words.counts), pa.py_buffer(np.concatenate(([0], np.cumsum(lengths)))), pa.py_buffer(data[kept].tobytes()))
    removed = np.bincount(text[gone], minlength=len(words.counts)) if n else np.zeros(len(words.counts), np.int64)
    return pa.RecordBatch.from_arrays([ids, pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), listed, out.cast(pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])
