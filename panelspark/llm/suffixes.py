"""Passages that repeat across documents, found with a sparse suffix array.

Only suffixes that start at content-selected positions are kept: in every run of consecutive positions the one whose next words
have the smallest hash (a minimiser). A passage of ``min_words`` words contains a whole run, so all its occurrences keep the same
position. Suffixes whose first words repeat are sorted over all machines; each is compared with its neighbours in that order, and a
match is extended to the right and to the left. What reaches ``min_words`` is repeated; longer passages are unions of such matches.

The neighbour with the longest match to the right may have a short one to the left. Where so many suffixes share their first words
that not all of them are neighbours, what is left open is settled exactly: each suffix has at most ``run`` windows of ``min_words`` words
around its first words, and windows with equal words in two texts are repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import bitmap
from panelspark.llm import wordhash as wh
from panelspark.llm.mixing import size_of
from panelspark.llm.rows import plain, text_key
from panelspark.session import cut_lineage

#: Positions of a run; with it, how many following words a position's hash covers: min_words - RUN + 1.
RUN = 32
#: Neighbours a suffix is compared with on either side, beside the nearest ones of other texts; of so many and one suffixes all pairs are.
REACH = 3
#: Suffixes whose windows are settled together, about.
SETTLED_ROWS = 20_000
#: 2^26 bits are 8 MB.
BITS = 1 << 26
ROW = "key long, right binary, left binary, t1 long, t2 long, at long, n_right int, n_left int"
NAMES = ["key", "right", "left", "t1", "t2", "at", "n_right", "n_left"]


def _anchors(words: wh.Words, k: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected word positions (in the group of texts) and the hashes of the k words from there."""
    text, value = words.text, wh.grams(words.hash, k)
    key = value
    n = len(words.hash) - k - run + 2
    if n <= 0:
        return np.zeros(0, np.int64), key
    at, span = np.arange(len(value)), 1
    while span < run:  # smallest value of ever longer runs, the first of equal ones
        step = min(span, run - span)
        later = value[step:] < value[:-step]
        value, at = np.where(later, value[step:], value[:-step]), np.where(later, at[step:], at[:-step])
        span += step
    inside = text[:n] == text[k + run - 2 :]
    return np.unique(at[:n][inside]), key


def _new_texts(batch, seen: set):
    """Rows of texts that this task has not met yet, so that copies are not shuffled over and over."""
    keep = []
    for i, k in enumerate(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist())):
        if k not in seen:
            seen.add(k)
            keep.append(i)
    return batch.take(pa.array(keep, pa.int64()))


def _texts(documents: DataFrame) -> DataFrame:
    return plain(documents, "text").select(*text_key(), "text")


def repeated_keys(documents: DataFrame, *, min_words: int, run: int) -> DataFrame:
    """Hashes at selected positions that two texts, or two positions, share."""
    k = min_words - run + 1

    def rows(batches):
        seen: set = set()
        for batch in batches:
            batch = _new_texts(batch, seen)
            t1 = batch.column("t1").to_numpy()
            for words in wh.groups(batch.column("text")):
                at, key = _anchors(words, k, run)
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(t1[words.first + words.text[at]])], ["key", "t1"])

    found = _texts(documents).mapInArrow(rows, "key long, t1 long")
    return found.groupBy("key").agg(F.min("t1").alias("a"), F.max("t1").alias("b")).where("a < b").select("key")


def suffixes(documents: DataFrame, keys: DataFrame, *, min_words: int, run: int, bits: int) -> DataFrame:
    """Suffixes at selected positions whose key repeats: the words after the key (right) and before it (left, nearest first), hashed."""
    k, side = min_words - run + 1, run - 1
    filters = bitmap.build(keys, "key", bits)

    def rows(batches):
        known, seen = filters.value, set()
        for batch in batches:
            batch = _new_texts(batch, seen)
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            for words in wh.groups(batch.column("text")):
                at, key = _anchors(words, k, run)
                at = at[bitmap.contains(known, key[at])]
                if not len(at):
                    continue
                text, bounds = words.text[at], words.bounds
                n_right = np.minimum(side, bounds[text + 1] - at - k)
                n_left = np.minimum(side, at - bounds[text])
                short = np.concatenate((words.hash.astype(np.uint32), np.zeros(1, np.uint32)))
                steps = np.arange(side)
                right = np.where(steps < n_right[:, None], short[np.minimum(at[:, None] + k + steps, len(short) - 1)], 0)
                left = np.where(steps < n_left[:, None], short[np.maximum(at[:, None] - 1 - steps, 0)], 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at].view(np.int64)), _binary(right), _binary(left), pa.array(t1[words.first + text]), pa.array(t2[words.first + text]),
                     pa.array(at - bounds[text]), pa.array(n_right.astype(np.int32)), pa.array(n_left.astype(np.int32))], NAMES)

    return _texts(documents).mapInArrow(rows, ROW)


def _binary(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values, np.uint32)
    offsets = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of rows."""
    differs = a != b
    return np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1]), most)


def _run_ends(t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """Ends of the runs of consecutive suffixes of one text."""
    return np.append(np.flatnonzero((t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])) + 1, len(t1)) if len(t1) else np.zeros(0, np.int64)


def _matches(rows: pa.Table, k: int, min_words: int) -> list[tuple]:
    """(t1, t2, start, end, later) of sorted suffixes that match a neighbour."""
    key, t1, t2, at, n_right, n_left = (rows.column(n).to_numpy() for n in ("key", "t1", "t2", "at", "n_right", "n_left"))
    right, left = (np.frombuffer(b"".join(rows.column(n).to_pylist()), np.uint32).reshape(len(key), -1) for n in ("right", "left"))
    out = []
    n = len(key)
    ends = _run_ends(t1, t2)
    starts = np.concatenate(([0], ends[:-1]))
    rows_of = np.repeat(np.arange(len(ends)), ends - starts)
    every = np.arange(n)
    pairs = [(every[:-lag], every[lag:]) for lag in range(1, min(REACH, n - 1) + 1)]
    pairs += [(every, ends[rows_of]), (starts[rows_of] - 1, every)]  # the nearest suffix of another text, after and before
    for a, b in pairs:
        ok = (a >= 0) & (b < n)
        a, b = a[ok], b[ok]
        ok = (key[a] == key[b]) & ((t1[a] != t1[b]) | (t2[a] != t2[b]))
        a, b = a[ok], b[ok]
        r = _common(right[a], right[b], np.minimum(n_right[a], n_right[b]))
        f = _common(left[a], left[b], np.minimum(n_left[a], n_left[b]))
        ok = f + k + r >= min_words
        a, b, r, f = a[ok], b[ok], r[ok], f[ok]
        first = (t1[a] < t1[b]) | ((t1[a] == t1[b]) & (t2[a] < t2[b]))
        for x, later in ((a, ~first), (b, first)):
            out.append((t1[x], t2[x], at[x] - f, at[x] + k + r, later))
    return out


SPANS = ["t1", "t2", "start", "end", "later"]


def _windows(rows: pa.Table, k: int, min_words: int):
    """(hash, suffix, words before its first words) of every window of ``min_words`` words around the suffixes' first words."""
    key, n_right, n_left = (rows.column(n).to_numpy() for n in ("key", "n_right", "n_left"))
    right, left = (np.frombuffer(b"".join(rows.column(n).to_pylist()), np.uint32).reshape(len(key), -1).astype(np.uint64) for n in ("right", "left"))
    side = min_words - k
    before, after = np.empty((side + 1, len(key)), np.uint64), np.empty((side + 1, len(key)), np.uint64)
    before[0], after[0] = key.view(np.uint64), wh.scramble(key.view(np.uint64))
    for j in range(side):
        before[j + 1] = wh.scramble(before[j] * np.uint64(wh.STEP) + left[:, j])
        after[j + 1] = wh.scramble(after[j] * np.uint64(wh.STEP) + right[:, j])
    back = np.arange(side + 1)[:, None]
    there = (n_left >= back) & (n_right >= side - back)
    j, suffix = np.nonzero(there)
    return wh.scramble(before[j, suffix] * np.uint64(wh.STEP) + after[side - j, suffix] + j.astype(np.uint64)).view(np.int64), suffix, j


def _runs(t1, t2, at, j, suffix, later, min_words: int):
    """Spans of windows: neighbouring ones of a suffix, alike in ``later``, are one."""
    order = np.lexsort((j, later, suffix))
    j, suffix, later = j[order], suffix[order], later[order]
    new = np.ones(len(j), bool)
    new[1:] = (suffix[1:] != suffix[:-1]) | (later[1:] != later[:-1]) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(j))[1:] - 1
    s = suffix[first]
    return t1[s], t2[s], at[s] - j[last], at[s] - j[first] + min_words, later[first]


def _settled(rows: pa.Table, k: int, min_words: int, whole: np.ndarray):
    """Spans of the windows that two texts of these suffixes share, and the windows that other tasks must be asked about.

    ``whole`` tells the suffixes all of whose group is here. Of a group that goes on in another task, a window's text with the smallest
    key asks: the others are repeated and later whatever there is elsewhere.
    """
    t1, t2, at = (rows.column(n).to_numpy() for n in ("t1", "t2", "at"))
    h, suffix, j = _windows(rows, k, min_words)
    order = np.lexsort((t1[suffix], h))
    h, suffix, j = h[order], suffix[order], j[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    text = t1[suffix]
    least, most = text[first][of], text[np.append(first[1:], len(h)) - 1][of] if len(h) else text
    asked = (text == least) & ~whole[suffix]
    here = least < most
    spans = _runs(t1, t2, at, j[here], suffix[here], (text > least)[here], min_words)
    s = suffix[asked]
    return spans, (h[asked], t1[s], t2[s], at[s] - j[asked])


def matches(rows: DataFrame, *, min_words: int, run: int) -> DataFrame:
    """(t1, t2, start, end, later) of all passages that suffixes of two texts share; ``later`` where another text has a smaller key.

    Suffixes are dealt out by range over their whole content, so a passage in any share of all texts is spread over tasks. Only the
    first and the last group of equal first words in a task can go on in another one; their open windows meet by their hashes, at
    most one text of a window from each task.
    """
    k = min_words - run + 1

    def groups(table, first, last):
        """Spans and questions of whole groups; the first or the last of them may go on in another task."""
        key = table.column("key").to_numpy()
        new = np.concatenate(([True], key[1:] != key[:-1]))
        of = np.cumsum(new) - 1
        size = np.bincount(of)
        whole = np.ones(len(size), bool)
        if first:
            whole[0] = False
        if last:
            whole[-1] = False
        yield from ((found, None) for found in _matches(table, k, min_words))
        open_ = np.flatnonzero((size > REACH + 1)[of] | ~whole[of])
        for lo in range(0, len(open_), SETTLED_ROWS):  # whole groups of about so many suffixes
            hi = lo + SETTLED_ROWS
            lo_at = np.searchsorted(of[open_], of[open_[lo]]) if lo else 0
            hi_at = np.searchsorted(of[open_], of[open_[hi]]) if hi < len(open_) else len(open_)
            if hi_at > lo_at:
                some = open_[lo_at:hi_at]
                yield _settled(table.take(pa.array(some)), k, min_words, whole[of[some]])

    def compared(batches):
        held, begun = None, False
        for batch in batches:
            table = pa.Table.from_batches([batch.select(NAMES)])
            table = table if held is None else pa.concat_tables([held, table])
            if len(table) > 1:  # equal rows are copies of one text
                t1, t2, at, key = (table.column(n).to_numpy() for n in ("t1", "t2", "at", "key"))
                same = (t1[1:] == t1[:-1]) & (t2[1:] == t2[:-1]) & (at[1:] == at[:-1]) & (key[1:] == key[:-1])
                table = table.filter(pa.array(np.concatenate(([True], ~same))))
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on in the next batch
            if cut:
                yield from written(groups(table.slice(0, cut).combine_chunks(), not begun, False))
                begun = True
            held = table.slice(cut)
        if held is not None and len(held):
            yield from written(groups(held.combine_chunks(), not begun, True))

    def written(found):
        for spans, asked in found:
            n = len(spans[0])
            if n:
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in spans), pa.nulls(n, pa.int64())], [*SPANS, "hash"])
            if asked is not None and len(asked[0]):
                h, t1, t2, start = asked
                yield pa.RecordBatch.from_arrays([pa.array(t1), pa.array(t2), pa.array(start), pa.array(start + min_words), pa.nulls(len(h), pa.bool_()), pa.array(h)], [*SPANS, "hash"])

    order = ["key", "right", "left", "t1", "t2", "at"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = cut_lineage(dealt.mapInArrow(compared, "t1 long, t2 long, start long, end long, later boolean, hash long"))
    same = Window.partitionBy("hash")
    asked = made.where("hash is not null").withColumns({"least": F.min("t1").over(same), "most": F.max("t1").over(same)}).where("least < most")
    return made.where("hash is null").select(*SPANS).unionByName(asked.select("t1", "t2", "start", "end", (F.col("t1") > F.col("least")).alias("later")))


def _merged(spans):
    """Sorted union of [start, end) spans."""
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), start, step)


def repeats(documents: DataFrame, *, min_words: int = 50, run: int = RUN, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, t1, t2, n_words, spans and later_spans, [start, end) in words.

    ``spans`` are the passages of at least ``min_words`` words that another text has too; ``later_spans`` those of them that a text
    with a smaller key has, which may be cut without losing a passage. Words are separated by white space and compared in lower
    case (A-Z). Documents with equal texts repeat each other wholly; the smallest doc_id of them is not later. Null, empty and
    short texts have no spans. Repetition within one text alone does not count. ``run`` and ``bits`` set the cost only.
    """
    if not 1 < run < min_words:
        raise ValueError("run must lie between 1 and min_words")
    keys = cut_lineage(repeated_keys(documents, min_words=min_words, run=run))
    rows = suffixes(documents, keys, min_words=min_words, run=run, bits=bits)
    found = matches(rows, min_words=min_words, run=run)
    span = F.struct("start", "end")
    found = found.groupBy("t1", "t2").agg(F.collect_set(span).alias("spans"), F.collect_set(F.when(F.col("later"), span)).alias("later"))
    texts = plain(documents, "doc_id", "text").select("doc_id", *text_key(), size_of().alias("n_words"))
    copies = texts.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_id"))
    found = copies.join(found, ["t1", "t2"], "left").where("n_rows > 1 or spans is not null")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    copied = F.coalesce((F.col("n_rows") > 1) & (F.col("n_words") >= min_words), F.lit(False))
    not_first = copied & ~F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(False))
    return texts.join(found, ["t1", "t2"], "left").select(
        "doc_id", "t1", "t2", "n_words",
        F.when(copied, everything).otherwise(_merged(F.coalesce("spans", none))).alias("spans"),
        F.when(not_first, everything).otherwise(_merged(F.coalesce("later", none))).alias("later_spans"),
    )
