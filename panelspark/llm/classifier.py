"""Quality classifier: logistic regression over hashed word n-grams, learned by follow-the-regularised-leader updates.

Features are runs of one and two words, of words as written and of word shapes (each letter, capital or digit stands for its
class), and a mark for a word that repeats the one before it. A score is a sparse dot product of hashed counts with the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import wordhash as wh
from panelspark.llm.labelled import held_out, sample
from panelspark.llm.rows import plain

#: Weights are a table of this size; 2^20 floats are 4 MB.
SLOTS = 1 << 20
#: Most labelled documents a model is fitted on.
MAX_FIT = 6_000


def _shapes() -> tuple[np.ndarray, np.ndarray]:
    is_sep, fold = wh.table(wh.SPACES, lower=False)
    fold[97:123] = fold[97]
    fold[65:91] = fold[65]
    fold[48:58] = fold[48]
    fold[192:] = fold[97]  # the first byte of a letter beyond ASCII
    fold[128:192] = np.uint64(0)  # and its further bytes
    return is_sep, fold


BY_SHAPE = _shapes()


def _features(column):
    """Yield (first text, number of texts, text of each feature, slot of each feature) for groups of texts."""
    for words, shapes in zip(wh.groups(column, wh.BY_SPACE_CASED), wh.groups(column, BY_SHAPE)):
        text = words.text
        out_text, out = [], []
        for kind, h in enumerate((words.hash, shapes.hash)):
            for k in (1, 2):
                ok = wh.whole(text, k)
                out.append(wh.scramble(wh.grams(h, k)[ok] + np.uint64(10 * kind + k)))
                out_text.append(text[: len(ok)][ok])
        again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1]))
        out.append(np.full(len(again), 99, np.uint64))
        out_text.append(text[again])
        yield words.first, len(words.counts), np.concatenate(out_text), (np.concatenate(out) & np.uint64(SLOTS - 1)).astype(np.int64)


def _examples(fitted_on: DataFrame):
    def counted(batches):
        for batch in batches:
            y = batch.column("y").to_numpy()
            rows = []
            for first, n, text, slots in _features(batch.column("text")):
                order = np.argsort(text, kind="stable")
                slots, bounds = slots[order], np.searchsorted(text[order], np.arange(n + 1))
                for t in range(n):
                    found, count = np.unique(slots[bounds[t] : bounds[t + 1]], return_counts=True)
                    rows.append((found.astype(np.int32).tobytes(), count.astype(np.int32).tobytes(), int(y[first + t])))
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.int32()))], ["slots", "counts", "y"])

    rows = fitted_on.mapInArrow(counted, "slots binary, counts binary, y int").collect()
    rows.sort()  # the order of tasks must not matter
    return [(np.frombuffer(r.slots, np.int32), np.frombuffer(r.counts, np.int32), r.y) for r in rows]


def fit(fitted_on: DataFrame, *, epochs: int = 3, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """(weights, bias) by FTRL-proximal over a bounded sample (text, y): one update per document, ``epochs`` times in random order."""
    examples = _examples(fitted_on)
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)  # the last is the bias, which is not shrunk
    random = np.random.default_rng(0)

    def weights(at, zs, ns):
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
        return np.where((np.abs(zs) <= l1) & (at < SLOTS), 0.0, w)

    for _ in range(epochs):
        for i in random.permutation(len(examples)):
            slots, counts, y = examples[i]
            at = np.append(slots, SLOTS)
            x = np.append(counts / np.sqrt(max(1, counts.sum())), 1.0)
            w = weights(at, z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(SLOTS + 1), z, n)
    return w[:SLOTS].astype(np.float32), float(w[SLOTS])


def score(documents: DataFrame, model) -> DataFrame:
    """doc_id and score, the chance of label 1; texts without words get the model's prior. Repeated rows get equal scores."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scored(batches):
        weights, bias = shared.value
        for batch in batches:
            s = np.zeros(batch.num_rows)
            for first, n, text, slots in _features(batch.column("text")):
                total, count = np.bincount(text, weights[slots], n), np.bincount(text, minlength=n)
                s[first : first + n] = total / np.sqrt(np.maximum(1, count))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(s + bias, -35, 35))))], ["doc_id", "score"])

    return plain(documents, "doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def quality_scores(documents: DataFrame, labels: DataFrame, *, most: int = MAX_FIT, threshold: float = 0.5) -> DataFrame:
    """Fit on the labelled rows that are not held out and score every document: doc_id, held_out, score and predicted."""
    model = fit(sample(documents, labels, "quality", most=most))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
