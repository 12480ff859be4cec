"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its hashed words and word beginnings; a document is toxic if any sentence is
(noisy-or): P = 1 - prod(1 - p). Weights are learned from document labels alone, through that product, and then point to the
offending sentences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import wordhash as wh
from panelspark.llm.labelled import held_out, sample
from panelspark.llm.rows import plain

#: Weights are a table of this size; 2^18 floats are 1 MB.
SLOTS = 1 << 18
#: Most labelled documents a model is fitted on.
MAX_FIT = 6_000
#: Beginnings of a word in bytes that are features beside the word itself, so inflected words share what they begin with.
PREFIXES = (4, 5, 6)
EACH = 1 + len(PREFIXES)
ENDS = np.isin(np.arange(256), [*b".!?\n"])


def _sentences(words: wh.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence, and the text it is in. A sentence ends at . ! ? or a line's end between words."""
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = words.start[0], words.end[-1]
    marks = np.concatenate(([0], np.cumsum(ENDS[words.data[lo:hi]])))
    text = words.text
    cut = (marks[words.start[1:] - lo] > marks[words.end[:-1] - lo]) | (text[1:] != text[:-1])
    first = np.concatenate(([0], np.flatnonzero(cut) + 1))
    return first, text[first]


def _groups(column):
    return wh.groups(column, wh.BY_SYMBOL, PREFIXES)


def _slots(words: wh.Words) -> np.ndarray:
    """``EACH`` slots of every word, word by word."""
    hashes = np.column_stack((words.hash, *(words.prefix[:, j] + np.uint64(n) for j, n in enumerate(PREFIXES))))
    return (wh.scramble(hashes) & np.uint64(SLOTS - 1)).astype(np.int64).ravel()


def _bags(fitted_on: DataFrame):
    """Collect the words' slots, sentence sizes and labels of a bounded sample."""

    def bags(batches):
        for batch in batches:
            y = batch.column("y").to_numpy()
            rows = []
            for words in _groups(batch.column("text")):
                slots, (first, text) = _slots(words).astype(np.int32), _sentences(words)
                sizes = np.diff(np.append(first, len(words.hash))).astype(np.int32) * EACH
                bounds, at = words.bounds * EACH, np.searchsorted(text, np.arange(len(words.counts) + 1))
                for t in range(len(words.counts)):
                    if words.counts[t]:
                        rows.append((slots[bounds[t] : bounds[t + 1]].tobytes(), sizes[at[t] : at[t + 1]].tobytes(), int(y[words.first + t])))
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.int32()))], ["slots", "sizes", "y"])

    rows = fitted_on.mapInArrow(bags, "slots binary, sizes binary, y int").collect()
    rows.sort()  # the order of tasks must not matter
    return [(np.frombuffer(r.slots, np.int32), np.frombuffer(r.sizes, np.int32), r.y) for r in rows]


def _softplus(x):
    return np.logaddexp(0, x)


def fit(fitted_on: DataFrame, **settings) -> tuple[np.ndarray, float]:
    """(weights, bias) from a bounded sample (text, y)."""
    return learn(_bags(fitted_on), **settings)


def _informative(bags, least_documents: int, least_z: float) -> np.ndarray:
    """Slots that are in enough toxic documents, and in more of them than chance explains: only such can make a sentence toxic."""
    seen, toxic = np.zeros(SLOTS), np.zeros(SLOTS)
    for slots, _, y in bags:
        own = np.unique(slots)
        seen[own] += 1
        toxic[own] += y
    share = np.clip(sum(y for _, _, y in bags) / len(bags), 1e-6, 1 - 1e-6)
    z = (toxic - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    return (toxic >= least_documents) & (z >= least_z)


def learn(bags, *, epochs: int = 60, batch: int = 128, rate: float = 0.5, decay: float = 1e-5, least_documents: int = 5, least_z: float = 4.0) -> tuple[np.ndarray, float]:
    """Descend the noisy-or likelihood of (slots, sentence sizes, label) bags, over the slots that are informative at all."""
    weights, bias = np.zeros(SLOTS), -5.0
    if not bags:
        return weights.astype(np.float32), bias
    useful = _informative(bags, least_documents, least_z)
    names = np.flatnonzero(useful)
    place = np.cumsum(useful) - 1
    w = np.zeros(len(names))
    rows = []
    for slots, sizes, y in bags:
        keep = useful[slots]
        rows.append((place[slots[keep]], np.repeat(np.arange(len(sizes)), sizes)[keep], len(sizes), y))
    scale, scale_bias = np.full(len(w), 1e-8), 1e-8  # sums of squared gradients
    random = np.random.default_rng(0)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = [rows[i] for i in order[at : at + batch]]
            count = np.array([r[2] for r in some])
            slots = np.concatenate([r[0] for r in some])
            sentence = np.concatenate([r[1] + n for r, n in zip(some, np.cumsum(count) - count)])
            owner = np.repeat(np.arange(len(some)), count)
            y = np.array([r[3] for r in some])
            s = np.clip(bias + np.bincount(sentence, w[slots], len(owner)), -30, 30)
            p = 1 / (1 + np.exp(-s))
            none = np.bincount(owner, _softplus(s), len(some))  # -log of the chance that no sentence is toxic
            # of -log P for toxic documents, and of -log(1 - P) for the others
            push = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(none, 50)), 1e-6), 1.0)
            g = push[owner] * p
            grad = np.bincount(slots, g[sentence], len(w)) / len(some) + decay * w
            scale += grad * grad
            w -= rate * grad / np.sqrt(scale)
            grad_bias = g.sum() / len(some)
            scale_bias += grad_bias**2
            bias -= 0.3 * rate * grad_bias / np.sqrt(scale_bias)
    weights[names] = w
    return weights.astype(np.float32), float(bias)


def _scores(words: wh.Words, weights, bias):
    first, text = _sentences(words)
    slots = _slots(words)
    sizes = np.diff(np.append(first, len(words.hash))) * EACH
    s = bias + np.bincount(np.repeat(np.arange(len(first)), sizes), weights[slots], len(first))
    return first, text, s


def score(documents: DataFrame, model) -> DataFrame:
    """doc_id, score (chance that a sentence is toxic), and the worst sentence: its score, first word (from 0) and number of words.

    Texts without words, null and empty ones have the score 0 and no sentence. Repeated rows get equal scores.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scored(batches):
        weights, bias = shared.value
        for batch in batches:
            n = batch.num_rows
            total, worst, at, size = np.zeros(n), np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for words in _groups(batch.column("text")):
                first, text, s = _scores(words, weights, bias)
                if not len(first):
                    continue
                sizes, bounds = np.diff(np.append(first, len(words.hash))), words.bounds
                total[words.first : words.first + len(words.counts)] = -np.expm1(-np.bincount(text, _softplus(s), len(words.counts)))
                for t, lo, hi in zip(*_runs(text)):
                    j = lo + int(np.argmax(s[lo:hi]))
                    i = words.first + t
                    worst[i], at[i], size[i] = 1 / (1 + np.exp(-s[j])), first[j] - bounds[t], sizes[j]
            none = pa.array(np.isnan(worst))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total), *(pa.array(x, mask=np.asarray(none)) for x in (worst, at, size))], ["doc_id", "score", "worst_score", "worst_at", "worst_words"])

    return plain(documents, "doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double, worst_score double, worst_at long, worst_words long")


def _runs(text: np.ndarray):
    """Values, starts and ends of runs of equal values."""
    lo = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    return text[lo], lo, np.append(lo[1:], len(text))


def toxic_documents(documents: DataFrame, labels: DataFrame, *, most: int = MAX_FIT, threshold: float = 0.7) -> DataFrame:
    """Fit on the labelled rows that are not held out and score every document: doc_id, held_out, score, predicted and the worst sentence."""
    model = fit(sample(documents, labels, "toxic", most=most))
    return score(documents, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_score", "worst_at", "worst_words")
