"""Removal of repeated windows against a plain version."""

import random

import brute
import pytest

from panelspark.llm import substrings


def plainly(rows, width):
    """[(doc_id, n_words, n_removed, spans, kept)] of rows (doc_id, text)."""
    rank = lambda d: substrings.LAST if d is None else d
    words = [brute.words(t) for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            least[key] = min(rank(d), least.get(key, rank(d)))
    out = []
    for (d, _), w in zip(rows, words):
        gone, seen = set(), set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen or least[key] < rank(d):
                gone.update(range(i, i + width))
            seen.add(key)
        spans = []
        for i in sorted(gone):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out.append((d, len(w), len(gone), [tuple(s) for s in spans], " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def check(docs, width):
    got = substrings.deduplicate_substrings(docs, width=width).select("doc_id", "n_words", "n_removed", "spans", "kept").collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.spans], r.kept) for r in got), key=repr)
    want = plainly([tuple(r) for r in docs.select("doc_id", "text").collect()], width)
    assert got == want
    return want


def test_tables_and_odd_rows(spark, sf, odd_documents, no_documents):
    assert any(0 < r[2] < r[1] for r in check(spark.read.parquet(f"{sf}/documents.parquet"), 20))
    check(odd_documents, 20)
    check(odd_documents, 3)
    assert check(no_documents, 20) == []


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages_and_periods(spark, seed):
    """Passages of just the width and one word less, inner repetition, periodic texts and ends of texts."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for d in range(120):
        w = [f"a{r.randrange(40)}" for _ in range(r.randrange(30))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w) + 1)
            length = r.choice([4, 5, 6, 9, 12])
            begin = r.randrange(12 - length + 1)
            w[at:at] = passage[begin : begin + length]
        rows.append((r.randrange(100), "  ".join(w)))
    rows += [(200, "x " * 40), (201, "x y " * 20 + "\tx"), (202, "x y z " * 5), (203, " ".join(passage)), (204, " ".join(passage))]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 5)


def test_a_passage_in_most_documents(spark, monkeypatch):
    """Pieces smaller than a text's share settle nothing alone, larger ones nearly all: results are the same."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(d, f"{d} start u{d} {passage} end {d}" if d % 3 else passage) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = check(docs, 20)
    monkeypatch.setattr(substrings.wh, "GROUP", 300)
    assert check(docs, 20) == want
