"""Classifiers on held-out rows, repeated passages, archives and page text."""

import random

import brute
import numpy as np
import pytest

from panelspark.llm import classifier, extraction, suffixes, toxicity, warc


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


BIG = "/root/testdata/sf0.1"


def rates(scored, labels, label):
    rows = scored.join(labels.select("doc_id", label), "doc_id").where("held_out").select("score", "predicted", label).collect()
    y, p, s = (np.array(x) for x in zip(*((r[label], r.predicted, r.score) for r in rows)))
    order = s.argsort().argsort() + 1
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    return auc, (p == y).mean(), p[y == 1].mean(), p[y == 0].mean()


def test_toxicity_held_out(spark):
    labels = read(spark, BIG, "labels")
    auc, accuracy, caught, wrong = rates(toxicity.toxic_documents(read(spark, BIG, "documents"), labels), labels, "toxic")
    assert auc > 0.9 and accuracy > 0.93 and caught > 0.7 and wrong < 0.03


def test_toxic_sentence_is_found(spark):
    docs = [(i, f"the house {i} is green. we like trees {i}. " + ("you are an awful idiot. " if i % 4 == 0 else "we like rain. ") + f"the end {i}.") for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "... !!"), (1003, "fine day. idiot. trees")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxic_documents(df, labels).collect()}
    assert len(got) == 404 and all(got[i].predicted == (i % 4 == 0) for i in range(400)) and got[8].worst_at == 9 and got[8].worst_words == 5
    assert [got[i].score for i in (1000, 1001, 1002)] == [0, 0, 0] and got[1003].worst_at == 2 and got[1000].worst_at is None
    none = toxicity.toxic_documents(df, labels.where("false")).collect()
    assert len(none) == 404 and all(r.predicted == 0 for r in none)


def test_quality_held_out(spark):
    labels = read(spark, BIG, "labels")
    auc, accuracy, good, wrong = rates(classifier.quality_scores(read(spark, BIG, "documents"), labels), labels, "quality")
    assert auc > 0.9 and accuracy > 0.93 and good > 0.97


def test_quality_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (6, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = classifier.quality_scores(odd_documents, labels).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert classifier.quality_scores(no_documents, labels).count() == 0 and toxicity.score(no_documents, (np.zeros(toxicity.SLOTS), 0.0)).count() == 0


def plain_repeats(rows, n):
    """{doc_id: covered word positions} of runs of n words that another text has."""
    lower = {d: brute.words((t or "").translate(brute.ASCII_LOWER)) for d, t in rows}
    has = {}
    for d, w in lower.items():
        for i in range(len(w) - n + 1):
            has.setdefault(tuple(w[i : i + n]), set()).add(tuple(w))
    copies = {}
    for w in lower.values():
        copies[tuple(w)] = copies.get(tuple(w), 0) + 1
    return {d: {i + j for i in range(len(w) - n + 1) if len(has[tuple(w[i : i + n])]) > 1 or copies[tuple(w)] > 1 for j in range(n)} for d, w in lower.items()}


def covered(spans):
    return {i for s in spans for i in range(s.start, s.end)}


def test_repeated_passages(spark, sf):
    docs = read(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain_repeats(rows, 20)  # the default length is held against SQL
    assert any(want.values())
    for r in suffixes.repeats(docs, min_words=20, run=8).collect():
        assert covered(r.spans) == want[r.doc_id], r.doc_id
        assert covered(r.later_spans) <= covered(r.spans)


def apart(draw, n=60):
    """Two texts that share just 50 words, among texts that share only what follows or only what precedes the middle of these."""
    r = random.Random(draw)
    word = lambda kind, i: f"{kind}{draw}x{i}"
    passage = [word("p", i) for i in range(50)]
    at = r.randrange(5, 26)  # the middle that all share: 20 words
    filler = lambda d, k: [word(f"f{d}y", i) for i in range(k)]
    rows = [filler(d, 40) + passage + filler(f"{d}e", 40) for d in range(2)]
    for d in range(n):
        rows.append(filler(f"a{d}", 40) + passage[at : at + 20] + passage[at + 20 :] + filler(f"ae{d}", 30))
        rows.append(filler(f"b{d}", 40) + passage[: at + 20] + filler(f"be{d}", 40))
    return [" ".join(w) for w in rows]


@pytest.mark.parametrize("reach", [0, 3])
def test_passages_between_texts_that_are_no_neighbours(spark, monkeypatch, reach):
    monkeypatch.setattr(suffixes, "REACH", reach or suffixes.REACH)
    texts = [t for draw in range(50) for t in apart(draw)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r.doc_id: [tuple(x) for x in r.spans] for r in suffixes.repeats(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {d: x for d, x in got.items() if x} == {122 * draw + d: [(40, 90)] for draw in range(50) for d in (0, 1)}


def test_groups_over_many_tasks_are_settled(spark):
    """One key in most texts, with few tasks' worth of suffixes each, so that its group goes on over several tasks."""
    key = [f"k{i}" for i in range(19)]
    rows = []
    for d in range(900):
        w = [f"l{d % 40}x{i}" for i in range(20)] + key + [f"r{d % 30}x{i}" for i in range(20)]
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {r.doc_id: covered(r.spans) for r in suffixes.repeats(docs, min_words=30, run=12).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == plain_repeats(rows, 30)


def test_repeated_passages_in_many_texts(spark, odd_documents, no_documents):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(d, " ".join(f"a{d}x{i}" for i in range(d % 50)) + f" {passage} " + " ".join(f"b{d}x{i}" for i in range(60 - d % 50))) for d in range(300)]
    got = suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert all([tuple(s) for s in r.spans] == [(r.doc_id % 50, r.doc_id % 50 + 70)] for r in got)
    assert sum(not r.later_spans for r in got) >= 1 and sum(bool(r.later_spans) for r in got) > 250
    odd = suffixes.repeats(odd_documents).collect()
    assert len(odd) == odd_documents.count() and suffixes.repeats(no_documents).count() == 0
    assert {r.doc_id for r in odd if r.spans} == {1, 2, 6, 7, None}


def test_archives_round_trip(spark, sf, tmp_path):
    big = "x" * 1200 + "\r\n\r\nWARC/1.1\r\n"
    odd = spark.createDataFrame([(1, "http://a/%0A", big, 1), (5, "http://b/\r\nX: y", big, 2), (3, None, big, 3), (5, "http://b/", big, 4), (None, "http://c", big, 5), (6, "http://d", None, 6), (7, "http://e", "", 7), (8, "u", "short é", 8), (9, "u", "short é", 8)], "page_id long, url string, html string, payload_digest int")
    for i, pages in enumerate((read(spark, sf, "pages"), odd, odd.where("false"))):
        warc.write_archives(warc.records(pages), f"{tmp_path}/{i}", date="2000-01-01T00:00:00Z", file_records=7)
        back = warc.read_archives(spark, f"{tmp_path}/{i}")
        want = sorted(((r.page_id, r.url, r.html or "") for r in pages.collect()), key=repr)
        assert sorted((tuple(r) for r in warc.resolved(back).collect()), key=repr) == want
        seen = {}
        for p, _, h in want:
            seen.setdefault(h, []).append(p)
        by_id = {}
        for r in back.collect():
            by_id.setdefault(r.page_id, set()).add((r.record_type, r.refers_to, r.payload_bytes))
        for p, _, h in want:
            size, top = len(h.encode()), max((x for x in seen[h] if x is not None), default=None)
            assert (("response", None, size) if size < 1000 or p == top else ("revisit", top, size)) in by_id[p]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><a href=/a>Home</a> <a href=/b>News</a></nav>
<div class="cookie-notice">We use cookies on this page.</div><article><h1>A&nbsp;title &amp; more</h1><p>First <b>bold</b>
 text of the article goes on for a while.<br>Next line here.<p>Second paragraph of the article with <a href="#">a link</a> in it.<aside><p>Aside words here.</p></aside>
<ul><li>One point of it.<li>Another point.</ul></article><div id="comments"><p>Reader says something here.</p></div><form><p>Your mail</p></form><footer>&copy; me</footer></body></html>"""


@pytest.fixture(scope="module")
def field():
    return extraction.train(extraction.template_pages())


def test_main_text_of_pages(spark, field):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (None, None, ""), (4, "w", "<article><p>This sentence is cut off <b"), (5, "x", '<a "' * 30_000), (5, "x", "no markup at all, just words. " * 3)], "page_id long, url string, html string")
    rows = extraction.extract(pages, field).collect()
    got = {(r.page_id, r.n_chars > 9): r.text for r in rows}
    assert got[1, True] == "A title & more\n\nFirst bold text of the article goes on for a while. Next line here.\n\nSecond paragraph of the article with a link in it.\n\nOne point of it.\n\nAnother point."
    assert len(rows) == 6 and got[2, False] == "" and got[None, False] == "" and got[4, True] == "This sentence is cut off" and all(r.n_chars == len(r.text) for r in rows)


def test_field_on_templates_and_tables(spark, sf, field):
    held = extraction.template_pages()
    right = [int(a == b) for ids, y in held for a, b in zip(extraction.decode(ids, field), y)]
    assert np.mean(right) > 0.97
    model = extraction.fit(read(spark, sf, "pages"))
    for r in read(spark, sf, "pages").collect():
        found = extraction.blocks(r.html)
        want = [b[0] for b in found if b[1].content and not b[1].outer]
        assert [b[0] for b, y in zip(found, extraction.decode(extraction.features(found), model)) if y] == want, r.page_id


def test_viterbi_is_the_best_path(field):
    random = np.random.default_rng(1)
    weights, move, start = random.normal(size=extraction.N), random.normal(size=(2, 2)), random.normal(size=2)
    ids = [list(random.integers(0, extraction.N, 5)) for _ in range(9)]
    score = lambda y: sum((weights[x].sum() if a else 0) for x, a in zip(ids, y)) + start[y[0]] + sum(move[a, b] for a, b in zip(y, y[1:]))
    best = max(([(k >> j) & 1 for j in range(9)] for k in range(512)), key=score)
    assert extraction.decode(ids, (weights, move, start)) == best
