"""Quality rules, Jaccard classes, decontamination and mixing against their plain versions."""

import brute
import numpy as np
from pyspark.sql import functions as F

from panelspark.llm import contamination, jaccard, mixing, quality
from panelspark.llm import wordhash as wh
from panelspark.llm.jaccard import Rule


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_text_measures(spark, sf, odd_documents):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for docs in (read(spark, sf, "documents"), odd_documents):
        got = rows_of(quality.judge(docs), "doc_id", *names)
        want = sorted(((r.doc_id, *(brute.measures(r.text)[n] for n in names)) for r in docs.select("doc_id", "text").collect()), key=repr)
        assert got == want


def test_line_frequency_rejects_boilerplate_not_copies(spark):
    body = [" ".join(f"d{d}w{i}" for i in range(30)) for d in range(120)]
    menu = "home about contact imprint\nall rights reserved by nobody in particular at all"
    rows = [(d, f"start {d} of it\n{menu}\nmore {d} about it\n" + "\n".join(f"x{d} y{d}" for _ in range(1)), "h") for d in range(40)]
    rows += [(100 + d, body[d], "h") for d in range(60)] + [(200 + d, f"{body[100]}\n{body[101]}\n{body[102]} {d}", "h") for d in range(50)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[d] for d in range(40))
    assert all(got[d] for d in got if d >= 100)
    cleaned = {r.doc_id: r.text for r in quality.clean(spark.createDataFrame([*rows, (999, menu + "\n" + body[110], "h")], "doc_id long, text string, source string")).collect()}
    assert cleaned[999].split("\n")[-1] == body[110] and 0 not in cleaned and cleaned[205].endswith(" 5")


def judged(spark, rows):
    return {(r.doc_id, r.n_words): (r.n_kept_words, r.kept) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}


def test_every_line_of_a_menu_is_found(spark):
    menu = ["home and news", "about us", "contact and imprint", "all rights reserved"]
    rows = [(d, "\n".join([*menu, f"own {d} " + " ".join(f"w{d}x{i}" for i in range(25))]), "h") for d in range(60)]
    assert set(judged(spark, rows).values()) == {(27, True)}


def test_a_line_repeated_by_one_document_is_not_boilerplate(spark):
    again = "the same line of eight words comes here"
    rows = [(0, "\n".join(f"{again}\nown {i} line" for i in range(25)), "h")] + [(d, " ".join(f"w{d}x{i}" for i in range(30)), "h") for d in range(1, 59)]
    assert judged(spark, rows)[0, 25 * 8 + 25 * 3][0] == 25 * 8 + 25 * 3


def test_one_row_in_two_hosts(spark):
    line = "a line that all of this host have"
    rows = [(d, f"{line}\nrest {d} " + " ".join(f"w{d}x{i}" for i in range(30)), "h") for d in range(40)]
    rows += [(100 + d, " ".join(f"v{d}x{i}" for i in range(30)), "other") for d in range(40)] + [(5, rows[5][1], "other")]
    got = [(r.n_words, r.n_kept_words) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id = 5").collect()]
    assert sorted(got) == [(40, 32), (40, 40)]


def test_copies_are_one_document_on_both_sides_of_the_share(spark):
    text = "first line of the copied text\n" + " ".join(f"c{i}" for i in range(30))
    rows = [(d, text if d % 2 else text.upper(), "h") for d in range(300)] + [(1000 + d, " ".join(f"w{d}x{i}" for i in range(30)), "h") for d in range(60)]
    assert all(kept for _, kept in judged(spark, rows).values())
    few = [(d, f"a common line\n{d} " + " ".join(f"w{d}x{i}" for i in range(30)), "h") for d in range(25)]
    assert judged(spark, few + [(2000 + d, text, "h") for d in range(1000)])[3, 34] == (31, True)


def test_jaccard_classes(spark, sf, odd_documents):
    for rule, docs in ((Rule(), read(spark, sf, "documents")), (Rule(4, 85), odd_documents)):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = rows_of(jaccard.classes(docs, rule=rule), "doc_id", "n_shingles", "component_id")
        assert got == sorted(((r[0], *x) for r, x in zip(rows, brute.jaccard_classes(rows, rule.words, rule.percent))), key=repr)


def near_copies(n=160):
    """Copies with edits in several places, so that links form chains, beside unrelated texts."""
    base = [f"w{i}" for i in range(90)]
    rows = []
    for d in range(n):
        w = list(base)
        for e in range(d % 7):
            w[(d * 13 + e * 29) % 90] = f"e{d % 11}{e}"
        rows.append((d, " ".join(w[d % 5 :])))
    return rows + [(1000 + d, " ".join(f"u{d}v{i}" for i in range(5 + d))) for d in range(60)]


def test_large_regions_split_by_pivots(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((r[0], *x) for r, x in zip(rows, brute.jaccard_classes(rows, 4, 85))), key=repr)
    assert rows_of(jaccard.classes(docs, rule=Rule(4, 85), region_elements=200), "doc_id", "n_shingles", "component_id") == want


def test_large_regions_of_repeated_rows_keep_their_links(spark):
    rows = [(d, " ".join(f"w{i}" for i in range(60 + d))) for d in range(4) for _ in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in jaccard.classes(docs, rule=Rule(4, 85), region_elements=200).select("doc_id", "component_id").distinct().collect()}
    assert found == {(d, 0) for d in range(4)}


def test_regions_that_pivots_do_not_part_stay_bounded(spark, monkeypatch):
    """Texts too far from each other to link and too near for pivots to part, some with a copy that links."""
    rows = []
    for d in range(60):
        w = [f"w{i}" for i in range(200)]
        for e in range(5):
            w[(d * 37 + e * 41) % 200] = f"e{d}x{e}"
        rows.append((d, " ".join(w)))
        if d % 9 == 0:
            rows.append((500 + d, " ".join(w[:-1])))
    sizes, linked = [], jaccard._linked

    def watched(members, rule):
        sizes.extend(r.n for r in members.groupBy("region").agg(F.sum(F.octet_length("elements") / 8).alias("n")).collect())
        return linked(members, rule)

    monkeypatch.setattr(jaccard, "_linked", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(jaccard.classes(docs, rule=Rule(4, 85), region_elements=2500), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((r[0], *x) for r, x in zip(rows, brute.jaccard_classes(rows, 4, 85))), key=repr)
    assert max(sizes) < 2 * 2500


def in_one_task(sets, rule=Rule(4, 85)):
    """Classes of one region's sets as its task finds them, and how many pairs it compared."""
    region = jaccard._Sets([np.sort(wh.scramble(np.array(sorted(s), np.uint64))) for s in sets], [None] * len(sets), rule)
    region.join(np.arange(len(sets)))
    return [region.root(i) for i in range(len(sets))], region.compared


def classes_of(sets, rule=Rule(4, 85)):
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if rule.links(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def hard_regions():
    rng = np.random.default_rng(5)
    yield [set(range(12 * i, 12 * i + 200)) for i in range(800)]  # a chain that drifts
    families = []
    for i in range(800):
        own = {1000 * (i % 12) + k for k in range(200)}
        families.append((own - set(rng.choice(sorted(own), 12, replace=False).tolist())) | {100_000 + 50 * i + k for k in range(12)})
    yield families
    far = []
    for i in range(500):  # too far to link, too near for pivots to part
        far.append(set(rng.choice(250, 200, replace=False).tolist()))
    yield far
    yield [set(rng.choice(30, rng.integers(1, 6), replace=False).tolist()) for _ in range(300)] + [set(range(k)) for k in range(1, 60)]


def test_a_region_in_one_task_takes_at_most_all_pairs():
    for sets in hard_regions():
        got, compared = in_one_task(sets)
        # all pairs, and one try of parting them
        assert got == classes_of(sets) and compared <= len(sets) * ((len(sets) - 1) / 2 + jaccard.PIVOTS)


def test_regions_of_much_work_are_spread(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((r[0], *x) for r, x in zip(rows, brute.jaccard_classes(rows, 4, 85))), key=repr)
    assert rows_of(jaccard.classes(docs, rule=Rule(4, 85), region_work=2e4), "doc_id", "n_shingles", "component_id") == want


def test_deduplicate_keeps_one_of_each_class(spark, odd_documents):
    kept = rows_of(jaccard.deduplicate(odd_documents), "doc_id", "k1")
    assert [r[0] for r in kept] == [1, 1, 10, 3, 4, 5, 6, 8, None]
    assert jaccard.deduplicate(odd_documents).columns == odd_documents.columns


def test_contamination(spark, sf, odd_documents):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    bench = read(spark, sf, "benchmark")
    odd = spark.createDataFrame([(1, "alpha3 BETA3"), (2, "One"), (2, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x13 w14x14 w15x15 zz"), (3, None), (4, ""), (None, "beta5 alpha6 beta6")], "item_id long, text string")
    for docs, bench in ((docs, bench), (odd_documents.select("doc_id", "text"), odd)):
        items = [tuple(r) for r in bench.select("item_id", "text").collect() if r.item_id is not None]
        bench = bench.where("item_id is not null")
        rows = [tuple(r) for r in docs.collect()]
        got = rows_of(contamination.occurrences(docs, bench), "doc_id", "n_words", "n_hit", "items")
        assert got == sorted(((r[0], *x) for r, x in zip(rows, brute.contamination([r[1] for r in rows], items))), key=repr)


def test_contamination_filter_size_changes_nothing(spark, sf):
    docs, bench = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    got = [rows_of(contamination.occurrences(docs, bench, **s), "doc_id", "n_hit", "items") for s in ({}, {"bits": 1 << 15, "width": 3})]
    assert got[0] == got[1]


def test_mixture_targets_and_totals(spark, sf, odd_documents):
    for docs in (read(spark, sf, "documents"), odd_documents):
        sizes = {}
        for r in docs.select("source", "text").collect():
            sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
        want = brute.targets(sizes)
        targets = {r.source: r.target for r in mixing.source_targets(docs.select("source", mixing.size_of().alias("size"))).collect()}
        assert set(targets) == set(want) and all(abs(targets[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
        got = mixing.mixture(docs, slice_rows=3).collect()
        assert len(got) == docs.count() and all(r.taken in [r.size * c for c in range(4)] for r in got)
        assert rows_of(mixing.mixture(docs, slice_rows=3), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=repr)
    docs = read(spark, sf, "documents")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.size_of()).alias("n")).collect()}
    largest = {r.source: r.n for r in docs.groupBy("source").agg(F.max(mixing.size_of()).alias("n")).collect()}
    want = brute.targets({r.source: r.n for r in docs.groupBy("source").agg(F.sum(mixing.size_of()).alias("n")).collect()})
    assert all(abs(taken.get(s, 0) - want[s]) <= 2 * largest[s] + 1 for s in want)


def test_empty_tables(spark, no_documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (quality.judge(no_documents), quality.clean(no_documents), jaccard.classes(no_documents), jaccard.deduplicate(no_documents), contamination.occurrences(no_documents, bench),
               contamination.decontaminate(no_documents, bench), mixing.mixture(no_documents), mixing.mix(no_documents)):
        assert df.count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert contamination.decontaminate(some, bench).count() == 1
