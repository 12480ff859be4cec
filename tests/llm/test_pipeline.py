"""The pipeline against plain versions of its stages, stage by stage and as a whole."""

import re

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from panelspark.llm import pii
from panelspark.llm.mixing import size_of


def line_rule(rows):
    """Plain cross-document line frequency: rows (doc_id, text, source) to {doc_id: text or None}."""
    carriers, hosts = {}, {}
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    for _, t, s in rows:
        names = frozenset(norm(x) for x in (t or "").split("\n") if brute.SPACED.search(x))
        hosts.setdefault(s, set()).add(names)
        for x in names:
            carriers.setdefault((s, x), set()).add(names)
    gone = {k for k, v in carriers.items() if len(v) >= 20 and len(v) > 0.1 * len(hosts[k[0]])}
    out = {}
    for d, t, s in rows:
        kept = [x for x in (t or "").split("\n") if (s, norm(x)) not in gone]
        words = sum(len(brute.words(x)) for x in kept)
        out[d] = None if brute.measures(t)["base_failed"] or words < 20 else ("\n".join(kept) if len(kept) < len((t or "").split("\n")) else t)
    return out


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and docs.count() == len(after)
        rows = [(d, r.text) for d, r in before.items()]
        if i == 0:
            want = {d: t for d, t in line_rule([(d, r.text, r.source) for d, r in before.items()]).items() if t is not None}
            assert {d: r.text for d, r in after.items()} == want
        elif i == 1:
            assert set(after) == {d for (d, _), (_, c) in zip(rows, brute.jaccard_classes(rows, 5, 80)) if c == d}
        elif i == 2:
            assert set(after) == {d for (d, _), (_, hit, _) in zip(rows, brute.contamination([t for _, t in rows], items)) if not hit}
        else:
            assert set(after) == set(before) and any(after[d].text != before[d].text for d in after)
            for d, r in after.items():
                assert (r.text == before[d].text) == (re.search(pii.ANY, before[d].text) is None) or re.search(pii.ANY, before[d].text)
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(size_of()).alias("n")).collect()}
    mixed = corpus_pipeline.run(spark, sf)
    taken = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(size_of()).alias("n")).collect()}
    largest = {r.source: r.n for r in docs.groupBy("source").agg(F.max(size_of()).alias("n")).collect()}
    assert mixed.columns == columns and all(abs(taken.get(s, 0) - t) <= 2 * largest[s] + 1 for s, t in brute.targets(sizes).items())
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= {r.doc_id for r in docs.collect()}


def test_stages_on_odd_rows(spark, odd_documents, no_documents, tmp_path):
    spark.createDataFrame([(1, "alpha3 beta3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, docs in (("odd", odd_documents), ("none", no_documents)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
