"""Registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.sql import ORACLE

__all__ = ["ORACLE", "QUERIES"]
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_contamination(spark, sf_dir):
    """Every document's words that lie in a window of a benchmark item."""
    from panelspark.llm.contamination import occurrences

    found = occurrences(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op5_line_frequency(spark, sf_dir):
    """Word and repetition rules, and rejection of documents that are mostly a host's boilerplate lines."""
    from panelspark.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


#: Key of the registered query and pipeline only; a real run passes its own secret.
EXAMPLE_KEY = "example"


@query
def op1_pseudonyms(spark, sf_dir):
    """Every document's text with personal values replaced by format-preserving pseudonyms."""
    from panelspark.llm.pii import report

    return report(_table(spark, sf_dir, "documents"), key=EXAMPLE_KEY)


@query
def op2_mixture(spark, sf_dir):
    """What a mix of all sources to target weights takes of every document."""
    from panelspark.llm.mixing import mixture

    return mixture(_table(spark, sf_dir, "documents"))


@query
def op6_jaccard_classes(spark, sf_dir):
    """Classes of documents linked by 4-word shingle sets of Jaccard similarity 0.85 or more."""
    from panelspark.llm.jaccard import Rule, classes

    return classes(_table(spark, sf_dir, "documents"), rule=Rule(words=4, percent=85)).select("doc_id", "n_shingles", "component_id")


@query
def op4_repeated_passages(spark, sf_dir):
    """Passages of 50 words or more that documents share, as word spans of every document."""
    from panelspark.llm.suffixes import repeats

    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("spans").cast("long").alias("n_spans"), covered.alias("n_repeated_words"), (F.size("spans") > 0).alias("repeated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


@query
def op3_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from document labels, and its worst sentence."""
    from panelspark.llm.toxicity import toxic_documents

    return toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op10_quality(spark, sf_dir):
    """Quality score of every document, learned from labels."""
    from panelspark.llm.classifier import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op7_revisits(spark, sf_dir):
    """All pages as WARC records, equal payloads stored once, read back from the archives."""
    from panelspark.llm.warc import read_archives, records, write_archives
    from panelspark.session import run_dir

    path = run_dir(spark, "warc")
    write_archives(records(_table(spark, sf_dir, "pages")), path, date="2000-01-01T00:00:00Z")
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_main_text(spark, sf_dir):
    """Main text of every page."""
    from panelspark.llm.extraction import extract

    return extract(_table(spark, sf_dir, "pages"))


@query
def op13_fill_in_middle(spark, sf_dir):
    """Every document rearranged for infilling, and rebuilt from the output."""
    from panelspark.llm.middle import fill_in_middle, restored

    both = restored(fill_in_middle(_table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query
def op12_repeated_windows(spark, sf_dir):
    """Every document without the words of 20-word windows that also start earlier."""
    from panelspark.llm.substrings import deduplicate_substrings

    return deduplicate_substrings(_table(spark, sf_dir, "documents"), width=20).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Folder of the vocabularies of the registered query.
TOKENIZERS = "/opt/tokenizers"


@query
def op11_token_alignment(spark, sf_dir):
    """Groups and links of two tokenizers' tokens of every document, and how common its links are in the whole corpus."""
    from dataclasses import replace

    from panelspark.llm.alignment import align, link_scores, pair_counts
    from panelspark.session import cut_lineage

    aligned = align(_table(spark, sf_dir, "documents"), byte_level=f"{TOKENIZERS}/byte_bpe_50k.json", sentence=f"{TOKENIZERS}/piece_bpe_32k.model")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = replace(aligned, rows=cut_lineage(aligned.rows.select("*", digest).drop("groups")))  # tokens are made once
    return link_scores(aligned, pair_counts(aligned)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
