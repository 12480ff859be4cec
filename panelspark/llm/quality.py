"""Quality rules: word counts and repetition of each text, and cross-document line frequency.

Lines are normalised and hashed; a line that too many documents of one host carry is boilerplate and is removed, and a document
that keeps too few words without such lines is rejected. Documents of a host with the same set of lines are one document on both
sides of the share, so a group of copies does not turn its own text into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.rows import packed, plain, unpacked, words
from panelspark.session import cut_lineage

RUN = 8


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, also where ``use`` needs it inside another lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(w: Column) -> Column:
    """Words inside runs of eight words that occur twice or more in the array."""

    def spread(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, among))

    def among(sorted_pairs):
        def again(p, j):
            return (F.get(sorted_pairs, j - 1)["h"].eqNullSafe(p["h"])) | (F.get(sorted_pairs, j + 1)["h"].eqNullSafe(p["h"]))

        at = F.array_sort(F.transform(F.filter(sorted_pairs, again), lambda p: p["i"]))
        return let(at, lambda a: F.aggregate(F.transform(a, lambda p, j: F.least(F.lit(RUN), F.coalesce(F.get(a, j + 1) - p, F.lit(RUN)))), F.lit(0), lambda x, y: x + y))

    each = F.transform(F.sequence(F.lit(1), F.size(w) - (RUN - 1)), lambda i: F.xxhash64(F.slice(w, i, RUN)))
    return F.when(F.size(w) > RUN, let(each, spread)).otherwise(F.lit(0))


def text_measures(text: str = "text") -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; null is like an empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    ))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.array_join(words(line), " ")))


def _keys() -> list[Column]:
    """Two 64-bit keys of a row's id, text and host; repeated rows share them, and every decision."""
    return [F.xxhash64("doc_id", "text", "source").alias("k1"), F.xxhash64("text", "source", "doc_id", F.lit(7)).alias("k2")]


def _read(documents: DataFrame) -> DataFrame:
    """One row per document, written once: its keys, measures, host, lines with a word (hash and number of words) and a key of their set."""
    t = F.coalesce("text", F.lit(""))
    kept = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = F.transform(kept, lambda x: F.struct(_line_hash(x).alias("line"), F.size(words(x)).alias("n_words")))
    rows = plain(documents, "doc_id", "text", "source").select(*_keys(), "doc_id", F.xxhash64("source").alias("host"), text_measures().alias("m"), lines.alias("lines"))
    return cut_lineage(rows.withColumn("content", F.xxhash64(F.array_sort(F.array_distinct("lines.line")))))


def _each_line(read: DataFrame) -> DataFrame:
    return read.select("k1", "k2", "host", "content", F.explode("lines").alias("x")).select("k1", "k2", "host", "content", "x.*")


def boilerplate(read: DataFrame, *, min_documents: int, max_share: float) -> DataFrame:
    """(host, line) of the lines in at least ``min_documents`` distinct documents of a host and over ``max_share`` of its distinct documents."""
    hosts = read.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    carried = _each_line(read).select("host", "line", "content").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    return carried.where(F.col("n") >= min_documents).join(hosts, "host").where(F.col("n") > F.col("n_host") * max_share).select("host", "line")


def judge(documents: DataFrame, *, min_words: int = 20, max_repeat_percent: int = 30, min_documents: int = 20, max_share: float = 0.1) -> DataFrame:
    """One row per document: k1, k2, doc_id, the text measures, base_failed, n_kept_words, gone (line hashes) and kept.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated runs. ``kept``: not
    failed, and at least ``min_words`` words remain without the lines above the limits of :func:`boilerplate`.
    Null and empty texts fail; a null host is a host of its own. Repeated rows are one document of their host and get equal
    verdicts; the same text in two hosts is judged by each host's own lines.
    """
    read = _read(documents)
    lost = _each_line(read).join(boilerplate(read, min_documents=min_documents, max_share=max_share), ["host", "line"])
    found = lost.groupBy("k1", "k2").agg(F.collect_set("line").alias("gone"), F.sum("n_words").alias("n_gone"))
    # repeated rows share their keys and their lines are in one sum: divide it among them
    copies = read.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_rows"))
    found = found.join(copies, ["k1", "k2"]).select("k1", "k2", "gone", (F.col("n_gone") / F.col("n_rows")).cast("long").alias("n_gone"))
    measured = read.select("k1", "k2", "doc_id", "m.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("n_gone", F.lit(0))
    return measured.join(found, ["k1", "k2"], "left").select(
        "k1", "k2", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), left.alias("n_kept_words"), "gone", (~failed & (left >= min_words)).alias("kept"),
    )


def clean(documents: DataFrame, **settings) -> DataFrame:
    """The kept documents, without their boilerplate lines; ``n_chars``, if there, is counted again for changed texts.

    Rows keep their columns and repeated rows stay repeated; see :func:`judge`.
    """
    good = judge(documents, **settings).where("kept").select("k1", "k2", "gone").dropDuplicates(["k1", "k2"])
    text = F.col("row.text")
    trimmed = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("gone"), _line_hash(x))), "\n")
    rows = packed(documents, *_keys()).join(good, ["k1", "k2"])
    changed = {"text": F.when(F.col("gone").isNull(), text).otherwise(trimmed)}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(trimmed).cast(documents.schema["n_chars"].dataType))
    return unpacked(rows, documents.columns, **changed)
