"""Fill-in-the-middle against a plain version, and rotations against slices."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import middle

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plainly(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slices of the token list."""
    text = text or ""
    w = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(w), "plain", None, None, text
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h4 % 100 < 20:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(docs):
    got = middle.restored(middle.fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    rows = docs.select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((r.doc_id, *plainly(*r), r.text or "") for r in rows), key=repr)
    return {r.form for r in got}


def test_against_slices(spark, sf, odd_documents, no_documents):
    assert check(spark.read.parquet(f"{sf}/documents.parquet")) == {"plain", "psm", "spm"}
    check(odd_documents)
    assert check(no_documents) == set()


def test_hard_texts(spark):
    texts = ["<", "<<P", "a<P", "P>b", "<P>", "x<S>y", "<M>", "<X>", "é", "日本語テキスト", "\n\n", "a" * 200_000, "ab\U0001f600cd́" * 50, "<P<S<M", ">" * 40, "1" * 3000, "don't", "\x00a\x00"]
    docs = spark.createDataFrame([(i * len(texts) + j, t) for i in range(12) for j, t in enumerate(texts)], "doc_id long, text string")
    assert check(docs) == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]))
def test_rotations_invert(text, a, b, form):
    if any(x in text for x in middle.SENTINELS):
        return
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    p, m, s = text[:a], text[a:b], text[b:]
    out = middle.arrange(text, a, b, form)
    assert out == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
    assert middle.restore(bytes(out), form) == text
