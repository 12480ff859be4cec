"""Token alignment against a plain version."""

import hashlib
import os
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from panelspark.llm import alignment
from panelspark.llm.queries import TOKENIZERS

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabularies")
FILES = {"byte_level": f"{TOKENIZERS}/byte_bpe_50k.json", "sentence": f"{TOKENIZERS}/piece_bpe_32k.model"}


def plainly(texts):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, groups)] with the libraries' own encoders and a pair of nested loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES["byte_level"])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES["sentence"])
    alphabet = alignment.byte_alphabet()

    def ends(pieces):
        out, n = [], 0
        for p in pieces:
            out.append((n, n + len(p)))
            n += len(p)
        return out

    links, rows = [], []
    for text in texts:
        text = text or ""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
            links.append([])
            rows.append((0, 0, 0, 0, ""))
            continue
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        shared = sorted({e for _, e in ends_a} & {e for _, e in ends_b})
        found, j = [], 0
        for i, (s, e) in enumerate(ends_a):
            while ends_b[j][1] <= s:
                j += 1
            k = j
            while k < len(ends_b) and ends_b[k][0] < e:
                found.append((ids_a[i], ids_b[k]))
                k += 1
        groups, i, j = [], 0, 0
        for cut in shared:
            x, y = i, j
            while i < len(ends_a) and ends_a[i][1] <= cut:
                i += 1
            while j < len(ends_b) and ends_b[j][1] <= cut:
                j += 1
            groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
        links.append(found)
        rows.append((len(ids_a), len(ids_b), len(groups), len(found), ";".join(groups)))
    n = Counter(x for found in links for x in found)
    most = {}
    for (_, y), c in n.items():
        most[y] = max(c, most.get(y, 0))
    return [(*r[:4], sum(n[x] == most[x[1]] for x in found), sum(n[x] for x in found), r[4]) for r, found in zip(rows, links)]


def check(docs, **settings):
    aligned = alignment.align(docs, **FILES)
    got = alignment.link_scores(aligned, alignment.pair_counts(aligned), **settings).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, plainly([r.text for r in rows]))), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    return want


def test_tables_and_odd_rows(spark, sf, odd_documents, no_documents):
    check(spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 20000"))
    check(odd_documents)
    assert check(no_documents) == []


def hard(spark):
    texts = [" ", "a", "é", "日本語のテキスト", "<|endoftext|> and <s></s><unk>", "▁x", "x" * 5000, "\n\n\t  two  spaces ", "\x00nul", "\U0001f600" * 40, "don't we'll", "1234567890" * 30, "<0x41>", "." * 700, "a b" * 900]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")


def test_hard_texts(spark):
    want = check(hard(spark))
    assert [r[1] for r in want if r[0] in (5, 20)] == [0, 0]


def test_join_beyond_the_table(spark):
    check(hard(spark), table_pairs=0)


def test_query_hashes_groups(spark, sf):
    from panelspark.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op11_token_alignment"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r, want in zip(rows, plainly([r.text for r in rows])):
        digest = hashlib.sha256(want[6].encode()).hexdigest() if want[6] else ""
        assert tuple(got[r.doc_id])[1:] == (*want[:6], digest)


@pytest.mark.parametrize("lane", [1, 3, 1000])
def test_lanes_change_nothing(lane):
    rng = np.random.default_rng(lane)
    end_a, end_b, bounds = [], [], [0]
    base = 0
    for n in (0, 1, 7, 400, 2):
        cuts = lambda: sorted({*rng.choice(np.arange(1, n + 1), min(n, 1 + n // 3), replace=False).tolist(), n}) if n else []
        x, y = cuts(), cuts()
        end_a += [base + e for e in x]
        end_b += [base + e for e in y]
        bounds.append(len(end_a))
        base += n
    end_a, end_b, bounds = (np.array(x, np.int64) for x in (end_a, end_b, bounds))
    links, cuts = alignment.lockstep(end_a, end_b, *alignment.lanes(end_a, end_b, bounds, lane))
    begin_a, begin_b = np.append(0, end_a[:-1]), np.append(0, end_b[:-1])
    want = {(i, j) for i in range(len(end_a)) for j in range(len(end_b)) if begin_a[i] < end_b[j] and begin_b[j] < end_a[i]}
    assert links.shape[1] == len(want) and set(map(tuple, links.T.tolist())) == want
    assert end_a[cuts[0]].tolist() == sorted(set(end_a.tolist()) & set(end_b.tolist())) == end_b[cuts[1]].tolist()
