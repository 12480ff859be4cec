"""Alignment of two tokenizers over the same bytes.

Both token streams of a text cover the same bytes. All texts of a batch are merged in lockstep: one NumPy state holds an A and a B
pointer for each of them, every step links the two tokens of each pair of pointers, cuts where both end, moves on whichever ends
first, and drops the texts that are finished. Texts with very many tokens enter as several lanes that begin where both tokenizers
happen to end, so no text keeps the others waiting.

How often an id pair is linked in the whole corpus comes from counts per text, summed in tasks first. The table of counts is sent to
all tasks only while it is within ``table_pairs``; beyond that the texts' pairs are joined with it.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import wordhash as wh
from panelspark.llm.rows import plain, row_key
from panelspark.session import cut_lineage

#: Fixed value: how byte-level BPE splits a text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP = 2 << 20
#: Tokens of a lane, about, and how many further tokens are tried for its end.
LANE, TRIES = 512, 64
#: Pairs of which a task sums up counts before it hands them on.
HELD_PAIRS = 4_000_000
#: Most pairs (17 bytes each) that are sent to all tasks.
TABLE_PAIRS = 4_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    plainly = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plainly]
    return {chr(b): b for b in plainly} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Pieces:
    """Bytes of every id of a vocabulary, end to end."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> Pieces:
        size = np.array([len(p) for p in pieces], np.int64)
        return cls(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum(size)[:-1])), size)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        begin = np.cumsum(n) - n
        return self.data[np.repeat(self.start[ids] - begin, n) + np.arange(int(n.sum()))]


class ByteLevel:
    """Byte-level BPE from the text of a tokenizers JSON file; special tokens in a text are ordinary text."""

    def __init__(self, source: bytes):
        model = json.loads(source)
        vocabulary, alphabet = model["model"]["vocab"], byte_alphabet()
        extra = {t["content"]: t["id"] for t in model["added_tokens"]}
        pieces = [b""] * (1 + max([*vocabulary.values(), *extra.values()]))
        for token, i in vocabulary.items():
            if token not in extra:
                pieces[i] = bytes(alphabet[c] for c in token)
        self.pieces = Pieces.of(pieces)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        ids = [vocabulary["".join(m)] for m in merges]
        if ids == sorted(ids):  # merges in the order of their ids, so ids serve as ranks
            import tiktoken

            ranks = {p: i for i, p in enumerate(pieces) if p}
            one = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [one.encode_to_numpy(t, disallowed_special=()) for t in texts]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            other = Tokenizer.from_buffer(source)
            other.encode_special_tokens = True
            self.encode = lambda texts: [np.array(e.ids, np.uint32) for e in other.encode_batch_fast(texts, add_special_tokens=False)]


class Sentence:
    """A sentencepiece model from the bytes of its file."""

    def __init__(self, source: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=source)
        self.pieces = Pieces.of([
            bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())])
        self.encode = lambda texts: model.encode(texts, num_threads=1)


def _counted(encoded: list) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in encoded], np.int64)
    if encoded and isinstance(encoded[0], np.ndarray):
        return np.concatenate(encoded).astype(np.int64), n
    return np.fromiter(itertools.chain.from_iterable(encoded), np.int64, int(n.sum())), n


def _same(pieces: Pieces, ids: np.ndarray, counts: np.ndarray, spaced: bytes, sizes: np.ndarray) -> np.ndarray:
    """Which texts' tokens have exactly the text's bytes."""
    owner = np.repeat(np.arange(len(counts)), counts)
    made = np.bincount(owner, pieces.size[ids], len(counts)).astype(np.int64)
    good = made == sizes
    if not good.all():  # compare only texts of equal length
        ids, owner = ids[good[owner]], owner[good[owner]]
    out, want = pieces.bytes_of(ids), np.frombuffer(spaced, np.uint8)
    if not good.all():
        want = want[np.repeat(good, sizes)]
    differs = np.flatnonzero(out != want)
    if len(differs):
        good[np.repeat(np.flatnonzero(good), sizes[good])[differs]] = False
    return good


def lanes(end_a: np.ndarray, end_b: np.ndarray, bounds: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """First A and first B token of every lane: texts (A bounds), and within long texts places where both tokenizers end."""
    n = np.diff(bounds)
    more = np.maximum(n // lane - 1, 0)
    owner = np.repeat(np.arange(len(n)), more)
    at = bounds[owner] + lane * (1 + np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more)) - 1
    found = np.full(len(at), -1, np.int64)
    for k in range(min(TRIES, lane)):  # the first token from there that ends where a B token ends
        open_ = np.flatnonzero(found < 0)
        if not len(open_):
            break
        token = at[open_] + k
        inside = token < bounds[owner[open_] + 1] - 1
        open_, token = open_[inside], token[inside]
        shared = end_b[np.searchsorted(end_b, end_a[token])] == end_a[token]
        found[open_[shared]] = token[shared] + 1
    first_a = np.unique(np.concatenate((bounds[:-1][n > 0], found[found >= 0])))
    before = np.where(first_a > 0, end_a[first_a - 1], 0)
    return first_a, np.searchsorted(end_b, before, "right")


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray):
    """Links (A and B token positions) and cuts (the last A and B tokens of each group) of all lanes; lanes follow each other."""
    state = np.stack((first_a, first_b))
    stop = np.append(first_a[1:], len(end_a))
    links, cuts = [], []
    while state.shape[1]:
        links.append(state)
        ends = np.stack((end_a[state[0]], end_b[state[1]]))
        moved = ends <= ends[::-1]
        both = moved[0] & moved[1]
        if both.any():
            cuts.append(state[:, both])
        state = state + moved
        live = state[0] < stop
        if not live.all():
            state, stop = state[:, live], stop[live]
    none = np.zeros((2, 0), np.int64)
    return np.concatenate([none, *links], axis=1), np.sort(np.concatenate([none, *cuts], axis=1), axis=1)


def _decimals(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. top, one row each with room for a separator, and their number."""
    width = len(str(top))
    value = np.arange(top + 1)
    size = np.ones(top + 1, np.int64)
    for d in range(1, width):
        size += value >= 10**d
    place = size[:, None] - 1 - np.arange(width + 1)
    digit = value[:, None] // 10 ** np.maximum(place, 0) % 10
    return np.where(place >= 0, 48 + digit, 0).astype(np.uint8), size


def _written(ids_a, ids_b, cuts, last_b: np.ndarray, decimals) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;a3|b2`` and the bytes that every token of the merged order takes; ``last_b`` are the texts' last B tokens."""
    table, size = decimals
    cut_a, cut_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    cut_a[cuts[0]] = cut_b[cuts[1]] = True
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    begin_b, end_a = np.append(0, cuts[1] + 1), cuts[0] + 1
    n = len(ids_a) + len(ids_b)
    ids, mark = np.empty(n, np.int64), np.empty(n, np.uint8)
    at_a, at_b = np.arange(len(ids_a)) + begin_b[group_a], np.arange(len(ids_b)) + end_a[group_b]
    ids[at_a], ids[at_b] = ids_a, ids_b
    mark[at_a], mark[at_b] = np.where(cut_a, ord("|"), ord(",")), np.where(cut_b, ord(";"), ord(","))
    length = size[ids] + 1
    length[at_b[last_b]] -= 1
    rows = table[ids]
    rows[np.arange(n), size[ids]] = mark
    return rows[np.arange(rows.shape[1]) < length[:, None]], length


def _merged(a: ByteLevel, b: Sentence, texts: list[str], decimals, base: int):
    """Per text: n_a, n_b, n_groups, n_links, groups, and its linked pairs (a * base + b, ascending) with counts up to 255 and their number."""
    spaced = [b" " + t.encode() for t in texts]
    sizes = np.array([len(s) for s in spaced], np.int64)
    ids_a, n_a = _counted(a.encode([" " + t for t in texts]))
    ids_b, n_b = _counted(b.encode(texts))
    whole = b"".join(spaced)
    good = _same(a.pieces, ids_a, n_a, whole, sizes) & _same(b.pieces, ids_b, n_b, whole, sizes) & (sizes > 1)
    ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
    n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
    bounds_a, bounds_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    end_a, end_b = np.cumsum(a.pieces.size[ids_a]), np.cumsum(b.pieces.size[ids_b])
    links, cuts = lockstep(end_a, end_b, *lanes(end_a, end_b, bounds_a))
    owner = np.repeat(np.arange(len(texts)), n_a)
    n_groups, n_links = np.bincount(owner[cuts[0]], minlength=len(texts)), np.bincount(owner[links[0]], minlength=len(texts))
    out, length = _written(ids_a, ids_b, cuts, bounds_b[1:][good] - 1, decimals)
    ends = np.append(0, np.cumsum(length))[bounds_a + bounds_b]
    groups = [out[lo:hi].tobytes() for lo, hi in zip(ends[:-1], ends[1:])]
    # pairs of each text, sorted; a pair linked more than 255 times takes several entries
    pair = ids_a[links[0]] * base + ids_b[links[1]]
    order = np.lexsort((pair, owner[links[0]]))
    pair, text = pair[order], owner[links[0]][order]
    first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])))) if len(pair) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(pair)))
    entries = -(-times // 255)
    pair, text = np.repeat(pair[first], entries), np.repeat(text[first], entries)
    left = np.repeat(times, entries) - 255 * (np.arange(len(pair)) - np.repeat(np.cumsum(entries) - entries, entries))
    return n_a, n_b, n_groups, n_links, groups, pair, np.minimum(left, 255).astype(np.uint8), np.bincount(text, minlength=len(texts))


def _blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(counts) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


@dataclass
class Aligned:
    """``rows``: k1, k2, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times (binary: sorted pair codes and how often each is linked)."""

    rows: DataFrame
    base: int
    kind: np.dtype

    def split(self, pair):
        return pair // self.base, pair % self.base


def align(documents: DataFrame, *, byte_level: str, sentence: str) -> Aligned:
    """Tokens of two vocabularies over each document's bytes, their common groups and links.

    ``byte_level`` is a tokenizers JSON file, which encodes a space and the text; ``sentence`` a sentencepiece model, which adds the
    space itself. Null and empty texts, and texts that either vocabulary cannot give back byte by byte, have no tokens: zeros and
    empty groups. Repeated rows are aligned alike. The driver reads both files and sends them to the tasks.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    with open(byte_level, "rb") as f, open(sentence, "rb") as g:
        sources = f.read(), g.read()
    a, b = ByteLevel(sources[0]), Sentence(sources[1])
    base = len(b.pieces.size)
    code = np.dtype(np.uint32 if len(a.pieces.size) * base <= 1 << 32 else np.uint64)
    sent = documents.sparkSession.sparkContext.broadcast(sources)

    def aligned(batches):
        a = None
        for batch in batches:
            if a is None:
                a, b = ByteLevel(sent.value[0]), Sentence(sent.value[1])
                decimals = _decimals(max(len(a.pieces.size), len(b.pieces.size)))
            _, offsets = wh._bytes(batch.column("text"))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP, "right")) - 1)
                part = batch.slice(i, j - i)
                texts = [t or "" for t in part.column("text").to_pylist()]
                n_a, n_b, n_groups, n_links, groups, pair, times, n_pairs = _merged(a, b, texts, decimals, base)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1"), part.column("k2"), part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)),
                     pa.array(groups, pa.binary()).cast(pa.string()), _blobs(pair.astype(code), n_pairs), _blobs(times, n_pairs)],
                    ["k1", "k2", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
                i = j

    rows = plain(documents, "doc_id", "text").select(*row_key(), "doc_id", "text").mapInArrow(
        aligned, f"k1 long, k2 long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary")
    return Aligned(rows, base, code)


def pair_counts(aligned: Aligned) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each id pair, and whether no pair of its B id has more."""
    code, base = aligned.kind, aligned.base

    def summed(pair, n):
        order = np.argsort(pair, kind="stable")
        pair, n = pair[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
        return pair[first], np.add.reduceat(n, first) if len(first) else n

    def counts(batches):
        held, room = [], 0

        def settled():
            pair, n = summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            return [(pair, n)], len(pair)

        for batch in batches:
            held.append(summed(_flat(batch.column("pairs"), code).astype(np.int64), _flat(batch.column("times"), np.uint8).astype(np.int64)))
            room += len(held[-1][0])
            if room > HELD_PAIRS:
                held, room = settled()
                if room > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["pair", "n"])
                    held, room = [], 0
        if held:
            held, _ = settled()
            yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["pair", "n"])

    n = aligned.rows.select("pairs", "times").mapInArrow(counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = cut_lineage(n.withColumn("b", F.col("pair") % base))
    most = n.groupBy("b").agg(F.max("n").alias("most"))  # one row for each id of the vocabulary
    return n.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_scores(aligned: Aligned, counts: DataFrame, *, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """``aligned.rows`` without pairs, with n_best (links whose pair is a best one of its B id) and count_sum (sum of the links' counts)."""
    code = aligned.kind
    counts = cut_lineage(counts)
    keep = [c for c in aligned.rows.columns if c not in ("pairs", "times")]
    if counts.count() <= table_pairs:
        table = counts.toArrow()
        order = np.argsort(table.column("pair").to_numpy())
        table = tuple(table.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
        sent = aligned.rows.sparkSession.sparkContext.broadcast(table)

        def scores(batches):
            known, n, best = sent.value
            for batch in batches:
                pair, times = _flat(batch.column("pairs"), code).astype(np.int64), _flat(batch.column("times"), np.uint8).astype(np.int64)
                sizes = np.array([len(x) for x in batch.column("times").to_pylist()], np.int64)
                ends = np.append(0, np.cumsum(sizes))
                at = np.searchsorted(known, pair) if len(pair) else np.zeros(0, np.int64)
                of_best, of_all = (np.append(0, np.cumsum(x))[ends] for x in (times * best[at], times * n[at]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.diff(of_best), pa.int64()), pa.array(np.diff(of_all), pa.int64())], [*keep, "n_best", "count_sum"])

        kinds = ", ".join(f"`{c}` {aligned.rows.schema[c].dataType.simpleString()}" for c in keep)
        return aligned.rows.mapInArrow(scores, f"{kinds}, n_best long, count_sum long")

    def exploded(batches):
        for batch in batches:
            pair, times = _flat(batch.column("pairs"), code).astype(np.int64), _flat(batch.column("times"), np.uint8).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), [len(x) for x in batch.column("times").to_pylist()])
            k1, k2 = (batch.column(c).to_numpy()[row] for c in ("k1", "k2"))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(pair), pa.array(times)], ["k1", "k2", "pair", "times"])

    one = aligned.rows.select("k1", "k2", "pairs", "times").dropDuplicates(["k1", "k2"])
    met = one.mapInArrow(exploded, "k1 long, k2 long, pair long, times long").join(counts, "pair")
    sums = met.groupBy("k1", "k2").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return aligned.rows.select(*keep).join(sums, ["k1", "k2"], "left").select(*keep, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")))
