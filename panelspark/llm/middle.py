"""Fill-in-the-middle transformation: a text is cut twice and its parts change places behind sentinels, in place and exactly reversible.

The form of a row and its two cuts come from a hash of its id alone, so reruns and other tables agree. The text's bytes and three
sentinels stand in one buffer in the order prefix, middle, suffix; a block rotation made of three reversals exchanges two
neighbouring segments in place. The inverse rotation restores the order, and what is left without sentinels is the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import wordhash as wh
from panelspark.llm.rows import plain

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
GROUP = 4 << 20


def draws(doc_id: Column, seed) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first eight-digit groups of the hex SHA-256 of ``seed:id`` (a null id is written empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _form(text: Column, h3: Column, h4: Column, percent: int, spm_percent: int) -> Column:
    marked = F.lit(False)
    for mark in SENTINELS:
        marked = marked | F.contains(text, F.lit(mark.decode()))
    unchanged = (text == "") | marked | (h3 % 100 >= percent)
    return F.when(unchanged, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")


def _reverse(view: np.ndarray, lo: int, hi: int) -> None:
    half = (hi - lo) // 2
    left, right = view[lo : lo + half], view[hi - half : hi]
    held = left[::-1].copy()
    left[:] = right[::-1]
    right[:] = held


def rotate(buffer: bytearray, lo: int, middle: int, hi: int) -> None:
    """Exchange the neighbouring blocks [lo, middle) and [middle, hi) in place."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, lo, middle)
    _reverse(view, middle, hi)
    _reverse(view, lo, hi)


def arrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """``text`` cut at two byte positions, in the order of ``form`` (psm or spm)."""
    out = bytearray(text)
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(out, middle if form == "psm" else 0, suffix, len(out))
    return out


def restore(arranged: bytes, form: str) -> bytearray:
    """The text that :func:`arrange` was given; the sentinels' bytes occur once each, as such a text has none of its own."""
    out = bytearray(arranged)
    if form == "plain":
        return out
    at, turn = out.index(SUFFIX), out.index(MIDDLE if form == "psm" else PREFIX)
    rotate(out, at, turn, len(out))  # the suffix goes back behind the middle
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = out.index(mark)
        del out[at : at + len(mark)]
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """Ranges of texts of about GROUP bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP, "right")) - 1)
        yield i, j
        i = j


def _starts(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes start a token (a run of letters, or one other code point), and which a code point; ``cuts`` are starts of texts."""
    point, letter = (data & 0xC0) != 0x80, LETTER[data]
    token = point.copy()
    token[1:] &= ~(letter[1:] & letter[:-1])
    cuts = cuts[cuts < len(data)]
    token[cuts] = True
    return token, point


def fill_in_middle(documents: DataFrame, *, seed=1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output.

    Tokens are runs of ASCII letters and single other code points; both cuts fall between tokens. ``percent`` of the documents are
    transformed, ``spm_percent`` of these in the order suffix, prefix, middle. Null texts count as empty; empty texts and those
    that hold a sentinel stay plain. Repeated rows are transformed alike.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    rows = plain(documents, "doc_id", "text").select("doc_id", text.alias("text"), h1.alias("h1"), h2.alias("h2"), _form(text, h3, h4, percent, spm_percent).alias("form"))

    def arranged(batches):
        for batch in batches:
            data, offsets = wh._bytes(batch.column("text"))
            draw = [batch.column(c).to_numpy() for c in ("h1", "h2")]
            forms = batch.column("form").to_pylist()
            for i, j in _pieces(data, offsets):
                base, some = int(offsets[i]), data[offsets[i] : offsets[j]]
                edges = offsets[i : j + 1] - base
                token, point = _starts(some, edges[:-1])
                at, points = np.append(np.flatnonzero(token), len(some)), np.append(0, np.cumsum(point))
                bounds = np.searchsorted(at[:-1], edges)
                n = np.diff(bounds)
                a, b = (d[i:j] % (n + 1) for d in draw)
                # the token after the last one of a text starts where the text ends
                first, second = at[bounds[:-1] + np.minimum(a, b)], at[bounds[:-1] + np.maximum(a, b)]
                out = [some[lo:hi].tobytes() if form == "plain" else bytes(arrange(some[lo:hi].tobytes(), x - lo, y - lo, form))
                       for lo, hi, x, y, form in zip(edges[:-1].tolist(), edges[1:].tolist(), first.tolist(), second.tolist(), forms[i:j])]
                unchanged = np.array([f == "plain" for f in forms[i:j]], bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), batch.column("form").slice(i, j - i),
                     pa.array(points[first] - points[edges[:-1]], pa.int64(), mask=unchanged), pa.array(points[second] - points[first], pa.int64(), mask=unchanged),
                     pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(arranged, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(transformed: DataFrame) -> DataFrame:
    """``transformed`` (with form and output) and ``restored``, the exact text rebuilt from these two."""

    def rebuilt(batches):
        for batch in batches:
            data, offsets = wh._bytes(batch.column("output"))
            forms = batch.column("form").to_pylist()
            for i, j in _pieces(data, offsets):
                out = [bytes(restore(data[offsets[t] : offsets[t + 1]].tobytes(), forms[t])) for t in range(i, j)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary()).cast(pa.string())], [*part.schema.names, "restored"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema)
    return transformed.mapInArrow(rebuilt, f"{kinds}, restored string")
