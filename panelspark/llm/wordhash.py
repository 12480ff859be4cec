"""Words of whole Arrow text columns as 64-bit hashes, found with a few passes over the column's bytes.

Every function works on one Arrow batch inside a task. Texts are taken in pieces of about a megabyte, cut at separators, so a
very long text needs no more than its own words. Hashes are a polynomial in a fixed odd base, scrambled; they depend on nothing
but the word's bytes, so they agree between tasks, jobs and tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
GROUP = 4 << 20
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
STEP = 0xD1342543DE82EF95


def table(separators, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is separator, folded value) of every byte; only A-Z is folded."""
    is_sep = np.zeros(256, bool)
    is_sep[list(separators)] = True
    fold = np.arange(256, dtype=np.uint64) + np.uint64(1)
    if lower:
        fold[65:91] = fold[97:123]
    return is_sep, fold


SPACES = (0x20, *range(0x09, 0x0E))
BY_SPACE = table(SPACES)
BY_SPACE_CASED = table(SPACES, lower=False)
#: Words are runs of digits, letters and everything beyond ASCII.
BY_SYMBOL = table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", BASE), ("down", UNBASE)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


@dataclass
class Words:
    """Words of the consecutive texts ``first .. first + len(counts) - 1`` of a column."""

    first: int
    counts: np.ndarray  # words of each text
    hash: np.ndarray
    start: np.ndarray  # bytes in ``data``
    end: np.ndarray
    data: np.ndarray
    prefix: np.ndarray  # hashes of the words' first bytes, a column for each length asked for

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.counts)))

    @property
    def text(self) -> np.ndarray:
        """Which text of this group each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if not pa.types.is_large_string(column.type) or column.null_count else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _piece(data: np.ndarray, lo: int, cuts: np.ndarray, is_sep, fold, prefixes):
    """Starts, ends, hashes and prefix hashes of the words in ``data``; no word crosses a cut (a position in ``data``)."""
    inside = ~is_sep[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _Powers.of(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(fold[data] * up[: len(data)])))

    def hashed(end):
        return scramble((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    some = np.empty((len(start), len(prefixes)), np.uint64)
    for j, n in enumerate(prefixes):
        some[:, j] = hashed(np.minimum(end, start + n))
    return start + lo, end + lo, hashed(end), some


def groups(column, how=BY_SPACE, prefixes=()):
    """Yield :class:`Words` for groups of texts of about four megabytes each."""
    is_sep, fold = how
    data, offsets = _bytes(column)
    n = len(offsets) - 1
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        parts = []
        while lo < hi:
            stop = min(hi, lo + PIECE)
            while stop < hi:
                seps = np.flatnonzero(is_sep[data[lo:stop]])
                if len(seps):
                    stop = lo + int(seps[-1]) + 1
                    break
                stop = min(hi, stop + PIECE)
            parts.append(_piece(data[lo:stop], lo, offsets[i : j + 1] - lo, is_sep, fold, prefixes))
            lo = stop
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, len(prefixes)), np.uint64))
        start, end, h, some = (np.concatenate(x) for x in zip(*parts)) if parts else none
        counts = np.diff(np.searchsorted(start, offsets[i : j + 1]))
        yield Words(i, counts, h, start, end, data, some)
        i = j


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, also of those that cross texts (see :func:`whole`)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(STEP)
        out += h[j : j + n]
    return scramble(out + np.uint64(k))


def whole(text: np.ndarray, k: int) -> np.ndarray:
    """Which runs of ``k`` words lie in one text."""
    return text[: max(0, len(text) - k + 1)] == text[k - 1 :]


def lists(values, counts, kind) -> pa.ListArray:
    """An Arrow list column from concatenated values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))
