"""Plain Python versions of what the text operators promise, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, rule=SPACED):
    return rule.findall(text or "")


def measures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
        "base_failed": len(w) < 20 or 100 * len(hit) > 30 * len(w),
    }


def jaccard_classes(rows, k, percent):
    """{position: (n_shingles, component_id)} of rows (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = words((text or "").translate(ASCII_LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    has = {}
    for i, s in enumerate(sets):
        for x in s:
            has.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in has[x] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = root(i)
            least[r] = min(doc_id, least.get(r, doc_id))
    return [(len(s), least.get(root(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def contamination(rows, items, window=10):
    """[(n_words, n_hit, item ids as sorted strings)] of texts, for items (item_id, text)."""
    known = {}
    for item_id, text in items:
        w = words((text or "").translate(ASCII_LOWER), SYMBOLS)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add(str(item_id))
    out = []
    for text in rows:
        w, hit, found = words((text or "").translate(ASCII_LOWER), SYMBOLS), set(), set()
        for n in {len(x) for x in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
                    found |= known[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by sharing again and again; sizes is {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {s: 0.0 for s in order if sizes[s] == 0}
    while True:
        free = [s for s in order if s not in done]
        share = (total - sum(done.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if share * weight[s] > most * sizes[s]]
        if not above:
            return done | {s: share * weight[s] for s in free}
        done |= {s: float(most * sizes[s]) for s in above}
