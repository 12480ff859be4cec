"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is a sequence of leaf blocks: runs of text between block-level tags. Each has features of its ancestors (tags, class words)
and of its text; a chain of two labels, article or not, is decoded by Viterbi. The field is trained on labelled pages: pages made
from the templates below, and a bounded sample of the input whose <article> or <main> element labels their blocks.
"""

from __future__ import annotations

import html as markup
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.rows import plain

#: Most pages of the input that the field is trained on.
MAX_FIT = 300

#: Comments, declarations, and tags up to their first quote or end.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*)", re.S)
PLAIN = re.compile(r"[^<>\"']+")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMED = frozenset("class id role aria-label".split())
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
TOKENS = re.compile(r"[a-z]+")

#: Kinds of elements in HTML.
RAW = frozenset("script style noscript template textarea svg iframe select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead title tr ul button label".split())
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())
OUTER = frozenset("nav header footer aside form menu dialog button fieldset label legend option".split())
CONTENT = frozenset("article main".split())
#: Words in class names and ids of what is not the article.
OUTER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related "
    "recommended recommendations share sharing social comment comments reply replies respond discussion disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login form search pagination pager toolbar skip copyright legal teaser trending".split())
CONTENT_WORDS = frozenset("article content post entry story body text main".split())


def _tag_end(page: str, at: int, unclosed: set) -> int:
    """Where the tag open at ``at`` ends: the place of its ">", or the complement of the place that breaks it, a "<" or the page's end.

    A quote opens a value only after "="; one that never closes (kept in ``unclosed``) is an ordinary character. Every call goes on
    from where the one before it stopped, so pages are read once however they are made.
    """
    while at < len(page):
        c = page[at]
        if c == ">":
            return at
        if c == "<":
            return ~at
        if c in "\"'":
            before = at - 1
            while page[before].isspace():
                before -= 1
            end = page.find(c, at + 1) if page[before] == "=" and c not in unclosed else -1
            if end < 0 and page[before] == "=":
                unclosed.add(c)
            at = max(end, at) + 1
        else:
            at = PLAIN.match(page, at).end()
    return ~len(page)


def blocks(page: str):
    """Leaf blocks of a page: (text, ancestor path, words in links, words). Markup, scripts, styles and hidden elements give none."""
    page = page or ""
    stack: list[tuple] = []  # (tag, marks of it and its ancestors)
    pieces: list[str] = []
    linked: list[str] = []
    out = []
    at, in_link, n = 0, 0, len(page)
    unclosed: set = set()

    def close():
        text = " ".join("".join(pieces).split())
        if text:
            links = sum(len(x.split()) for x in linked)
            out.append((text, stack[-1][1] if stack else NO_MARKS, links, len(text.split())))
        pieces.clear()
        linked.clear()

    def take(text):
        if text and not (stack and stack[-1][1].hidden):
            text = markup.unescape(text)
            pieces.append(text)
            if in_link:
                linked.append(text)

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        stop = at if at < n and page[at] == ">" else _tag_end(page, at, unclosed)
        if stop < 0:
            at = ~stop
            if at < n:  # not a tag, as another one begins inside it; a tag cut off by the end of the page is dropped
                take(page[m.start() : at])
            continue
        attributes, at = page[m.start(3) : stop], stop + 1
        tag, ending = tag.lower(), m[1] == "/"
        if tag in RAW and not ending:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag == "a":
            in_link = 0 if ending else 1
        if tag in BLOCK:
            close()
            if ending:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif tag not in VOID:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag and tag in CLOSED_BY_SAME or stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in ("ul", "ol", "table", "dl", "div", "article", "section", "td"):
                        break
                stack.append((tag, (stack[-1][1] if stack else NO_MARKS).inside(tag, attributes)))
                in_link = 0
    close()
    return out


class Marks:
    """What the ancestors of a block say."""

    __slots__ = ("tag", "outer", "outer_words", "content", "content_words", "hidden", "head")

    def __init__(self, tag="", outer=False, outer_words=False, content=False, content_words=False, hidden=False, head=False):
        self.tag, self.outer, self.outer_words, self.content, self.content_words, self.hidden, self.head = tag, outer, outer_words, content, content_words, hidden, head

    def inside(self, tag: str, attributes: str) -> "Marks":
        words: set = set()
        own, hidden = False, self.hidden
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in NAMED:
                for token in value.lower().split():
                    parts = TOKENS.findall(token)
                    words.update(parts)
                    # what begins and ends with words of an article is part of it, whatever stands between
                    own = own or (not OUTER_WORDS.isdisjoint(parts) and not (parts[0] in CONTENT_WORDS and parts[-1] in CONTENT_WORDS))
            elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and UNSEEN.search(value)):
                hidden = True
        whole = tag in ("html", "body")
        own = own and not (whole or tag in CONTENT)
        # an article's own header holds its title
        outer = self.outer or (tag in OUTER and not (tag == "header" and self.content))
        return Marks(tag, outer, self.outer_words or own, self.content or tag in CONTENT, self.content_words or (not whole and bool(words & CONTENT_WORDS)), hidden, self.head or tag in ("head", "title"))


NO_MARKS = Marks()
TAGS = ("p", "h1", "h2", "h3", "h4", "li", "td", "th", "div", "blockquote", "pre", "figcaption", "dd", "dt", "section", "article", "body", "main", "other")
NAMES = (
    "bias", "outer", "outer words", "content", "no content", "content words", "head", "clear", "content, clear", "content, outer", *(f"tag {t}" for t in TAGS), *(f"links {i}" for i in range(4)),
    *(f"words {i}" for i in range(6)), "ends a sentence", "copyright sign", "first", "last", *(f"clear, words {i}" for i in range(6)), "clear p", "clear heading", "link list")
INDEX = {n: i for i, n in enumerate(NAMES)}
LINKS, WORDS = INDEX["links 0"], INDEX["words 0"]
CLEAR_WORDS = INDEX["clear, words 0"]
N = len(NAMES)


def features(found) -> list[list[int]]:
    """Indices of the features that hold for each block of a page."""
    out = []
    for i, (text, marks, links, n) in enumerate(found):
        ids = [0]
        add = ids.append
        clear = not (marks.outer or marks.outer_words or marks.head)
        tag = marks.tag if marks.tag in TAGS else "other"
        size = 0 if n < 2 else 1 if n < 5 else 2 if n < 10 else 3 if n < 20 else 4 if n < 40 else 5
        share = links / n
        add(INDEX[f"tag {tag}"])
        add(LINKS + (0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3))
        add(WORDS + size)
        if marks.outer:
            add(INDEX["outer"])
        if marks.outer_words:
            add(INDEX["outer words"])
        add(INDEX["content"] if marks.content else INDEX["no content"])
        if marks.content_words:
            add(INDEX["content words"])
        if marks.head:
            add(INDEX["head"])
        if clear:
            add(INDEX["clear"])
            add(CLEAR_WORDS + size)
            if marks.content:
                add(INDEX["content, clear"])
            if tag == "p":
                add(INDEX["clear p"])
            if tag in ("h1", "h2", "h3"):
                add(INDEX["clear heading"])
        elif marks.content:
            add(INDEX["content, outer"])
        if text[-1] in ".!?:”\"":
            add(INDEX["ends a sentence"])
        if "©" in text:
            add(INDEX["copyright sign"])
        if tag == "li" and share >= 0.7:
            add(INDEX["link list"])
        if i == 0:
            add(INDEX["first"])
        if i == len(found) - 1:
            add(INDEX["last"])
        out.append(ids)
    return out


def template_pages() -> list[tuple[list, list[int]]]:
    """Labelled pages (features, labels) from a few layouts: with and without <article>, with lists, quotes, notices and comments."""
    random = np.random.default_rng(0)
    made = []

    def words(lo, hi, end="."):
        return " ".join("".join(random.choice(list("abcdefgilmnorstu"), random.integers(2, 9))) for _ in range(random.integers(lo, hi))) + end

    outer = [
        lambda: "<nav><ul>" + "".join(f"<li><a href='#'>{words(1, 3, '')}</a></li>" for _ in range(random.integers(2, 9))) + "</ul></nav>",
        lambda: f"<header><p>{words(2, 8, '')}</p><a href='/'>{words(1, 3, '')}</a></header>", lambda: f"<aside><p>{words(4, 40)}</p><p>{words(4, 30)}</p></aside>",
        lambda: f"<div class='{random.choice(['ad', 'cookie-notice', 'sidebar', 'promo banner', 'related', 'newsletter', 'share-buttons'])}'>{words(3, 40)}</div>",
        lambda: f"<div id='comments'><h3>{words(1, 3, '')}</h3>" + "".join(f"<div class='comment'><p>{words(3, 50)}</p></div>" for _ in range(random.integers(1, 6))) + "</div>",
        lambda: f"<form><label>{words(1, 3, '')}</label><p>{words(3, 9)}</p><button>{words(1, 2, '')}</button></form>", lambda: f"<footer>&copy; {words(2, 9, '')} <a href='#'>{words(1, 3, '')}</a></footer>",
        lambda: "<ul>" + "".join(f"<li><a href='#'>{words(1, 5, '')}</a></li>" for _ in range(random.integers(2, 7))) + "</ul>",
    ]
    inner = [
        lambda: f"<p>{words(8, 90)}</p>", lambda: f"<p>{words(8, 90)}</p>", lambda: f"<p>{words(5, 30, '')} <a href='#'>{words(1, 3, '')}</a> {words(4, 30)}</p>", lambda: f"<p>{words(1, 6)}</p>",
        lambda: f"<h2>{words(2, 8, '')}</h2>", lambda: "<ul>" + "".join(f"<li>{words(3, 20)}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote>{words(8, 40)}</blockquote>", lambda: f"<pre>{words(3, 20, '')}</pre>",
        lambda: f"<table><tr><td>{words(1, 4, '')}</td><td>{words(1, 4, '')}</td></tr></table>",
    ]
    some = lambda parts, lo, hi: [parts[i]() for i in random.integers(0, len(parts), random.integers(lo, hi))]
    for turn in range(240):
        body = [f"<h1>{words(2, 12, '')}</h1>", *some(inner, 2, 12)]
        if turn % 3 == 0:  # an interruption inside the article
            body.insert(int(random.integers(1, len(body))), "\0" + outer[[2, 3, 5, 0][turn % 4]]() + "\1")
        wrap = [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div>", "</div>"), ("<article class='story'>", "</article>")][turn % 5]
        before, after = some(outer, 0, 4), some(outer, 0, 4)
        labels, found = [], []
        head = f"<html><head><title>{words(2, 9, '')}</title></head><body>"
        page = head + "".join(before) + wrap[0] + "\2" + "".join(body) + "\3" + wrap[1] + "".join(after) + "</body></html>"
        inside = 0
        depth_marks = {"\0": -1, "\1": 1, "\2": 1, "\3": -1}
        # the marks are text, so they stick to blocks; give each its own block and drop it
        for block in blocks("".join(f"<div>{c}</div>" if c in depth_marks else c for c in page)):
            if block[0] in depth_marks:
                inside += depth_marks[block[0]]
            else:
                found.append(block)
                labels.append(1 if inside == 1 else 0)
        made.append((features(found), labels))
    return made


def labelled_by_element(page: str):
    """Features and labels of a page that marks its article itself, else nothing."""
    found = blocks(page)
    labels = [int(m.content and not (m.outer or m.outer_words)) for _, m, _, _ in found]
    return (features(found), labels) if any(labels) and not all(labels) else None


def train(pages, *, turns: int = 150, rate: float = 0.3, decay: float = 1e-3):
    """(emission weights, transitions, start) by gradient ascent on the conditional likelihood of labelled pages, all at once."""
    longest = max(len(y) for _, y in pages)
    n = len(pages)
    x = np.zeros((n, longest, N), np.float32)
    y, on = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (rows, labels) in enumerate(pages):
        on[i, : len(labels)] = True
        y[i, : len(labels)] = labels
        for j, ids in enumerate(rows):
            x[i, j, ids] = 1
    weights, move, start = np.zeros((N, 2)), np.zeros((2, 2)), np.zeros(2)
    params = [weights, move, start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = on.sum()
    truth = np.eye(2)[y] * on[..., None]
    pair = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    for turn in range(1, turns + 1):
        score = x @ weights
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = score[:, 0] + start
        for t in range(1, longest):
            step = np.logaddexp(*np.moveaxis(alpha[:, t - 1, :, None] + move, 1, 0)) + score[:, t]
            alpha[:, t] = np.where(on[:, t, None], step, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = (score[:, t + 1] + beta[:, t + 1])[:, None, :] + move
            beta[:, t] = np.where(on[:, t + 1, None], np.logaddexp(after[..., 0], after[..., 1]), 0)
        whole = np.logaddexp(*alpha[:, -1].T)
        p = np.exp(alpha + beta - whole[:, None, None]) * on[..., None]
        both = np.exp(alpha[:, :-1, :, None] + move + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * on[:, 1:, None, None]
        grads = [np.einsum("ntf,nta->fa", x, truth - p) / total - decay * weights, (pair - both.sum((0, 1))) / total - decay * move, (truth[:, 0] - p[:, 0]).sum(0) / total]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] += rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
    return weights[:, 1] - weights[:, 0], move, start


def decode(ids: list[list[int]], model) -> list[int]:
    """The most likely labels of a page's blocks."""
    if not ids:
        return []
    weights, move, start = model
    flat = weights[np.fromiter(chain.from_iterable(ids), np.int64)]
    one = np.add.reduceat(flat, np.concatenate(([0], np.cumsum([len(x) for x in ids])[:-1]))).tolist()
    (m00, m01), (m10, m11) = move.tolist()
    a, b = float(start[0]), float(start[1]) + one[0]
    back = []
    for e in one[1:]:
        from0, from1 = a + m01 >= b + m11, a + m00 >= b + m10
        back.append((from1, from0))
        a, b = (a + m00 if from1 else b + m10), (a + m01 if from0 else b + m11) + e
    label = int(b > a)
    out = [label]
    for to_zero, to_one in reversed(back):
        label = 0 if (to_one if label else to_zero) else 1
        out.append(label)
    return out[::-1]


def fit(pages: DataFrame, *, most: int = MAX_FIT, most_chars: int = 50_000):
    """Train on the template pages and on at most ``most`` pages of the input that have an <article> or <main> element.

    Pages of ``most_chars`` characters and more are not drawn, which bounds what comes to the driver; extraction reads all of every page.
    """
    rows = plain(pages, "page_id", "html")
    order = F.xxhash64("html", "page_id")
    # a draw by hash first, so that tasks send few pages however many there are
    drawn = rows.where(F.pmod(order, F.lit(1 << 30)) < min(1.0, 4 * most / max(1, rows.count())) * (1 << 30))
    some = drawn.where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") < most_chars)).orderBy(order, "page_id").select("html").limit(most)
    sampled = [labelled_by_element(r.html) for r in some.collect()]
    return train([*template_pages(), *(x for x in sampled if x)])


def extract(pages: DataFrame, model=None) -> DataFrame:
    """page_id, url, text and n_chars of every page; text is empty for null and empty pages and where no block is article.

    White space inside a block becomes one space; blocks are joined in page order by an empty line. Repeated rows get equal texts.
    """
    model = fit(pages) if model is None else model
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = plain(pages, "page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def extracted(batches):
        for batch in batches:
            texts = []
            for page in batch.column("html"):
                found = blocks(page.as_py())
                texts.append("\n\n".join(b[0] for b, y in zip(found, decode(features(found), shared.value)) if y))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
