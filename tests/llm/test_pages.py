"""Main text of pages labelled by hand, and odd markup."""

import time

import pytest

from panelspark.llm import extraction

SENTENCES = ["The river rose again last night and the lower bridge was closed until noon.", "Nobody in the village could remember such a spring, said the keeper of the lock.",
             "By the evening most of the water had gone, and the ferry was back on its course.", "The council will meet on Monday to talk about a second wall behind the mill."]
TITLE = "High water closes the lower bridge"
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul></nav>"
FOOT = "<footer>&copy; 2020 The Paper <a href='/i'>Imprint</a></footer>"
BODY = "".join(f"<p>{x}</p>" for x in SENTENCES)
WANT = [TITLE, *SENTENCES]


def page(wrapped, head="", body=""):
    return f"<html><head><title>t</title>{head}</head><body{body}>{MENU}{wrapped}{FOOT}</body></html>"


@pytest.fixture(scope="module")
def field():
    return extraction.train(extraction.template_pages())


def text(html, field):
    found = extraction.blocks(html)
    return [b[0] for b, y in zip(found, extraction.decode(extraction.features(found), field)) if y]


@pytest.mark.parametrize("open_, close", [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div>", "</div>"), ("<section>", "</section>"), ("<article aria-hidden='false'>", "</article>"),
    ("<div class='article-related-story'>", "</div>"), ("<article id='post-hidden-gems' title='hidden'>", "</article>"), ("<article style='overflow:hidden'>", "</article>"),
    ("<div data-x='{\"a\": \"<b>\"}' class='story'>", "</div>"), ("<td>", "</td>"),
])
def test_articles_in_all_kinds_of_elements(field, open_, close):
    assert text(page(f"{open_}<h1>{TITLE}</h1>{BODY}{close}"), field) == WANT


def test_body_classes_do_not_hide_a_page(field):
    assert text(page(f"<article><h1>{TITLE}</h1>{BODY}</article>", body=" class='overflow-hidden'"), field) == WANT


def test_what_is_hidden_or_around_is_left_out(field):
    hidden = "".join(f"<div {x}><p>{SENTENCES[0]} Not to be seen.</p></div>" for x in ("hidden", "style='color:red; display: none'", "aria-hidden=true", "style=visibility:hidden", "class='comment-body'", "class='sidebar-content'", "id='article-comments'"))
    assert text(page(f"<article><h1>{TITLE}</h1>{BODY}</article>{hidden}"), field) == WANT


def test_math_and_fallbacks_are_text():
    found = [b[0] for b in extraction.blocks("<p>So <math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds.</p><object data='x'><p>A chart of it.</p></object>")]
    assert found == ["So x+1 holds.", "A chart of it."]


def test_long_and_broken_attributes():
    long = "<div data-x=\"" + "<p>inside</p>" * 20_000 + "\"><p>Real text.</p></div>"
    assert [b[0] for b in extraction.blocks(long)] == ["Real text."]
    assert [b[0] for b in extraction.blocks("<p title=it's>One.</p><p title='never closed>Two.</p><p>3 <4 and a <b c</p>")] == ["One.", "Two.", "3 <4 and a <b c"]
    for odd in ('<a "' * 60_000, "<a x='" * 60_000, '<a b="' + "<c d='" * 60_000, "<" * 200_000, "<a " * 100_000, "<!--" * 50_000, "<p>" * 20_000, '="' * 90_000):
        begin = time.time()
        extraction.blocks(odd)
        assert time.time() - begin < 10


def test_odd_tables(spark, field):
    pages = spark.createDataFrame([(1, "u", page(f"<article>{BODY}</article>"), "x"), (1, "u", page(f"<article>{BODY}</article>"), "x"), (None, None, None, None), (3, "v", "", "y")], "page_id long, url string, html string, text string")
    rows = extraction.extract(pages, field).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 0), (1, len("\n\n".join(SENTENCES))), (1, len("\n\n".join(SENTENCES))), (3, 0)]
    assert extraction.extract(pages.where("false")).count() == 0
