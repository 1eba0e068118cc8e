"""Main text of pages: structure, character references, odd markup, edge cases."""

import pytest

from cohortlens.llm import html_text
from cohortlens.llm.html_text import main_text

LONG = "A sentence of the article, with commas, and a full stop. It goes on for a while; then it ends."


def page(article, before="", after=""):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>'</script></head><body>"
            f"<nav><ul><li><a href='/'>Home</a></li><li><a>Long menu entry, with text. And more.</a></li></ul></nav>{before}"
            f"<article>{article}</article>{after}<footer>&copy; us, all rights reserved. Really, all.</footer></body></html>")


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("   ", ""), ("plain text", "plain text"), ("<p>", ""), ("<div hidden>x</div>", ""), ("<!-- no end", ""), ("<script>var a = 1", ""),
    (page(f"<h1>Title</h1><p>{LONG}</p><p>Ed.</p>"), f"Title\n\n{LONG}\n\nEd."),
    (page(f"<p>{LONG}<p><b>Bold<br>line<p>{LONG}"), f"{LONG}\n\nBold line\n\n{LONG}"),
    (page(f"<p>a&nbsp;b &amp; c&#233;&#x41; &lt;p&gt;  \n x</p><p>{LONG}</p>"), f"a b & céA <p> x\n\n{LONG}"),
    (page(f"<p>{LONG}</p><aside>{LONG}</aside><div class='comments'><p>{LONG}</p></div><form><p>{LONG}</p></form><p>End.</p>"), f"{LONG}\n\nEnd."),
    (page(f"<p>{LONG}</p>", f"<div class='cookie-notice'>{LONG}</div><div class=\"ad\">{LONG}</div><header>{LONG}</header>", f"<div id='sidebar'>{LONG}</div>"), LONG),
    (page(f"<h2>one</h2><ul><li>first<li>second</ul><p>{LONG}</p>"), f"one\n\nfirst\n\nsecond\n\n{LONG}"),
    (f"<body><div class='top'>Menu | Login</div><div id='main'><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'>{LONG}</div></body>", f"T\n\n{LONG}\n\n{LONG}"),
    (page(f"<p>{LONG} <em>very</em><b>bold</b></p>")[:-30], f"{LONG} verybold"),
])
def test_main_text(html, text):
    assert main_text(html) == text


def test_div_pages_keep_title_lead_and_small_sections():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(40))
    texts = [f"{LONG} {i}" for i in range(40)]
    menus = "<div class='top'>Menu | Login</div><div><a href='/'>Home</a> <a href='/n'>News</a></div>"
    legal = "<div>© 2024 Us. All rights reserved.</div><div class='sidebar'>Other news, here.</div>"
    for parts in (f"<div id=content><h1>Title</h1><div class=lead>A lead</div><div class=body>{body}</div><div class=more><h2>Note</h2><p>One more.</p></div></div>",
                  f"<div id=head><h1><a href='/t'>Title</a></h1><p>A lead</p></div><div><div>{body}</div></div><section><h2>Note</h2><p>One more.</p></section>"):
        assert main_text(f"<html><body>{menus}{parts}{legal}</body></html>").split("\n\n") == ["Title", "A lead", *texts, "Note", "One more."]


def test_query_form_and_edge_cases(spark):
    big = page("".join(f"<p>{LONG} {i}</p>" for i in range(3000)))
    rows = [(1, "u", big), (2, "u", None), (3, None, ""), (3, None, ""), (None, "v", page(f"<p>{LONG}</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as row")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in out.collect()), key=str)
    whole = "\n\n".join(f"{LONG} {i}" for i in range(3000))
    assert got == sorted([(0, "v", LONG, len(LONG)), (1, "u", whole, len(whole)), (2, "u", "", 0), (3, None, "", 0), (3, None, "", 0)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0
