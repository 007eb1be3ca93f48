from __future__ import annotations

import math
import random
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quire.llm import html_text as H
from quire.llm.html_text import extract_text, main_text

ARTICLE = "<p>The first paragraph of the story has quite some words in it.<p>The <b>second</b> one follows<br>it &amp; has &eacute;ven more words than the first one had.</p>"
TEXT = "The first paragraph of the story has quite some words in it.\nThe second one follows it & has éven more words than the first one had."
NOISE = "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{NOISE}<article>{ARTICLE}</article><footer>&copy; x</footer></body></html>",
        f"<body><header><h1>Site</h1></header><div id=content>{ARTICLE}</div><aside><p>other words of a sidebar that are long enough to look like text</p></aside></body>",
        f"<body><div class='cookie-notice'>We use cookies and say so at some length here.</div><main>{ARTICLE}<div class=\"ad\">Buy this thing now</div></main><div id='comments'><p>I disagree with all of this, and at length.</p></div></body>",
        f"<body><div><div><div>{ARTICLE}</div></div></div><form><p>Your name, your address and your opinion</p><input></form>",
        f"<BODY><TABLE class=menu><tr><td><a href=x>one</a><td><a href=y>two</a></table><DIV CLASS='Story'>{ARTICLE}</DIV><!-- <p>hidden</p> -->",
        f"<body><div class='layout with-sidebar'><div class='sidebar'><p>Things on the side, rather many of them.</p></div><main>{ARTICLE}</main></div>",
        f"<body><section role='navigation'>a b c</section><article><div class='share-buttons'>Share</div>{ARTICLE}<section class='related'><p>You may also like</p></section></article>",
    ],
)
def test_the_article_and_nothing_else(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><form id='aspnetForm'><div class='menu'><a href=x>one</a></div><article>{ARTICLE}</article></form>", TEXT),
        (f"<body><form><div>{ARTICLE}</div></form><div>little</div>", TEXT),
        (f"<article><p>Start.<section id='discussion'>{ARTICLE}</section><p class='legal'>The court said that the law of the land had to be read in another way.</article>", "Start.\n" + TEXT + "\nThe court said that the law of the land had to be read in another way."),
        (f"<article>{ARTICLE}<p>Since <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds.</article>", TEXT + "\nSince a=b holds."),
    ],
)
def test_forms_words_and_formulas_keep_prose(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><article>{ARTICLE}</article><article>{ARTICLE}</article></body>", TEXT + "\n" + TEXT),
        (f"<body><div><h1>Title</h1><p>The lead paragraph says in a few more words what the story is all about.</p></div><article>{ARTICLE}</article><div><a href=x>more</a></div></body>", "Title\nThe lead paragraph says in a few more words what the story is all about.\n" + TEXT),
        (f"<body><h1>Title</h1><ul><li><a href=x>more</a></ul><article>{ARTICLE}</article></body>", "Title\n" + TEXT),
        (f"<p>Before the body there are words as many as in it.<body>{ARTICLE}<body><p>A second body has words as well as the first.</p></body><p>After the body there are words too, and not so few.</p>", f"Before the body there are words as many as in it.\n{TEXT}\nA second body has words as well as the first.\nAfter the body there are words too, and not so few."),
    ],
)
def test_dense_text_beside_the_article_and_the_body(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [("", ""), (None, ""), ("just text", "just text"), ("<p>", ""), ("<div>a<div>b", "a\nb"), ("<script>x", ""), ("a < b <i>c</i>", "a < b c"), ("<body><p>one &#x41;&nbsp;two</p>", "one A two"), ("<b>" * 3000 + "deep", "deep"), ("<td>a<td>b", "a\nb"), ("<textarea>no</textarea>yes", "yes")])
def test_odd_pages(page, text):
    assert main_text(page) == text


@given(st.text(alphabet="<>/=\"'ab p&;!-", max_size=80))
def test_any_input_gives_a_text(page):
    out = main_text(page)
    assert "\n\n" not in out and out == "\n".join(" ".join(x.split()) for x in out.split("\n"))


def test_rows(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (None, None, None), (1, "u", f"<article>{ARTICLE}</article>"), (2, "v", "<p>" + "word " * 60000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "0 as n_chars").repartition(2)
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract_text(pages).collect())
    assert got == [(0, "", "", 0), (1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, "v", ("word " * 60000).strip(), 299999)]
    assert extract_text(pages.limit(0)).count() == 0


def test_parts_of_an_article_stay_whatever_their_class():
    page = (
        '<body><nav>x</nav><article><h1>T</h1><p>First.</p><div class="related-work"><p>Others did it too.</p></div><section id="legal"><p>The law says so.</p></section>'
        '<div class="share"><a href="x">Share</a></div><div class="related"><a href="y">More of the same kind, and more, and more, and more, and more</a></div>'
        '<div class="comments"><p>I, a reader, do not agree with any of this, and I say so at some length here.</p></div></article></body>'
    )
    assert H.main_text(page) == "T\nFirst.\nOthers did it too.\nThe law says so."


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<span>" * 50_000 + "<hr>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<article>" * 50_000 + "a", '<div class="legal">' * 30_000 + "x", '<a "' * 50_000, "<p><b>" * 50_000])
def test_time_in_proportion_to_length(page):
    began = time.perf_counter()
    H.main_text(page)
    assert time.perf_counter() - began < 5


def test_densities_by_their_definition():
    rng = random.Random(7)

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "p", "a", "span", "section"])
            out.append(rng.choice(["", "some words here ", "x"]))
            if depth:
                out.append(f"<{tag}>{tree(depth - 1) if tag not in ('a', 'p') else 'linked text'}</{tag}>")
        return "".join(out)

    def numbers(x):
        kids = [k for k in x.kids if not isinstance(k, str)]
        below = [numbers(k) for k in kids]
        c = sum(len(k.strip()) for k in x.kids if isinstance(k, str)) + sum(b[0] for b in below)
        t = len(kids) + sum(b[1] for b in below)
        lc = c if x.tag == "a" else sum(b[2] for b in below)
        lt = t if x.tag == "a" else sum(b[3] for b in below) + sum(k.tag == "a" for k in kids)
        return c, t, lc, lt

    for _ in range(60):
        root = H.parse(f"<body>{tree(3)}</body>")
        H._measure(root)
        body = root.kids[0]
        bc, _, blc, _ = numbers(body)
        stack = [body]
        while stack:
            x = stack.pop()
            c, t, lc, lt = numbers(x)
            one = lambda v: v or 1
            want = 0.0
            if c:
                low = math.log(math.log(c / one(c - lc) * lc + blc / one(bc) * c + math.e))
                want = c / one(t) * math.log(c / one(lc) * one(t) / one(lt)) / one(low)
            kids = [k for k in x.kids if not isinstance(k, str)]
            assert math.isclose(x.density, want, abs_tol=1e-9) and math.isclose(x.sum, sum(k.density for k in kids), abs_tol=1e-9)
            stack += kids
