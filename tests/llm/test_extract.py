"""Operator 12: pages made of a known article in several layouts, single rules, and the given pages by a plain reading."""

import html
import random
import re

import numpy as np
import pytest
from helpers import prose
from pyspark.sql import functions as F

from tallyforge.llm.extract import Lines, border, extract, main_text, smoothed


def article(rng):
    title = prose(rng, rng.randrange(3, 9))
    paragraphs = [prose(rng, rng.choice((1, 3, 15, 40, 90))) + rng.choice(("", " & more <b>", " “é”")) for _ in range(rng.randrange(3, 9))]
    return [title, *paragraphs]


def body(rng, blocks):
    out = f"<h1>{html.escape(blocks[0])}</h1>"
    for b in blocks[1:]:
        w = html.escape(b).split(" ")
        at = rng.randrange(len(w))
        w[at] = rng.choice(("<a href='/x'>{}</a>", "<em>{}</em>", "{}", "<span>{}</span>\n")).format(w[at])
        out += rng.choice(("<p>{}</p>", "<p>\n  {}\n</p>", "<p>{}")).format(" ".join(w))
    return out


def links(rng, n):
    return "".join(f"<li><a href='/{i}'>{prose(rng, 2)}</a></li>" for i in range(n))


LAYOUTS = {
    "plain": "<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul>{menu}</ul></nav><article>{body}</article><footer>&copy; x <p>Terms</p></footer></body></html>",
    "marked": "<body class='has-sidebar'><header><h2>Site</h2><p>{junk}</p></header><div id='main-menu'><ul>{menu}</ul></div><div class='page'><div class='post-content'>{body}</div><div class='sidebar'><p>{junk}</p></div></div><div class='cookie-notice'>We use {junk}</div></body>",
    "replies": "<main><article>{body}<aside>{junk}</aside><div class='ad'>{junk}</div></article><section id='comments'><article class='comment'><p>{junk}</p><p>{junk} {junk}</p></article></section></main>",
    "form": "<body><form action='/'><div role='navigation'>{menu}</div><article>{body}</article><form><label>Mail</label><input></form></form><script>var t='</p><p>{junk}';</script>",
    "table": "<table><tr><td><ul>{menu}</ul></td><td><div>{body}</div></td></tr></table><div class='footer'>{junk}</div><noscript>{junk}</noscript>",
    "cut": "<div class='newsletter'><p>{junk}</p></div><article><!-- {junk} -->{body}",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_finds_the_article(layout):
    rng = random.Random(layout)
    for _ in range(60):
        blocks = article(rng)
        page = LAYOUTS[layout].format(menu=links(rng, rng.randrange(3, 9)), junk=prose(rng, rng.randrange(4, 30)), body=body(rng, blocks))
        assert main_text(page).split("\n") == [" ".join(b.split()) for b in blocks], page


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("   ", ""), ("just words &amp; &#233;&nbsp;x", "just words & é x"), ("<p>one<br>two</p>", "one two"), ("<ul><li>a</ul>", "a"), ("<p>a<p>b", "a\nb"), ("<script>x", ""), ("<!-- open", ""),
        ("<nav>only a menu</nav>", "only a menu"), ("<div class=ad>only an advert</div>", "only an advert"), ("<p hidden>no</p><p>yes</p>", "yes"), ("<article><p>a</article><p style='display: none'>b", "a"),
        ("<article><header><h1>T</h1><p class=byline>by x</p></header><p>text of it</p></article>", "T\ntext of it"), ("<b><i>a</b> b</i><p>c", "a b\nc"), ("</div></p>stray", "stray"), ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_rules(page, want):
    assert main_text(page) == want


def test_given_pages_by_a_plain_reading(spark):
    rows = extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:h1|p)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_rows_by_themselves(spark):
    rows = [(1, "u", "<p>a b</p>"), (1, "u", "<p>a b</p>"), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "long words " * 40_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(5) for c in ("text", "n_chars", "part")})
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0), (2, "v", "", 0), (3, "w", ("long words " * 40_000).strip(), 439_999)], key=str)
    assert extract(df.limit(0)).collect() == []


def test_ratios():
    lines = Lines().finished("<p>abcd</p><ul><li><a>x</a><li><a>y</a></ul>").lines
    assert [(t, tags) for _, t, tags, _ in lines] == [("abcd", 1), ("x", 5), ("y", 3)]
    flat = smoothed(np.full(7, 3.0))
    assert np.allclose(flat, 3) and smoothed(np.array([0.0, 0, 9, 0, 0])).argmax() == 2
    assert 1 < border(np.array([1.0, 1.2, 0.8, 9, 10])) < 9 and border(np.array([2.0])) == 2
