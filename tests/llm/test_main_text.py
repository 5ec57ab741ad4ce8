"""Main text: what the surge and dive of line blocks decide, with and without marks, and odd tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitequarry.llm import htmltext

LONG = "a sentence of the article that goes on for a while " * 3


def inside(html):
    return "\n".join(x.text for x in htmltext.lines_of(html)[0] if x is not None and x.inside)


def test_windows_alone_find_nearly_every_article(spark, monkeypatch):
    """Without names of parts and without what a mark gives, surge and dive leave the adverts out on at least 95 of 100 pages; with them on all."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert all(htmltext.main_text(p) == inside(p) for p in pages)
    monkeypatch.setattr(htmltext, "_WORDS", frozenset())
    assert all(htmltext.main_text(p) == inside(p) for p in pages)
    monkeypatch.setattr(htmltext, "BONUS", 1)
    monkeypatch.setattr(htmltext, "LIFT", 0)
    assert sum(htmltext.main_text(p) == inside(p) for p in pages) >= 0.95 * len(pages)


def test_unmarked_pages():
    page = f"<body><div><a href=x>Home</a> <a href=y>About us</a></div><div><h1>Hi</h1><p>{LONG}</p><p>Short.</p><ul><li><a href=q>a link</a></ul><p>{LONG}</p></div><div>Copyright 2020</div></body>"
    assert htmltext.main_text(page).split("\n") == ["Hi", LONG.strip(), "Short.", "a link", LONG.strip()]
    assert htmltext.main_text(f"<div>{LONG}</div><div>ok</div><div>{LONG}</div>").split("\n") == [LONG.strip(), "ok", LONG.strip()]


def test_marks_are_a_prior_and_no_verdict():
    beside = "an advert of a few words that stands beside"
    assert htmltext.main_text(f"<div>{beside}</div><article><p>One word</p></article><div>{beside}</div>") == "One word"
    text = "".join(f"<p>{LONG * 40}</p>" for _ in range(3))
    assert htmltext.main_text(f"<article>card</article><div>{text}</div>") == "\n".join([(LONG * 40).strip()] * 3)


def test_windows_decide_inside_and_beside_a_marked_article():
    body = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    want = ["Title", LONG.strip(), LONG.strip()]
    teaser = "<article class=card><h3>Other</h3><p>A teaser of few words.</p></article>"
    links = "<ul>" + "".join(f"<li><a href=/{k}>read also number {k}</a></li>" for k in range(5)) + "</ul>"
    unnamed = "<div><p>Buy one, get one free today only.</p></div>"
    assert htmltext.main_text(f"<article>{body}</article>{teaser}{unnamed}").split("\n") == want
    assert htmltext.main_text(f"{unnamed}<article>{body}{links}</article>{teaser}").split("\n") == want
    assert htmltext.main_text(f'<article><h1><a href="/x">Title</a></h1><p>{LONG}</p><p>{LONG}</p></article>').split("\n") == want
    two = f"<article>{body}</article><article>{body}</article>"
    assert htmltext.main_text(two).split("\n") == want * 2


def test_ends_of_unmarked_pages():
    page = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div><p>The end.</p></div><div>Copyright 2020</div></body>"
    assert htmltext.main_text(page).split("\n") == [LONG.strip(), LONG.strip(), "The end."]
    assert htmltext.main_text("<div><p>Two short words.</p></div><div>Copyright 2020 by someone.</div>") == "Two short words."


@pytest.mark.parametrize("name", ["comment-thread", "user-comments", "comments", "ad-wrap", "advertisement-top", "ad", "cookies", "cookie_bar", "post-comments main", "newsletter-box"])
def test_comments_and_adverts_go_wherever_they_stand(name):
    part = f'<div class="{name}"><p>{LONG * 60}</p></div>'
    for page in (f"<article><p>{LONG}</p>{part}</article>", f"<article><p>{LONG}</p></article>{part}", f"<div><p>{LONG}</p></div>{part}"):
        assert htmltext.main_text(page) == LONG.strip()


def test_parts_of_an_article_stay_whatever_their_name():
    page = '<article><p>a</p><section id="legal"><p>b</p></section><div class="social"><p>c</p></div><p class="tags">d</p><h2 id="menu">f</h2><div class="alert">g</div><section class="promo">h</section><div class="notice banner">i</div><div class="adept shadow">j</div><div class="ad">no</div><div id="comments">no</div><aside>no</aside><p>e</p></article>'
    assert htmltext.main_text(page) == "a\nb\nc\nd\nf\ng\nh\ni\nj\ne"


def test_references_are_decoded_in_one_text_node():
    assert htmltext.main_text("<p>a &am<b>p; x</b> &amp b</p>") == "a &amp; x & b"
    assert htmltext.main_text("<p>&#x41;&lt;b&gt; &nosuch;</p>") == "A<b> &nosuch;"


def test_empty_table_repeats_and_clashing_columns(spark):
    kind = "page_id long, url string, html string, text int, n_chars string, _main int"
    assert htmltext.op5(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, "u", "<article>a</article>", 5, "x", 7), (1, "u", "<article>a</article>", 5, "x", 7), (None, None, None, None, None, None)]
    got = htmltext.op5(spark.createDataFrame(rows, kind)).orderBy(F.col("page_id").asc_nulls_last()).collect()
    assert [tuple(r) for r in got] == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]


def test_very_long_lines_and_deep_trees():
    assert len(htmltext.main_text("<div>" * 5000 + "x" * 1_000_000)) == 1_000_000
    assert htmltext.main_text("<p>" + "</p><p>".join(["line"] * 50_000)).count("\n") == 49_999
