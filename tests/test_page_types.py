"""Types of pages: a page of each kind, ties, empty and missing input."""

import pytest
from pyspark.sql import functions as F

from quern.operators import page_types as pt

PAGES = {
    "article": ("https://x.example/a", "<article><h1>T</h1><span class='byline'>A</span><time datetime='2024-01-01'>d</time>" + "<p>words of the text here</p>" * 6 + "</article>"),
    "knowledge": ("https://docs.x.example/start", "<div id='toc'></div><div class='mw-parser'>" + "<h2>h</h2>" * 5 + "[edit]</div>"),
    "notice": ("https://x.example/press/1", "<div class='date'>d</div><div class='tag'>t</div><p>a</p><p>b</p>"),
    "forum": ("https://x.example/thread/1", "<div class='thread'><div class='upvote'></div><img class='avatar'><form id='reply'></form></div>"),
    "login_wall": ("https://x.example/signin", "<form action='/login'><input type='password'></form>"),
    "index": ("https://x.example/category/", "<ul class='pagination'>" + "<li><a href='/x'>link text</a></li>" * 12 + "</ul>"),
    "academic": ("https://arxiv.org/abs/1", "<h2>Abstract</h2><p>doi:10.1234/abc</p><h2>References</h2>"),
    "report": ("https://x.example/ir/", "<h2>要約</h2><div class='revenue'>売上</div><canvas></canvas>"),
    "legal": ("https://x.example/law/1", "<div class='statute'>第三条 section 4</div>"),
    "product": ("https://x.example/shop/1", "<b class='price'>$ 12.50</b><button>add-to-cart</button><i class='spec'>s</i>"),
    "profile": ("https://x.example/company/", "<div id='about'>会社概要</div><div class='team'>t</div>tel: 1"),
    "other": (None, "<div><div><div>plain</div></div></div>"),
}


@pytest.fixture(scope="module")
def typed(spark):
    d = spark.createDataFrame([(n, u, h) for n, (u, h) in PAGES.items()] + [("empty", None, ""), ("null", "https://x.example/p", None)], "page_id string, url string, html string")
    return {r.page_id: r for r in pt.classify(pt.page_features(d)).collect()}


@pytest.mark.parametrize("kind", PAGES)
def test_each_kind(typed, kind):
    assert typed[kind].page_type == kind


def test_empty_and_missing_html(typed):
    for k in ("empty", "null"):
        assert (typed[k].page_type, typed[k].score, typed[k].confidence, typed[k].reason) == ("other", 1.0, 1.0, "no strong classification signals")


def test_reasons_and_share(typed):
    assert typed["login_wall"].reason == "login form with password field detected; URL hints: login_wall"
    assert typed["article"].reason == "article tag present; publication date found; author information present; 6 paragraphs"
    assert typed["index"].reason.startswith("pagination detected; high link density (1.00); 12 list items")
    article = 2.5 + 2 + 1.5 + 0  # tag, date with author, paragraphs
    assert typed["article"].score >= article


def test_first_type_wins_among_equals(spark):
    f = pt.page_features(spark.createDataFrame([(1, None, "<div class='price'></div>第一条")], "page_id int, url string, html string"))
    got = pt.classify(f).first()  # product and legal have 2.5 each; legal comes first
    assert (got.page_type, got.score) == ("legal", 2.5) and got.confidence == round(2.5 / (2.5 * 2 + 0.1 * 9), 9)


def test_counts_ratios_and_hints(spark):
    html = "<html><meta property='og:type' content='Article'><p>ab cd</p><p>  </p><a href='x'> link </a><table></table></html>"
    r = pt.page_features(spark.createDataFrame([(1, "https://blog.x.example:8080/news/2024/01/02/?page=2", html)] * 2, "page_id int, url string, html string")).collect()
    assert len(r) == 2
    r = r[0]
    assert (r.paragraph_count, r.link_count, r.og_type, r.has_charts_tables) == (2, 1, "article", False)
    assert r.text_to_html_ratio == len("ab cd link") / len(html) and r.link_density == len("link") / len("ab cd link")
    assert r.url_hints == ["article", "notice", "news", "blog"]


def test_no_pages(spark):
    d = spark.createDataFrame([], "page_id int, url string, html string").withColumn("__h", F.lit("x"))
    assert pt.classify(pt.page_features(d)).count() == 0
