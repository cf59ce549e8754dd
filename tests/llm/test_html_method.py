import pytest

import quern.llm.html_text as m
from quern.llm.html_text import main_text

SENTENCE = "The river rose, and the town, which had slept, woke at once."
LONG = "".join(f"<p>{SENTENCE * 3}</p>" for _ in range(8))
BODY = [SENTENCE * 3] * 8
MENU = "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(9))


@pytest.mark.parametrize("name", ["has-sidebar", "content-sidebar-wrap", "post comments-open", "layout no-ads", "wrapper with-footer", "page-header-wrap", "sidebar", "comments"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_names_on_wrappers_of_an_article(name, tag):
    assert main_text(f'<body><div class="{name}"><ul>{MENU}</ul><{tag}><h1>Head</h1>{LONG}<p>End.</p></{tag}></div></body>').split("\n") == ["Head", *BODY, "End."]


@pytest.mark.parametrize("name", ["has-sidebar", "content-sidebar-wrap", "layout no-ads", "wrapper with-footer"])
def test_names_on_wrappers_without_semantic_tags(name):
    assert main_text(f'<body><div class="{name}"><ul>{MENU}</ul><div><h1>Head</h1>{LONG}</div><div class="share-bar">Share this</div></div></body>').split("\n") == ["Head", *BODY]


@pytest.mark.parametrize("mark", ['class="comments"', 'id="comments"', 'class="discussion"', 'id="responses"', 'class="talkback"', 'class="qx7"'])
@pytest.mark.parametrize("where", ["inside", "after"])
def test_comments_under_any_name(mark, where):
    items = "".join(f"<div class=c><div>Ann {k} says:</div><p>{SENTENCE}</p><p>{SENTENCE}</p></div>" for k in range(4))
    part = f"<section {mark}>{items}</section>"
    page = f"<body><article><h1>Head</h1>{LONG}{part if where == 'inside' else ''}</article>{part if where == 'after' else ''}</body>"
    assert main_text(page).split("\n") == ["Head", *BODY]


def test_comments_under_a_heading():
    part = f"<h3>2 Comments</h3><div><p>{SENTENCE}</p></div><div><p>{SENTENCE}</p></div>"
    assert main_text(f"<body><article><h1>Head</h1>{LONG}{part}</article>").split("\n") == ["Head", *BODY]
    assert main_text(f"<body><div><h1>Head</h1>{LONG}</div><div>{part}</div>").split("\n") == ["Head", *BODY]


def test_discussion_as_a_part_of_the_article_stays():
    part = f'<section class="discussion"><h2>Discussion</h2><p>{SENTENCE}</p><p>Short, too.</p></section>'
    assert main_text(f"<body><article><h1>Head</h1>{LONG}{part}</article>").split("\n") == ["Head", *BODY, "Discussion", SENTENCE, "Short, too."]


def test_comments_as_articles():
    items = "".join(f"<li><article class=comment><div>Ann {k}</div><p>{SENTENCE * 3}</p></article></li>" for k in range(9))
    assert main_text(f'<body><article><h1>Head</h1>{LONG}</article><div class="comments"><ol>{items}</ol></div>').split("\n") == ["Head", *BODY]


def test_teasers_are_not_the_article():
    teasers = "".join(f"<article><h3><a href=/{k}>Teaser {k}</a></h3><p>Read on.</p></article>" for k in range(6))
    assert main_text(f"<body><div><h1>Head</h1>{LONG}</div><div>{teasers}</div>").split("\n") == ["Head", *BODY]


def test_inline_mathematics_and_forms_around_pages():
    assert main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>") == "Let x=1 be."
    assert main_text(f"<body><form><div><h1>Head</h1>{LONG}</div></form></body>").split("\n") == ["Head", *BODY]


def test_threshold_and_links_decide(monkeypatch):
    notes = "".join(f"<div class=k>Some words of a note {k}, here</div>" for k in range(4))
    page = f"<body><div class=t>{LONG}</div><div class=n>{notes}</div><div class=l>" + "".join(f"<p><a href=/{k}>A long name of another page, number {k}, to be read.</a></p>" for k in range(8)) + "</div></body>"
    assert main_text(page).split("\n") == BODY
    monkeypatch.setattr(m, "THRESHOLD", 0.0)
    assert len(main_text(page).split("\n")) > len(BODY) + 3
    monkeypatch.setattr(m, "THRESHOLD", 0.25)
    inner = page.replace("<div class=t>", "<article>").replace("</div></body>", "</div></article></body>").replace("</div><div class=n>", "<div class=n>")
    kept = main_text(inner).split("\n")
    assert not any("another page" in x for x in kept)
    monkeypatch.setattr(m, "LINKS", 2.0)
    assert any("another page" in x for x in main_text(inner).split("\n"))
    monkeypatch.setattr(m, "NAMED", 1.0)
    advert = f"<body><article>{LONG}<div class=ad><p>{SENTENCE * 2}</p></div></article>"
    assert len(main_text(advert).split("\n")) == 9
    monkeypatch.undo()
    assert main_text(advert).split("\n") == BODY


def test_repeated_rows_and_clashing_columns(spark):
    page = f"<article><p>{SENTENCE}</p></article>"
    rows = [(1, "u", page, "x", 5), (1, "u", page, "x", 5), (None, None, page, None, None)]
    got = m.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_blocks string, n_chars long")).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, "u", SENTENCE, len(SENTENCE))] * 2 + [(None, None, SENTENCE, len(SENTENCE))]
