import pytest

from quern.llm.html_text import main_text

SENTENCE = "The river rose, and the town, which had slept, woke at once."
LONG = "".join(f"<p>{SENTENCE * 3}</p>" for _ in range(12))
BODY = [SENTENCE * 3] * 12


def test_article_around_a_long_part():
    assert main_text(f"<body><article><h1>Head</h1><p>Intro.</p><div class=body>{LONG}</div><p>End.</p></article>").split("\n") == ["Head", "Intro.", *BODY, "End."]
    assert main_text(f"<body><main><section><h2>One</h2>{LONG}</section><section><h2>Two</h2><p>Short.</p></section></main>").split("\n") == ["One", *BODY, "Two", "Short."]


@pytest.mark.parametrize("part", ["<ul>" + f"<li>{SENTENCE}</li>" * 30 + "</ul>", "<table>" + f"<tr><td>{SENTENCE}</td></tr>" * 30 + "</table>", f"<pre>{SENTENCE * 30}</pre>"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_paragraphs_around_a_long_list_table_or_listing(part, tag):
    got = main_text(f"<body><{tag}><h1>Head</h1><p>{SENTENCE}</p>{part}<p>End, then.</p></{tag}>").split("\n")
    assert got[:2] == ["Head", SENTENCE] and got[-1] == "End, then." and len(got) > 3


def test_selected_blocks_and_headings_outside_the_container():
    page = f"<body><div><h1>Head</h1><div class=body>{LONG}</div></div><div><ul>" + "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(9)) + "</ul></div>"
    assert main_text(page).split("\n") == ["Head", *BODY]
    page = f"<body><div><section>{LONG}</section><section><h2>Two</h2><p>{SENTENCE * 3}</p></section></div>"
    assert main_text(page).split("\n") == [*BODY, "Two", SENTENCE * 3]
