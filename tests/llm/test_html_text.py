from quern.llm.html_text import extract, main_text

SENTENCE = "The river rose, and the town, which had slept, woke at once. "


def test_article_among_boilerplate():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1><p>{SENTENCE}</p></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>
    <!-- <p>no</p> --><div class="ad">{SENTENCE}</div><div id="cookie-notice">{SENTENCE}</div>
    <article><header><h1>Head&amp;line</h1></header><p><b>First &lt;b&gt;   para\n graph.<br><p>Second &eacute;&#233;&#xe9; one</p><ul><li>x<li>y</ul>
    <div class="share-bar">Share this</div><form><p>Name</p><input></form><table><tr><td>1<td>2</table><section class="comments"><p>{SENTENCE * 9}</p></section></article>
    <aside><p>{SENTENCE * 5}</p></aside><footer>&copy; {SENTENCE}</footer></body></html>"""
    assert main_text(page) == "Head&line\nFirst <b> para graph.\nSecond ééé one\nx\ny\n1\n2"


def test_without_semantic_tags():
    body = "".join(f"<p>{SENTENCE * 3}</p>" for _ in range(6))
    links = "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><div><h2>Title</h2>{body}</div></div><div><span>Contact us</span> <a href=x>Imprint</a></div>"
    assert main_text(page) == "\n".join(["Title"] + [(SENTENCE * 3).strip()] * 6)


def test_broken_and_short_pages():
    assert main_text("<article><h1>A</h1><p>Cut off in the mid") == "A\nCut off in the mid"
    assert main_text('<p>x <a href="unclosed>y</a></p>').startswith("x")
    assert main_text("<nav>menu</nav><footer>f</footer>") == "" and main_text("") == "" and main_text(None) == ""
    assert main_text("plain < text & more") == "plain < text & more"
    assert main_text("<article><p>ok</p><script>if (a<b) {") == "ok"


def test_frame(spark):
    rows = [(1, "u", f"<body><article><p>{SENTENCE * 20000}</p></article>", 7), (2, None, None, None), (None, "v", "", 0), (1, "u", "<p>日本 𝒳</p>", 7)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", len(SENTENCE) * 20000 - 1), (2, None, 0), (None, "v", 0), (1, "u", 4)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string, text long")).collect() == []


def test_sample_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        inside = r.html.split("<article>")[1].split("</article>")[0]
        import html
        import re

        want = [" ".join(html.unescape(x).split()) for x in re.sub(r"</?b>|<br>", " ", inside).replace("</p>", "").replace("<h1>", "").replace("</h1>", "<p>").split("<p>")]
        assert got[r.page_id] == "\n".join(x for x in want if x)
