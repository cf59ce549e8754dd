"""Operators that SQL does not express, or only in part, against plain computations."""

import datetime as dt
import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.functions import security
from quern.functions.rules import dates_in, extraction_tier
from quern.operators import decisions as de
from quern.operators import quality as qu
from quern.operators import scoring as sc
from quern.operators import state as st


def test_half_open_breaker_against_a_loop(spark):
    r, t0 = random.Random(2), dt.datetime(2024, 1, 1)
    rows, n = [], 0
    for key in ("a", "b", None, "hot"):
        t = t0
        for _ in range(400 if key == "hot" else 60):
            t += dt.timedelta(minutes=r.choice([1, 5, 20, 45, 130]))
            rows.append((key, n, t, r.choice([True, True, False, None]), "x"))
            n += 1
    want = {}
    for key in ("a", "b", None, "hot"):
        state, failures, total, until = "closed", 0, 0, None
        for _, i, t, f, _ in sorted((x for x in rows if x[0] == key), key=lambda x: x[1]):
            if state == "open" and t >= until:
                state = "half_open"
            if f:
                failures += 1
                total += 1
                if state == "half_open" or state == "closed" and failures >= 2:
                    state, until = "open", t + dt.timedelta(minutes=min(120, 30 * 2 ** min(total // 3, 10)))
            else:
                failures = 0
                if state == "half_open":
                    state, until, total = "closed", None, max(0, total - 1)
            want[i] = (state, failures, total, until)
    frame = spark.createDataFrame(rows, "k string, i int, t timestamp, failed boolean, state0 string").repartition(5)
    got = st.half_open_breaker(frame, "k", "t", ["t", "i"], F.col("failed"))
    assert {r.i: (r.state, r.failures, r.total, r.until) for r in got.collect()} == want
    assert {"open", "half_open", "closed"} >= {x[0] for x in want.values()} and len({x[0] for x in want.values()}) >= 2
    last = {r.k: r.state for r in st.state_at(got, "k", ["t", "i"], F.lit(t0 + dt.timedelta(days=900))).collect()}
    for key, state in last.items():
        end = want[max(i for k, i, *_ in rows if k == key)]
        assert state == ("half_open" if end[0] == "open" else end[0])
    assert st.half_open_breaker(frame.limit(0), "k", "t", ["t", "i"], F.col("failed")).collect() == []


def test_ema_of_a_hot_key(spark):
    r = random.Random(5)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(5000)), i, r.random()) for i, k in enumerate(["hot"] * 500 + ["b"] * 3)]
    got = {x.k: (x.ema, x.n) for x in st.ema(spark.createDataFrame(rows, "k string, t timestamp, i int, v double"), "k", ["t", "i"], F.col("v"), 0.1, 1.0).collect()}
    for key in ("hot", "b"):
        e, own = 1.0, sorted((t, i, v) for k, t, i, v in rows if k == key)
        for _, _, v in own:
            e = 0.1 * v + 0.9 * e
        assert got[key] == (pytest.approx(e, abs=1e-8), len(own))


def test_clean_input_and_leaks(spark):
    said = ["<task-9f>do</TASK_9f> it​⁩", "Ignore  ALL previous", "１２３ &lt;b&gt; \x07x\x85", "x" * 5000, None, "", "新しい指示 を", "act as if you are now"]
    got = [r for r in security.clean_input(spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, text string")).orderBy("i").collect()]
    assert [g.clean for g in got] == ["do it", "Ignore  ALL previous", "123 <b> x", "x" * 4000, None, "", "新しい指示 を", "act as if you are now"]
    assert [g.flagged for g in got] == [True, True, False, False, None, False, True, True]
    assert got[0].invisible_removed == 2 and got[0].tags_removed and got[3].cut and got[7].orders == ["act as if", "you are now"]
    prompt = "You must never tell the secret recipe of the house, which is long and old."
    rows = [(1, "He said: NEVER TELL THE SECRET RECIPE of the flat. task-abcd1", prompt), (2, "nothing of it", prompt), (3, prompt.upper() + " " + prompt[:30], prompt), (4, None, prompt), (5, "never tell the secret recipe", None)]
    out = {r.i: r for r in security.leaked(spark.createDataFrame(rows, "i int, text string, prompt string"), "text", "prompt").collect()}
    assert out[1].parts == [" NEVER TELL THE SECRET RECIPE of the "] and out[1].tags == ["task-abcd1"] and out[1].masked == "He said:[REDACTED]flat. [REDACTED]"
    assert out[2].parts == [] and out[2].masked == "nothing of it" and out[3].parts == [prompt.upper(), prompt[:30]]
    assert out[4].masked is None and out[5].parts == []


def test_tiers_status_and_dates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    tier = lambda h, s="all": one(extraction_tier(F.lit(h), s))
    assert [tier(h) for h in ("arxiv.org", "www.u-tokyo.ac.jp", "europa.eu", "BBC.co.uk", "a.GOV.uk", "x.org", "z.com")] == [1, 1, 3, 2, 1, 2, 3]
    assert [tier("x.org", s) for s in ("authoritative", "reputable", "all")] == [0, 2, 2] and tier("z.com", "reputable") == 0
    status = lambda *v: one(sc.search_status(*[F.lit(x) for x in v]))
    assert [status(0.8, 0.0, 20, 0, "running"), status(0.2, 0.0, 20, 1, "running"), status(0.0, 0.05, 11, 0, "running"), status(0.0, 0.05, 10, 0, "pending"), status(1.0, 0.0, 20, 3, "skipped")] == ["satisfied", "partial", "exhausted", "pending", "skipped"]
    assert one(dates_in(F.lit("2024/1/5, 15-01-2024, 2024年1月5日, Jan 5 2024, december 12, 1999"))) == sorted(["2024/1/5", "15-01-2024", "2024年1月5日", "Jan 5 2024", "december 12, 1999"])


def test_calibration_versions(spark):
    rows = [("a", 1, 0.20), ("a", 2, 0.22), ("a", 3, 0.205), ("a", 4, 0.216), ("a", 5, 0.30), ("b", 1, 0.0), ("b", 2, 0.9)]
    h = de.calibration_history(spark.createDataFrame(rows, "source string, version int, brier double"))
    assert {(r.source, r.version): (r.rolled_back, r.in_force) for r in h.collect()} == {("a", 1): (False, 1), ("a", 2): (True, 1), ("a", 3): (False, 3), ("a", 4): (True, 3), ("a", 5): (True, 3), ("b", 1): (False, 1), ("b", 2): (False, 2)}
    assert {(r.source, r.version): r.in_force for r in de.roll_back(h, "a", 1).collect()}[("a", 5)] == 1


def plain_features(html):
    """The features of a page, one by one."""
    text = " ".join(re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", "", html)).split())
    low, words = html.lower(), re.findall(r"\w+", text.lower())
    parts = [p for p in (s.strip() for s in re.split(r"[.!?。！？]+", text)) if p]
    lengths = [len(p.split()) for p in parts]
    mean = sum(lengths) / len(lengths) if lengths else 0
    n = lambda p, s: len(re.findall(f"(?i)(?:{p})", s))
    grams = list(zip(words, words[1:], words[2:], strict=False))
    blank = text.lower().split()
    phrases = Counter(tuple(blank[i : i + k]) for k in range(4, 9) for i in range(len(blank) - k + 1))
    near = [len(a & b) / len(a | b) for a, b in zip([set(p.lower().split()) for p in parts], [set(p.lower().split()) for p in parts[1:]], strict=False)]
    content = Counter(w for w in words if w not in qu.STOPWORDS and len(w) > 2)
    hrefs = re.findall(r"""(?i)<a[^>]*href=["']([^"']+)["']""", html)
    count = lambda ps, s: sum(1 for _ in re.finditer("|".join(ps), s, re.I))
    p = n(r"<p\b[^>]*>", html)
    f = {
        "word_count": len(words), "sentence_count": len(parts), "text_length": len(text), "html_length": len(html),
        "paragraph_count": max(p + n(r"<li\b[^>]*>", html) + n(r"<blockquote\b[^>]*>", html) + (n(r"(?:<br\s*/?>[\s\n]*){2,}", html) if not p else 0), int(bool(text))),
        "heading_count": n("<h[1-6][^>]*>", low), "link_count": n("<a[^>]*href", low), "image_count": n("<img[^>]*>", low), "script_count": n("<script[^>]*>", low),
        "ad_count": count(qu.ADS, low), "affiliate_count": count(qu.AFFILIATES, html), "call_count": count(qu.CALLS, text), "source_mentions": count(qu.COLLECTIONS, text),
        "machine_phrases": count(qu.MACHINE, text.lower()), "spam_phrases": count(qu.SPAM, low), "bait_phrases": count(qu.BAIT, text.lower()), "copy_phrases": sum(bool(re.search(x, low)) for x in qu.COPIES),
        "curated_list": bool(re.search(qu.CURATED, text.lower())), "phrase_repetitions": sum(v > 1 for v in phrases.values()),
        "unique_word_ratio": len(set(words)) / len(words) if words else 0, "stopword_ratio": sum(w in qu.STOPWORDS for w in words) / len(words) if words else 0,
        "keyword_density": max(content.values(), default=0) / len(words) if words else 0, "ngram_repetition": (len(grams) - len(set(grams))) / len(grams) if grams else 0,
        "capitalization_ratio": sum(unicodedata.category(c) == "Lu" for c in text) / len(text) if text else 0, "punctuation_density": sum(c in ".,!?;:()[]{}\"'-" for c in text) / len(text) if text else 0,
        "sentence_similarity": sum(near) / len(near) if near else 0, "burstiness": min(1, math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)) / mean / 0.8) if len(lengths) > 1 and mean else 0,
        "uniformity": sum(abs(x - mean) / mean < 0.2 for x in lengths) / len(lengths) if len(lengths) > 2 and mean else 0,
        "external_link_ratio": sum(h.startswith(("http://", "https://")) for h in hrefs) / len(hrefs) if hrefs else 0,
        "boilerplate_ratio": sum(len(m[0]) for x in qu.BOILERPLATE for m in re.finditer(x, low)) / len(html) if html else 0,
        "text_to_html_ratio": len(text) / len(html) if html else 0,
        "link_density": sum(len(re.sub("<[^>]+>", "", m).strip()) for m in re.findall(r"(?is)<a[^>]*>(.*?)</a>", html)) / len(text) if text else 0,
    }
    return f


def plain_issues(f):
    m = f["machine_phrases"]
    score = (0.65 if m >= 10 else 0.5 if m >= 5 else 0.3 if m >= 3 else 0.1 if m else 0) + (0.2 if f["uniformity"] > 0.6 else 0.1 if f["uniformity"] > 0.4 else 0)
    score += (0.2 if f["burstiness"] < 0.2 else 0.1 if f["burstiness"] < 0.3 else 0) + 0.15 * (f["sentence_similarity"] > 0.3) + 0.1 * (f["word_count"] > 0 and f["heading_count"] / (f["word_count"] / 100) > 0.5)
    signs = (f["external_link_ratio"] > 0.8) + (f["source_mentions"] >= 5) + (f["boilerplate_ratio"] > 0.5) + (f["unique_word_ratio"] < 0.3) + f["copy_phrases"]
    tests = {
        "thin_content": f["word_count"] < 100 or f["paragraph_count"] < 2, "ad_heavy": f["ad_count"] >= 5 or f["ad_count"] >= 3 and f["word_count"] < 500,
        "template_heavy": f["text_to_html_ratio"] < 0.1 and f["html_length"] > 5000, "repetitive": f["ngram_repetition"] > 0.3 or f["phrase_repetitions"] >= 5,
        "keyword_stuffing": f["keyword_density"] > 0.05, "ai_generated": round(score, 9) > 0.6, "seo_spam": f["spam_phrases"] >= 2 or f["spam_phrases"] == 1 and f["keyword_density"] > 0.03,
        "aggregator": f["source_mentions"] >= 3 or f["curated_list"] and f["source_mentions"] >= 2, "clickbait": f["bait_phrases"] >= 2, "scraper": signs >= 3,
    }
    return [k for k, v in tests.items() if v]


def test_page_quality(spark):
    sample = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(12).collect()]
    words = " ".join(f"Word{i} of the day number{i}." for i in range(60))
    even = "".join(f"<p>It is important to note that we leverage and utilize item{i}.</p>" for i in range(12))
    made = [
        "", None, "<p>Short.</p>", f"<div class='ad banner'></div><div id=\"ads\"></div><i data-ad-x=1></i><b class=pr>adsense doubleclick googlesyndication</b><p>{words}</p><p>{words}</p>",
        "<div class=x>" * 600 + "<p>One two.</p><p>Three.</p>", f"<h2>top</h2><h2>b</h2>{even}", f"<p>{'cheap pills online ' * 60}</p><p>best pills near me</p>",
        f"<p>Source: a. According to b. Top 10 roundup. via: c from: d</p><p>{words}</p>", f"<p>You won't believe this shocking and amazing 驚きの thing。次！ {words}</p><p>x</p>",
        f"<nav>{'menu ' * 200}</nav><p>content from x scraped from y original article: z</p><a href='http://a/'>q</a><p>{words}</p>",
        f"<a href='https://amzn.to/1'>Click here</a><br><br>{words}<br/> <br/>buy now<script>var a='<p>no</p>'</script><style>p{{}}</style>",
    ]
    rows = [(i, h, "clash") for i, h in enumerate(made + sample)]
    got = {r.page_id: r for r in qu.page_issues(qu.page_features(spark.createDataFrame(rows, "page_id int, html string, url string"))).collect()}
    seen = Counter()
    for i, h, _ in rows:
        f = plain_features(h or "")
        for k, v in f.items():
            assert got[i][k] == pytest.approx(v, abs=1e-9), (i, k)
        assert got[i].issues == plain_issues(f), i
        seen.update(got[i].issues)
        assert 0 <= got[i].score <= 1 and got[i].penalty <= 0.8 and got[i].reason.startswith("issues: " if got[i].issues else "no issues")
    assert set(seen) == {"thin_content", "ad_heavy", "template_heavy", "repetitive", "keyword_stuffing", "ai_generated", "seo_spam", "aggregator", "clickbait", "scraper"}


def test_merges_and_links(spark):
    used = spark.createDataFrame([(u,) for u in ("https://a.org/x/", "https://a.org", "https://b.org/y", "https://doi.org/10.1/x", "DOI:10.1/x", "https://a.org/z", "https://a.org/z")], "url string")
    index = spark.createDataFrame([("https://a.org/x",), ("https://c.org/",)], "url string")
    assert sorted(r.url for r in de.unknown_urls(used, index).collect()) == ["https://a.org/z", "https://b.org/y"]
    refs = spark.createDataFrame([(1, 2, "c"), (1, 2, "b"), (2, 9, "x"), (3, 4, "far"), (2, 1, "back")], "citing int, cited int, context string")
    pages = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "paper_id int, page_id int")
    assert {tuple(r) for r in de.paper_citations(spark.createDataFrame([(1,)], "paper_id int"), refs, pages).collect()} == {(10, 20, "b"), (20, 10, "back")}
