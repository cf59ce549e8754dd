"""Rule columns: cleaning of model input, page challenges, headings and tables, repetition, tiers, diffs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_words, let, ngrams

lit = F.lit


def json_in(text: Column) -> Column:
    """The first outermost JSON object in a text, between its first and last brace; null when it does not parse."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


def headings(html: Column) -> Column:
    """array<struct<level, text>> of the headings, in order."""
    each = F.regexp_extract_all(html, lit(r"(?is)<h([1-6])\b[^>]*>.*?</h\1\s*>"), lit(0))
    return F.transform(each, lambda x: F.struct(F.regexp_extract(x, r"(?i)<h([1-6])", 1).cast("int").alias("level"), F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " ")).alias("text")))


def paragraph_headings(html: Column) -> Column:
    """array<struct<position, hierarchy, context, element>> of the paragraphs, in order.

    hierarchy are the headings that hold there, array<struct<level, text>> from the top
    down; a heading ends deeper ones, and one without text is none. context is the deepest
    heading's text, element the place of the paragraph below the last heading.
    """
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", ""), r"(?U)^\s+|\s+$", "")
    pieces = F.regexp_extract_all(html, lit(r"(?is)<h([1-6])[^>]*>.*?</h\1>|<p[^>]*>.*?</p>"), lit(0))
    head = "array<struct<level: int, text: string>>"
    out = f"array<struct<position: int, hierarchy: {head}, context: string, element: int>>"
    none = lambda t: F.array().cast(t)

    def step(s: Column, x: Column) -> Column:
        level = F.when(F.regexp_extract(x, r"(?i)^<h([1-6])", 1) != "", F.regexp_extract(x, r"(?i)^<h([1-6])", 1)).cast("int")
        text = clean(x)
        kept = F.filter(s["h"], lambda e: e["level"] < level)
        h = F.concat(kept, F.array(F.struct(level.alias("level"), text.alias("text"))))
        row = F.struct(s["n"].alias("position"), s["h"].alias("hierarchy"), F.try_element_at(s["h"], lit(-1))["text"].alias("context"), (s["n"] - s["at"]).alias("element"))
        heading = F.struct(s["n"].alias("n"), s["n"].alias("at"), h.cast(head).alias("h"), s["out"].alias("out"))
        paragraph = F.struct((s["n"] + 1).alias("n"), s["at"].alias("at"), s["h"].alias("h"), F.concat(s["out"], F.array(row)).cast(out).alias("out"))
        return F.when(level.isNull(), paragraph).when(text == "", s).otherwise(heading)

    first = F.struct(lit(0).alias("n"), lit(0).alias("at"), none(head).alias("h"), none(out).alias("out"))
    kind = f"struct<n: int, at: int, h: {head}, out: {out}>"
    return F.aggregate(pieces, first.cast(kind), lambda s, x: step(s, x).cast(kind), lambda s: s["out"])


def table_rows(html: Column) -> Column:
    """array<array<string>> of the cells of all table rows."""
    rows = F.regexp_extract_all(html, lit(r"(?is)<tr\b.*?</tr\s*>"), lit(0))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, lit(r"(?is)<t[dh]\b[^>]*>.*?</t[dh]\s*>"), lit(0)), lambda c: clean(c)))


# Text by which login walls, challenges and cookie banners are known.
PASSWORD_FIELDS = ['type="password"', "type='password'", "type=password"]
LOGIN_FORMS = [
    'id="login', 'class="login', 'name="login', 'id="signin', 'class="signin', 'action="/login', 'action="/signin', 'action="/auth',
    'id="ログイン', 'class="ログイン',
]
LOGIN_TEXT = [
    "please sign in", "please log in", "login required", "sign in required", "authentication required", "you must be logged in", "you need to log in", "please login to continue", "sign in to continue",
    "ログインしてください", "ログインが必要です", "サインインしてください", "会員登録が必要です",
]
LOGIN_TITLES = ["<title>login", "<title>log in", "<title>sign in", "<title>signin", "<title>ログイン", "<title>サインイン"]
CHALLENGES = ["cf-browser-verification", "_cf_chl_opt", "checking your browser before accessing", "please wait while we verify your browser", "ray id:</strong>"]
CAPTCHAS = [
    'src="https://hcaptcha.com', 'src="https://www.hcaptcha.com', "data-sitekey=", 'class="h-captcha"', 'class="g-recaptcha"', 'id="captcha-container"', "grecaptcha.execute", "hcaptcha.execute",
    'class="cf-turnstile"', "challenges.cloudflare.com/turnstile",
]
CONSENT_MARKS = [
    "cookieconsent", "cookie-consent", "cookie_consent", "onetrust", "cookiebot", "cookie-notice", "cookie-banner", "cookie-policy-banner", "gdpr-cookie", "ccpa-notice", "privacy-consent",
    "consent-banner", "consent-dialog", "consent-modal", 'class="cc-', 'id="cc-', 'class="cky-', 'id="cky-',
]
CONSENT_TEXT = [
    "we use cookies", "this site uses cookies", "this website uses cookies", "accept cookies", "accept all cookies", "cookie settings", "cookie preferences", "manage cookies", "customize cookies",
    "reject all cookies", "decline cookies", "gdpr compliance", "privacy preferences", "your privacy choices", "do not sell my personal information",
    "cookieを使用", "クッキーを使用", "cookie設定", "クッキー設定", "すべて許可", "すべて拒否",
]
CONSENT_BUTTONS = ["accept all", "accept cookies", "i agree", "i accept", "got it", "ok, i agree", "agree and proceed", "同意する", "許可する", "受け入れる"]
#: Characters from which on a page with a captcha has it in a form, and with a login title is no login page.
LARGE, LONG = 10_000, 50_000


def any_of(words: list[str]) -> str:
    """A pattern that finds any of the words as they stand."""
    return "|".join(re.sub(r"([.*+?()\[\]{}|^$\\])", r"\\\1", w) for w in words)


def page_state(html: Column) -> Column:
    """'challenge', 'login', 'cookie' or 'content'."""
    low, size = F.lower(html), F.length(html)
    has = lambda words: low.rlike(any_of(words))
    challenge = has(CHALLENGES) | low.contains("just a moment") & (low.contains("cloudflare") | low.contains("_cf_")) | has(CAPTCHAS) & (size < LARGE)
    login = has(PASSWORD_FIELDS) & (has(LOGIN_FORMS) | has(LOGIN_TEXT) | (size < LONG) & has(LOGIN_TITLES))
    return F.when(challenge, "challenge").when(login, "login").when(has(CONSENT_MARKS) | has(CONSENT_TEXT) & has(CONSENT_BUTTONS), "cookie").otherwise("content")


def phrase_repetitions(text: Column, shortest: int = 4, longest: int = 8) -> Column:
    """Distinct phrases of four to eight words that occur twice or more."""

    def repeated(w: Column) -> Column:
        out = lit(0)
        for n in range(shortest, longest + 1):
            out = out + let(F.array_sort(ngrams(w, n)), lambda g: F.size(F.array_distinct(F.filter(g, lambda x, i: (i > 0) & (F.get(g, F.greatest(i - 1, lit(0))) == x)))))
        return out

    return let(blank_words(F.lower(text)), repeated)


# Domain parts by extraction tier.
AUTHORITATIVE = [
    "go.jp", "gov.uk", "gov", "gouv.fr", "bund.de",
    "edu", "ac.jp", "ac.uk", "edu.cn",
    "iso.org", "ietf.org", "w3.org",
    "who.int", "un.org", "oecd.org",
    "arxiv.org", "pubmed.gov", "jstage.jst.go.jp", "doi.org",
]
REPUTABLE = [
    "org", "noaa.gov", "nasa.gov", "nih.gov",
    "reuters.com", "apnews.com", "bbc.com", "bbc.co.uk", "nytimes.com", "theguardian.com", "nature.com", "sciencemag.org", "scientificamerican.com",
    "ieee.org", "acm.org",
    "snopes.com", "factcheck.org", "politifact.com",
]


def holds(host: Column, parts: list[str]) -> Column:
    """Whether any of the parts stands anywhere in the host."""
    return host.rlike("|".join(p.replace(".", r"\.") for p in parts))


def primary_source(url: Column) -> Column:
    """Whether a URL's host is an authoritative one."""
    return F.coalesce(holds(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), AUTHORITATIVE), lit(False))


def extraction_tier(host: Column, scope: str) -> Column:
    """1 authoritative, 2 reputable, 3 general, 0 out of scope; parts match anywhere in the host."""
    low = F.lower(host)
    out = F.when(holds(low, AUTHORITATIVE), 1)
    if scope in ("reputable", "all"):
        out = out.when(holds(low, REPUTABLE), 2)
    return out.otherwise(3 if scope == "all" else 0)


def line_diff(old: Column, new: Column) -> Column:
    """struct<added, removed, word_delta> between two texts by their lines."""
    a, b = F.split(F.coalesce(old, lit("")), "\n"), F.split(F.coalesce(new, lit("")), "\n")
    return F.struct(F.size(F.array_except(b, a)).alias("added"), F.size(F.array_except(a, b)).alias("removed"), (F.size(blank_words(F.coalesce(new, lit("")))) - F.size(blank_words(F.coalesce(old, lit(""))))).alias("word_delta"))


# The shapes of dates.
DATES = [
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"\d{1,2}[-/]\d{1,2}[-/]\d{4}",
    r"\d{4}年\d{1,2}月\d{1,2}日",
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}",
]


def dates_in(text: Column) -> Column:
    """Distinct dates of all shapes, sorted; shapes are sought one by one."""
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(text, lit("(?i)" + p), lit(0)) for p in DATES])))


def entity_kind(text: Column) -> Column:
    """Kind of a named entity by its shape."""
    return (
        F.when(text.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$"), "email").when(text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(text.rlike(r"^([a-z0-9-]+\.)+[a-z]{2,}$"), "domain").when(text.rlike(r"(?i)\b(inc|corp|ltd|llc|gmbh|university|institute)\b\.?"), "organization")
        .when(text.rlike(r"^[A-Z][a-z]+( [A-Z][a-z]*\.?)* [A-Z][a-z]+$"), "person").otherwise("unknown")
    )


def valid_target(kind: Column, value: Column) -> Column:
    """Whether a queue target is well formed: a URL with a host, a DOI, or a query of text."""
    return F.when(kind == "url", value.rlike(r"^https?://[^/\s]+\S*$")).when(kind == "doi", value.rlike(r"^10\.\d{4,}/\S+$")).when(kind == "query", F.length(F.trim(value)) > 0).otherwise(lit(False))


def step_parameter(value: Column, success: Column, step: float = 0.1, low: float = 0.1, high: float = 1.0) -> Column:
    """A policy parameter after one adjustment: down under half success, up over nine tenths, within its bounds."""
    moved = F.when(success < 0.5, value - step).when(success > 0.9, value + step).otherwise(value)
    return F.round(F.least(lit(high), F.greatest(lit(low), moved)), 9)
