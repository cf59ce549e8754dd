"""Columns that identify papers, people, organisations and network names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

lit = F.lit


def title_key(title: Column) -> Column:
    """Lower-cased title without punctuation, articles and repeated blanks."""
    t = F.regexp_replace(F.lower(F.coalesce(title, lit(""))), r"[^\p{L}\p{N}_]+", " ")
    return F.array_join(F.filter(F.split(t, " "), lambda w: ~w.isin("", "the", "a", "an")), " ")


def surname(author: Column) -> Column:
    """Lower-cased surname of 'First Last' or 'Last, First'; null for no name."""
    name = F.trim(author)
    last = F.when(name.contains(","), F.trim(F.split(name, ",")[0])).otherwise(F.element_at(F.split(name, r"\s+"), -1))
    return F.when(F.length(name) > 0, F.lower(last))


def paper_id(doi: Column, title: Column, first_author: Column, year: Column) -> Column:
    """DOI, else a digest of title, surname and year, else of the title; null without any."""
    key, who = title_key(title), surname(first_author)
    digest = lambda p, x: F.concat(lit(p + ":"), F.substring(F.md5(x), 1, 12))
    meta = F.when((key != "") & who.isNotNull() & year.isNotNull(), digest("meta", F.concat_ws("|", key, who, year.cast("string"))))
    return F.coalesce(F.when(F.length(doi) > 0, F.concat(lit("doi:"), F.trim(F.lower(doi)))), meta, F.when(key != "", digest("title", key)))


def network_domain(value: Column) -> Column:
    """Lower-cased host name without scheme, path, port and final dots."""
    d = F.regexp_replace(F.lower(F.trim(value)), r"\.+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(d, r"^[^/]*://", ""), r"/.*$", ""), r":.*$", "")


def email(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.contains("@"), F.concat(F.regexp_extract(v, r"^(.*)@", 1), lit("@"), network_domain(F.regexp_extract(v, r"@([^@]*)$", 1)))).otherwise(v)


def phone(value: Column, country: Column) -> Column:
    """Digits and a leading plus; Japanese numbers take their country code."""
    d = F.regexp_replace(value, r"[^0-9+]", "")
    jp = F.concat(lit("+81"), F.regexp_replace(d, "^0", ""))
    return F.when(d.startswith("+"), d).when((country == "jp") & ~d.startswith("81"), jp).otherwise(d)


def ip(value: Column) -> Column:
    """IPv4 without leading zeros, IPv6 lower-cased."""
    v = F.trim(value)
    return F.when(v.contains(".") & ~v.contains(":"), F.regexp_replace(v, r"(^|\.)0+(?=\d)", "$1")).otherwise(F.lower(v))


# Legal forms at the end of organisation names, by their short form.
LEGAL_FORMS = {"inc": "INC", "incorporated": "INC", "corp": "CORP", "corporation": "CORP", "ltd": "LTD", "limited": "LTD", "llc": "LLC", "gmbh": "GMBH", "ag": "AG", "sa": "SA", "plc": "PLC", "kk": "KK"}


def name_parts(name: Column) -> Column:
    """struct<canonical, legal_form, tokens> of an organisation name."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}\s]", " "), r"\s+", " ")), " ")
    forms = F.create_map(*[x for k, v in LEGAL_FORMS.items() for x in (lit(k), lit(v))])
    form = F.when(F.size(words) > 1, forms[F.element_at(words, -1)])
    core = F.when(form.isNotNull(), F.slice(words, lit(1), F.size(words) - 1)).otherwise(words)
    return F.struct(F.array_join(core, " ").alias("canonical"), form.alias("legal_form"), F.array_distinct(core).alias("tokens"))


# Legal forms as they end, or stand in, a name, and as they begin one; in the order they are sought.
SUFFIX_FORMS = {
    "corporation": "corp", "corp.": "corp", "corp": "corp", "incorporated": "inc", "inc.": "inc", "inc": "inc", "limited": "ltd", "ltd.": "ltd", "ltd": "ltd", "company": "co", "co.": "co", "co": "co",
    "llc": "llc", "l.l.c.": "llc", "plc": "plc", "p.l.c.": "plc", "gmbh": "gmbh", "ag": "ag", "s.a.": "sa", "n.v.": "nv", "b.v.": "bv", "pty": "pty", "pty.": "pty",
    "株式会社": "KK", "有限会社": "YK", "合同会社": "GK", "合資会社": "GS", "合名会社": "GM", "(株)": "KK", "（株）": "KK", "(有)": "YK", "（有）": "YK",
}
PREFIX_FORMS = {"(株)": "KK", "（株）": "KK", "(有)": "YK", "（有）": "YK", "株式会社": "KK", "有限会社": "YK", "合同会社": "GK", "合資会社": "GS", "合名会社": "GM"}


def half_width(text: Column) -> Column:
    """Full-width ASCII and the ideographic space as plain characters."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
    return F.translate(text, wide, "".join(chr(c) for c in range(0x21, 0x7F)) + " ")


def normalised_name(name: Column, organisation: bool = True) -> Column:
    """struct<normalized, canonical, tokens, legal_form, language> of a name; a missing name counts as empty.

    White space is made single and full-width ASCII plain. Of an organisation, the first
    form that begins the name is taken off, else the first that stands in it as a word;
    canonical is lower-cased without marks, its form behind it.
    """
    raw = F.regexp_replace(F.coalesce(name, lit("")), r"(?U)^\s+|\s+$", "")
    plain = half_width(F.regexp_replace(raw, r"(?U)\s+", " "))
    form, rest = lit(None).cast("string"), plain
    if organisation:
        tried = [(r"^\Q" + p + r"\E(?=.)", f, "") for p, f in PREFIX_FORMS.items()] + [(r"(?i)(?:^|\s)\Q" + p + r"\E\.?(?:\s|$)", f, " ") for p, f in SUFFIX_FORMS.items()]
        for p, f, by in reversed(tried):
            hit = plain.rlike(p)
            form, rest = F.when(hit, f).otherwise(form), F.when(hit, F.trim(F.regexp_replace(plain, p, by))).otherwise(rest)
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(rest), r"(?U)[^\w\s\-']", " "), r"(?U)\s+", " "))
    canonical = F.when(form.isNotNull(), F.concat(bare, lit(" "), form)).otherwise(bare)
    tokens = F.filter(F.split(canonical, r"[\s\-]+"), lambda t: t != "")
    language = F.when(raw.rlike("[\u3040-\u309F\u30A0-\u30FF\u4E00-\u9FFF]"), "ja").when(raw.rlike("[\uAC00-\uD7AF\u1100-\u11FF]"), "ko").when(raw.rlike("[a-zA-Z]"), "en")
    return F.struct(rest.alias("normalized"), canonical.alias("canonical"), tokens.alias("tokens"), form.alias("legal_form"), language.alias("language"))


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the tokens of two name_parts, a tenth more for the same legal form, at most 1."""
    both = F.size(F.array_intersect(a["tokens"], b["tokens"]))
    j = both / (F.size(a["tokens"]) + F.size(b["tokens"]) - both)
    return F.least(lit(1.0), j + F.when(a["legal_form"] == b["legal_form"], lit(0.1)).otherwise(lit(0.0)))


def source_quality(url: Column, host: Column, source_api: Column, doi: Column, author: Column, year: Column, venue: Column) -> Column:
    """Additive quality of a citation; -100 for wikis, patents and press releases."""
    u, h = F.lower(url), F.lower(host)
    out = u.contains("/wiki/") | u.contains("/patent/") | u.contains("/patents/") | u.contains("/news-release") | u.contains("/press-release")
    ends = lambda *xs: F.coalesce(sum((h.endswith(x).cast("int") for x in xs[1:]), h.endswith(xs[0]).cast("int")) > 0, lit(False))
    has = lambda c: (c.isNotNull() & (c.cast("string") != "")).cast("int")
    none = author.isNull() & year.isNull() & venue.isNull() & (has(doi) == 0)
    kind = F.when(F.coalesce(source_api.isin("semantic_scholar", "openalex"), lit(False)), 3).when(has(doi) == 1, 2).when(ends(".gov", ".go.jp", ".edu", ".ac.jp", ".ac.uk"), 2).when(none, -2).otherwise(0)
    return F.when(F.coalesce(out, lit(False)), -100).otherwise(kind + 3 * has(doi) + has(author) + has(year) + has(venue))


# Base priorities of links by their place, and boosts of words in their text.
LINK_BASE = {"heading": 0.9, "toc": 0.85, "related": 0.8, "body": 0.6, "sidebar": 0.4, "navigation": 0.3, "pagination": 0.2, "unknown": 0.5}
LINK_WORDS = [(0.1, ["詳細", "detail", "more", "続き", "全文"]), (0.1, ["資料", "document", "report", "paper"]), (0.15, ["公式", "official", "原文", "source"])]


def link_priority(kind: Column, text: Column) -> Column:
    base = F.create_map(*[x for k, v in LINK_BASE.items() for x in (lit(k), lit(v))])
    t = F.lower(text)
    out = F.coalesce(base[kind], lit(0.5))
    for boost, words in LINK_WORDS:
        out = out + F.when(t.rlike("|".join(words)), lit(boost)).otherwise(lit(0.0))
    return F.least(lit(1.0), out)


def score_0_10(text: Column) -> Column:
    """The first integer of a text, within 0 and 10."""
    n = F.regexp_extract(F.trim(text), r"(\d+)", 1)
    return F.when(n != "", F.least(lit(10), F.substring(n, 1, 4).cast("int")))


def yes_no(text: Column) -> Column:
    t = F.regexp_replace(F.upper(F.trim(text)), "[^A-Z]", "")
    return F.when(t.startswith("YES"), "YES").when(t.startswith("NO"), "NO")


def mask_secrets(text: Column) -> Column:
    """Text with e-mail addresses, keys and long digit runs masked."""
    t = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    t = F.regexp_replace(t, r"(?i)\b(api[_-]?key|token|secret|password)\s*[=:]\s*\S+", "$1=[masked]")
    return F.regexp_replace(t, r"\b\d{12,19}\b", "[number]")


def search_operators(q: Column) -> Column:
    """struct<site, filetype, exact, excluded, rest> of a search query with operators."""
    one = lambda p: F.when(F.regexp_extract(q, p, 1) != "", F.regexp_extract(q, p, 1))
    rest = F.trim(F.regexp_replace(F.regexp_replace(q, r"""(site|filetype|intitle):\S+|"[^"]*"|(^|\s)-\S+""", " "), r"\s+", " "))
    return F.struct(one(r"site:(\S+)").alias("site"), one(r"filetype:(\S+)").alias("filetype"), F.regexp_extract_all(q, lit('"([^"]*)"'), lit(1)).alias("exact"), F.regexp_extract_all(q, lit(r"(?:^|\s)-(\S+)"), lit(1)).alias("excluded"), rest.alias("rest"))
