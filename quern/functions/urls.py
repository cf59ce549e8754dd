"""Columns about URLs and scholarly identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers in URLs, and host parts by kind of source.
IDENTIFIERS = {
    "doi": r"(?i)doi\.org/(10\.\d{4,}/[^\s?#]+)",
    "pmid": r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d+)",
    "pmcid": r"(?i)pmc\.ncbi\.nlm\.nih\.gov/articles/(PMC\d+)",
    "arxiv": r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})",
    "openalex": r"(?i)openalex\.org/(W\d+)",
    "s2": r"(?i)semanticscholar\.org/paper/[^/]+/([a-f0-9]{40})",
    "jstage": r"(?i)jstage\.jst\.go\.jp/.*/(10\.\d+/[^/?#]+)",
    "nature": r"(?i)nature\.com/articles/(s\d+-\d+-\d+-\w+)",
    "sciencedirect": r"(?i)sciencedirect\.com/science/article/pii/([A-Z0-9]+)",
}
SOURCE_TAGS = {
    "academic": ["arxiv.org", "pubmed", "ncbi.nlm.nih.gov", "jstage.jst.go.jp", "cir.nii.ac.jp", "scholar.google", "researchgate.net", "academia.edu", "sciencedirect.com", "springer.com"],
    "government": [".gov", ".go.jp", ".gov.uk", ".gouv.fr", ".gov.au"],
    "standards": ["iso.org", "ietf.org", "w3.org", "iana.org", "ieee.org"],
    "knowledge": ["wikipedia.org", "wikidata.org"],
    "news": ["reuters.com", "bbc.com", "nytimes.com", "theguardian.com", "nhk.or.jp", "asahi.com", "nikkei.com"],
    "technical": ["github.com", "gitlab.com", "stackoverflow.com", "docs.", "developer.", "documentation"],
    "blog": ["blog", "medium.com", "note.com", "qiita.com", "zenn.dev"],
}
CATEGORY_WEIGHTS = {"primary": 1.0, "government": 0.95, "academic": 0.90, "trusted": 0.75, "low": 0.40, "unverified": 0.30, "blocked": 0.0}


def _extract(c: Column, pattern: str) -> Column:
    got = F.regexp_extract(c, pattern, 1)
    return F.when(got != "", got)


def netloc(url: Column) -> Column:
    """Lower-cased host with its port, as written; null without one."""
    return F.lower(_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]+)"))


def domain(url: Column) -> Column:
    """Lower-cased host without user and port."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", "")


def normalise(url: Column) -> Column:
    """Scheme and host lower-cased, query parameters sorted, fragment dropped."""
    base = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?]*)", 1))
    rest = F.substring(base, F.length(head) + 1, F.lit(1 << 30))
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    return F.concat(head, path, F.when(query != "", F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))).otherwise(""))


def identifiers(url: Column) -> dict[str, Column]:
    return {k: _extract(url, p) for k, p in IDENTIFIERS.items()}


def canonical_id(url: Column) -> Column:
    """The best identifier in a URL, else a digest of the URL."""
    i = identifiers(url)
    tag = lambda name, c: F.concat(F.lit(name + ":"), c)
    parts = [tag("doi", F.trim(F.lower(i["doi"]))), *[tag(k, i[k]) for k in ("pmid", "pmcid", "arxiv", "openalex", "s2")], tag("url", F.substring(F.md5(url), 1, 12))]
    return F.coalesce(*parts)


def doi_in_text(text: Column) -> Column:
    """The first DOI in a text, lower-cased, without trailing punctuation."""
    got = F.lower(F.regexp_replace(F.regexp_extract(text, r"""(10\.\d{4,}/[^\s<>"']+)""", 1), r"[.,;:)\]]+$", ""))
    return F.when(got != "", got)


def source_tag(url: Column) -> Column:
    """Kind of source by the first matching part, in the order of SOURCE_TAGS."""
    low = F.lower(url)
    out = F.lit("unknown")
    for tag, parts in reversed(SOURCE_TAGS.items()):
        cond = F.lit(False)
        for p in parts:
            cond = cond | low.contains(p)
        out = F.when(cond, tag).otherwise(out)
    return out


def category_weight(category: Column, url: Column) -> Column:
    """Ranking weight of a domain category; 1 without a URL, the lowest verified otherwise unknown."""
    w = F.create_map(*[x for k, v in CATEGORY_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(url.isNull(), F.lit(1.0)).otherwise(F.coalesce(w[category], F.lit(CATEGORY_WEIGHTS["unverified"])))


def domain_matches(host: Column, pattern: Column) -> Column:
    """Exact, `*.suffix` or suffix match of a host, as rule tables write them."""
    bare = F.regexp_replace(pattern, r"^\*\.", "")
    return (host == bare) | host.endswith(F.concat(F.lit("."), bare))
