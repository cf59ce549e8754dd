"""Registered queries: features and types of pages."""

from __future__ import annotations

from quern.operators import page_types as pt
from quern.sources.graph import table

from .registry import query


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(xs: list[str]) -> str:
    return ", ".join(quoted(x) for x in xs)


def matches(c: str, patterns: list[str]) -> str:
    return f"regexp_matches({c}, {quoted(pt.any_of(patterns))})"


def total(t: str) -> str:
    words, w = pt.HINT_WORDS[t]
    parts = [f"CASE WHEN len(list_filter(url_hints, lambda h: {matches('h', words)})) > 0 THEN {w}::DOUBLE ELSE 0::DOUBLE END"]
    parts += [f"CASE WHEN {c} THEN {x}::DOUBLE ELSE 0::DOUBLE END" for c, x in pt.WEIGHTS[t]]
    return f"greatest({' + '.join(parts)}, {pt.FLOOR}::DOUBLE)"


def said(t: str) -> str:
    def one(c, text, value=None):
        value = "format('{:.2f}', link_density)" if value and value.startswith("format") else value
        return f"CASE WHEN {c} THEN {quoted(text) if value is None else f'replace({quoted(text)}, {quoted('{n}')}, ({value})::VARCHAR)'} END"

    return f"WHEN '{t}' THEN [" + ", ".join(one(*r) for r in pt.REASONS[t]) + "]"


BEST = "CASE best " + " ".join(f"WHEN {t}_score THEN '{t}'" for t in pt.WEIGHTS) + " END"
SUM = " + ".join(f"{t}_score" for t in pt.WEIGHTS)
FEATURES = f"""
WITH a AS (SELECT page_id, coalesce(html, '') AS h, lower(coalesce(html, '')) AS l, coalesce(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]+)', 1)), '') AS host, coalesce(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)), '') AS path FROM pages),
b AS (SELECT *, length(trim(regexp_replace(regexp_replace(h, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))) AS t, coalesce(list_sum(list_transform(regexp_extract_all(h, '(?is)<a[^>]*>(.*?)</a>', 1), lambda x: length(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g')))), 0) AS k FROM a),
f AS (SELECT page_id, {", ".join(f"{matches('l', p)} AS {n}" for n, p in pt.FLAGS.items() if n != "has_charts")},
{matches("l", pt.FLAGS["has_charts"])} OR len(regexp_extract_all(l, {quoted(pt.COUNTS["table_count"])})) >= 3 AS has_charts_tables,
{", ".join(f"len(regexp_extract_all(l, {quoted(p)})) AS {n}" for n, p in pt.COUNTS.items() if n != "table_count")},
CASE WHEN length(h) > 0 THEN t::DOUBLE / length(h) ELSE 0 END AS text_to_html_ratio, CASE WHEN t > 0 THEN k::DOUBLE / t ELSE 0 END AS link_density,
nullif(regexp_extract(l, {quoted(pt.OG_TYPE)}, 1), '') AS og_type,
list_concat(list_concat(list_filter([{", ".join(f"CASE WHEN {matches('host || path', p)} THEN '{t}' END" for t, p in pt.URL_PATTERNS.items())}], lambda x: x IS NOT NULL),
list_filter(string_split(path, '/'), lambda s: s IN ({listed(pt.SEGMENTS)}))), CASE WHEN split_part(host, '.', 1) IN ({listed(pt.SUBDOMAINS)}) THEN [split_part(host, '.', 1)] ELSE [] END) AS url_hints FROM b)"""
TYPES = f"""{FEATURES},
s AS (SELECT *, {", ".join(f"{total(t)} AS {t}_score" for t in pt.WEIGHTS)} FROM f),
m AS (SELECT *, greatest({", ".join(f"{t}_score" for t in pt.WEIGHTS)}) AS best, {SUM} AS total FROM s),
n AS (SELECT *, CASE WHEN best > {pt.LEAST}::DOUBLE THEN {BEST} ELSE 'other' END AS page_type FROM m),
o AS (SELECT *, list_concat(list_filter(CASE page_type {" ".join(said(t) for t in pt.REASONS)} END, lambda x: x IS NOT NULL), CASE WHEN len(url_hints) > 0 THEN ['URL hints: ' || array_to_string(url_hints[1:3], ', ')] ELSE [] END) AS r FROM n)
SELECT page_id, page_type, CASE WHEN page_type = 'other' THEN 1.0::DOUBLE ELSE best END AS score, CASE WHEN page_type = 'other' THEN 1.0::DOUBLE ELSE round(best / total, 9) END AS confidence, CASE WHEN len(r) = 0 THEN 'default classification' ELSE array_to_string(r, '; ') END AS reason FROM o"""


@query("H7_page_features", FEATURES + " SELECT * FROM f")
def h7(spark, sf_dir):
    return pt.page_features(table(spark, sf_dir, "pages"))


@query("H8_page_type", TYPES)
def h8(spark, sf_dir):
    return pt.classify(pt.page_features(table(spark, sf_dir, "pages")))
