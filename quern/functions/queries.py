"""Columns over search queries: operators, how an engine writes them, templates that suit a hypothesis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

lit = F.lit

# Operators in the order they are taken out of a query, and how engines write them; what has no form there is left out.
PATTERNS = {
    "site": r"\bsite:([^\s]+)",
    "filetype": r"\bfiletype:(\w+)",
    "intitle": r'\bintitle:("[^"]+"|[^\s]+)',
    "date_after": r"\bafter:(\d{4}(?:-\d{2}(?:-\d{2})?)?)",
    "exact": r'"([^"]+)"',
    "exclude": r"(?<![:\w])-([a-zA-Z぀-鿿][^\s]*)",
    "required": r"(?<![:\w])\+([a-zA-Z぀-鿿][^\s]*)",
}
FORMS = {"site": "site:{}", "filetype": "filetype:{}", "intitle": "intitle:{}", "date_after": None, "exact": '"{}"', "exclude": "-{}", "required": "+{}"}
ENGINE_FORMS = {("google", "date_after"): "after:{}"}
# Words of a hypothesis that call for a template, and each template's operators and engines.
TEMPLATE_WORDS = {
    "academic": ["研究", "論文", "学術", "研究", "paper", "study", "research", "journal"],
    "government": ["政府", "省", "庁", "官", "法律", "規制", "government", "regulation", "policy"],
    "corporate": ["会社", "企業", "株式", "IR", "決算", "業績", "company", "corporation"],
    "technical": ["技術", "仕様", "規格", "プロトコル", "API", "specification", "protocol", "standard"],
    "news": ["ニュース", "報道", "最新", "news", "latest", "recent"],
}
TEMPLATES = {
    "academic": (["site:arxiv.org", "site:pubmed.gov", "filetype:pdf", "site:jstage.jst.go.jp"], ["duckduckgo", "qwant"]),
    "government": (["site:go.jp", "site:gov.uk", "site:who.int", "filetype:pdf"], ["duckduckgo", "qwant", "mojeek"]),
    "corporate": (["site:edinet-fsa.go.jp", "IR", "有価証券報告書", "プレスリリース"], ["duckduckgo", "qwant"]),
    "technical": (["filetype:pdf", "specification", "RFC", "仕様書"], ["duckduckgo", "mojeek"]),
    "news": (["after:2024-01-01", "ニュース", "報道"], ["duckduckgo", "qwant"]),
}
NOTES = {
    "organization": "組織名が検出されました。IR情報や公式サイトの検索が有効です。",
    "location": "地名が検出されました。地域特化の検索が有効です。",
    "academic": "学術検索が推奨されます（site:arxiv.org, site:jstage.jst.go.jp等）。",
    "government": "政府系サイト検索が推奨されます（site:go.jp等）。",
}
NO_NOTE = "特記事項なし"


def _typed(kind: str):
    return lambda v: F.struct(lit(kind).alias("type"), v.alias("value"))


def parse_operators(q: Column) -> Column:
    """struct<base, operators: array<struct<type, value>>> of a query: kind by kind, the last of a kind first."""
    rest, found = F.coalesce(q, lit("")), []
    for kind, p in PATTERNS.items():
        p = "(?iU)" + p
        values = F.regexp_extract_all(rest, lit(p), lit(1))
        if kind == "intitle":
            values = F.transform(values, lambda v: F.regexp_replace(v, r'^"([^"]+)"$', "$1"))
        found.append(F.reverse(F.transform(values, _typed(kind))))
        rest = F.regexp_replace(rest, p, "")
    base = F.trim(F.regexp_replace(rest, r"(?U)\s+", " "))
    return F.struct(base.alias("base"), F.concat(*found).alias("operators"))


def write_query(parsed: Column, engine: str = "default") -> Column:
    """A parsed query as an engine writes it; operators that it lacks are left out."""
    forms = {k: ENGINE_FORMS.get((engine.lower(), k)) or f for k, f in FORMS.items()}

    def form(o: Column) -> Column:
        c = lit(None).cast("string")
        for k, f in forms.items():
            if f:
                c = F.when(o["type"] == k, F.concat(lit(f.split("{}")[0]), o["value"], lit(f.split("{}")[1]))).otherwise(c)
        return c

    parts = F.concat(F.filter(F.array(parsed["base"]), lambda b: b != ""), F.array_compact(F.transform(parsed["operators"], form)))
    return F.array_join(parts, " ")


def build_query(base: Column, operators: dict[str, Column], engine: str = "default") -> Column:
    """A query of base words and operators given as columns, in the order named; empty ones are left out. Lists give one each."""
    given = []
    for k, c in operators.items():
        given.append(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: v != ""), _typed(k)))
    return write_query(F.struct(F.coalesce(base, lit("")).alias("base"), F.concat(*given).alias("operators")), engine)


def supported_operators(engine: str) -> list[str]:
    return [k for k, f in FORMS.items() if f or ENGINE_FORMS.get((engine.lower(), k))]


def templates_for(hypothesis: Column) -> Column:
    """array<string> of the templates whose words the lower-cased hypothesis holds; academic and government where none does."""
    t = F.lower(F.coalesce(hypothesis, lit("")))
    has = lambda ws: F.greatest(*[t.contains(w) for w in ws])
    found = F.array_compact(F.array(*[F.when(has(ws), n) for n, ws in TEMPLATE_WORDS.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(lit("academic"), lit("government")))


def template_hints(templates: Column) -> Column:
    """array<string> of the operators that the templates suggest, in their order, each once."""
    m = F.create_map(*[x for n, (ops, _) in TEMPLATES.items() for x in (lit(n), F.array(*[lit(o) for o in ops]))])
    return F.array_distinct(F.flatten(F.transform(templates, lambda n: m[n])))


def notes_for(kinds: Column, templates: Column) -> Column:
    """Notes on kinds of entities found and on templates."""
    said = F.array_compact(F.array(*[F.when(F.array_contains(kinds if k in ("organization", "location") else templates, k), n) for k, n in NOTES.items()]))
    return F.when(F.size(said) > 0, F.array_join(said, " ")).otherwise(lit(NO_NOTE))
