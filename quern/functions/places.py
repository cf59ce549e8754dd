"""Columns over postal addresses and names of drug classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

lit = F.lit

# Names of countries by code, in the order they are sought; prefectures; shapes of postal codes.
COUNTRIES = {
    "jp": ["japan", "日本", "jpn"],
    "us": ["united states", "usa", "u.s.a.", "united states of america", "アメリカ", "米国"],
    "uk": ["united kingdom", "great britain", "england", "gb", "イギリス", "英国"],
    "cn": ["china", "中国", "prc", "people's republic of china", "中华人民共和国"],
    "kr": ["korea", "south korea", "韓国", "大韓民国", "rok", "republic of korea"],
    "de": ["germany", "deutschland", "ドイツ"],
    "fr": ["france", "フランス"],
    "au": ["australia", "オーストラリア"],
    "ca": ["canada", "カナダ"],
    "sg": ["singapore", "シンガポール"],
    "hk": ["hong kong", "香港"],
    "tw": ["taiwan", "台湾", "中華民国"],
}
PREFECTURES = {"東京都": "tokyo", "大阪府": "osaka", "京都府": "kyoto", "北海道": "hokkaido"}
POSTAL = [r"〒?(\d{3}-?\d{4})", r"\b(\d{5}(?:-\d{4})?)\b", r"\b([A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})\b", r"\b(\d{4,6})\b"]


def first_of(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for c in cases[1:]:
        out = out.when(*c)
    return out


def address_parts(address: Column, hint: Column) -> Column:
    """struct<country, region, postal_code, normalized> of an address; a hint names the country, by code or name."""
    a = F.regexp_replace(F.trim(address), r"\s+", " ")
    low, h = F.lower(a), F.lower(F.trim(hint))
    named = F.coalesce(first_of([(h.isin(k, *v), lit(k)) for k, v in COUNTRIES.items()]), F.when(h.rlike("^[a-z]{2}$"), h))
    found = first_of([(F.greatest(*[low.contains(x) for x in v]), lit(k)) for k, v in COUNTRIES.items()])
    country = F.when(F.length(hint) > 0, named).otherwise(found)
    hit = lambda p: F.regexp_extract(a, "(?i)" + p, 1)
    postal = first_of([(hit(p) != "", hit(p)) for p in POSTAL])
    region = F.when(country == "jp", first_of([(a.contains(k), lit(v)) for k, v in PREFECTURES.items()]))
    parts = F.concat_ws(", ", region, postal, F.upper(country))
    return F.struct(country.alias("country"), region.alias("region"), postal.alias("postal_code"), F.when(parts != "", parts).otherwise(a).alias("normalized"))


def drug_class(hypothesis: Column) -> Column:
    """struct<name, short> of the drug or class that a hypothesis is about; else of its beginning."""
    hit = lambda p: F.regexp_extract(hypothesis, "(?i)" + p, 1)
    bare = lambda c: F.replace(c, lit("-"), lit(""))
    inhibitor, agonist = hit(r"\b(DPP-?4|SGLT-?2|ACE|ARB|PDE-?5)\s*inhibitors?\b"), hit(r"\b(GLP-?1)\s*(?:receptor\s*)?agonists?\b")
    generic, first = hit(r"\b([A-Z][a-z]+(?:metformin|gliptin|flozin|glutide|tide))\b"), hit(r"^([A-Z][A-Za-z0-9\-]+(?:\s+[a-z]+)?)")
    title = F.concat(F.upper(F.substring(generic, 1, 1)), F.lower(F.substring(generic, 2, 200)))
    start = F.trim(F.substring(hypothesis, 1, 20))
    pair = lambda a, b: F.struct(a.alias("name"), b.alias("short"))
    return (
        F.when(inhibitor != "", pair(F.concat(F.upper(inhibitor), lit(" Inhibitors")), F.concat(bare(inhibitor), lit("i"))))
        .when(agonist != "", pair(F.concat(F.upper(agonist), lit(" Receptor Agonists")), F.concat(bare(agonist), lit("RA"))))
        .when(generic != "", pair(title, F.substring(generic, 1, 8)))
        .when(first != "", pair(first, F.substring(first, 1, 8)))
        .otherwise(pair(start, F.substring(start, 1, 8)))
    )
