"""Types of web pages: flags and counts of their markup, additive scores, the best type with its share and reason; all in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import urls as ur

col, lit = F.col, F.lit

CLASS = r"""class=["'][^"']*"""
ID = r"""id=["']"""
HEADING = r"<h[1-6][^>]*>"

# What in the lower-cased markup raises each flag.
FLAGS = {
    "has_article_tag": ["<article"],
    "has_main_tag": ["<main"],
    "has_nav_tag": ["<nav"],
    "has_aside_tag": ["<aside"],
    "has_comments_section": [ID + r"""comments["']""", CLASS + "comment", CLASS + "disqus", "<div[^>]*data-comments"],
    "has_breadcrumb": [CLASS + "breadcrumb", r"""aria-label=["']breadcrumb""", CLASS + "パンくず"],
    "has_pagination": [CLASS + "pagination", CLASS + "pager", CLASS + "page-numbers", r"""aria-label=["']pagination""", r"""rel=["']next["']""", r"""rel=["']prev["']"""],
    "has_date": ["<time[^>]*datetime", CLASS + "date", CLASS + "published", r"""property=["']article:published_time"""],
    "has_author": [CLASS + "author", CLASS + "byline", r"""itemprop=["']author""", r"""rel=["']author""", r"""property=["']article:author"""],
    "has_category": [CLASS + "category", CLASS + "tag", r"""rel=["']tag""", r"""property=["']article:tag"""],
    "has_login_form": ["<form[^>]*login", "<form[^>]*signin", "<form[^>]*auth", ID + "login", CLASS + "login-form"],
    "has_password_field": [r'type="password"', "type='password'"],
    "has_paywall_indicator": [CLASS + "paywall", CLASS + "subscribe", CLASS + "premium", CLASS + "members-only", "data-paywall", "登録が必要", "有料会員"],
    "has_reply_form": ["<form[^>]*reply", "<form[^>]*comment", ID + "reply", CLASS + "reply-form", CLASS + "comment-form", "<textarea[^>]*comment"],
    "has_vote_buttons": [CLASS + "vote", CLASS + "upvote", CLASS + "downvote", CLASS + "like-button", CLASS + "rating", r"""aria-label=["'][^"']*vote"""],
    "has_user_avatars": [CLASS + "avatar", CLASS + "user-icon", CLASS + "profile-pic", CLASS + "user-image"],
    "has_thread_structure": [CLASS + "thread", CLASS + "post-list", CLASS + "comment-thread", CLASS + "nested-comment", CLASS + "reply-list"],
    "has_toc": [CLASS + "toc", CLASS + "table-of-contents", ID + r"""toc["']""", ID + "table-of-contents", CLASS + "mw-toc", "目次"],
    "has_wiki_structure": [CLASS + "mw-", CLASS + "wiki", ID + "mw-", CLASS + "wikitable"],
    "has_edit_links": [CLASS + "edit-?section", CLASS + "mw-editsection", CLASS + "edit-link", r"""title=["'][^"']*edit""", ">編集<", "action=edit", r"\[edit\]"],
    "has_infobox": [CLASS + "infobox", CLASS + "sidebar", CLASS + "factbox", CLASS + "summary-box"],
    "has_abstract": [CLASS + "abstract", ID + "abstract", HEADING + "abstract</h", HEADING + "要旨</h", HEADING + "概要</h"],
    "has_citations": [CLASS + "citation", CLASS + "reference", ID + "references", HEADING + "references</h", HEADING + "参考文献</h", HEADING + "引用</h"],
    "has_doi": [r"doi\.org/", r"doi:\s*10\.", CLASS + "doi", r"""10\.\d{4,}/[^\s"'<>]+"""],
    "has_academic_structure": [CLASS + "author-affiliation", CLASS + "journal", CLASS + "volume", "issn|isbn", "peer-review", "<meta[^>]*citation"],
    "has_executive_summary": [CLASS + "executive-summary", HEADING + "executive summary</h", HEADING + "エグゼクティブサマリー</h", HEADING + "要約</h"],
    "has_financial_data": [CLASS + "financial", CLASS + "revenue", CLASS + "earnings", "決算|売上|利益|財務", r"quarter|fiscal|fy\d{2,4}"],
    "has_charts": [CLASS + "chart", CLASS + "graph", "<canvas"],
    "has_report_structure": [CLASS + "report", CLASS + "whitepaper", CLASS + "disclosure", "有価証券報告書|決算短信|年次報告"],
    "has_legal_structure": [CLASS + "statute", CLASS + "regulation", CLASS + "law-text", CLASS + "legal-doc", "法令|条例|規則|判例"],
    "has_article_numbers": ["第[一二三四五六七八九十百千]+条", r"article\s+\d+", r"section\s+\d+", r"§\s*\d+"],
    "has_legal_citations": [r"\d+\s+u\.?s\.?\s+\d+", r"平成\d+年.*判決", r"令和\d+年.*判決", CLASS + "case-citation"],
    "has_price": [CLASS + "price", r"¥\s*[\d,]+", r"\$\s*[\d,]+\.?\d*", r"€\s*[\d,]+", r"""itemprop=["']price"""],
    "has_add_to_cart": ["add-to-cart", "add_to_cart", CLASS + "cart", CLASS + "buy-now", "カートに入れる", "購入する"],
    "has_specifications": [CLASS + "spec", CLASS + "product-detail", "仕様|スペック"],
    "has_product_gallery": [CLASS + "product-gallery", CLASS + "product-image", CLASS + "gallery-thumb", "data-zoom-image"],
    "has_company_info": [CLASS + "company-info", CLASS + "corporate", "会社概要|企業情報|会社情報", r"founded|established|since\s+\d{4}"],
    "has_contact_info": [CLASS + "contact", CLASS + "address", "お問い合わせ|連絡先", "tel:|phone:|fax:"],
    "has_team_section": [CLASS + "team", CLASS + "leadership", CLASS + "executive", "経営陣|役員|チーム"],
    "has_about_section": [CLASS + "about", ID + "about", HEADING + r"about\s*(us)?</h", "私たちについて|当社について"],
}
COUNTS = {"heading_count": r"<h[1-6][^>]*>", "paragraph_count": r"<p[^>]*>", "link_count": r"<a[^>]*href", "list_item_count": r"<li[^>]*>", "form_count": r"<form[^>]*>", "input_count": r"<input[^>]*>", "table_count": r"<table[^>]*>"}
OG_TYPE = r"""<meta[^>]*property=["']og:type["'][^>]*content=["']([^"']+)["']"""
# What in host and path hints at a type; parts of paths and first parts of hosts that are hints themselves.
URL_PATTERNS = {
    "article": ["/news/", "/article/", "/blog/", "/post/", "/story/", "/entry/", r"\d{4}/\d{2}/\d{2}/"],
    "knowledge": ["/wiki/", "/docs/", "/documentation/", "/manual/", "/faq/", "/help/", "/guide/", "/reference/", "/how-to/", "/tutorial/"],
    "notice": ["/news/", "/press/", "/announcement/", "/notice/", "/release/", "/update/", "/info/", "/oshirase/", "/topics/"],
    "forum": ["/forum/", "/thread/", "/topic/", "/discussion/", "/community/", "/board/", "/questions/", "/answers/", "/qa/"],
    "login_wall": ["/login", "/signin", "/auth/", "/register", "/signup", "/member/"],
    "index": ["/category/", "/tag/", "/archive/", "/search", "/list/", "/index", r"/page/\d+"],
    "academic": [r"arxiv\.org", "pubmed", r"scholar\.google", "/paper/", "/publication/", "/abstract/", r"jstage\.jst\.go\.jp", r"cinii\.ac\.jp", r"doi\.org", "/journal/", "/proceedings/"],
    "report": ["/report/", "/ir/", "/investor/", "/annual-report", "/whitepaper/", "/white-paper/", "edinet", "/disclosure/", "/yuho/", "/policy/", "/statistics/"],
    "legal": ["/law/", "/legal/", "/regulation/", "/statute/", "/ordinance/", "/judgment/", r"e-gov\.go\.jp", r"courts\.go\.jp", "/act/", "/code/", "/rule/"],
    "product": ["/product/", "/products/", "/item/", "/spec/", "/specification/", "/datasheet/", "/catalog/", "/shop/", "/store/"],
    "profile": ["/about/", "/company/", "/profile/", "/team/", "/staff/", "/people/", "/corporate/", "/organization/"],
}
SEGMENTS = ["news", "blog", "article", "wiki", "docs", "forum", "thread", "category", "tag", "archive", "press", "notice", "announcement", "release"]
SUBDOMAINS = ["docs", "blog", "forum", "wiki", "help", "support", "community", "news"]
# Words of hints, and the weight they add.
HINT_WORDS = {
    "article": (["article", "blog"], 2.0), "knowledge": (["wiki", "docs"], 2.5), "notice": (["news", "notice", "press"], 2.0), "forum": (["forum", "thread"], 2.0),
    "login_wall": (["login", "signin"], 2.0), "index": (["category", "archive", "list"], 2.0), "academic": (["academic", "paper", "arxiv"], 2.5), "report": (["report", "ir", "investor"], 2.5),
    "legal": (["legal", "law", "regulation"], 2.5), "product": (["product", "shop", "store"], 2.0), "profile": (["profile", "about", "company"], 2.0),
}
# Conditions over the features, and the weight each adds to a type; among equal scores the first type wins.
WEIGHTS = {
    "article": [("has_comments_section", 0.5), ("has_article_tag", 2.5), ("has_date AND has_author", 2.0), ("has_date AND NOT has_author", 1.0), ("paragraph_count >= 5", 1.5), ("text_to_html_ratio > 0.3", 1.0), ("og_type = 'article'", 3.0), ("has_breadcrumb", 0.5)],
    "knowledge": [("has_toc", 3.0), ("has_wiki_structure", 2.5), ("has_edit_links", 2.0), ("has_infobox", 2.0), ("heading_count >= 5", 1.0)],
    "notice": [("has_date AND NOT has_author", 1.0), ("has_category AND has_date", 1.5), ("paragraph_count BETWEEN 2 AND 10", 0.5)],
    "forum": [("has_thread_structure", 3.0), ("has_reply_form", 2.0), ("has_vote_buttons", 2.0), ("has_user_avatars", 1.5), ("has_comments_section", 1.0)],
    "login_wall": [("has_login_form AND has_password_field", 5.0), ("has_paywall_indicator", 3.0)],
    "index": [("has_pagination", 2.5), ("link_density > 0.4", 2.0), ("list_item_count >= 10", 1.5), ("has_breadcrumb", 1.0), ("paragraph_count < 3 AND link_count > 20", 2.0)],
    "academic": [("has_abstract", 3.0), ("has_doi", 3.0), ("has_citations", 2.0), ("has_academic_structure", 2.0)],
    "report": [("has_executive_summary", 3.0), ("has_financial_data", 2.5), ("has_report_structure", 2.0), ("has_charts_tables", 1.5)],
    "legal": [("has_legal_structure", 3.0), ("has_article_numbers", 2.5), ("has_legal_citations", 2.0)],
    "product": [("has_price", 2.5), ("has_add_to_cart", 3.0), ("has_specifications", 2.0), ("has_product_gallery", 1.5)],
    "profile": [("has_about_section", 2.5), ("has_company_info", 2.0), ("has_team_section", 2.0), ("has_contact_info", 1.5)],
}
FLOOR, LEAST = 0.1, 0.5
# What a reason says of the chosen type, in order; {n} stands for the column that follows.
REASONS = {
    "article": [("has_article_tag", "article tag present"), ("has_date", "publication date found"), ("has_author", "author information present"), ("paragraph_count >= 5", "{n} paragraphs", "paragraph_count")],
    "knowledge": [("has_toc", "table of contents present"), ("has_wiki_structure", "wiki-like structure detected"), ("has_edit_links", "edit links found")],
    "notice": [("has_date", "date information present"), ("true", "notice/announcement structure")],
    "forum": [("has_thread_structure", "thread structure detected"), ("has_reply_form", "reply form present"), ("has_vote_buttons", "vote buttons found")],
    "login_wall": [("has_login_form AND has_password_field", "login form with password field detected"), ("has_paywall_indicator", "paywall indicator found")],
    "index": [("has_pagination", "pagination detected"), ("link_density > 0.4", "high link density ({n})", "format_number(link_density, '0.00')"), ("list_item_count >= 10", "{n} list items", "list_item_count")],
    "academic": [("has_abstract", "abstract section found"), ("has_doi", "DOI identifier present"), ("has_citations", "citations/references section"), ("has_academic_structure", "academic paper structure")],
    "report": [("has_executive_summary", "executive summary present"), ("has_financial_data", "financial data found"), ("has_report_structure", "report structure detected")],
    "legal": [("has_legal_structure", "legal document structure"), ("has_article_numbers", "article/section numbering"), ("has_legal_citations", "legal citations present")],
    "product": [("has_price", "price information found"), ("has_add_to_cart", "add to cart functionality"), ("has_specifications", "product specifications")],
    "profile": [("has_about_section", "about section present"), ("has_company_info", "company information found"), ("has_team_section", "team/leadership section")],
    "other": [("true", "no strong classification signals")],
}


def any_of(patterns: list[str]) -> str:
    return "|".join(patterns)


def url_hints(url: Column) -> Column:
    """Hints of an address, repeats kept: types whose patterns host and path hold, then known path parts, then a known first part of the host. Empty without an address."""
    host = F.coalesce(ur.netloc(url), lit(""))
    path = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    full = F.concat(host, path)
    types = F.array_compact(F.array(*[F.when(full.rlike(any_of(p)), t) for t, p in URL_PATTERNS.items()]))
    parts = F.filter(F.split(path, "/"), lambda s: s.isin(SEGMENTS))
    first = F.element_at(F.split(host, r"\."), 1)
    sub = F.when(first.isin(SUBDOMAINS), F.array(first)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.concat(types, parts, sub), F.array().cast("array<string>"))


def page_features(pages: DataFrame) -> DataFrame:
    """Flags, counts, ratios, address hints and declared type of pages(page_id, url, html); a missing html counts as empty.

    Repeated rows give repeated rows; other columns do not pass.
    """
    d = pages.select("page_id", "url", F.coalesce("html", lit("")).alias("__h"))
    d = d.withColumn("__l", F.lower("__h")).withColumn("__t", F.length(F.trim(F.regexp_replace(F.regexp_replace("__h", "<[^>]+>", ""), r"(?U)\s+", " "))))
    inside = F.transform(F.regexp_extract_all("__h", lit(r"(?is)<a[^>]*>(.*?)</a>"), lit(1)), lambda x: F.length(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), r"(?U)^\s+|\s+$", "")))
    links = F.aggregate(inside, lit(0), lambda a, n: a + n)
    # values of class attributes are taken out once, so that most patterns see little text
    d = d.withColumn("__c", F.array_join(F.regexp_extract_all("__l", lit(r"""c(?=lass=["']([^"']*))"""), lit(1)), "\n"))

    def raised(patterns: list[str]) -> Column:
        names, rest = [p.removeprefix(CLASS) for p in patterns if p.startswith(CLASS)], [p for p in patterns if not p.startswith(CLASS)]
        tests = [c.rlike(any_of(ps)) for c, ps in ((col("__c"), names), (col("__l"), rest)) if ps]
        return tests[0] if len(tests) == 1 else tests[0] | tests[1]

    flags = {n: raised(p) for n, p in FLAGS.items()}
    counts = {n: F.regexp_count("__l", lit(p)).cast("long") for n, p in COUNTS.items()}
    flags["has_charts_tables"] = flags.pop("has_charts") | (counts.pop("table_count") >= 3)
    og = F.regexp_extract("__l", OG_TYPE, 1)
    return d.select(
        "page_id", *[c.alias(n) for n, c in (flags | counts).items()],
        F.when(F.length("__h") > 0, col("__t") / F.length("__h")).otherwise(lit(0.0)).alias("text_to_html_ratio"),
        F.when(col("__t") > 0, links / col("__t")).otherwise(lit(0.0)).alias("link_density"),
        F.when(og != "", og).alias("og_type"), url_hints(col("url")).alias("url_hints"),
    )


def scores() -> dict[str, Column]:
    """Score of each type over the columns of page_features(): its weights and its hints', at least the floor."""
    out = {}
    for t, ws in WEIGHTS.items():
        words, w = HINT_WORDS[t]
        hinted = F.array_join("url_hints", "\n").rlike(any_of(words))
        total = F.when(hinted, w).otherwise(0.0)
        for c, x in ws:
            total = total + F.when(F.expr(c), x).otherwise(0.0)
        out[t] = F.greatest(total, lit(FLOOR))
    return out


def classify(features: DataFrame) -> DataFrame:
    """(page_id, page_type, score, confidence, reason) of page_features(): the first type of the largest score, its share of all scores.

    Without a score above the least the type is other, with score and share 1.
    """
    each = F.array(*[F.struct(s.alias("s"), lit(-k).alias("k"), lit(t).alias("t")) for k, (t, s) in enumerate(scores().items())])
    d = features.withColumn("__e", each).withColumn("__b", F.array_max("__e"))
    total = F.aggregate("__e", lit(0.0), lambda a, x: a + x["s"])
    known = col("__b.s") > LEAST
    d = d.withColumn("page_type", F.when(known, col("__b.t")).otherwise("other")).withColumn("score", F.when(known, col("__b.s")).otherwise(lit(1.0))).withColumn("confidence", F.when(known, F.round(col("__b.s") / total, 9)).otherwise(lit(1.0)))

    def said(c: str, text: str, value: str | None = None) -> Column:
        s = lit(text) if value is None else F.replace(lit(text), lit("{n}"), F.expr(value).cast("string"))
        return F.when(F.expr(c), s)

    none = F.array().cast("array<string>")
    own = none
    for t, rs in REASONS.items():
        own = F.when(col("page_type") == t, F.array_compact(F.array(*[said(*r) for r in rs]))).otherwise(own)
    hints = F.when(F.size("url_hints") > 0, F.array(F.concat(lit("URL hints: "), F.array_join(F.slice("url_hints", 1, 3), ", ")))).otherwise(none)
    reason = F.array_join(F.concat(own, hints), "; ")
    return d.select("page_id", "page_type", "score", "confidence", F.when(reason == "", "default classification").otherwise(reason).alias("reason"))
