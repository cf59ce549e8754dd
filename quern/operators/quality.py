"""Quality of web pages: features of text and markup, issues, score and penalty, all in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import rules as ru
from quern.functions import text as tx

col, lit = F.col, F.lit

# Stop words, and the patterns of adverts, affiliate links, calls to action, collections, bait, spam, machine text and copies.
STOPWORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must shall can need "
    "this that these those it its they them their we us our you your he she him her his i me my not no yes so if then than when where what which who whom how why all "
    "each every both few more most other some such only own same just also very "
    "の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって "
    "により おり より による ず なり られる において ば なかっ なく しかし について せ だっ その後 できる それ う ので なお のみ でき き つ における および いう さらに でも"
).split()
ADS = [
    r"""class=["'][^"']*\b(ad|ads|advert|advertisement|banner|sponsor)\b""",
    r"""id=["'][^"']*\b(ad|ads|advert|advertisement|banner|sponsor)\b""",
    r"data-ad-",
    r"googlesyndication",
    r"doubleclick",
    r"adsense",
    r"adsbygoogle",
    r"""class=["'][^"']*\b(pr|sponsored|promotion)\b""",
]
AFFILIATES = [
    r"amazon\.[^/]+/.*[?&]tag=", r"amzn\.to/", r"a]\.co/", r"linksynergy\.com", r"shareasale\.com", r"awin1\.com", r"commission-junction",
    r"clickbank\.net", r"rakuten\.co\.jp/.*\?scid=", r"valuecommerce\.com", r"accesstrade\.net", r"a8\.net",
]
CALLS = [
    r"click\s+here", r"buy\s+now", r"sign\s+up", r"subscribe\s+now", r"get\s+started", r"learn\s+more", r"try\s+free", r"download\s+now",
    r"今すぐ", r"申し込む", r"購入する", r"登録する", r"無料で", r"詳しくはこちら",
]
COLLECTIONS = [
    r"(source|出典|引用元|via|from)\s*[:：]\s*", r"(according\s+to|によると|によれば)", r"(originally\s+published|元記事)", r"(top\s+\d+|best\s+\d+|まとめ|\d+選)",
    r"(roundup|curated|collection|compilation)", r"(この記事は.*から|from\s+.*\s+article)",
]
CURATED = r"(top\s+\d+|best\s+\d+|\d+\s+(best|top)|まとめ|\d+選)"
BAIT = [
    r"you\s+won'?t\s+believe", r"shocking", r"amazing", r"incredible", r"unbelievable", r"mind-?blowing", r"jaw-?dropping", r"this\s+one\s+trick", r"doctors\s+hate",
    r"what\s+happened\s+next", r"number\s+\d+\s+will\s+shock", r"驚きの", r"衝撃の", r"まさかの", r"ヤバい", r"信じられない",
]
SPAM = [
    r"<h\d[^>]*>.*keyword.*</h\d>", r"(best|top|cheap|free|buy)\s+([\w\s]+\s+){0,3}(online|near\s+me|2024|2025)",
    r"(\w+\s+){0,2}(review|reviews|guide|tips|tricks)\s+2024", r"<a[^>]*>\s*click\s+here\s*</a>",
]
MACHINE = [
    r"as\s+an\s+ai", r"i\s+cannot\s+provide", r"it'?s\s+important\s+to\s+note", r"it'?s\s+worth\s+noting", r"in\s+conclusion", r"in\s+summary", r"to\s+summarize",
    r"firstly.*secondly.*thirdly", r"on\s+the\s+other\s+hand", r"having\s+said\s+that", r"with\s+that\s+being\s+said", r"it\s+is\s+important\s+to\s+understand",
    r"there\s+are\s+several\s+(?:factors|reasons|ways)", r"let'?s\s+delve\s+into", r"let'?s\s+explore", r"delve\s+into", r"dive\s+into", r"landscape", r"leverage",
    r"utilize", r"facilitate", r"comprehensive\s+(?:guide|overview|analysis)",
]
COPIES = [r"(scraped|crawled|aggregated)\s+from", r"(original|source)\s+(article|content)\s*:", r"content\s+(from|via)\s+"]
BOILERPLATE = [
    r"(?s)<header[^>]*>.*?</header>", r"(?s)<footer[^>]*>.*?</footer>", r"(?s)<nav[^>]*>.*?</nav>", r"(?s)<aside[^>]*>.*?</aside>",
    r"""class=["'][^"']*sidebar""", r"""class=["'][^"']*widget""", r"""class=["'][^"']*menu""",
]


def plain_text(html: Column) -> Column:
    """Text without scripts, styles and tags, blanks as one."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"(?U)\s+", " "))


def times(text: Column, patterns: list[str] | str) -> Column:
    return F.regexp_count(text, lit("(?iu)" + (patterns if isinstance(patterns, str) else "|".join(patterns))))


def share_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(lit(0.0))


def most_frequent(words: Column) -> Column:
    """How often the most frequent of the words occurs, by one pass over the sorted words."""
    start = F.struct(lit("").alias("w"), lit(0).alias("run"), lit(0).alias("best"))

    def step(a: Column, w: Column) -> Column:
        run = F.when(a["w"] == w, a["run"] + 1).otherwise(lit(1))
        return F.struct(w.alias("w"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(F.array_sort(words), start, step, lambda a: a["best"])


def page_features(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text and the quality features of each page's html; a null page counts as empty. Texts under two sentences have no variation."""
    h = col("__h")
    d = pages.withColumn("__h", F.coalesce(col(html), lit(""))).withColumn("text", plain_text(h)).withColumn("__low", F.lower("__h")).withColumn("__w", tx.tokens(col("text"))).withColumn("__s", tx.sentences(col("text")))
    d = d.withColumn("__l", F.transform("__s", lambda s: F.size(tx.blank_words(s)))).withColumn("__t", F.lower("text"))
    t, low, w, n = col("text"), col("__low"), col("__w"), col("word_count")
    tags = lambda p: F.regexp_count(h, lit(f"(?i){p}"))
    blocks = tags(r"<p\b[^>]*>") + tags(r"<li\b[^>]*>") + tags(r"<blockquote\b[^>]*>") + F.when(tags(r"<p\b[^>]*>") == 0, tags(r"(?:<br\s*/?>[\s\n]*){2,}")).otherwise(0)
    content = F.filter(w, lambda x: ~x.isin(STOPWORDS) & (F.length(x) > 2))
    links = F.regexp_extract_all(h, lit(r"(?is)<a[^>]*>(.*?)</a>"), lit(1))
    linked = tx.sum_of(F.transform(links, lambda x: F.length(F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", ""), r"^\s+|\s+$", "")))))
    matched = lambda ps: sum((tx.matched_length(low, p) for p in ps[1:]), tx.matched_length(low, ps[0]))
    d = d.select(
        *[c for c in d.columns], F.length(t).alias("text_length"), F.length(h).alias("html_length"), F.size(w).alias("word_count"), F.size("__s").alias("sentence_count"),
        F.greatest(blocks, (F.length(t) > 0).cast("int")).alias("paragraph_count"), F.regexp_count(low, lit(r"<h[1-6][^>]*>")).alias("heading_count"), F.regexp_count(low, lit(r"<a[^>]*href")).alias("link_count"),
        F.regexp_count(low, lit(r"<img[^>]*>")).alias("image_count"), F.regexp_count(low, lit(r"<script[^>]*>")).alias("script_count"), times(low, ADS).alias("ad_count"), times(h, AFFILIATES).alias("affiliate_count"),
        times(t, CALLS).alias("call_count"), times(t, COLLECTIONS).alias("source_mentions"), F.lower(t).rlike(CURATED).alias("curated_list"),
    )
    size, chars = col("html_length"), col("text_length")
    d = d.select(
        "*", share_of(n, col("sentence_count")).alias("avg_sentence_length"), share_of(n, col("paragraph_count")).alias("avg_paragraph_length"), share_of(chars, size).alias("text_to_html_ratio"),
        share_of(linked, chars).alias("link_density"), share_of(F.size(F.array_distinct(w)), n).alias("unique_word_ratio"), share_of(F.size(F.filter(w, lambda x: x.isin(STOPWORDS))), n).alias("stopword_ratio"),
        share_of(F.regexp_count(t, lit(r"\p{Lu}")), chars).alias("capitalization_ratio"), share_of(F.regexp_count(t, lit(r"""[.,!?;:()\[\]{}"'\-]""")), chars).alias("punctuation_density"),
        tx.ngram_repetition(w).alias("ngram_repetition"), ru.phrase_repetitions(t).alias("phrase_repetitions"), tx.consecutive_similarity(t).alias("sentence_similarity"),
        tx.burstiness(col("__l")).alias("burstiness"), tx.uniformity(col("__l")).alias("uniformity"), share_of(most_frequent(content), n).alias("keyword_density"), tx.external_link_ratio(h).alias("external_link_ratio"),
        share_of(matched(BOILERPLATE), size).alias("boilerplate_ratio"), share_of(matched([r"(?s)<nav[^>]*>.*?</nav>", r"""(?s)class=["'][^"']*menu[^"']*["'][^>]*>.*?</\w+>"""]), size).alias("navigation_ratio"),
        share_of(matched([r"(?s)<footer[^>]*>.*?</footer>"]), size).alias("footer_ratio"),
        times(F.lower(t), MACHINE).alias("machine_phrases"), times(low, SPAM).alias("spam_phrases"), times(F.lower(t), BAIT).alias("bait_phrases"), sum((low.rlike(p).cast("int") for p in COPIES[1:]), low.rlike(COPIES[0]).cast("int")).alias("copy_phrases"),
    )
    return d.drop("__h", "__low", "__w", "__s", "__l", "__t")


def steps(value: Column, cases: list[tuple[float, float]], below: bool = False) -> Column:
    """The first case's figure whose bound the value passes; 0 for none."""
    out = lit(0.0)
    for bound, figure in reversed(cases):
        out = F.when(value < bound if below else value > bound, lit(figure)).otherwise(out)
    return out


def machine_score(heading_ratio: Column) -> Column:
    """How likely a text is a machine's, by phrases, evenness and structure."""
    m = col("machine_phrases")
    phrases = F.when(m >= 10, 0.65).when(m >= 5, 0.5).when(m >= 3, 0.3).when(m >= 1, 0.1).otherwise(0.0)
    s = phrases + steps(col("uniformity"), [(0.6, 0.2), (0.4, 0.1)]) + steps(col("burstiness"), [(0.2, 0.2), (0.3, 0.1)], below=True) + steps(col("sentence_similarity"), [(0.3, 0.15)]) + steps(heading_ratio, [(0.5, 0.1)])
    return F.least(lit(1.0), s)


def page_issues(features: DataFrame) -> DataFrame:
    """Adds machine_score, issues, score, penalty and reason to page_features()."""
    c = col
    d = features.withColumn("machine_score", F.round(machine_score(share_of(c("heading_count") * 100, c("word_count"))), 9))
    marks = sum((x.cast("int") for x in (c("source_mentions") >= 5, c("boilerplate_ratio") > 0.5, c("unique_word_ratio") < 0.3)), (c("external_link_ratio") > 0.8).cast("int")) + c("copy_phrases")
    found = {
        "thin_content": (c("word_count") < 100) | (c("paragraph_count") < 2),
        "ad_heavy": (c("ad_count") >= 5) | (c("ad_count") >= 3) & (c("word_count") < 500),
        "template_heavy": (c("text_to_html_ratio") < 0.1) & (c("html_length") > 5000),
        "repetitive": (c("ngram_repetition") > 0.3) | (c("phrase_repetitions") >= 5),
        "keyword_stuffing": c("keyword_density") > 0.05,
        "ai_generated": c("machine_score") > 0.6,
        "seo_spam": (c("spam_phrases") >= 2) | (c("spam_phrases") >= 1) & (c("keyword_density") > 0.03),
        "aggregator": (c("source_mentions") >= 3) | c("curated_list") & (c("source_mentions") >= 2),
        "clickbait": c("bait_phrases") >= 2,
        "scraper": marks >= 3,
    }
    d = d.withColumn("issues", F.array_compact(F.array(*[F.when(v, lit(k)) for k, v in found.items()])))
    good = sum((x.cast("int") for x in (c("text_to_html_ratio") > 0.3, c("burstiness") > 0.3, (c("paragraph_count") >= 5) & (c("heading_count") >= 2))), (c("unique_word_ratio") > 0.5).cast("int"))
    score = F.greatest(lit(0.0), F.least(lit(1.0), 1.0 - tx.issue_penalty(c("issues"), 0, 100.0) + good * 0.05))
    reason = F.when(F.size("issues") == 0, lit("no issues")).otherwise(F.concat(lit("issues: "), F.array_join("issues", ", ")))
    return d.withColumn("score", F.round(score, 6)).withColumn("penalty", F.round(tx.issue_penalty(c("issues")), 6)).withColumn("reason", reason)
