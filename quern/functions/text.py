"""Columns over text and HTML: tokens, shingles, repetition, variation, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def blank_words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of n words, in order, repeats kept; none when there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def word_shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of k words; a shorter text is one shingle, no words none."""

    def of(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(ngrams(w, k)))

    return let(tokens(text), of)


def char_shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of k characters, lower-cased, blanks as underscores."""
    c = F.replace(F.lower(text), F.lit(" "), F.lit("_"))
    return F.when(F.length(c) < k, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total > 0, both / total).otherwise(F.lit(0.0))


def ngram_repetition(words: Column, n: int = 3) -> Column:
    """Share of n-word runs that repeat an earlier one; runs are told apart by 64-bit hashes."""

    def runs(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(F.array().cast("array<bigint>"))

    return let(runs(words), lambda g: F.when(F.size(g) > 0, (F.size(g) - F.size(F.array_distinct(g))) / F.size(g)).otherwise(F.lit(0.0)))


def sentences(text: Column) -> Column:
    """Parts between sentence ends, trimmed, not empty."""
    return F.filter(F.transform(F.split(text, r"[.!?。！？]+"), lambda s: F.trim(F.regexp_replace(s, r"[ \t\n\r]+", " "))), lambda s: s != "")


def sentence_lengths(text: Column) -> Column:
    return F.transform(sentences(text), lambda s: F.size(blank_words(s)))


def sum_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y.cast("bigint"))


def burstiness(lengths: Column) -> Column:
    """Deviation over mean of sentence lengths, 0.8 and above as 1; 0 for under two sentences."""

    def of(a: Column) -> Column:
        n, s, q = F.size(a), sum_of(a), sum_of(F.transform(a, lambda x: x * x))
        return F.when((n < 2) | (s == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.sqrt((n * q - s * s).cast("double")) / s / F.lit(0.8)))

    return let(lengths, of)


def uniformity(lengths: Column) -> Column:
    """Share of sentences within 20 percent of the mean length; 0 for under three."""

    def of(a: Column) -> Column:
        n, s = F.size(a), sum_of(a)
        near = F.size(F.filter(a, lambda x: F.abs(x * n - s) * 5 < s))
        return F.when((n < 3) | (s == 0), F.lit(0.0)).otherwise(near / n)

    return let(lengths, of)


def consecutive_similarity(text: Column) -> Column:
    """Mean Jaccard similarity of the word sets of neighbouring sentences."""

    def of(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), jaccard)
        return F.when(F.size(w) < 2, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda x, y: x + y) / (F.size(w) - 1))

    return let(F.transform(sentences(text), lambda s: F.array_distinct(blank_words(F.lower(s)))), of)


def strip_scripts(html: Column) -> Column:
    """HTML without script, style and noscript elements."""
    return F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def matched_length(text: Column, pattern: str) -> Column:
    """Characters in all matches of a pattern."""
    return sum_of(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length))


def external_link_ratio(html: Column) -> Column:
    links = F.regexp_extract_all(html, F.lit(r"""(?i)<a[^>]*href=["']([^"']+)["']"""), F.lit(1))
    return let(links, lambda x: F.when(F.size(x) > 0, F.size(F.filter(x, lambda u: u.startswith("http://") | u.startswith("https://"))) / F.size(x)).otherwise(F.lit(0.0)))


def share(part: Column, html: Column) -> Column:
    return F.when(F.length(html) > 0, part / F.length(html)).otherwise(F.lit(0.0))


def japanese_share(text: Column) -> Column:
    """Share of characters in Japanese scripts."""
    return share(F.length(text) - F.length(F.regexp_replace(text, r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]", "")), text)


# The patterns that show a claim's polarity and kind, in the order they are sought, and penalties by issue.
NEGATIVES = ["ない", "しない", "できない", "不可能", "否定", "反対", "誤り", "間違い", "not", "never", "cannot", "impossible", "false", "incorrect", "wrong"]
QUESTIONS = [r"\?$", r"？$", r"^(what|who|when|where|why|how|which)", r"^(何|誰|いつ|どこ|なぜ|どう|どの)", r"(か|のか|でしょうか)$"]
KINDS = {
    "temporal": [r"\d{4}年", r"\d{4}/\d{1,2}", r"(いつ|when|年|月|日|時)", r"(以前|以後|before|after|during)"],
    "quantitative": [r"\d+%", r"\d+億", r"\d+万", r"(数|量|率|比率|割合)", r"(how many|how much|percentage|ratio)"],
    "comparative": [r"(より|compared to|than|versus|vs)", r"(比較|違い|difference|similar|different)"],
    "causal": [r"(なぜ|原因|理由|結果|影響)", r"(because|cause|effect|result|impact|why)", r"(によって|ため|から)"],
    "definitional": [r"(とは|定義|意味|what is|define|definition)"],
}
NEGATIVE, QUESTION = "|".join(NEGATIVES), "|".join(QUESTIONS)
CLAIM_TYPES = [(k, "|".join(v)) for k, v in KINDS.items()]
ISSUE_PENALTIES = {"thin_content": (0.3, 0.2), "ad_heavy": (0.2, 0.15), "template_heavy": (0.15, 0.1), "repetitive": (0.2, 0.15), "keyword_stuffing": (0.25, 0.2), "ai_generated": (0.3, 0.25), "seo_spam": (0.35, 0.3), "aggregator": (0.2, 0.15), "clickbait": (0.25, 0.2), "scraper": (0.4, 0.35)}


def polarity(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(NEGATIVE), "negative").when(low.rlike(QUESTION), "neutral").otherwise("positive")


def claim_type(text: Column) -> Column:
    low, out = F.lower(text), F.lit("factual")
    for name, pattern in reversed(CLAIM_TYPES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def claim_segments(text: Column) -> Column:
    """Parts of a question between conjunctions and commas, longer than five characters."""
    return F.filter(F.transform(F.split(text, r"(?:and|or|but|also|moreover)|[,;、。]"), lambda s: F.trim(s)), lambda s: F.length(s) > 5)


def issue_penalty(issues: Column, column: int = 1, cap: float = 0.8) -> Column:
    """Sum of the penalties of an array of issues (0: of the quality score, 1: of the ranking), capped."""
    m = F.create_map(*[x for k, v in ISSUE_PENALTIES.items() for x in (F.lit(k), F.lit(v[column]))])
    return F.least(F.lit(cap), F.aggregate(issues, F.lit(0.0), lambda a, x: a + F.coalesce(m[x], F.lit(0.1))))
