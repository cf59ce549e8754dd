"""Registered queries over documents, pages and conversations: scalar functions (F), HTML and quality (H), duplicates (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import urls
from quern.operators import dedup as dd
from quern.sources.graph import table

from .registry import query

col = F.col
HOST = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]+)', 1)"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("F1_url_normalise", r"""WITH a AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), b AS (SELECT page_id, u, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?]*)', 1)) AS head FROM a), c AS (SELECT *, substr(u, length(head) + 1) AS rest FROM b)
SELECT page_id, head || regexp_extract(rest, '^([^?]*)', 1) || CASE WHEN regexp_extract(rest, '\?(.*)$', 1) <> '' THEN '?' || array_to_string(list_sort(string_split(regexp_extract(rest, '\?(.*)$', 1), '&')), '&') ELSE '' END AS url FROM c""")
def f1(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.normalise(col("url")).alias("url"))


@query("F2_domains", f"SELECT lower({HOST}) AS domain, count(*) AS pages FROM pages GROUP BY 1")
def f2(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(urls.netloc(col("url")).alias("domain")).agg(F.count("*").alias("pages"))


PAPER_URL = "CASE page_id % 7 WHEN 0 THEN 'https://doi.org/10.1234/Ab.' || page_id || '?x=1' WHEN 1 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || (page_id + 100) || '/' WHEN 2 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || page_id WHEN 3 THEN 'https://arxiv.org/abs/2101.' || (10000 + page_id) WHEN 4 THEN 'https://openalex.org/W' || page_id WHEN 5 THEN 'https://blog.example/w3.org/' || page_id ELSE url END"


def paper_urls(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.expr(PAPER_URL).alias("url"))


def _sql_id(name):
    return f"nullif(regexp_extract(url, '{urls.IDENTIFIERS[name].removeprefix('(?i)')}', 1, 'i'), '')"


@query("F3_identifiers", f"WITH p AS (SELECT page_id, {PAPER_URL} AS url FROM pages) SELECT page_id, " + ", ".join(f"{_sql_id(k)} AS {k}" for k in urls.IDENTIFIERS) + " FROM p")
def f3(spark, sf_dir):
    return paper_urls(spark, sf_dir).select("page_id", *[c.alias(k) for k, c in urls.identifiers(col("url")).items()])


@query("F5_canonical_id", f"WITH p AS (SELECT page_id, {PAPER_URL} AS url FROM pages) SELECT page_id, coalesce('doi:' || lower({_sql_id('doi')}), " + ", ".join(f"'{k}:' || {_sql_id(k)}" for k in ("pmid", "pmcid", "arxiv", "openalex", "s2")) + ", 'url:' || substr(md5(url), 1, 12)) AS canonical_id FROM p")
def f5(spark, sf_dir):
    return paper_urls(spark, sf_dir).select("page_id", urls.canonical_id(col("url")).alias("canonical_id"))


def _tag_sql():
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(url), '{p}')" for p in parts) + f" THEN '{tag}'" for tag, parts in urls.SOURCE_TAGS.items()) + " ELSE 'unknown' END"


@query("F16_source_tags", f"WITH p AS (SELECT page_id, {PAPER_URL} AS url FROM pages) SELECT {_tag_sql()} AS tag, count(*) AS pages FROM p GROUP BY 1")
def f16(spark, sf_dir):
    return paper_urls(spark, sf_dir).groupBy(urls.source_tag(col("url")).alias("tag")).agg(F.count("*").alias("pages"))


@query("F4_doi_in_text", r"""WITH p AS (SELECT conv_id, turn, 'see 10.1000/Ab' || conv_id || '.' || turn || '). ' || text AS t FROM conversations) SELECT conv_id, turn, nullif(lower(regexp_replace(regexp_extract(t, '(10\.\d{4,}/[^\s<>"'']+)', 1), '[.,;:)\]]+$', '')), '') AS doi FROM p""")
def f4(spark, sf_dir):
    t = F.concat(F.lit("see 10.1000/Ab"), col("conv_id").cast("string"), F.lit("."), col("turn").cast("string"), F.lit("). "), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", urls.doi_in_text(t).alias("doi"))


@query("F14_query_keys", "SELECT conv_id, turn, substr(sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) || '|' || role), 1, 32) AS cache_key FROM conversations")
def f14(spark, sf_dir):
    text = F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(F.sha2(F.concat_ws("|", text, "role"), 256), 1, 32).alias("cache_key"))


@query("F20_suspicious_output", r"SELECT doc_id, len(regexp_extract_all(text, 'https?://[^\s<>]+')) AS urls, len(regexp_extract_all(text, '\b\d{1,3}(?:\.\d{1,3}){3}\b')) AS ipv4, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails FROM documents")
def f20(spark, sf_dir):
    n = lambda p: F.regexp_count("text", F.lit(p))
    return documents(spark, sf_dir).select("doc_id", n(r"https?://[^\s<>]+").alias("urls"), n(r"\b\d{1,3}(?:\.\d{1,3}){3}\b").alias("ipv4"), n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("emails"))


def _type_sql(c):
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{p}') THEN '{n}'" for n, p in tx.CLAIM_TYPES) + " ELSE 'factual' END"


@query("F22_claim_decomposition", f"""WITH s AS (SELECT conv_id, turn, unnest(list_filter(list_transform(regexp_split_to_array(text, '(?:and|or|but|also|moreover)|[,;、。]'), lambda x: trim(x, ' ')), lambda x: length(x) > 5)) AS segment FROM conversations)
SELECT conv_id, turn, segment, CASE WHEN regexp_matches(lower(segment), '{tx.NEGATIVE}') THEN 'negative' WHEN regexp_matches(lower(segment), '{tx.QUESTION}') THEN 'neutral' ELSE 'positive' END AS polarity, {_type_sql('segment')} AS claim_type FROM s""")
def f22(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(tx.claim_segments(col("text"))).alias("segment"))
    return s.select("*", tx.polarity(col("segment")).alias("polarity"), tx.claim_type(col("segment")).alias("claim_type"))


@query("F24_refutation_queries", "SELECT conv_id, turn, substr(text, 1, 100) || ' ' || s AS query FROM conversations, unnest(['problems', 'criticism', 'limitations', 'contradiction', 'debunked']) t(s) WHERE role = 'user'")
def f24(spark, sf_dir):
    s = F.explode(F.array(*[F.lit(x) for x in ("problems", "criticism", "limitations", "contradiction", "debunked")]))
    d = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.substring("text", 1, 100).alias("q"), s.alias("s"))
    return d.select("conv_id", "turn", F.concat_ws(" ", "q", "s").alias("query"))


@query("F19_leaked_benchmark", """WITH b AS (SELECT DISTINCT unnest(list_transform(range(1, length(text) - 18), lambda i: substr(text, i, 20))) AS g FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, length(text) - 18), lambda i: substr(text, i, 20)))) AS g FROM documents)
SELECT doc_id, count(*) AS shared FROM d WHERE g IN (SELECT g FROM b) GROUP BY 1""")
def f19(spark, sf_dir):
    return dd.shared_runs(texts(spark, sf_dir), table(spark, sf_dir, "benchmark")).select(col("id").alias("doc_id"), "shared")


@query("H1_strip_scripts", r"SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', '', 'g')) AS n FROM pages")
def h1(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.length(tx.strip_scripts(col("html"))).cast("long").alias("n"))


@query("H4_paragraphs", r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS paragraphs FROM documents")
def h4(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(tx.paragraphs(col("text"))).cast("long").alias("paragraphs"))


SENT = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？]+'), lambda s: trim(regexp_replace(s, '[ \t\n\r]+', ' ', 'g'), ' ')), lambda s: s <> '')"


@query("H9_quality_features", rf"""WITH d AS (SELECT doc_id, text, {WORDS} AS w, list_transform({SENT}, lambda s: len(list_filter(regexp_split_to_array(s, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::BIGINT) AS l FROM documents),
e AS (SELECT *, len(l) AS n, coalesce(list_sum(l), 0)::BIGINT AS s, coalesce(list_sum(list_transform(l, lambda x: x * x)), 0)::BIGINT AS q, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [] END AS g FROM d)
SELECT doc_id, len(w) AS words, CASE WHEN len(w) > 0 THEN len(list_distinct(w))::DOUBLE / len(w) ELSE 0 END AS unique_ratio, CASE WHEN len(g) > 0 THEN (len(g) - len(list_distinct(g)))::DOUBLE / len(g) ELSE 0 END AS ngram_repetition,
CASE WHEN n < 2 OR s = 0 THEN 0 ELSE round(least(1, sqrt((n * q - s * s)::DOUBLE) / s / 0.8::DOUBLE), 9) END AS burstiness, CASE WHEN n < 3 OR s = 0 THEN 0 ELSE len(list_filter(l, lambda x: abs(x * n - s) * 5 < s))::DOUBLE / n END AS uniformity FROM e""")
def h9(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", tx.tokens(col("text")).alias("w"), tx.sentence_lengths(col("text")).alias("l"))
    return d.select("doc_id", F.size("w").cast("long").alias("words"), F.when(F.size("w") > 0, F.size(F.array_distinct("w")) / F.size("w")).otherwise(F.lit(0.0)).alias("unique_ratio"), tx.ngram_repetition(col("w")).alias("ngram_repetition"), F.round(tx.burstiness(col("l")), 9).alias("burstiness"), tx.uniformity(col("l")).alias("uniformity"))


@query("H11_issues", rf"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), f AS (SELECT doc_id, len(w) AS n, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [] END AS g FROM d), i AS (SELECT doc_id, list_filter([CASE WHEN n < 100 THEN 'thin_content' END, CASE WHEN len(g) > 0 AND (len(g) - len(list_distinct(g)))::DOUBLE / len(g) > 0.3::DOUBLE THEN 'repetitive' END], lambda x: x IS NOT NULL) AS issues FROM f)
SELECT doc_id, issues, round(1 - coalesce(list_sum(list_transform(issues, lambda x: CASE x WHEN 'thin_content' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END)), 0), 6) AS score, round(least(0.8::DOUBLE, coalesce(list_sum(list_transform(issues, lambda x: CASE x WHEN 'thin_content' THEN 0.2::DOUBLE ELSE 0.15::DOUBLE END)), 0)), 6) AS penalty FROM i""")
def h11(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", tx.tokens(col("text")).alias("w"))
    issues = F.array_compact(F.array(F.when(F.size("w") < 100, "thin_content"), F.when(tx.ngram_repetition(col("w")) > 0.3, "repetitive")))
    d = d.select("doc_id", issues.alias("issues"))
    return d.select("doc_id", "issues", F.round(1 - tx.issue_penalty(col("issues"), 0, 1.0), 6).alias("score"), F.round(tx.issue_penalty(col("issues")), 6).alias("penalty"))


@query("H12_japanese", "SELECT count(*) FILTER (length(regexp_replace(text, '[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}]', '', 'g')) * 10 < length(text) * 9) AS japanese, count(*) AS documents FROM documents")
def h12(spark, sf_dir):
    return documents(spark, sf_dir).agg(F.count_if(tx.japanese_share(col("text")) > 0.1).alias("japanese"), F.count("*").alias("documents"))


@query("H14_page_ratios", r"""SELECT page_id, round(coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<nav[^>]*>.*?</nav>'), lambda x: length(x))), 0)::DOUBLE / length(html), 9) AS navigation, round(coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<footer[^>]*>.*?</footer>'), lambda x: length(x))), 0)::DOUBLE / length(html), 9) AS footer, len(regexp_extract_all(html, '(?i)<a[^>]*href=["'']([^"'']+)["'']')) AS links FROM pages""")
def h14(spark, sf_dir):
    part = lambda p: F.round(tx.share(tx.matched_length(col("html"), p), col("html")), 9)
    return pages(spark, sf_dir).select("page_id", part(r"(?is)<nav[^>]*>.*?</nav>").alias("navigation"), part(r"(?is)<footer[^>]*>.*?</footer>").alias("footer"), F.regexp_count("html", F.lit(r"""(?i)<a[^>]*href=["']([^"']+)["']""")).cast("long").alias("links"))


@query("D1_word_shingles", rf"WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS shingles FROM d")
def d1(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(tx.word_shingles(col("text"))).cast("long").alias("shingles"))


@query("D2_char_shingles", "SELECT item_id, len(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(replace(lower(text), ' ', '_'), i, 3)))) AS shingles FROM benchmark")
def d2(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(tx.char_shingles(col("text"))).cast("long").alias("shingles"))


def texts(spark, sf_dir):
    return documents(spark, sf_dir).select(col("doc_id").alias("id"), "text")


@query("D13_exact_duplicates", "SELECT substr(sha256(text), 1, 32) AS hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def d13(spark, sf_dir):
    return dd.exact_duplicates(texts(spark, sf_dir))


@query("D14_url_novelty", f"WITH s AS (SELECT page_id, lower({HOST}) AS h FROM pages) SELECT page_id // 50 AS batch, count(*) FILTER (h NOT IN (SELECT h FROM s o WHERE o.page_id < 50))::DOUBLE / count(*) AS novelty FROM s WHERE page_id >= 50 GROUP BY 1")
def d14(spark, sf_dir):
    s = pages(spark, sf_dir).select("page_id", urls.netloc(col("url")).alias("h"))
    seen = s.where("page_id < 50").select("h").distinct().withColumn("old", F.lit(True))
    return s.where("page_id >= 50").join(seen, "h", "left").groupBy(F.expr("page_id div 50").alias("batch")).agg((F.count_if(col("old").isNull()) / F.count("*")).alias("novelty"))


@query("D16_sentence_similarity", rf"""WITH s AS (SELECT item_id, list_transform({SENT}, lambda s: list_distinct(list_filter(regexp_split_to_array(lower(s), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS w FROM benchmark)
SELECT item_id, CASE WHEN len(w) < 2 THEN 0 ELSE round(list_sum(list_transform(range(1, len(w)), lambda i: len(list_intersect(w[i], w[i + 1]))::DOUBLE / (len(w[i]) + len(w[i + 1]) - len(list_intersect(w[i], w[i + 1]))))) / (len(w) - 1), 9) END AS similarity FROM s""")
def d16(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(tx.consecutive_similarity(col("text")), 9).alias("similarity"))


@query("D5_similar_pairs")
def d5(spark, sf_dir):
    return dd.similar_pairs(texts(spark, sf_dir), 0.5)


@query("D7_clusters")
def d7(spark, sf_dir):
    return dd.linked(*dd.similar_classes(texts(spark, sf_dir), 0.5))


@query("D9_deduplicate")
def d9(spark, sf_dir):
    t = texts(spark, sf_dir)
    return dd.deduplicate(t, dd.linked(*dd.similar_classes(t, 0.5)), "longest").select("id")


@query("D8_duplicate_ratio")
def d8(spark, sf_dir):
    t = texts(spark, sf_dir)
    return dd.duplicate_ratio(t, dd.linked(*dd.similar_classes(t, 0.5)))


@query("D10_simhash_pairs")
def d10(spark, sf_dir):
    return dd.simhash_pairs(texts(spark, sf_dir))


@query("D12_hybrid_pairs")
def d12(spark, sf_dir):
    return dd.hybrid_pairs(texts(spark, sf_dir))


@query("D15_title_match", r"""WITH a AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark), p AS (SELECT a.item_id AS l, b.item_id AS r, len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS similarity FROM a, a b)
SELECT l, min(r) AS r, arg_min(similarity, r) AS similarity FROM p WHERE similarity >= 0.2::DOUBLE GROUP BY 1""")
def d15(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(col("item_id").alias("id"), col("text").alias("title"))
    return dd.title_matches(b, b, 0.2)


EXACT = rf"""
d AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM d),
x AS (SELECT id, len(g) AS n, unnest(g) AS g FROM s), b AS (SELECT a.id AS a, c.id AS b, any_value(a.n) + any_value(c.n) AS t, count(*) AS k FROM x a JOIN x c ON a.g = c.g AND a.id < c.id AND least(a.n, c.n) * 100 >= greatest(a.n, c.n) * 80 GROUP BY 1, 2),
p AS (SELECT a, b, k::DOUBLE / (t - k) AS similarity FROM b WHERE k * 100 >= (t - k) * 80)
"""


@query("D5b_exact_pairs", f"WITH {EXACT} SELECT * FROM p")
def d5b(spark, sf_dir):
    return dd.exact_pairs(texts(spark, sf_dir))


@query("D7b_exact_clusters", f"WITH RECURSIVE {EXACT}, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(id, reach) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach) SELECT id, min(reach) AS cluster FROM r GROUP BY 1")
def d7b(spark, sf_dir):
    return dd.linked(*dd.exact_classes(texts(spark, sf_dir)))
