"""Registered queries: evidence selection, identity, extraction and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import identity as idn
from quern.operators import evidence as ev
from quern.operators import graph as gr
from quern.operators import state as st
from quern.sources.graph import table

from .registry import on_graph, query

col = F.col


def i_events(spark, sf_dir):
    return table(spark, sf_dir, "events")


SIMILAR = "WITH s AS (SELECT user_id AS claim_id, event_id AS fragment_id, 'd' || (event_id % 13) AS domain, (event_id * 71 % 100)::DOUBLE / 100 AS similarity FROM events), o AS (SELECT DISTINCT user_id AS claim_id, 'd' || (user_id % 13) AS domain FROM events), j AS (SELECT user_id AS claim_id, event_id AS fragment_id FROM events WHERE event_id % 9 = 0) "


@query("V2_nli_candidates", SIMILAR + """, a AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY similarity DESC, fragment_id) AS k FROM s WHERE similarity >= 0.55::DOUBLE AND (claim_id, domain) NOT IN (SELECT claim_id, domain FROM o)),
b AS (SELECT *, min(k) OVER (PARTITION BY claim_id, domain) AS f FROM a WHERE k <= 30), c AS (SELECT *, dense_rank() OVER (PARTITION BY claim_id ORDER BY f) AS seen FROM b),
d AS (SELECT claim_id, fragment_id, domain, similarity, row_number() OVER (PARTITION BY claim_id ORDER BY similarity DESC, fragment_id) AS n FROM c WHERE seen <= 6 AND (claim_id, fragment_id) NOT IN (SELECT claim_id, fragment_id FROM j)) SELECT claim_id, fragment_id, domain, similarity FROM d WHERE n <= 20""")
def v2(spark, sf_dir):
    e, i, u = i_events(spark, sf_dir), col("event_id"), col("user_id")
    d = lambda x: F.concat(F.lit("d"), (x % 13).cast("string"))
    s = e.select(u.alias("claim_id"), i.alias("fragment_id"), d(i).alias("domain"), (i * 71 % 100 / 100.0).alias("similarity"))
    return ev.nli_candidates(s, e.select(u.alias("claim_id"), d(u).alias("domain")).distinct(), e.where("event_id % 9 = 0").select(u.alias("claim_id"), i.alias("fragment_id")))


@query("V3_accept_nli", "WITH j AS (SELECT user_id AS claim_id, event_id % 40 AS fragment_id, CASE event_id % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'refutes' ELSE 'neutral' END AS relation, (event_id * 71 % 100)::DOUBLE / 100 AS confidence FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY claim_id, fragment_id ORDER BY confidence DESC, relation DESC) AS n FROM j WHERE (relation <> 'neutral' AND confidence >= 0.6::DOUBLE) OR relation = 'neutral') SELECT claim_id, fragment_id, relation, confidence FROM k WHERE n = 1 AND fragment_id % 10 <> 0")
def v3(spark, sf_dir):
    i = col("event_id")
    j = i_events(spark, sf_dir).select(col("user_id").alias("claim_id"), (i % 40).alias("fragment_id"), F.when(i % 3 == 0, "supports").when(i % 3 == 1, "refutes").otherwise("neutral").alias("relation"), (i * 71 % 100 / 100.0).alias("confidence"))
    return ev.accept_nli(j, j.where("fragment_id % 10 = 0").select("claim_id", "fragment_id").distinct())


@query("V4_filter_citations", """WITH p AS (SELECT event_type AS query, event_id AS id, event_id % 23 AS c, (event_id * 71 % 100)::DOUBLE / 100 AS s, (event_id * 31 % 11)::DOUBLE / 10 AS llm FROM events WHERE event_id % 23 >= 1),
i AS (SELECT *, (rank() OVER (PARTITION BY query ORDER BY c) - 1 + (count(*) OVER (PARTITION BY query, c) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY query) - 1) AS impact FROM p), a AS (SELECT *, round(0.5::DOUBLE * s + 0.5::DOUBLE * impact, 9) AS stage1 FROM i),
b AS (SELECT *, round(0.5::DOUBLE * llm + 0.3::DOUBLE * s + 0.2::DOUBLE * impact, 9) AS stage2 FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY stage1 DESC, id) AS k FROM a) WHERE k <= 30) SELECT query, id, stage1, stage2 FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY stage2 DESC, id) AS n FROM b) WHERE n <= 10""")
def v4(spark, sf_dir):
    i = col("event_id")
    p = i_events(spark, sf_dir).select(col("event_type").alias("query"), i.alias("id"), (i % 23).alias("citations"), (i * 71 % 100 / 100.0).alias("similarity"), (i * 31 % 11 / 10.0).alias("llm"))
    return ev.filter_citations(p)


QUALITY_SQL = "CASE WHEN url LIKE '%/wiki/%' OR url LIKE '%/patent/%' OR url LIKE '%/press-release%' THEN -100 ELSE (CASE WHEN api IS NOT NULL THEN 3 WHEN doi IS NOT NULL THEN 2 WHEN host LIKE '%.gov' OR host LIKE '%.edu' THEN 2 WHEN author IS NULL AND year IS NULL AND venue IS NULL THEN -2 ELSE 0 END) + CASE WHEN doi IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN author IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN venue IS NOT NULL THEN 1 ELSE 0 END END"
SOURCES_SQL = "SELECT event_id AS id, 'https://h.example' || CASE event_id % 9 WHEN 0 THEN '/wiki/x' WHEN 1 THEN '/press-release/1' ELSE '/a' END AS url, CASE event_id % 4 WHEN 0 THEN 'x.gov' WHEN 1 THEN 'y.edu' ELSE 'z.org' END AS host, CASE WHEN event_id % 5 = 0 THEN 'openalex' END AS api, CASE WHEN event_id % 3 = 0 THEN '10.1/x' END AS doi, CASE WHEN event_id % 2 = 0 THEN 'A' END AS author, CASE WHEN event_id % 7 = 0 THEN 2020 END AS year, CASE WHEN event_id % 11 = 0 THEN 'V' END AS venue FROM events"


@query("V13_source_quality", f"SELECT id, {QUALITY_SQL} AS score FROM ({SOURCES_SQL})")
def v13(spark, sf_dir):
    d = i_events(spark, sf_dir).select(F.expr("event_id as id"), *[F.expr(x) for x in ("concat('https://h.example', CASE event_id % 9 WHEN 0 THEN '/wiki/x' WHEN 1 THEN '/press-release/1' ELSE '/a' END) as url", "CASE event_id % 4 WHEN 0 THEN 'x.gov' WHEN 1 THEN 'y.edu' ELSE 'z.org' END as host", "CASE WHEN event_id % 5 = 0 THEN 'openalex' END as api", "CASE WHEN event_id % 3 = 0 THEN '10.1/x' END as doi", "CASE WHEN event_id % 2 = 0 THEN 'A' END as author", "CASE WHEN event_id % 7 = 0 THEN 2020 END as year", "CASE WHEN event_id % 11 = 0 THEN 'V' END as venue")])
    return d.select("id", idn.source_quality(*[col(c) for c in ("url", "host", "api", "doi", "author", "year", "venue")]).alias("score"))


TITLE = r"array_to_string(list_filter(string_split(regexp_replace(lower(t), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'the', 'a', 'an')), ' ')"


@query("F6_paper_identity", f"WITH p AS (SELECT item_id, text AS t, CASE WHEN item_id % 5 = 0 THEN '10.1/AB' || item_id END AS doi, CASE WHEN item_id % 3 > 0 THEN 'Ann B. Smith' || item_id END AS who, CASE WHEN item_id % 2 = 0 THEN 2000 + item_id END AS y FROM benchmark) SELECT item_id, coalesce('doi:' || lower(doi), CASE WHEN who IS NOT NULL AND y IS NOT NULL THEN 'meta:' || substr(md5({TITLE} || '|smith' || item_id || '|' || y), 1, 12) END, 'title:' || substr(md5({TITLE}), 1, 12)) AS paper_id FROM p")
def f6(spark, sf_dir):
    i = col("item_id")
    tag = lambda p: F.concat(F.lit(p), i.cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", idn.paper_id(F.when(i % 5 == 0, tag("10.1/AB")), col("text"), F.when(i % 3 > 0, tag("Ann B. Smith")), F.when(i % 2 == 0, 2000 + i)).alias("paper_id"))


@query("F8_registry_merge", "WITH a AS (SELECT p_partkey AS canonical_id, p_name AS t, CASE WHEN p_partkey % 4 = 0 THEN 'abs' END AS abstract FROM part WHERE p_partkey % 2 = 0), s AS (SELECT p_partkey AS canonical_id, p_type AS u FROM part WHERE p_partkey % 3 = 0) SELECT canonical_id, CASE WHEN t IS NOT NULL AND u IS NOT NULL THEN 'both' WHEN t IS NOT NULL THEN 'api' ELSE 'serp' END AS source, coalesce(t, u) AS title, abstract IS NULL AS needs_fetch FROM a FULL JOIN s USING (canonical_id)")
def f8(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), col("p_partkey")
    a = p.where("p_partkey % 2 = 0").select(k.alias("canonical_id"), col("p_name").alias("title"), F.when(k % 4 == 0, "abs").alias("abstract"))
    return ev.merge_registry(a, p.where("p_partkey % 3 = 0").select(k.alias("canonical_id"), col("p_type").alias("title")))


@query("F12_network_names", "SELECT user_id, 'host' || user_id || '.example.org' AS domain, 'ann@host' || user_id || '.org' AS email, '+8190' || user_id AS phone, '10.0.' || (user_id % 200) || '.7' AS ip FROM (SELECT DISTINCT user_id FROM events)")
def f12(spark, sf_dir):
    u = col("user_id").cast("string")
    d = i_events(spark, sf_dir).select("user_id").distinct()
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    return d.select("user_id", idn.network_domain(c("HTTPS://Host", u, ".Example.ORG:80/x")).alias("domain"), idn.email(c(" Ann@Host", u, ".org ")).alias("email"), idn.phone(c("0 90-", u), F.lit("jp")).alias("phone"), idn.ip(c("010.000.", F.lpad((col("user_id") % 200).cast("string"), 3, "0"), ".007")).alias("ip"))


RULES = [("example.com", "trusted", 1), ("*.spam-farm.example.org", "blocked", 9), ("spam-farm.example.org", "low", 2), ("example.org", "academic", 1), ("net", "low", 0)]


@query("F17_domain_policy", "WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages), r(pattern, category, priority) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in RULES) + "), m AS (SELECT host, pattern, category, row_number() OVER (PARTITION BY host ORDER BY priority DESC, length(replace(pattern, '*.', '')) DESC, pattern DESC) AS k FROM h JOIN r ON host = replace(pattern, '*.', '') OR ends_with(host, '.' || replace(pattern, '*.', ''))) SELECT h.host, coalesce(category, 'unverified') AS category, pattern FROM h LEFT JOIN m ON m.host = h.host AND k = 1")
def f17(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)).alias("host"))
    return ev.domain_policy(h, spark.createDataFrame(RULES, "pattern string, category string, priority int"))


@query("F13_entity_match")
def f13(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    names = s.select(F.concat("s_name", F.when(col("s_suppkey") % 2 == 0, " Inc.").otherwise(" LTD")).alias("name"))
    return ev.entity_matches(names, s.select(col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" inc")).alias("name")), s.select(col("s_suppkey").alias("entity_id"), F.concat(F.lit("The "), "s_name").alias("alias")))


@query("F15_search_operators", "SELECT conv_id, turn, 'a.org' AS site, 'pdf' AS filetype, 1 AS exact, ['ads'] AS excluded FROM conversations")
def f15(spark, sf_dir):
    q = F.concat(F.lit("site:a.org filetype:pdf \"x y\" -ads "), F.regexp_replace("text", r'["\-:]', " "))
    o = idn.search_operators(q)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", o["site"].alias("site"), o["filetype"].alias("filetype"), F.size(o["exact"]).alias("exact"), o["excluded"].alias("excluded"))


@query("F29_masking", r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g') = text AS no_email FROM documents")
def f29(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (~idn.mask_secrets(col("text")).contains("[email]")).alias("no_email"))


@query("C16_link_priority", "SELECT page_id, round(least(1, 0.6::DOUBLE + CASE WHEN regexp_matches(lower(url), 'detail|more') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(url), 'document|report|paper') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(url), 'official|source') THEN 0.15::DOUBLE ELSE 0 END), 6) AS priority FROM pages")
def c16(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.round(idn.link_priority(F.lit("body"), col("url")), 6).alias("priority"))


@query("H5_links", r"""WITH n AS (SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s[^>]*href="[^"]*"[^>]*>')) AS links, len(regexp_extract_all(regexp_extract(html, '(?is)<nav>.*?</nav>'), '(?i)<a\s')) AS navigation FROM pages) SELECT * FROM n WHERE links > 0""")
def h5(spark, sf_dir):
    d = ev.links(table(spark, sf_dir, "pages"))
    return d.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(col("kind") == "navigation").alias("navigation"))


@query("H6_citation_candidates")
def h6(spark, sf_dir):
    d = ev.links(table(spark, sf_dir, "pages")).where(col("kind").isin("body", "heading", "navigation"))
    return gr.ranked(d, [F.desc("priority"), F.asc("position")], 5, ["page_id"]).select("page_id", "href", "priority")


@query("A16_fragments")
def a16(spark, sf_dir):
    return ev.html_fragments(table(spark, sf_dir, "pages"))


@query("X36_llm_scores", "SELECT conv_id, turn, CASE WHEN regexp_extract(trim(text), '(\\d+)', 1) <> '' THEN least(10, substr(regexp_extract(trim(text), '(\\d+)', 1), 1, 4)::INT) END AS score, CASE WHEN regexp_replace(upper(text), '[^A-Z]', '', 'g') LIKE 'YES%' THEN 'YES' WHEN regexp_replace(upper(text), '[^A-Z]', '', 'g') LIKE 'NO%' THEN 'NO' END AS answer FROM conversations")
def x36(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", idn.score_0_10(col("text")).alias("score"), idn.yes_no(col("text")).alias("answer"))


@query("X22_task_metrics", "SELECT user_id, count(*) AS requests, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) AS error_rate, coalesce(count(*) FILTER (event_type = 'purchase')::DOUBLE / nullif(count(*) FILTER (event_type = 'click'), 0), 0) AS harvest FROM events GROUP BY 1")
def x22(spark, sf_dir):
    k = col("event_type")
    n = lambda x: F.count_if(k == x)
    return i_events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("requests"), F.countDistinct("event_type").alias("kinds"), (n("error") / F.count("*")).alias("error_rate"), F.coalesce(F.try_divide(n("purchase"), n("click")), F.lit(0.0)).alias("harvest"))


@query("X23_collector_ema", "SELECT event_type, round(list_reduce(list_prepend(0.5::DOUBLE, list(value ORDER BY ts, event_id)), lambda e, x: 0.01::DOUBLE * x + 0.99::DOUBLE * e), 5) AS ema FROM events GROUP BY 1")
def x23(spark, sf_dir):
    return st.ema(i_events(spark, sf_dir), "event_type", ["ts", "event_id"], col("value"), 0.01, 0.5).select("event_type", F.round("ema", 5).alias("ema"))


HARVEST = "(conv_id * 37 % 100)::DOUBLE / 100"


@query("X1_similar_queries", "WITH u AS (SELECT conv_id, list_distinct(regexp_extract_all(lower('drug effect on ' || text), '[\\p{L}\\p{N}_]+')) AS w, " + HARVEST + " AS harvest FROM conversations WHERE role = 'user' AND turn = 0), r AS (SELECT * FROM u WHERE harvest > 0.2::DOUBLE ORDER BY conv_id DESC LIMIT 10), s AS (SELECT q.conv_id AS query_id, r.conv_id, round(len(list_intersect(q.w, r.w))::DOUBLE / least(len(q.w), len(r.w)), 9) AS overlap FROM u q, r WHERE q.conv_id % 100 = 0 AND q.conv_id <> r.conv_id AND len(q.w) > 0 AND len(r.w) > 0) SELECT query_id, conv_id, overlap FROM s WHERE overlap > 0.3::DOUBLE QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY conv_id DESC) <= 5")
def x1(spark, sf_dir):
    from quern.functions import text as tx

    u = table(spark, sf_dir, "conversations").where("role = 'user' and turn = 0").select("conv_id", F.array_distinct(tx.tokens(F.concat(F.lit("drug effect on "), "text"))).alias("w"), (col("conv_id") * 37 % 100 / 100).alias("harvest"))
    return ev.similar_queries(u.where("conv_id % 100 = 0").select(col("conv_id").alias("query_id"), "w"), u)


on_graph("G24_entity_relations", lambda g: g.cites.select(F.col("source_id").alias("entity"), F.col("target_id").alias("neighbour")), "SELECT source_id AS entity, target_id AS neighbour FROM g_cites")
on_graph("G25_bfs", lambda g: ev.bfs(g.pages.where("id = 1").select("id"), g.cites.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), (F.col("target_id") % 10 / 10).alias("priority"))), """
q_1 AS (SELECT target_id AS id FROM g_cites WHERE source_id = 1 AND target_id <> 1 GROUP BY 1 ORDER BY max(target_id % 10) DESC, 1 LIMIT 50),
q_2 AS (SELECT target_id AS id FROM g_cites WHERE source_id IN (SELECT id FROM q_1) AND target_id <> 1 AND target_id NOT IN (SELECT id FROM q_1) GROUP BY 1 ORDER BY max(target_id % 10) DESC, 1 LIMIT 50)
SELECT 1::BIGINT AS id, 0 AS depth UNION ALL SELECT id, 1 FROM q_1 UNION ALL SELECT id, 2 FROM q_2""")
on_graph("G2_simple_edges", lambda g: gr.simple_edges(g.edges, "id").select("source_type", "source_id", "target_type", "target_id", "relation"), "SELECT source_type, source_id, target_type, target_id, arg_max(relation, id) AS relation FROM g_edges GROUP BY 1, 2, 3, 4")
on_graph("G21_claim_assessment", lambda g: gr.claim_confidence(g).join(gr.evidence_by_relation(g), "claim_id", "left").select("claim_id", "confidence", F.coalesce(F.size("supports"), F.lit(0)).cast("long").alias("n_supports"), F.coalesce(F.size("refutes"), F.lit(0)).cast("long").alias("n_refutes")), "SELECT c.id AS claim_id, round((1 + coalesce(sum(nli_edge_confidence::DECIMAL(18,9)) FILTER (relation = 'supports'), 0)::DOUBLE) / (2 + coalesce(sum(nli_edge_confidence::DECIMAL(18,9)) FILTER (relation IN ('supports', 'refutes')), 0)::DOUBLE), 3) AS confidence, count(*) FILTER (relation = 'supports') AS n_supports, count(*) FILTER (relation = 'refutes') AS n_refutes FROM g_claims c LEFT JOIN g_nli n ON n.target_id = c.id GROUP BY 1")
