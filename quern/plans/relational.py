"""Registered queries: the named views (R) on the bridged evidence graph."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quern.operators import views as v
from quern.sources.graph import table

from .registry import on_graph, query

YEAR = 2026
AS_OF = datetime(2024, 1, 20)

SUMMARY = """
q_edges AS (SELECT target_id, sum(CASE WHEN relation = 'supports' THEN 1 ELSE 0 END)::BIGINT AS s, sum(CASE WHEN relation = 'refutes' THEN 1 ELSE 0 END)::BIGINT AS r, sum(CASE WHEN relation = 'neutral' THEN 1 ELSE 0 END)::BIGINT AS n, count(*) AS e, max(nli_edge_confidence) AS mx, sum(nli_edge_confidence::DECIMAL(18,9))::DOUBLE AS total,
  sum(CASE WHEN relation = 'supports' THEN nli_edge_confidence ELSE 0 END::DECIMAL(18,9))::DOUBLE AS sw, sum(CASE WHEN relation = 'refutes' THEN nli_edge_confidence ELSE 0 END::DECIMAL(18,9))::DOUBLE AS rw FROM g_nli GROUP BY target_id),
q_summary AS (SELECT task_id, id AS claim_id, claim_text, coalesce(s, 0) AS support_count, coalesce(r, 0) AS refute_count, coalesce(n, 0) AS neutral_count, coalesce(e, 0) AS evidence_count, coalesce(mx, 0) AS max_nli_edge_confidence, coalesce(total / e, 0) AS avg_nli_edge_confidence, coalesce(sw, 0) AS support_weight, coalesce(rw, 0) AS refute_weight,
  round((1.0::DOUBLE + coalesce(sw, 0)) / ((1.0::DOUBLE + coalesce(sw, 0)) + (1.0::DOUBLE + coalesce(rw, 0))), 4) AS nli_claim_support_ratio FROM g_claims LEFT JOIN q_edges ON id = target_id)
"""
LOCATED = """
q_located AS (SELECT e.id AS edge_id, e.source_id AS fragment_id, e.target_id AS claim_id, e.relation, e.nli_edge_confidence, c.task_id, c.claim_text, c.llm_claim_confidence, f.page_id, f.heading_context, f.text_content, p.url, p.domain, p.title, w.canonical_id AS work_id, w.year, w.venue, w.doi, w.source_api, a.authors, a.first_author
  FROM g_edges e JOIN g_claims c ON e.target_type = 'claim' AND e.target_id = c.id JOIN g_fragments f ON e.source_type = 'fragment' AND e.source_id = f.id JOIN g_pages p ON f.page_id = p.id LEFT JOIN g_works w ON p.canonical_id = w.canonical_id LEFT JOIN g_author a ON a.canonical_id = w.canonical_id),
q_ev AS (SELECT * FROM q_located WHERE relation IN ('supports', 'refutes', 'neutral')),
q_in AS (SELECT target_id AS page_id, count(*) AS n FROM g_cites GROUP BY 1),
q_out AS (SELECT source_id AS page_id, count(*) AS n FROM g_cites GROUP BY 1)
"""
AUTHOR = "CASE WHEN authors IS NULL THEN 'unknown' WHEN authors = 1 THEN first_author ELSE first_author || ' et al.' END"

on_graph("R7_claim_evidence_summary", v.claim_evidence_summary, SUMMARY + "SELECT * FROM q_summary")
on_graph("R8_contradictions", v.contradictions, SUMMARY + "SELECT task_id, claim_id, claim_text, support_count, refute_count, neutral_count, evidence_count, least(support_count, refute_count)::DOUBLE / evidence_count AS controversy_score FROM q_summary WHERE support_count > 0 AND refute_count > 0")
on_graph("R9_unsupported_claims", v.unsupported_claims, SUMMARY + "SELECT task_id, claim_id, claim_text, evidence_count FROM q_summary WHERE evidence_count = 0")
on_graph("R10_claim_origins", v.claim_origins, LOCATED + f"SELECT task_id, claim_id, claim_text, edge_id AS origin_edge_id, fragment_id, text_content AS fragment_text, heading_context, page_id, url, domain, title AS page_title, year, venue, doi, source_api, {AUTHOR} AS author_display FROM q_located WHERE relation = 'origin'")
on_graph("R11_evidence_chain", v.evidence_chain, LOCATED + f"SELECT task_id, edge_id, relation, nli_edge_confidence, fragment_id, heading_context, page_id, url, domain, claim_id, claim_text, year, venue, doi, source_api, CASE WHEN work_id IS NOT NULL THEN {AUTHOR} END AS author_display FROM q_ev")
on_graph("R12_citation_flow", v.citation_flow, "SELECT source_id AS citing_page_id, target_id AS cited_page_id, created_at FROM g_cites")
on_graph("R13_orphan_sources", v.orphan_sources, LOCATED + "SELECT DISTINCT task_id, page_id, url, title, domain, 0::BIGINT AS cited_by_count FROM q_ev WHERE page_id NOT IN (SELECT page_id FROM q_in)")
on_graph("R14_evidence_with_year", v.evidence_with_year, LOCATED + "SELECT task_id, claim_id, claim_text, relation, fragment_id, page_id, domain, year FROM q_ev")
on_graph("R15_evidence_timeline", v.evidence_timeline, LOCATED + "SELECT task_id, year, count(DISTINCT fragment_id) AS fragment_count, count(DISTINCT claim_id) AS claim_count FROM q_ev GROUP BY 1, 2")
on_graph("R16_emerging_consensus", lambda g: v.emerging_consensus(g, YEAR), LOCATED + f"SELECT task_id, claim_id, claim_text, count(*) FILTER (year >= {YEAR - 2}) AS recent_support_count, count(*) FILTER (year IS NULL OR year < {YEAR - 2}) AS older_support_count, count(*) FILTER (year >= {YEAR - 2}) - count(*) FILTER (year IS NULL OR year < {YEAR - 2}) AS support_trend FROM q_ev WHERE relation = 'supports' GROUP BY 1, 2, 3")
on_graph("R17_outdated_evidence", lambda g: v.outdated_evidence(g, YEAR), LOCATED + f"SELECT task_id, claim_id, claim_text, max(year) AS newest_evidence_year, {YEAR} - max(year) AS years_since_update FROM q_ev WHERE relation = 'supports' GROUP BY 1, 2, 3")
on_graph("R18_source_authority", v.source_authority, LOCATED + """, q_a AS (SELECT task_id, page_id, url, title, domain, year, count(DISTINCT claim_id) AS claims_supported FROM q_ev WHERE relation = 'supports' GROUP BY ALL)
SELECT q_a.*, coalesce(o.n, 0) AS citation_count, coalesce(i.n, 0) AS cited_by_count, round(claims_supported * 1.0::DOUBLE + coalesce(i.n, 0) * 0.5::DOUBLE + coalesce(o.n, 0) * 0.2::DOUBLE, 6) AS authority_score FROM q_a LEFT JOIN q_out o USING (page_id) LEFT JOIN q_in i USING (page_id)""")
on_graph("R19_source_impact", v.source_impact, LOCATED + """, q_g AS (SELECT task_id, page_id, url, title, domain, count(DISTINCT claim_id) AS n, sum(llm_claim_confidence::DECIMAL(18,9))::DOUBLE / count(llm_claim_confidence) AS av FROM q_located WHERE relation = 'origin' GROUP BY ALL),
q_s AS (SELECT task_id, page_id, count(DISTINCT edge_id) AS k FROM q_ev WHERE relation = 'supports' GROUP BY ALL)
SELECT task_id, page_id, url, title, domain, n AS claims_generated, round(av, 4) AS avg_claim_confidence, coalesce(k, 0) AS claims_supported, round(n + coalesce(av, 0.5::DOUBLE) * n * 0.5::DOUBLE + coalesce(k, 0) * 0.3::DOUBLE, 2) AS impact_score FROM q_g LEFT JOIN q_s USING (task_id, page_id)""")
on_graph("R20_citation_age_gap", v.citation_age_gap, """
q_y AS (SELECT p.id, w.year FROM g_pages p LEFT JOIN g_works w ON p.canonical_id = w.canonical_id)
SELECT c.source_id AS citing_page_id, c.target_id AS cited_page_id, a.year AS citing_year, b.year AS cited_year, a.year - b.year AS age_gap FROM g_cites c JOIN q_y a ON a.id = c.source_id JOIN q_y b ON b.id = c.target_id""")
on_graph("R21_evidence_freshness", lambda g: v.evidence_freshness(g, YEAR), LOCATED + f"SELECT task_id, claim_id, claim_text, sum({YEAR} - year)::DOUBLE / count(*) AS avg_evidence_age, max(CASE WHEN relation = 'supports' AND year >= {YEAR - 2} THEN 1 ELSE 0 END) AS has_recent_support, max(CASE WHEN relation = 'refutes' AND year >= {YEAR - 2} THEN 1 ELSE 0 END) AS has_recent_refutation FROM q_ev WHERE year IS NOT NULL GROUP BY 1, 2, 3")
on_graph("R22_bibliographic_coupling", v.bibliographic_coupling, "SELECT a.target_id AS page_a, b.target_id AS page_b, count(DISTINCT a.source_id) AS shared_citations FROM g_cites a JOIN g_cites b ON a.source_id = b.source_id AND a.target_id < b.target_id GROUP BY 1, 2")
on_graph("R23_citation_chains", v.citation_chains, "SELECT a.source_id AS page_a, substr(pa.title, 1, 60) AS title_a, a.target_id AS page_b, substr(pb.title, 1, 60) AS title_b, b.target_id AS page_c, substr(pc.title, 1, 60) AS title_c FROM g_cites a JOIN g_cites b ON a.target_id = b.source_id JOIN g_pages pa ON pa.id = a.source_id JOIN g_pages pb ON pb.id = a.target_id JOIN g_pages pc ON pc.id = b.target_id")
on_graph("R24_author_display", lambda g: v.author_display(g, g.works.select(F.col("canonical_id").alias("work_id")), None, "unknown"), f"SELECT w.canonical_id AS work_id, {AUTHOR} AS author_display FROM g_works w LEFT JOIN g_author a ON a.canonical_id = w.canonical_id")
on_graph("R25_reference_candidates", lambda g: v.reference_candidates(g, 1), """
SELECT e.id AS citation_edge_id, p.id AS candidate_page_id, p.url AS candidate_url, p.domain AS candidate_domain, p.html_path AS candidate_html_path, sp.id AS citing_page_id, sp.url AS citing_page_url, sp.domain AS citing_domain, tp.depth AS citing_depth, tp.reason AS citing_reason, e.created_at AS citation_created_at
FROM g_cites e JOIN g_pages p ON e.target_id = p.id JOIN g_pages sp ON sp.id = e.source_id JOIN g_task_pages tp ON tp.page_id = sp.id AND tp.task_id = 1
WHERE p.url NOT ILIKE 'javascript:%' AND p.url NOT ILIKE 'mailto:%' AND p.url NOT ILIKE '#%' AND p.url NOT ILIKE 'tel:%' AND p.id NOT IN (SELECT page_id FROM g_task_pages WHERE task_id = 1)
AND p.id NOT IN (SELECT f.page_id FROM g_fragments f JOIN g_origin o ON o.source_id = f.id JOIN g_claims c ON c.id = o.target_id AND c.task_id = 1)""")
on_graph("R25b_candidates_by_depth", lambda g: v.reference_candidates(g, 2).groupBy("citing_depth").agg(F.count("*").alias("candidates")), """
SELECT tp.depth AS citing_depth, count(*) AS candidates FROM g_cites e JOIN g_pages p ON e.target_id = p.id JOIN g_task_pages tp ON tp.page_id = e.source_id AND tp.task_id = 2 JOIN g_pages sp ON sp.id = e.source_id
WHERE p.url NOT ILIKE 'javascript:%' AND p.url NOT ILIKE 'mailto:%' AND p.id NOT IN (SELECT page_id FROM g_task_pages WHERE task_id = 2)
AND p.id NOT IN (SELECT f.page_id FROM g_fragments f JOIN g_origin o ON o.source_id = f.id JOIN g_claims c ON c.id = o.target_id AND c.task_id = 2) GROUP BY 1""")


# R1-R6 work on operational tables, which derive from events and the star schema.
ENGINES_SQL = """
WITH engines AS (SELECT event_type AS engine, CASE WHEN count(*) % 3 = 0 THEN 'open' ELSE 'closed' END AS status, count(*)::DOUBLE / 10 AS weight, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 4) AS success_rate_1h, 0.0::DOUBLE AS captcha_rate, 100::BIGINT AS median_latency_ms, count(*) FILTER (user_id % 2 = 0) AS daily_usage, CASE WHEN count(*) % 2 = 0 THEN count(*) // 2 END AS daily_limit, CASE WHEN count(*) % 5 < 3 THEN max(ts) END AS cooldown_until FROM events GROUP BY event_type)
"""


def engines(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("engine")).agg(
        F.when(n % 3 == 0, "open").otherwise("closed").alias("status"), (n / 10).alias("weight"), F.round(F.count_if(F.col("value") < 50) / n, 4).alias("success_rate_1h"), F.lit(0.0).alias("captcha_rate"),
        F.lit(100).cast("long").alias("median_latency_ms"), F.count_if(F.col("user_id") % 2 == 0).alias("daily_usage"), F.when(n % 2 == 0, F.floor(n / 2)).alias("daily_limit"), F.when(n % 5 < 3, F.max("ts")).alias("cooldown_until"),
    )


@query("R1_active_engines", ENGINES_SQL.replace("round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 4)", "round(count(*) FILTER (value < 50)::DOUBLE / count(*), 4)") + "SELECT engine, status, weight, success_rate_1h, captcha_rate, median_latency_ms, daily_usage, daily_limit FROM engines WHERE status <> 'open' AND (cooldown_until IS NULL OR cooldown_until < TIMESTAMP '2024-02-20 00:00:00') AND (daily_limit IS NULL OR daily_usage < daily_limit)")
def r1(spark, sf_dir):
    return v.active_engines(engines(spark, sf_dir), datetime(2024, 2, 20))


DOMAINS_SQL = "WITH domains AS (SELECT 'u' || user_id AS domain, max(ts) FILTER (event_type = 'error') AS cooldown_until, max(ts) FILTER (event_type = 'signup') AS skip_until, 'errors' AS skip_reason, count(*) FILTER (event_type = 'error') AS block_score, 0.0::DOUBLE AS captcha_rate FROM events GROUP BY user_id) "


@query("R2_domain_cooldowns", DOMAINS_SQL + "SELECT * FROM domains WHERE cooldown_until > TIMESTAMP '2024-01-20 00:00:00' OR skip_until > TIMESTAMP '2024-01-20 00:00:00'")
def r2(spark, sf_dir):
    kind = F.col("event_type")
    d = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("domain")).agg(F.max(F.when(kind == "error", F.col("ts"))).alias("cooldown_until"), F.max(F.when(kind == "signup", F.col("ts"))).alias("skip_until"), F.lit("errors").alias("skip_reason"), F.count_if(kind == "error").alias("block_score"), F.lit(0.0).alias("captcha_rate"))
    return v.domain_cooldowns(d, AS_OF)


on_graph(
    "R3_task_progress",
    lambda g: v.task_progress(g.tasks, g.claims.where("id % 7 = 0").select((F.col("id") + 0).alias("id"), "task_id"), g.claims.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.concat(F.lit("https://"), F.lit("x")).alias("u")).join(g.pages.select("url", F.col("id").alias("p")), F.col("query_id") == F.col("p")).select("query_id", "url"), g.pages, g.fragments, g.claims),
    """
q_q AS (SELECT id AS query_id, task_id FROM g_claims WHERE id % 7 = 0), q_serp AS (SELECT query_id, url FROM q_q JOIN g_pages ON g_pages.id = query_id),
q_hit AS (SELECT DISTINCT task_id, p.id AS page_id FROM q_q JOIN q_serp USING (query_id) JOIN g_pages p USING (url))
SELECT t.id AS task_id, t.hypothesis, t.status, (SELECT count(*) FROM q_q WHERE q_q.task_id = t.id) AS query_count, (SELECT count(*) FROM q_hit h WHERE h.task_id = t.id) AS page_count, (SELECT count(DISTINCT f.id) FROM q_hit h JOIN g_fragments f ON f.page_id = h.page_id WHERE h.task_id = t.id) AS fragment_count, (SELECT count(*) FROM g_claims c WHERE c.task_id = t.id) AS claim_count FROM g_tasks t""",
)


@query("R4_latest_metrics", "SELECT event_id, ts, value FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 1")
def r4(spark, sf_dir):
    return v.latest(table(spark, sf_dir, "events").select("event_id", "ts", "value"), "ts", 1, "event_id")


@query("R5_recent_policy_updates", "SELECT ts, event_type AS target_type, user_id AS target_id, event_id FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 100")
def r5(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("target_type"), F.col("user_id").alias("target_id"), "event_id")
    return v.latest(d, "ts", 100, "event_id")


on_graph(
    "R6_task_metrics_summary",
    lambda g: v.task_metrics_summary(g.tasks, g.task_pages.where("task_id < 4").groupBy("task_id").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in (("total_queries", "depth = 0"), ("total_pages_fetched", "depth > 0"), ("useful_fragments", "depth > 1"), ("total_claims", "depth = 2"), ("primary_sources", "reason = 'serp'"), ("total_sources", "true"), ("llm_time_ms", "depth = 3"), ("total_time_ms", "depth > 5"))])),
    """
q_m AS (SELECT task_id, count(*) FILTER (depth = 0) AS total_queries, count(*) FILTER (depth > 0) AS total_pages_fetched, count(*) FILTER (depth > 1) AS useful_fragments, count(*) FILTER (depth = 2) AS total_claims, count(*) FILTER (reason = 'serp') AS primary_sources, count(*) AS total_sources FROM g_task_pages WHERE task_id < 4 GROUP BY 1)
SELECT t.id AS task_id, t.hypothesis, t.status, total_queries, total_pages_fetched, useful_fragments, total_claims, CASE WHEN total_pages_fetched > 0 THEN useful_fragments::DOUBLE / total_pages_fetched ELSE 0 END AS harvest_rate, CASE WHEN total_sources > 0 THEN primary_sources::DOUBLE / total_sources ELSE 0 END AS primary_source_rate, 0.0::DOUBLE AS llm_time_ratio FROM g_tasks t LEFT JOIN q_m ON t.id = q_m.task_id""",
)
