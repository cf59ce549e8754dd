"""Registered queries: reporting queries (S) and graph operators (G) on the bridged evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import graph as gr
from quern.operators import reports as rp
from quern.operators import views as v
from quern.sources.graph import table

from .registry import BRIDGE_SQL, on_graph, query
from .relational import AUTHOR, LOCATED, SUMMARY

TOP = "ORDER BY evidence_count DESC, refute_count DESC, nli_claim_support_ratio DESC, claim_id"
on_graph("S1_top_claims", lambda g: rp.top_claims(g, 1, 30), SUMMARY + f"SELECT row_number() OVER ({TOP}) AS rank, claim_id, claim_text, support_count, refute_count, evidence_count, nli_claim_support_ratio FROM q_summary WHERE task_id = 1 {TOP} LIMIT 30")
on_graph("S2_top_contradictions", lambda g: rp.top_contradictions(g, 1, 15), SUMMARY + "SELECT claim_id, support_count, refute_count, least(support_count, refute_count)::DOUBLE / evidence_count AS controversy_score FROM q_summary WHERE task_id = 1 AND support_count > 0 AND refute_count > 0 ORDER BY controversy_score DESC, evidence_count DESC, claim_id LIMIT 15")
on_graph("S3_chains_of_top_claims", lambda g: rp.chains_of(g, rp.top_claims(g, 1, 30).select("claim_id")).drop("author_display"), SUMMARY + "," + LOCATED + f"SELECT task_id, edge_id, relation, nli_edge_confidence, fragment_id, heading_context, page_id, url, domain, claim_id, claim_text, year, venue, doi, source_api FROM q_ev WHERE claim_id IN (SELECT claim_id FROM q_summary WHERE task_id = 1 {TOP} LIMIT 30)")
on_graph("S4_citations_for_pages", lambda g: rp.page_citations(g, 1), LOCATED + f""", q_s AS (SELECT page_id, count(DISTINCT claim_id) AS k FROM q_ev WHERE relation = 'supports' AND task_id = 1 GROUP BY 1)
SELECT page_id, any_value(url) AS url, any_value(title) AS title, any_value(year) AS year, any_value(doi) AS doi, any_value(venue) AS venue, any_value(CASE WHEN work_id IS NOT NULL AND authors IS NOT NULL THEN {AUTHOR} END) AS author_display, coalesce(any_value(k), 0) AS claims_supported FROM q_ev LEFT JOIN q_s USING (page_id) WHERE task_id = 1 GROUP BY page_id""")
on_graph("S5_citation_flow_of_task", lambda g: rp.flow_touching(g, g.task_pages.where("task_id = 1").select("page_id")), "SELECT DISTINCT source_id AS citing_page_id, target_id AS cited_page_id FROM g_cites WHERE source_id IN (SELECT page_id FROM g_task_pages WHERE task_id = 1) OR target_id IN (SELECT page_id FROM g_task_pages WHERE task_id = 1)")
on_graph("S6_citation_index", rp.citation_index, "SELECT p.id AS page_id, p.url, w.doi IS NOT NULL AS has_doi, a.authors IS NOT NULL AS has_author, w.year IS NOT NULL AS has_year FROM g_pages p LEFT JOIN g_works w USING (canonical_id) LEFT JOIN g_author a ON a.canonical_id = w.canonical_id")
on_graph("S7_evidence_pack_counts", lambda g: rp.pack_counts(g, 1), SUMMARY + "," + LOCATED + "SELECT (SELECT count(*) FROM g_claims WHERE task_id = 1) AS claims, (SELECT count(*) FROM q_ev WHERE task_id = 1) AS evidence_chains, (SELECT count(DISTINCT page_id) FROM q_ev WHERE task_id = 1) AS sources, (SELECT count(*) FROM q_summary WHERE task_id = 1 AND support_count > 0 AND refute_count > 0) AS contradictions")
on_graph("S8_dashboard_claims", lambda g: rp.dashboard_claims(g, 2), SUMMARY + f"SELECT claim_id, claim_text, row_number() OVER ({TOP}) AS rank, row_number() OVER ({TOP}) <= 30 AS in_top FROM q_summary WHERE task_id = 2")
on_graph("S9_dashboard_sources", lambda g: rp.dashboard_sources(g, 2), LOCATED + "SELECT page_id, url, title, domain, year, count(DISTINCT claim_id) AS claims FROM q_located WHERE relation IN ('supports', 'origin') AND task_id = 2 GROUP BY ALL")
on_graph("S10_dashboard_fragments", lambda g: rp.dashboard_fragments(g, 2), LOCATED + "SELECT fragment_id, page_id, substr(any_value(text_content), 1, 500) AS text, list_sort(list(DISTINCT claim_id)) AS claim_ids FROM q_located WHERE task_id = 2 GROUP BY 1, 2")
on_graph("S11_dashboard_edges", lambda g: rp.dashboard_edges(g, 2), """
q_pages AS (SELECT DISTINCT f.page_id FROM g_edges e JOIN g_claims c ON c.id = e.target_id AND e.target_type = 'claim' AND c.task_id = 2 JOIN g_fragments f ON f.id = e.source_id)
SELECT e.id AS edge_id, e.source_type, e.source_id, e.target_type, e.target_id, e.relation FROM g_edges e JOIN g_claims c ON e.target_type = 'claim' AND c.id = e.target_id AND c.task_id = 2
UNION ALL SELECT id, source_type, source_id, target_type, target_id, relation FROM (SELECT * FROM g_cites SEMI JOIN q_pages ON source_id = page_id UNION SELECT * FROM g_cites SEMI JOIN q_pages ON target_id = page_id)""")
on_graph("S12_dashboard_citations", lambda g: g.cites.join(g.task_pages.where("task_id = 2").select(F.col("page_id").alias("source_id")), "source_id", "left_semi").select("source_id", "target_id").distinct(), "SELECT DISTINCT source_id, target_id FROM g_cites WHERE source_id IN (SELECT page_id FROM g_task_pages WHERE task_id = 2)")
on_graph("S13_dashboard_contradictions", rp.dashboard_contradictions, SUMMARY + "SELECT task_id, claim_id, support_count, refute_count, round(refute_count::DOUBLE / (support_count + refute_count + 1), 3) AS controversy FROM q_summary WHERE refute_count > 0")
on_graph("S14_dashboard_timeline", lambda g: v.evidence_with_year(g).where("task_id = 1 and year is not null").groupBy("year").agg(F.countDistinct("fragment_id").alias("fragments"), F.count("*").alias("edges")), LOCATED + "SELECT year, count(DISTINCT fragment_id) AS fragments, count(*) AS edges FROM q_ev WHERE task_id = 1 AND year IS NOT NULL GROUP BY 1")
on_graph("S15_dashboard_stats", rp.dashboard_stats, LOCATED + "SELECT task_id, count(DISTINCT claim_id) AS claims, count(DISTINCT page_id) AS pages, count(DISTINCT fragment_id) AS fragments FROM q_located GROUP BY 1")
on_graph("S16_analysis_summary", rp.analysis_summary, SUMMARY + "SELECT task_id, count(*) AS claims, round(sum(nli_claim_support_ratio::DECIMAL(18,9))::DOUBLE / count(*), 4) AS mean_ratio, max(nli_claim_support_ratio) AS best_ratio, sum(evidence_count)::BIGINT AS evidence FROM q_summary GROUP BY 1")
on_graph("S17_top_domains", lambda g: rp.top_domains(g, 1, 10), LOCATED + "SELECT domain, count(DISTINCT page_id) AS pages, count(*) FILTER (relation = 'supports') AS supports, count(*) FILTER (relation = 'refutes') AS refutes FROM q_ev WHERE task_id = 1 GROUP BY 1 ORDER BY pages DESC, domain LIMIT 10")
on_graph("S18_task_pages_two_paths", rp.task_page_union, LOCATED + "SELECT task_id, count(*) AS pages FROM (SELECT task_id, page_id FROM g_task_pages UNION SELECT task_id, page_id FROM q_located WHERE relation = 'origin') GROUP BY 1")


@query("S19_queue_status", "SELECT event_type, count(*) AS jobs, count(*) FILTER (json_extract_string(props, '$.k')::INT % 2 = 0) AS even, max(json_extract_string(props, '$.k')::INT) AS top FROM events GROUP BY 1")
def s19(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("jobs"), F.count_if(k % 2 == 0).alias("even"), F.max(k).alias("top"))


STATES = ["queued", "running", "completed", "failed"]
JOBS_SQL = "WITH jobs AS (SELECT event_id AS id, event_type AS kind, CASE user_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS state, (event_id * 7) % 5 AS priority, ts AS queued_at FROM events) "


def jobs(spark, sf_dir) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), state.alias("state"), ((F.col("event_id") * 7) % 5).alias("priority"), F.col("ts").alias("queued_at"))


@query("S20_jobs_by_kind_state", JOBS_SQL + "SELECT kind, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in STATES) + ", count(*) AS total FROM jobs GROUP BY 1")
def s20(spark, sf_dir):
    return rp.jobs_pivot(jobs(spark, sf_dir), STATES)


@query("S21_pending_by_domain", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, count(*) AS pending FROM events WHERE event_type <> 'view' GROUP BY 1")
def s21(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"), F.count("*").alias("pending"))


@query("S23_queue_summary", JOBS_SQL + "SELECT priority, count(*) AS n, count(DISTINCT kind) AS kinds, min(queued_at) AS oldest FROM jobs WHERE state = 'queued' GROUP BY 1")
def s23(spark, sf_dir):
    return jobs(spark, sf_dir).where("state = 'queued'").groupBy("priority").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"), F.min("queued_at").alias("oldest"))


@query("S25_next_jobs", JOBS_SQL + "SELECT kind, id, priority FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY priority, queued_at, id) AS k FROM jobs WHERE state = 'queued') WHERE k <= 4")
def s25(spark, sf_dir):
    return rp.next_jobs(jobs(spark, sf_dir), 4)


@query("S26_eta", JOBS_SQL + "SELECT kind, greatest(0, count(*) FILTER (state = 'queued') - (400 - count(*) FILTER (state = 'running'))) * 30 AS eta_s FROM jobs GROUP BY 1")
def s26(spark, sf_dir):
    return rp.eta(jobs(spark, sf_dir), 400, 30)


@query("S27_duplicate_targets", "WITH t AS (SELECT event_id, event_type, CASE WHEN event_id % 4 = 0 THEN '{\"target\": {\"kind\": \"url\"}}' ELSE '{\"target\": {\"kind\": \"doi\", \"doi\": \"10.1/' || user_id % 97 || '-' || (event_id // 7) % 5 || '\"}}' END AS input_json FROM events), d AS (SELECT *, CASE WHEN json_extract_string(input_json, '$.target.kind') = 'doi' THEN lower(json_extract_string(input_json, '$.target.doi')) END AS doi FROM t) SELECT event_id, doi FROM d WHERE event_type <> 'purchase' AND doi IS NOT NULL AND doi NOT IN (SELECT doi FROM d WHERE event_type = 'purchase' AND doi IS NOT NULL)")
def s27(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    doi = F.concat(F.lit('{"target": {"kind": "doi", "doi": "10.1/'), (F.col("user_id") % 97).cast("string"), F.lit("-"), (F.floor(i / 7) % 5).cast("string"), F.lit('"}}'))
    e = e.select("event_id", "event_type", F.when(i % 4 == 0, '{"target": {"kind": "url"}}').otherwise(doi).alias("input_json"))
    return rp.new_targets(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'")).select("event_id", "doi")


on_graph("S29_claim_origin_domains", lambda g: v.located(g, g.origin).select("claim_id", "domain").distinct(), LOCATED + "SELECT DISTINCT claim_id, domain FROM q_located WHERE relation = 'origin'")
on_graph("S30_unjudged_pairs", rp.unjudged_pairs, "SELECT o.source_id AS fragment_id, o.target_id AS claim_id FROM g_origin o WHERE NOT EXISTS (SELECT 1 FROM g_nli n WHERE n.source_id = o.source_id AND n.target_id = o.target_id)")
on_graph("S31_edge_corrections", rp.edge_corrections, "SELECT id, relation AS old, CASE WHEN target_id % 3 = 0 THEN 'supports' ELSE 'refutes' END AS new, 1.0::DOUBLE AS confidence FROM g_nli WHERE source_id % 101 = 0 AND relation <> CASE WHEN target_id % 3 = 0 THEN 'supports' ELSE 'refutes' END")


@query("S33_latest_rule", "SELECT user_id, event_type AS action, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type IN ('error', 'signup', 'click')) WHERE k = 1")
def s33(spark, sf_dir):
    return rp.latest_per(table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup", "click")), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("action"), "ts")


on_graph("S34_identifier_to_page", lambda g: g.works.where("doi is not null").select("canonical_id", "doi").join(g.pages.select(F.col("id").alias("page_id"), "canonical_id"), "canonical_id").select("doi", "page_id"), "SELECT doi, p.id AS page_id FROM g_works w JOIN g_pages p USING (canonical_id) WHERE doi IS NOT NULL")


@query("S35_policy_history", "SELECT event_id, ts FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC, event_id LIMIT 50")
def s35(spark, sf_dir):
    return rp.history(table(spark, sf_dir, "events"), kind="error", since="2024-01-10 00:00:00", n=50).select("event_id", "ts")


on_graph("S38_task_state", lambda g: v.located(g, rp.evidence_edges(g)).groupBy("task_id").agg(F.countDistinct("page_id").alias("pages"), F.countDistinct("domain").alias("domains")), LOCATED + "SELECT task_id, count(DISTINCT page_id) AS pages, count(DISTINCT domain) AS domains FROM q_located GROUP BY 1")


@query("S40_expired_items", JOBS_SQL + "SELECT id, CASE WHEN state = 'queued' AND queued_at < TIMESTAMP '2024-01-15 00:00:00' THEN 'expired' ELSE state END AS state FROM jobs")
def s40(spark, sf_dir):
    gone = (F.col("state") == "queued") & (F.col("queued_at") < F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return jobs(spark, sf_dir).select("id", F.when(gone, "expired").otherwise(F.col("state")).alias("state"))


# ---- graph operators
TASK = "(SELECT id FROM g_claims WHERE task_id = 1)"
on_graph("G1_task_graph", lambda g: gr.task_graph(g, 1), f"""
q_a AS (SELECT * FROM g_edges WHERE target_type = 'claim' AND target_id IN {TASK}), q_p AS (SELECT DISTINCT f.page_id FROM q_a JOIN g_fragments f ON f.id = q_a.source_id)
SELECT source_type || ':' || source_id AS src, target_type || ':' || target_id AS dst, relation FROM q_a
UNION ALL SELECT 'page:' || source_id, 'page:' || target_id, relation FROM g_cites WHERE source_id IN (SELECT page_id FROM q_p)
UNION ALL SELECT DISTINCT 'claim:' || q_a.target_id, 'page:' || f.page_id, 'evidence_source' FROM q_a JOIN g_fragments f ON f.id = q_a.source_id""")
on_graph("G3_supporting_evidence", lambda g: g.nli.where("relation = 'supports'").select(F.col("target_id").alias("claim_id"), F.col("source_id").alias("fragment_id"), "nli_edge_confidence"), "SELECT target_id AS claim_id, source_id AS fragment_id, nli_edge_confidence FROM g_nli WHERE relation = 'supports'")
on_graph("G4_evidence_by_relation", gr.evidence_by_relation, "SELECT target_id AS claim_id, list_sort(list(source_id) FILTER (relation = 'supports')) AS supports, list_sort(list(source_id) FILTER (relation = 'refutes')) AS refutes, list_sort(list(source_id) FILTER (relation = 'neutral')) AS neutral FROM g_nli GROUP BY 1".replace("list_sort(list(source_id)", "list_sort(coalesce(list(source_id)").replace("'supports')) AS", "'supports'), [])) AS").replace("'refutes')) AS", "'refutes'), [])) AS").replace("'neutral')) AS", "'neutral'), [])) AS"))
on_graph("G5_citation_chain", lambda g: gr.citation_chain(g.cites, 5), """
q_first AS (SELECT source_id AS s, min(target_id) AS t FROM g_cites GROUP BY 1),
q_1 AS (SELECT s AS start, [s] AS path, t AS nxt FROM q_first),
""" + ",\n".join(f"q_{k} AS (SELECT start, CASE WHEN nxt IS NULL OR list_contains(path, nxt) THEN path ELSE list_append(path, nxt) END AS path, CASE WHEN nxt IS NULL OR list_contains(path, nxt) THEN NULL ELSE f.t END AS nxt FROM q_{k - 1} LEFT JOIN q_first f ON f.s = nxt)" for k in range(2, 6)) + "\nSELECT start, path FROM q_5")
on_graph("G6_claim_confidence", gr.claim_confidence, """
q_e AS (SELECT e.target_id AS claim_id, e.relation, CASE WHEN nli_edge_confidence > 0 THEN nli_edge_confidence ELSE 0 END AS c, f.page_id, w.year FROM g_nli e JOIN g_fragments f ON f.id = e.source_id JOIN g_pages p ON p.id = f.page_id LEFT JOIN g_works w USING (canonical_id)),
q_x AS (SELECT claim_id, 1 + sum(CASE WHEN relation = 'supports' THEN c ELSE 0 END::DECIMAL(18,9))::DOUBLE AS a, 1 + sum(CASE WHEN relation = 'refutes' THEN c ELSE 0 END::DECIMAL(18,9))::DOUBLE AS b, count(*) FILTER (relation = 'supports') AS s, count(*) FILTER (relation = 'refutes') AS r, count(DISTINCT page_id) AS sources, min(year) AS oldest, max(year) AS newest FROM q_e GROUP BY 1)
SELECT c.id AS claim_id, round(coalesce(a / (a + b), 0.5::DOUBLE), 3) AS confidence, round(coalesce(sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), sqrt(1::DOUBLE / 12)), 3) AS uncertainty, coalesce(s, 0) AS supporting, coalesce(r, 0) AS refuting, coalesce(sources, 0) AS independent_sources, oldest, newest FROM g_claims c LEFT JOIN q_x ON q_x.claim_id = c.id""")
on_graph("G7_contradicted_claims", gr.contradicted_claims, "SELECT target_id AS claim_id, count(*) AS refuting, max(nli_edge_confidence) AS strongest FROM g_nli WHERE relation = 'refutes' GROUP BY 1")
# loops from their smallest page on: open paths of up to five pages, closed by an edge back
PATHS = """
q_c AS (SELECT DISTINCT source_id AS s, target_id AS t FROM g_cites),
q_p2 AS (SELECT [s, t] AS p, s AS b, t AS e FROM q_c WHERE t > s),
""" + "".join(f"q_p{k} AS (SELECT list_append(p, c.t) AS p, b, c.t AS e FROM q_p{k - 1} JOIN q_c c ON c.s = e WHERE c.t > b AND NOT list_contains(p, c.t)),\n" for k in (3, 4, 5)) + "q_loops AS (SELECT [s] AS p FROM q_c WHERE s = t" + "".join(f" UNION ALL SELECT p FROM q_p{k} JOIN q_c c ON c.s = e AND c.t = b" for k in (2, 3, 4, 5)) + ")"
on_graph("G9_citation_loops", lambda g: gr.citation_loops(g.cites, 5), PATHS + "\nSELECT p AS path, len(p)::INT AS length, CASE WHEN len(p) <= 2 THEN 'critical' WHEN len(p) = 3 THEN 'high' ELSE 'medium' END AS severity FROM q_loops")
on_graph("G10_round_trips", lambda g: gr.round_trips(g.cites), "SELECT a.source_id AS page_a, a.target_id AS page_b FROM g_cites a JOIN g_cites b ON a.source_id = b.target_id AND a.target_id = b.source_id WHERE a.source_id <= a.target_id")
SELF = "SELECT source_id AS page_id, source_id AS target_id, 'self_loop' AS kind, 'critical' AS severity FROM g_cites WHERE source_id = target_id UNION ALL SELECT c.source_id, c.target_id, 'same_domain', 'medium' FROM g_cites c JOIN g_pages a ON a.id = c.source_id JOIN g_pages b ON b.id = c.target_id WHERE source_id <> target_id AND lower(a.domain) = lower(b.domain)"
on_graph("G11_self_references", gr.self_references, SELF)
on_graph("G14_primary_ratio", gr.primary_ratio, "SELECT count(*) AS pages, count(*) FILTER (NOT EXISTS (SELECT 1 FROM g_cites c WHERE c.source_id = p.id)) AS primary_pages, round(count(*) FILTER (NOT EXISTS (SELECT 1 FROM g_cites c WHERE c.source_id = p.id))::DOUBLE / count(*), 3) AS ratio, count(*) FILTER (NOT EXISTS (SELECT 1 FROM g_cites c WHERE c.source_id = p.id))::DOUBLE / count(*) >= 0.6 AS enough FROM g_pages p")
on_graph("G15_graph_stats", gr.graph_stats, "SELECT relation, source_type, target_type, count(*) AS edges, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM g_edges GROUP BY 1, 2, 3")
on_graph("G18_hub_pages", lambda g: gr.hub_pages(g, 10), "SELECT target_id AS page_id, count(*) AS in_degree FROM g_cites GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
on_graph("G16_pagerank", lambda g: gr.pagerank(g.pages.select("id"), g.cites.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))))
on_graph("G17_betweenness", lambda g: gr.betweenness(g.cites.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))))
LOOPS = PATHS + """,
q_trips AS (SELECT a.s AS a, a.t AS b FROM q_c a JOIN q_c b ON a.s = b.t AND a.t = b.s WHERE a.s <= a.t),
q_same AS (SELECT c.s, c.t FROM q_c c JOIN g_pages a ON a.id = c.s JOIN g_pages b ON b.id = c.t WHERE c.s <> c.t AND lower(a.domain) = lower(b.domain)),
q_f AS (SELECT unnest(p) AS id, CASE WHEN len(p) <= 2 THEN 0.2::DOUBLE WHEN len(p) = 3 THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END AS f FROM q_loops UNION ALL SELECT a, 0.3::DOUBLE FROM q_trips UNION ALL SELECT b, 0.3::DOUBLE FROM q_trips UNION ALL SELECT s, 0.1::DOUBLE FROM q_c WHERE s = t UNION ALL SELECT s, 0.5::DOUBLE FROM q_same UNION ALL SELECT t, 0.6::DOUBLE FROM q_same),
q_pen AS (SELECT p.id AS page_id, round(least(1, coalesce(exp(sum(ln(f))), 1)), 9) AS penalty FROM g_pages p LEFT JOIN q_f ON q_f.id = p.id GROUP BY 1)
"""
on_graph("G12_citation_penalties", lambda g: gr.citation_penalties(g, 5).select("page_id", F.round("penalty", 6).alias("penalty")), LOOPS + "SELECT page_id, round(penalty, 6) AS penalty FROM q_pen")
on_graph("G13_integrity", lambda g: gr.integrity(g, 5), LOOPS + """, q_bad AS (SELECT unnest(p) AS id FROM q_loops UNION SELECT a FROM q_trips UNION SELECT b FROM q_trips UNION SELECT s FROM q_same UNION SELECT s FROM q_c WHERE s = t)
SELECT (SELECT count(*) FROM g_pages) AS pages, (SELECT count(*) FROM q_bad) AS problematic, (SELECT count(*) FROM q_pen WHERE penalty < 0.9) AS penalised, round(1 - (SELECT count(*) FROM q_bad)::DOUBLE / (SELECT count(*) FROM g_pages), 3) AS integrity""")
on_graph("G22_claim_relations", lambda g: gr.claim_relations(g, 1), LOCATED + """, q_t AS (SELECT DISTINCT claim_id, fragment_id, page_id FROM q_located WHERE task_id = 1),
q_pairs AS (SELECT a.claim_id AS a, b.claim_id AS b, 1 AS kind FROM q_t a JOIN q_t b ON a.fragment_id = b.fragment_id AND a.claim_id < b.claim_id UNION ALL SELECT a.claim_id, b.claim_id, 2 FROM q_t a JOIN q_t b ON a.page_id = b.page_id AND a.claim_id < b.claim_id)
SELECT a AS claim_a, b AS claim_b, CASE min(kind) WHEN 1 THEN 'co_fragment' ELSE 'co_page' END AS kind, CASE min(kind) WHEN 1 THEN 0.9 ELSE 0.6 END::DOUBLE AS weight FROM q_pairs GROUP BY 1, 2""")



def near_claims(spark, sf_dir):
    from quern.operators.ranking import knn
    from quern.sources.graph import bridge

    g = bridge(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(g.claims.where("task_id = 1").select("id"), "id", "left_semi")
    return gr.claim_relation_graph(g, 1, knn(v, 1 << 30, 0.2), 2, 0.2, 400)


def _near_sql() -> str:
    dot = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: {0}.embedding[i]::DOUBLE * {1}.embedding[i]::DOUBLE))".format
    return f"""{BRIDGE_SQL.rstrip()},
{LOCATED.lstrip()}, q_t AS (SELECT DISTINCT claim_id, fragment_id, page_id FROM q_located WHERE task_id = 1),
q_pairs AS (SELECT a.claim_id AS a, b.claim_id AS b, 1 AS kind FROM q_t a JOIN q_t b ON a.fragment_id = b.fragment_id AND a.claim_id < b.claim_id UNION ALL SELECT a.claim_id, b.claim_id, 2 FROM q_t a JOIN q_t b ON a.page_id = b.page_id AND a.claim_id < b.claim_id),
q_close AS (SELECT a AS claim_a, b AS claim_b, min(kind) AS kind FROM q_pairs GROUP BY 1, 2), q_v AS (SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id IN (SELECT id FROM g_claims WHERE task_id = 1)),
q_s AS (SELECT a.id AS a, b.id AS b, round({dot("a", "b")} / sqrt({dot("a", "a")} * {dot("b", "b")}), 9) AS s FROM q_v a, q_v b WHERE a.id <> b.id),
q_k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM q_s WHERE s >= 0.2 AND (least(a, b), greatest(a, b)) NOT IN (SELECT (claim_a, claim_b) FROM q_close)),
q_n AS (SELECT least(a, b) AS claim_a, greatest(a, b) AS claim_b, round(max(s), 3) AS weight FROM q_k WHERE k <= 2 GROUP BY 1, 2)
SELECT * FROM (SELECT claim_a, claim_b, 'co_fragment' AS kind, 0.9::DOUBLE AS weight FROM q_close WHERE kind = 1 ORDER BY 1, 2 LIMIT 140) UNION ALL SELECT * FROM (SELECT claim_a, claim_b, 'co_page', 0.6::DOUBLE FROM q_close WHERE kind = 2 ORDER BY 1, 2 LIMIT 100)
UNION ALL SELECT * FROM (SELECT claim_a, claim_b, 'semantic_sim', weight FROM q_n ORDER BY weight DESC, 1, 2 LIMIT 160)"""


query("G22b_claim_relation_graph", _near_sql())(near_claims)
