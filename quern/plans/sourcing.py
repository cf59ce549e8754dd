"""Registered queries: search rows, papers, citations, policies and tasks on their way into the graph."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quern.functions import queries as qu
from quern.operators import policy as po
from quern.operators import sourcing as so
from quern.sources.graph import table

from .decisions import pick, sql_pick
from .embedded import JOBS_SQL, jobs
from .registry import on_graph, query

col, lit = F.col, F.lit


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def s(c):
    return c.cast("string")


# X13: rows under seven kinds of addresses, with and without an entry in the crosswalk.
ADDRESSES = ["https://doi.org/10.1234/e", "https://pubmed.ncbi.nlm.nih.gov/", "https://pmc.ncbi.nlm.nih.gov/articles/PMC", "https://arxiv.org/abs/2401.", "https://openalex.org/W", "https://x.example/", "https://nature.example/articles/"]
ROUTES = f"""
WITH r AS (SELECT event_id AS id, event_id % 7 AS k, {sql_pick(ADDRESSES, "event_id")} || CASE event_id % 7 WHEN 3 THEN lpad((event_id % 100000)::VARCHAR, 5, '0') ELSE event_id::VARCHAR END AS url FROM events),
t AS (SELECT id, url, k, CASE WHEN k = 0 THEN '10.1234/e' || id WHEN k IN (1, 2, 3) AND id % 3 = 0 THEN '10.5/x' || id END AS doi FROM r),
q_r AS (SELECT id, url, doi, CASE WHEN k = 4 THEN 'openalex' WHEN doi IS NOT NULL OR k IN (1, 3) THEN 'semantic_scholar' END AS api, CASE WHEN k = 4 THEN 'openalex:W' || id WHEN doi IS NOT NULL THEN 'DOI:' || doi WHEN k = 1 THEN 'PMID:' || id WHEN k = 3 THEN 'ArXiv:2401.' || lpad((id % 100000)::VARCHAR, 5, '0') END AS api_id FROM t)"""


def routes(spark, sf_dir):
    i, k = col("event_id"), col("event_id") % 7
    short = F.lpad(s(i % 100000), 5, "0")
    rows = events(spark, sf_dir).select(i.alias("id"), F.concat(pick(ADDRESSES, i), F.when(k == 3, short).otherwise(s(i))).alias("url"))
    kind = F.when(k == 1, "pmid").when(k == 2, "pmcid").otherwise("arxiv")
    value = F.when(k == 1, s(i)).when(k == 2, F.concat(lit("PMC"), s(i))).otherwise(F.concat(lit("2401."), short))
    known = events(spark, sf_dir).where(k.isin(1, 2, 3) & (i % 3 == 0)).select(i.alias("id"), kind.alias("kind"), value.alias("value"), F.concat(lit("10.5/x"), s(i)).alias("doi"))
    return so.route_rows(rows, known)


@query("X13_routed_rows", ROUTES + "SELECT id, url, doi, CASE WHEN api IS NULL THEN 'fetch' ELSE 'complement' END AS route, api, api_id FROM q_r")
def x13(spark, sf_dir):
    return routes(spark, sf_dir)


@query("X13b_complemented", ROUTES + """, p AS (SELECT api, api_id, 'p' || id AS paper_id, CASE WHEN id % 5 > 1 THEN 'text' END AS abstract FROM q_r WHERE api IS NOT NULL AND id % 4 > 0),
o AS (SELECT id, doi, 'q' || id AS paper_id, CASE WHEN id % 2 = 0 THEN 'other text' END AS abstract FROM q_r WHERE doi IS NOT NULL AND id % 5 < 3)
SELECT r.id, CASE WHEN o.id IS NOT NULL AND p.abstract IS NULL THEN 'openalex' ELSE r.api END AS api, CASE WHEN o.id IS NOT NULL AND p.abstract IS NULL THEN o.paper_id ELSE p.paper_id END AS paper_id, CASE WHEN o.id IS NOT NULL AND p.abstract IS NULL THEN o.abstract ELSE p.abstract END AS abstract
FROM q_r r LEFT JOIN p ON p.api = r.api AND p.api_id = r.api_id LEFT JOIN o ON o.id = r.id WHERE r.api IS NOT NULL AND (p.paper_id IS NOT NULL OR o.id IS NOT NULL)""")
def x13b(spark, sf_dir):
    r, i = routes(spark, sf_dir), col("id")
    p = r.where("api is not null and id % 4 > 0").select("api", "api_id", F.concat(lit("p"), s(i)).alias("paper_id"), lit(None).cast("string").alias("doi"), F.when(i % 5 > 1, "text").alias("abstract"))
    o = r.where("doi is not null and id % 5 < 3").select(lit("openalex").alias("api"), F.concat(lit("https://doi.org/"), "doi").alias("api_id"), F.concat(lit("q"), s(i)).alias("paper_id"), lit(None).cast("string").alias("doi"), F.when(i % 2 == 0, "other text").alias("abstract"))
    return so.complement(r, p.unionByName(o))


@query("X43_academic_results", "WITH f AS (SELECT ['openalex', 'semantic_scholar', 'other'][event_id % 3 + 1] AS api, event_id AS position, user_id AS canonical_id, event_type || event_id AS title FROM events) SELECT canonical_id, arg_min(api, (CASE api WHEN 'semantic_scholar' THEN 1 WHEN 'openalex' THEN 2 ELSE 999 END, position)) AS api, arg_min(title, (CASE api WHEN 'semantic_scholar' THEN 1 WHEN 'openalex' THEN 2 ELSE 999 END, position)) AS title, count(DISTINCT api) AS apis FROM f GROUP BY 1")
def x43(spark, sf_dir):
    i = col("event_id")
    return so.academic_results(events(spark, sf_dir).select(pick(["openalex", "semantic_scholar", "other"], i).alias("api"), i.alias("position"), col("user_id").alias("canonical_id"), F.concat("event_type", s(i)).alias("title")))


def references(g):
    both = g.cites.select(col("source_id").alias("citing"), col("target_id").alias("cited"))
    return both.withColumn("api", F.when((col("citing") + col("cited")) % 2 == 0, "openalex").otherwise("semantic_scholar"))


STARTS = "q_p AS (SELECT id AS paper_id FROM g_pages WHERE id % 100 = 0), q_c AS (SELECT DISTINCT source_id AS citing, target_id AS cited, CASE WHEN (source_id + target_id) % 2 = 0 THEN 'openalex' ELSE 'semantic_scholar' END AS api FROM g_cites)"
on_graph("X43b_citation_graph", lambda g: so.citation_graph(g.pages.where("id % 100 = 0").select(col("id").alias("paper_id")), references(g), 2), f"""
{STARTS}, q_1 AS (SELECT * FROM q_c WHERE citing IN (SELECT paper_id FROM q_p) OR cited IN (SELECT paper_id FROM q_p)), q_n AS (SELECT paper_id FROM q_p UNION SELECT citing FROM q_1 UNION SELECT cited FROM q_1)
SELECT * FROM q_c WHERE citing IN (SELECT paper_id FROM q_n) OR cited IN (SELECT paper_id FROM q_n)""")


def job(g):
    """Papers and candidates of one job: every hundredth page is a paper, of which the first forty are followed."""
    papers = g.pages.where("id % 100 = 0").select(col("id").alias("paper_id"), col("id").alias("position"))
    refs = references(g)
    near = refs.select(col("citing").alias("query"), col("cited").alias("id")).union(refs.select(col("cited").alias("query"), col("citing").alias("id"))).distinct()
    candidates = near.select("query", "id", (col("id") % 23).alias("citations"), (col("id") * 71 % 100 / 100.0).alias("similarity"), (col("id") * 31 % 11 / 10.0).alias("llm"))
    info = g.pages.select(col("id").alias("paper_id"), lit(None).cast("string").alias("oa_url"), F.when(col("id") % 4 > 0, F.concat(lit("10.1/"), s(col("id")))).alias("doi"), "title", F.when(col("id") % 3 > 0, "an abstract").alias("abstract"))
    pages = g.pages.where("id % 5 = 0").select(col("id").alias("paper_id"), col("id").alias("page_id"))
    got = so.citation_job(papers, refs, candidates, info, pages, 40)
    rows = [got[k].select(lit(k).alias("kind"), col("url").alias("a"), s(col("paper_id")).alias("b")) for k in ("pages", "placeholders")]
    return rows[0].union(rows[1]).union(got["edges"].select(lit("edge"), "source_id", "target_id"))


on_graph("G23_citation_job", job, f"""
{STARTS}, q_w AS (SELECT paper_id FROM q_p ORDER BY 1 LIMIT 40), q_e AS (SELECT * FROM q_c WHERE citing IN (SELECT paper_id FROM q_w) OR cited IN (SELECT paper_id FROM q_w)),
q_k AS (SELECT citing AS query, cited AS id FROM q_c WHERE citing IN (SELECT paper_id FROM q_w) UNION SELECT cited, citing FROM q_c WHERE cited IN (SELECT paper_id FROM q_w)),
q_i AS (SELECT query, id, id % 23 AS c, (id * 71 % 100)::DOUBLE / 100 AS s, (id * 31 % 11)::DOUBLE / 10 AS llm FROM q_k WHERE id % 23 >= 1),
q_j AS (SELECT *, (rank() OVER (PARTITION BY query ORDER BY c) - 1 + (count(*) OVER (PARTITION BY query, c) - 1) / 2.0::DOUBLE) / nullif(count(*) OVER (PARTITION BY query) - 1, 0) AS impact0 FROM q_i),
q_a AS (SELECT *, round(0.5::DOUBLE * s + 0.5::DOUBLE * coalesce(impact0, 0.5::DOUBLE), 9) AS stage1, coalesce(impact0, 0.5::DOUBLE) AS impact FROM q_j),
q_b AS (SELECT *, round(0.5::DOUBLE * llm + 0.3::DOUBLE * s + 0.2::DOUBLE * impact, 9) AS stage2 FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY stage1 DESC, id) AS k FROM q_a) WHERE k <= 30),
q_x AS (SELECT DISTINCT id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY stage2 DESC, id) AS n FROM q_b) WHERE n <= 10 AND id % 5 > 0),
q_u AS (SELECT id, CASE WHEN id % 4 > 0 THEN 'https://doi.org/10.1/' || id ELSE 'https://paper/' || id END AS url FROM q_x),
q_m AS (SELECT id, id::VARCHAR AS page FROM g_pages WHERE id % 5 = 0 UNION ALL SELECT id, url FROM q_u)
SELECT CASE WHEN id % 3 > 0 THEN 'pages' ELSE 'placeholders' END AS kind, url AS a, id::VARCHAR AS b FROM q_u
UNION ALL SELECT DISTINCT 'edge', x.page, y.page FROM q_e JOIN q_m x ON x.id = citing JOIN q_m y ON y.id = cited WHERE x.page <> y.page""")


@query("V14_first_provider", "WITH a AS (SELECT user_id AS query, event_type AS provider, event_id AS position, event_id % 4 = 0 AS sick, event_id % 11 = 0 AS ok, 'e' || event_id AS error FROM events) SELECT query, coalesce(arg_min(provider, position) FILTER (NOT sick AND ok), 'none') AS provider, CASE WHEN count(*) FILTER (NOT sick AND ok) = 0 THEN 'All providers failed: ' || coalesce(string_agg(provider || ': ' || error, '; ' ORDER BY position) FILTER (NOT sick AND NOT ok), 'No providers available') END AS error FROM a GROUP BY 1")
def v14(spark, sf_dir):
    i = col("event_id")
    return so.first_ok(events(spark, sf_dir).select(col("user_id").alias("query"), col("event_type").alias("provider"), i.alias("position"), F.when(i % 4 == 0, "unhealthy").otherwise("healthy").alias("state"), (i % 11 == 0).alias("ok"), F.concat(lit("e"), s(i)).alias("error")))


PAPERS = "WITH p AS (SELECT doc_id::VARCHAR AS paper_id, CASE WHEN doc_id % 4 = 0 THEN 'https://oa.example/' || (doc_id // 8) END AS oa_url, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || doc_id END AS doi, 'T' || doc_id AS title, text AS abstract FROM documents), u AS (SELECT *, CASE WHEN oa_url IS NOT NULL THEN oa_url WHEN doi IS NOT NULL THEN 'https://doi.org/' || doi ELSE 'https://paper/' || paper_id END AS url FROM p WHERE abstract <> ''), k AS (SELECT doc_id AS page_id, 'https://doi.org/10.1/' || doc_id AS url FROM documents WHERE doc_id % 5 = 0) "


def abstracts(spark, sf_dir):
    i = col("doc_id")
    d = table(spark, sf_dir, "documents")
    papers = d.select(s(i).alias("paper_id"), F.when(i % 4 == 0, F.concat(lit("https://oa.example/"), s(F.floor(i / 8)))).alias("oa_url"), F.when(i % 3 == 0, F.concat(lit("10.1/"), s(i))).alias("doi"), F.concat(lit("T"), s(i)).alias("title"), col("text").alias("abstract"))
    return so.abstract_rows(papers, d.where(i % 5 == 0).select(i.alias("page_id"), F.concat(lit("https://doi.org/10.1/"), s(i)).alias("url")))


@query("X14_abstract_fragments", PAPERS + ", n AS (SELECT url, arg_min(abstract, paper_id) AS abstract FROM u WHERE url NOT IN (SELECT url FROM k) GROUP BY 1), f AS (SELECT url, length(abstract) AS n_chars, sha256(left(abstract, 500))[1:16] AS text_hash FROM n) SELECT url, n_chars, text_hash, url = min(url) OVER (PARTITION BY text_hash) AS is_novel FROM f")
def x14(spark, sf_dir):
    return abstracts(spark, sf_dir)["fragments"].select("url", F.length("text").cast("long").alias("n_chars"), "text_hash", "is_novel")


@query("X14b_paper_pages", PAPERS + "SELECT paper_id, u.url, page_id FROM u LEFT JOIN k ON k.url = u.url")
def x14b(spark, sf_dir):
    return abstracts(spark, sf_dir)["mapped"]


JUDGED = "WITH j AS (SELECT user_id AS query, event_id AS position, 'u' || event_id AS url, CASE WHEN event_id % 6 > 0 THEN event_type || ' passage' ELSE '' END AS passage, ['refutes', 'supports', 'neutral'][event_id % 3 + 1] AS stance, (event_id * 37 % 100)::DOUBLE / 100 AS confidence, event_id % 5 > 0 AS ok FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY position) AS k FROM j), d AS (SELECT *, ok AND passage <> '' AS useful, ok AND passage <> '' AND stance = 'refutes' AND confidence > 0.6::DOUBLE AS hit FROM k WHERE k <= 15) "


def judged(spark, sf_dir):
    i = col("event_id")
    j = events(spark, sf_dir).select(col("user_id").alias("query"), i.alias("position"), F.concat(lit("u"), s(i)).alias("url"), F.when(i % 6 > 0, F.concat("event_type", lit(" passage"))).otherwise("").alias("passage"), pick(["refutes", "supports", "neutral"], i).alias("stance"), (i * 37 % 100 / 100).alias("confidence"), (i % 5 > 0).alias("ok"))
    return so.refutation_outcome(j)


@query("X16_refutations", JUDGED + "SELECT query, url, passage AS text, confidence FROM d WHERE hit")
def x16(spark, sf_dir):
    return judged(spark, sf_dir)["refutations"]


@query("X16b_refutation_status", JUDGED + "SELECT query, count(*) AS pages, count(*) FILTER (useful) AS fragments, round(count(*) FILTER (useful)::DOUBLE / count(*), 9) AS harvest, count(*) FILTER (hit) AS refutations, CASE WHEN count(*) FILTER (hit) > 0 THEN 'satisfied' WHEN count(*) >= 15 THEN 'exhausted' ELSE 'partial' END AS status, round(least(1, count(*) FILTER (hit)::DOUBLE / 3), 9) AS satisfaction FROM d GROUP BY 1")
def x16b(spark, sf_dir):
    return judged(spark, sf_dir)["status"]


on_graph("X17_ingest_plan", lambda g: so.ingest_plan(g.task_pages.join(g.pages.select(col("id").alias("page_id"), "url"), "page_id").select("task_id", "url").union(g.tasks.select("id", F.concat(lit("https://new.example/"), s(col("id"))))), g.pages.select(col("id").alias("page_id"), "url", F.when(col("id") % 3 > 0, "x.html").alias("html_path")), g.claims.select("task_id", col("id").alias("page_id"))), """
q_t AS (SELECT DISTINCT task_id, p.url FROM g_task_pages t JOIN g_pages p ON p.id = t.page_id UNION SELECT id, 'https://new.example/' || id FROM g_tasks), q_p AS (SELECT url, min(id) AS page_id FROM g_pages GROUP BY 1)
SELECT t.task_id, t.url, p.page_id, CASE WHEN p.page_id IS NULL THEN 'ingest' WHEN EXISTS (SELECT 1 FROM g_claims c WHERE c.task_id = t.task_id AND c.id = p.page_id) THEN 'skip' WHEN p.page_id % 3 = 0 THEN 'fetch' ELSE 'reprocess' END AS action FROM q_t t LEFT JOIN q_p p ON p.url = t.url""")

EXTRACTED = "WITH x AS (SELECT event_id AS f, CASE WHEN event_id % 2 = 0 THEN event_id + 1000000 END AS c FROM events) "


def extracted(spark, sf_dir):
    i = col("event_id")
    e = events(spark, sf_dir)
    x = e.select(i.alias("fragment_id"), col("user_id").alias("page_id"), F.concat(lit("https://x.example/"), s(i)).alias("url"), lit("Title").alias("title"), F.when(i % 3 == 0, "Heading").when(i % 3 == 1, "").alias("heading"), F.concat(F.repeat("event_type", 200), s(i)).alias("text"), (i % 2 == 0).alias("primary"), F.when(i % 2 == 0, i + 1000000).alias("claim_id"), F.concat(F.repeat("event_type", 200), s(i)).alias("claim_text"), (i % 10 / 10).alias("confidence"))
    x = x.union(x.where("fragment_id % 4 = 0"))
    return so.web_rows(x, e.where(i % 9 == 0).select(i.alias("fragment_id")), e.where(i % 10 == 0).select((i + 1000000).alias("claim_id")))


@query("X18_web_fragments", "SELECT event_id AS fragment_id, user_id AS page_id, length(repeat(event_type, 200) || event_id) AS n_chars, CASE WHEN event_id % 3 = 0 THEN 'Heading' ELSE 'Title' END AS heading_context, sha256(left(repeat(event_type, 200) || event_id, 500))[1:16] AS text_hash, 'primary_source=' || CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END || '; url=https://x.example/' || event_id AS relevance_reason FROM events WHERE event_id % 9 > 0")
def x18(spark, sf_dir):
    return extracted(spark, sf_dir)["fragments"].select("fragment_id", "page_id", F.length("text").cast("long").alias("n_chars"), "heading_context", "text_hash", "relevance_reason")


@query("X18b_web_claims", "SELECT event_id + 1000000 AS claim_id, left(repeat(event_type, 200) || event_id, 500) AS claim_text, 'fact' AS claim_type, (event_id % 10)::DOUBLE / 10 AS llm_claim_confidence, 'adopted' AS status, 'source_url=https://x.example/' || event_id AS notes, event_id AS source_id FROM events WHERE event_id % 2 = 0 AND event_id % 10 > 0")
def x18b(spark, sf_dir):
    x = extracted(spark, sf_dir)
    return x["claims"].join(x["edges"].select(col("target_id").alias("claim_id"), "source_id"), "claim_id")


on_graph("A17_saved_edges", lambda g: so.edges_to_save(g.edges.where("source_id % 3 = 0").withColumn("relation", F.when(col("source_id") % 2 == 0, "evidence_source").otherwise("changed")), g.edges).select("id", "source_id", "target_id", "relation"), "SELECT id, source_id, target_id, CASE WHEN source_id % 3 = 0 AND source_id % 2 <> 0 THEN 'changed' ELSE relation END AS relation FROM g_edges")


@query("X9_new_tasks", "SELECT event_id AS id, CASE WHEN error IS NULL THEN 'created' END AS status, max_pages, max_seconds, error FROM (SELECT *, CASE WHEN trim(coalesce(h, '')) = '' THEN 'hypothesis is required' WHEN max_pages < 0 THEN 'budget.max_pages must be >= 0' WHEN max_pages > 500 THEN 'budget.max_pages exceeds the limit' END AS error FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE event_type END AS h, coalesce(CASE WHEN event_id % 7 > 0 THEN event_id % 800 - 100 END, 500) AS max_pages, greatest(0, coalesce(CASE WHEN event_id % 3 > 0 THEN event_id % 50 - 10 END, 3600)) AS max_seconds FROM events))")
def x9(spark, sf_dir):
    i = col("event_id")
    return so.new_tasks(events(spark, sf_dir).select(i.alias("id"), F.when(i % 5 == 0, " ").when(i % 5 > 1, col("event_type")).alias("hypothesis"), F.when(i % 7 > 0, i % 800 - 100).alias("max_pages"), F.when(i % 3 > 0, i % 50 - 10).alias("max_seconds"))).drop("hypothesis")


on_graph("X9b_stopped_tasks", lambda g: so.stop_tasks(g.tasks.select("id", "status"), g.claims.where("id % 2 = 0").select(col("task_id").alias("id"), F.when(col("id") % 4 == 0, "completed").otherwise("budget").alias("reason"), col("id").alias("at"))), "SELECT t.id, CASE WHEN m IS NULL THEN t.status WHEN m % 4 = 0 THEN 'completed' ELSE 'paused' END AS status FROM g_tasks t LEFT JOIN (SELECT task_id, max(id) AS m FROM g_claims WHERE id % 2 = 0 GROUP BY 1) c ON c.task_id = t.id")

PHASES = {"exploration": "click", "verification": "signup", "citation": "error"}


def status(spark, sf_dir):
    from quern.sources.graph import bridge

    g = bridge(spark, sf_dir)
    n = lambda d, name: d.groupBy("task_id").agg(F.count("*").alias(name))
    pages = n(g.task_pages, "pages")
    fragments = n(g.task_pages.join(g.fragments.select("page_id"), "page_id"), "fragments")
    totals = n(g.claims, "claims").join(pages, "task_id", "full_outer").join(fragments, "task_id", "full_outer")
    j = jobs(spark, sf_dir).withColumn("task_id", col("id") % 40)
    searches = g.claims.select("task_id", F.when(col("id") % 3 == 0, "satisfied").when(col("id") % 3 == 1, "running").otherwise("partial").alias("status"))
    auth = j.where("state = 'queued' and kind = 'view' and id % 3 = 0").select("task_id", F.concat(lit("d"), s(col("id") % 9)).alias("domain"))
    return so.task_status(g.tasks, totals, searches, j, auth, PHASES).drop("hypothesis")


STATES4 = ("queued", "running", "completed", "failed")
ZERO = ", ".join(f"coalesce({p}_{x}, 0) AS {p}_{x}" for p in PHASES for x in STATES4)
DRAINED = ", ".join(f"{p}_queued + {p}_running = 0 AS {p}_drained" for p in PHASES)
WAITING = ", ".join(f"CASE WHEN {p}_queued + {p}_running > 0 THEN '{p}' END" for p in PHASES)
STATUS_SQL = JOBS_SQL.rstrip() + ", j AS (SELECT *, id % 40 AS task_id FROM jobs), q_j AS (SELECT task_id, " + ", ".join(f"count(*) FILTER (kind = '{k}' AND state = '{x}') AS {p}_{x}" for p, k in PHASES.items() for x in STATES4) + f""" FROM j GROUP BY 1),
q_a AS (SELECT task_id, count(*) AS pending_auth, count(DISTINCT id % 9) AS auth_domains FROM j WHERE state = 'queued' AND kind = 'view' AND id % 3 = 0 GROUP BY 1),
q_c AS (SELECT task_id, count(*) AS claims, count(*) FILTER (id % 3 = 0) AS satisfied, count(*) FILTER (id % 3 = 1) AS running, count(*) AS searches FROM g_claims GROUP BY 1),
q_p AS (SELECT task_id, count(*) AS pages FROM g_task_pages GROUP BY 1), q_f AS (SELECT task_id, count(*) AS fragments FROM g_task_pages t JOIN g_fragments f ON f.page_id = t.page_id GROUP BY 1),
q_d AS (SELECT t.id AS task_id, CASE WHEN t.status IN ('exploring', 'created') THEN 'exploring' WHEN t.status IN ('awaiting_decision', 'paused', 'cancelled') THEN 'paused' WHEN t.status IN ('failed', 'completed') THEN t.status ELSE 'exploring' END AS status, coalesce(claims, 0) AS claims, coalesce(pages, 0) AS pages, coalesce(fragments, 0) AS fragments, coalesce(satisfied, 0) AS satisfied, coalesce(running, 0) AS running, coalesce(searches, 0) AS searches, {ZERO}, coalesce(pending_auth, 0) AS pending_auth, coalesce(auth_domains, 0) AS auth_domains FROM g_tasks t LEFT JOIN q_c ON q_c.task_id = t.id LEFT JOIN q_p ON q_p.task_id = t.id LEFT JOIN q_f ON q_f.task_id = t.id LEFT JOIN q_j ON q_j.task_id = t.id LEFT JOIN q_a ON q_a.task_id = t.id)
SELECT *, greatest(0, floor((1 - pages::DOUBLE / 500) * 100 + 1e-9))::BIGINT AS remaining_percent, {DRAINED}, list_filter([{WAITING}, CASE WHEN pending_auth > 0 THEN 'auth' END], lambda x: x IS NOT NULL) AS waiting_for FROM q_d"""


def _status_sql() -> str:
    from quern.sources.graph import BRIDGE_SQL

    return BRIDGE_SQL.rstrip() + ",\n" + STATUS_SQL.removeprefix("WITH ")


query("X8_task_status", _status_sql())(status)

NOW = datetime(2024, 2, 1)
RATES = "WITH m AS (SELECT 'engine' AS target_type, 'e' || user_id AS target_id, count(*) FILTER (event_id % 3 > 0 OR user_id % 4 = 0)::DOUBLE / count(*) AS s, 0.0::DOUBLE AS c, 0.0::DOUBLE AS f, 0.0::DOUBLE AS r FROM events GROUP BY user_id UNION ALL SELECT 'domain', 'd' || user_id, 0.5::DOUBLE, CASE WHEN user_id % 3 = 0 THEN 0 ELSE count(*) FILTER (event_type = 'error')::DOUBLE / count(*) END, CASE WHEN user_id % 3 = 0 THEN 0 ELSE count(*) FILTER (event_type = 'click')::DOUBLE / count(*) END, CASE WHEN user_id % 5 > 0 THEN 0 ELSE count(*) FILTER (event_type = 'view')::DOUBLE / count(*) END FROM events GROUP BY user_id)"
VALUES = "[b.least, b.first, b.most][abs(('0x' || left(md5(m.target_id || b.p), 6))::BIGINT) % 3 + 1]"
PARAMETERS = ", ".join(f"('{'engine' if p.startswith('engine') else 'domain'}', '{p}', {b[0]}::DOUBLE, {b[1]}::DOUBLE, {b[2]}::DOUBLE, {b[3]}::DOUBLE, {b[4]}::DOUBLE)" for p, b in po.BOUNDS.items())
WAY = "CASE p WHEN 'engine_weight' THEN CASE WHEN s < 0.5::DOUBLE THEN -1 WHEN s > 0.9::DOUBLE THEN 1 END WHEN 'engine_qps' THEN CASE WHEN s < 0.7::DOUBLE THEN -1 END WHEN 'headful_ratio' THEN CASE WHEN c + f + r > 0.3::DOUBLE THEN 1 WHEN c + f + r < 0.05::DOUBLE AND v > 0.1::DOUBLE THEN -1 END WHEN 'tor_usage_ratio' THEN CASE WHEN f > 0.2::DOUBLE OR r > 0.2::DOUBLE THEN 1 END WHEN 'domain_cooldown' THEN CASE WHEN c > 0.3::DOUBLE THEN 1 END END"
CYCLE = f"{RATES}, b(t, p, least, most, first, up, down) AS (VALUES {PARAMETERS}), t AS (SELECT m.*, b.*, {VALUES} AS v, ('0x' || left(md5(b.p || m.target_id), 6))::BIGINT % 2 = 0 AS rested FROM m JOIN b ON b.t = m.target_type), w AS (SELECT *, {WAY} AS way FROM t WHERE rested), u AS (SELECT target_type, target_id, p AS parameter, v AS old_value, round(greatest(least, least(most, v + way * CASE WHEN way > 0 THEN up ELSE down END)), 9) AS new_value FROM w WHERE way IS NOT NULL) "
CYCLE = CYCLE.replace("round(greatest(least, least(most", "round(greatest(w.least, least(w.most")


def cycle(spark, sf_dir):
    n, k, u = F.count("*"), col("event_type"), col("user_id")
    share = lambda c: F.count_if(c) / n
    e = events(spark, sf_dir).groupBy("user_id").agg(share((col("event_id") % 3 > 0) | (u % 4 == 0)).alias("s"), share(k == "error").alias("c"), share(k == "click").alias("f"), share(k == "view").alias("r"))
    none = lit(None).cast("double")
    m = e.select(lit("engine").alias("target_type"), F.concat(lit("e"), s(u)).alias("target_id"), col("s").alias("success_rate"), none.alias("captcha_rate"), none.alias("error_403_rate"), none.alias("error_429_rate"))
    m = m.union(e.select(lit("domain"), F.concat(lit("d"), s(u)), none, F.when(u % 3 > 0, col("c")), F.when(u % 3 > 0, col("f")), F.when(u % 5 == 0, col("r"))))
    state = po.first_state(m, lit(NOW))
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("long")
    values = F.create_map(*[x for p, b in po.BOUNDS.items() for x in (lit(p), F.array(lit(b[0]), lit(b[2]), lit(b[1])))])
    state = state.withColumn("value", F.element_at(values[col("parameter")], (number(F.concat("target_id", "parameter")) % 3 + 1).cast("int")))
    state = state.withColumn("changed_at", F.when(number(F.concat("parameter", "target_id")) % 2 == 0, lit(datetime(2024, 1, 31, 23, 55))).otherwise(lit(datetime(2024, 1, 31, 23, 55, 1))))
    return state, po.policy_updates(m, state, lit(NOW))


@query("X28_policy_cycle", CYCLE + "SELECT * FROM u WHERE new_value <> old_value")
def x28(spark, sf_dir):
    return cycle(spark, sf_dir)[1].drop("reason")


@query("X24_persisted_policy", CYCLE + ", x AS (SELECT * FROM u WHERE new_value <> old_value) SELECT 'e' || user_id AS engine, coalesce(w.new_value, 1.0::DOUBLE) AS weight, coalesce(q.new_value, 0.25::DOUBLE) AS qps_limit, w.new_value IS NOT NULL OR q.new_value IS NOT NULL AS changed FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN x w ON w.target_id = 'e' || user_id AND w.parameter = 'engine_weight' LEFT JOIN x q ON q.target_id = 'e' || user_id AND q.parameter = 'engine_qps'")
def x24(spark, sf_dir):
    engines = events(spark, sf_dir).select(F.concat(lit("e"), s(col("user_id"))).alias("engine"), lit(1.0).alias("weight"), lit(0.25).alias("qps_limit"), lit(datetime(2024, 1, 1)).alias("updated_at")).distinct()
    d = po.persist_updates(engines, "engine", cycle(spark, sf_dir)[1], {"engine_weight": "weight", "engine_qps": "qps_limit"}, lit(NOW))
    return d.select("engine", "weight", "qps_limit", (col("updated_at") == lit(NOW)).alias("changed"))


@query("X55_evaluations", "SELECT event_id AS id, event_type AS source, ts AS evaluated_at, value AS brier FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 50")
def x55(spark, sf_dir):
    h = events(spark, sf_dir).select(col("event_id").alias("id"), col("event_type").alias("source"), col("ts").alias("evaluated_at"), col("value").alias("brier"))
    return po.evaluations(h, "click", lit(datetime(2024, 1, 10)))[0]


@query("X57_learned_policies", "WITH c AS (SELECT 'd' || user_id AS domain, event_id AS n, CASE WHEN event_id % 3 = 0 THEN value END AS block_score, CASE WHEN event_id % 50 = 0 THEN value END AS captcha_rate FROM events) SELECT domain, coalesce(arg_max(block_score, n) FILTER (block_score IS NOT NULL), 0.0::DOUBLE) AS block_score, coalesce(arg_max(captcha_rate, n) FILTER (captcha_rate IS NOT NULL), 0.0::DOUBLE) AS captcha_rate, 'unverified' AS category FROM c WHERE domain NOT LIKE '%3' GROUP BY 1")
def x57(spark, sf_dir):
    e, i = events(spark, sf_dir), col("event_id")
    d = F.concat(lit("d"), s(col("user_id")))
    p = e.select(d.alias("domain"), lit(0.0).alias("block_score"), lit(0.0).alias("captcha_rate"), lit("unverified").alias("category")).distinct().where("domain not like '%3'")
    return po.learned(p, e.select(d.alias("domain"), i.alias("at"), F.when(i % 3 == 0, col("value")).alias("block_score"), F.when(i % 50 == 0, col("value")).alias("captcha_rate")), ["block_score", "captcha_rate"])


KINDS = ["query", "page", "page", "error", "fragments", "claim", "citation", "llm_time", "time", "page"]
FLAGS = ["tor", "headful", "referer", "revisit", "not_modified", "primary", "aggregator", "timeline", "contradiction", "loop", "captcha", "403", "429"]
HELD = [(f, 2 + n % 5) for n, f in enumerate(FLAGS)]
COUNTERS = {
    "tor_requests": ("page", "tor"), "headful_requests": ("page", "headful"), "referer_matched": ("page", "referer"), "revisit_count": ("page", "revisit"), "primary_sources": ("page", "primary"), "aggregator_sources": ("page", "aggregator"),
    "captcha_count": ("error", "captcha"), "error_403_count": ("error", "403"), "error_429_count": ("error", "429"), "claims_with_timeline": ("claim", "timeline"), "contradictions_found": ("claim", "contradiction"), "citation_loops_detected": ("citation", "loop"),
}
COUNTED = f"WITH e AS (SELECT user_id AS task_id, {sql_pick(KINDS, 'event_id')} AS kind, event_id, 'D' || (event_id % 17) AS domain, event_id // 10 AS n, event_id // 20 AS useful, list_filter([{', '.join(f'''CASE WHEN event_id // 10 % {m} = 0 THEN '{f}' END''' for f, m in HELD)}], lambda x: x IS NOT NULL) AS flags FROM events), c AS (SELECT task_id, count(*) FILTER (kind = 'query') AS total_queries, count(*) FILTER (kind = 'page') AS total_pages_fetched, count(*) FILTER (kind = 'page') AS total_requests, count(*) FILTER (kind = 'page') AS total_sources, count(*) FILTER (kind = 'page' AND list_contains(flags, 'revisit') AND list_contains(flags, 'not_modified')) AS cache_304_hits, " + ", ".join(f"count(*) FILTER (kind = '{k}' AND list_contains(flags, '{f}')) AS {n}" for n, (k, f) in COUNTERS.items()) + ", count(*) FILTER (kind = 'claim') AS total_claims, count(*) FILTER (kind = 'citation') AS total_citations, " + ", ".join(f"coalesce(sum({x}) FILTER (kind = '{k}'), 0)::BIGINT AS {n}" for n, k, x in (("total_fragments", "fragments", "n"), ("useful_fragments", "fragments", "useful"), ("llm_time_ms", "llm_time", "n"), ("total_time_ms", "time", "n"))) + ", count(DISTINCT lower(domain)) FILTER (kind = 'page') AS unique_domains FROM e GROUP BY 1) "


def task_events(spark, sf_dir):
    i = col("event_id")
    t = F.floor(i / 10)
    flags = F.array_compact(F.array(*[F.when(t % m == 0, f) for f, m in HELD]))
    return po.task_counters(events(spark, sf_dir).select(col("user_id").alias("task_id"), pick(KINDS, i).alias("kind"), F.concat(lit("D"), s(i % 17)).alias("domain"), flags.alias("flags"), t.alias("n"), F.floor(i / 20).alias("useful")))


@query("X22b_task_counters", COUNTED + "SELECT * FROM c")
def x22b(spark, sf_dir):
    return task_events(spark, sf_dir)


@query("C11_task_figures", COUNTED + "SELECT task_id, " + ", ".join(f"round(CASE WHEN {d} > 0 THEN {'1 - ' if m == 'duplicate_rate' else ''}{n}::DOUBLE / {d} ELSE 0 END, 9) AS {m}" for m, (n, d) in po.RATIOS.items()) + " FROM c")
def c11(spark, sf_dir):
    return po.task_figures(task_events(spark, sf_dir))


HYPOTHESES = ["A study of drug effects", "政府の規制 and policy", "株式会社の決算", "protocol specification", "Latest news", "nothing of the kind", "Research paper on API regulation"]
HAS = "CASE WHEN " + " WHEN ".join(f"h = '{x}' THEN {v}" for x, v in zip(HYPOTHESES, ["['academic']", "['government']", "['corporate']", "['technical']", "['news']", "['academic', 'government']", "['academic', 'government']"], strict=True)) + " END"


@query("X5_templates", f"WITH h AS (SELECT conv_id, turn, role, {sql_pick(HYPOTHESES, 'conv_id')} AS h FROM conversations) SELECT conv_id, turn, role, {HAS} AS templates, CASE WHEN list_contains({HAS}, 'academic') THEN CASE WHEN list_contains({HAS}, 'government') THEN '{qu.NOTES['academic']} {qu.NOTES['government']}' ELSE '{qu.NOTES['academic']}' END WHEN list_contains({HAS}, 'government') THEN '{qu.NOTES['government']}' ELSE '{qu.NO_NOTE}' END AS notes FROM h")
def x5(spark, sf_dir):
    t = qu.templates_for(pick(HYPOTHESES, col("conv_id")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", t.alias("templates"), qu.notes_for(F.array().cast("array<string>"), t).alias("notes"))


ASKED = ["drug -trial site:who.int \"side effects\" +dose", "plain words", "intitle:\"long title\" after:2024-01 filetype:pdf", "-5 degrees well-known -ads -spam", "SITE:a.org site:b.org x", ""]
GOOGLE = ["drug site:who.int \"side effects\" -trial +dose", "plain words", "filetype:pdf intitle:long title after:2024-01", "-5 degrees well-known -spam -ads", "x site:b.org site:a.org", ""]
BING = [g.replace(" after:2024-01", "") for g in GOOGLE]


@query("X46_engine_queries", f"SELECT conv_id, turn, role, {sql_pick(GOOGLE, 'conv_id')} AS google, {sql_pick(BING, 'conv_id')} AS bing FROM conversations")
def x46(spark, sf_dir):
    p = qu.parse_operators(pick(ASKED, col("conv_id")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", qu.write_query(p, "Google").alias("google"), qu.write_query(p, "bing").alias("bing"))


CANDIDATES = """
q_k AS (SELECT e.id AS citation_edge_id, p.id AS candidate_page_id, p.url AS candidate_url, tp.depth, e.created_at FROM g_cites e JOIN g_pages p ON e.target_id = p.id JOIN g_task_pages tp ON tp.page_id = e.source_id AND tp.task_id = 1
WHERE p.url NOT ILIKE 'javascript:%' AND p.url NOT ILIKE 'mailto:%' AND p.id NOT IN (SELECT page_id FROM g_task_pages WHERE task_id = 1)
AND p.id NOT IN (SELECT f.page_id FROM g_fragments f JOIN g_origin o ON o.source_id = f.id JOIN g_claims c ON c.id = o.target_id AND c.task_id = 1))
"""


def candidates(g):
    from quern.operators import views as vw

    return vw.reference_candidates(g, 1)


def shown(d):
    return d.select("citation_edge_id", "candidate_page_id", "kind", "target")


on_graph("S28b_queued_candidates", lambda g: shown(so.candidate_targets(candidates(g), exclude=g.cites.where("source_id % 7 = 0").select(col("id").alias("citation_edge_id")), limit=25)), CANDIDATES.lstrip() + ", q_x AS (SELECT id FROM g_cites WHERE source_id % 7 = 0) SELECT citation_edge_id, candidate_page_id, 'url' AS kind, candidate_url AS target FROM q_k WHERE citation_edge_id NOT IN (SELECT id FROM q_x) ORDER BY depth, created_at DESC, citation_edge_id LIMIT 25")


@query("S32b_claim_feedback", "WITH f AS (SELECT user_id AS id, event_type AS k, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k) AS n FROM events WHERE event_type IN ('error', 'signup') AND event_id % 3 = 0), u AS (SELECT DISTINCT user_id AS id FROM events) SELECT u.id, CASE WHEN f.k IS NULL THEN 'new' WHEN f.k = 'error' THEN 'not_adopted' ELSE 'adopted' END AS status, CASE WHEN f.k = 'error' THEN 'r' || f.event_id END AS reason, f.ts AS \"at\" FROM u LEFT JOIN f ON f.id = u.id AND f.n = 1")
def s32b(spark, sf_dir):
    e, k = events(spark, sf_dir), col("event_type")
    f = e.where(k.isin("error", "signup") & (col("event_id") % 3 == 0)).select(col("user_id").alias("id"), F.when(k == "error", "reject").otherwise("restore").alias("action"), F.concat(lit("r"), s(col("event_id"))).alias("reason"), col("ts").alias("at"))
    return so.claim_feedback(e.select(col("user_id").alias("id"), lit("new").alias("status")).distinct(), f)


@query("S39b_stopped_jobs", JOBS_SQL.rstrip() + ", j AS (SELECT id, id % 6 AS task_id, CASE kind WHEN 'click' THEN 'target_queue' ELSE kind END AS kind, state FROM jobs) SELECT id, task_id, kind, CASE WHEN state = 'queued' AND (task_id IN (1, 3) OR task_id IN (0, 2) AND kind = 'target_queue') OR state = 'running' AND (task_id = 3 OR task_id = 2 AND kind = 'target_queue') THEN 'cancelled' ELSE state END AS state FROM j")
def s39b(spark, sf_dir):
    j = jobs(spark, sf_dir).select("id", (col("id") % 6).alias("task_id"), F.when(col("kind") == "click", "target_queue").otherwise(col("kind")).alias("kind"), "state")
    stops = spark.createDataFrame([(0, "graceful", "target_queue_only"), (1, "graceful", "all_jobs"), (2, "immediate", "target_queue_only"), (3, "full", "all_jobs")], "task_id long, mode string, scope string")
    return so.cancel_jobs(j, stops)


@query("H2b_paragraph_headings", """WITH x AS (SELECT page_id, regexp_extract_all(html, '(?is)<h1[^>]*>.*?</h1>|<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>|<h4[^>]*>.*?</h4>|<h5[^>]*>.*?</h5>|<h6[^>]*>.*?</h6>|<p[^>]*>.*?</p>') AS x FROM pages), y AS (SELECT page_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM x), z AS (SELECT *, nullif(regexp_extract(x, '(?i)^<h([1-6])', 1), '')::INT AS level, trim(regexp_replace(x, '<[^>]+>', '', 'g')) AS text FROM y),
h AS (SELECT * FROM z WHERE level IS NOT NULL AND text <> ''), p AS (SELECT page_id, i, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position FROM z WHERE level IS NULL),
l AS (SELECT p.*, h.i AS hi, h.level, h.text, (SELECT min(k.level) FROM h k WHERE k.page_id = p.page_id AND k.i > h.i AND k.i < p.i) AS later FROM p JOIN h ON h.page_id = p.page_id AND h.i < p.i),
n AS (SELECT page_id, position, string_agg(level || ' ' || text, ' / ' ORDER BY level) FILTER (later IS NULL OR later > level) AS headings, arg_max(text, hi) AS context, position - (SELECT count(*) FROM p q WHERE q.page_id = l.page_id AND q.i < max(l.hi)) AS element FROM l GROUP BY 1, 2)
SELECT p.page_id, p.position, coalesce(headings, '') AS headings, context, coalesce(element, p.position) AS element FROM p LEFT JOIN n ON n.page_id = p.page_id AND n.position = p.position""")
def h2b(spark, sf_dir):
    from quern.functions import rules as ru

    d = table(spark, sf_dir, "pages").select("page_id", F.explode(ru.paragraph_headings(col("html"))).alias("p"))
    headings = F.array_join(F.transform("p.hierarchy", lambda h: F.concat(s(h["level"]), lit(" "), h["text"])), " / ")
    return d.select("page_id", col("p.position").cast("long").alias("position"), headings.alias("headings"), "p.context", col("p.element").cast("long").alias("element"))


NAMES = ["Acme Corp.", "ACME  Corporation", "株式会社山田", "山田 株式会社", "（株）テスト", "Ｆｏｏ Ltd", "Smith & Co. Group", "O'Neil-Ray LLC", "한국 회사", "", "123"]
NAMED = [("acme corp", "corp", "en"), ("acme corp", "corp", "en"), ("山田 KK", "KK", "ja"), ("山田 KK", "KK", "ja"), ("テスト KK", "KK", "ja"), ("foo ltd", "ltd", "en"), ("smith group co", "co", "en"), ("o'neil-ray llc", "llc", "en"), ("한국 회사", None, "ko"), ("", None, None), ("123", None, None)]


@query("F9_names", f"SELECT conv_id, turn, role, {sql_pick([n[0] for n in NAMED], 'conv_id')} AS canonical, {sql_pick([n[1] for n in NAMED], 'conv_id')} AS legal_form, {sql_pick([n[2] for n in NAMED], 'conv_id')} AS language FROM conversations")
def f9(spark, sf_dir):
    from quern.functions import identity as idn

    n = idn.normalised_name(pick(NAMES, col("conv_id")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", n["canonical"].alias("canonical"), n["legal_form"].alias("legal_form"), n["language"].alias("language"))
