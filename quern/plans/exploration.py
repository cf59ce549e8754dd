"""Registered queries: counters and status of searches, queues, archives and pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quern.operators import dedup as dd
from quern.operators import evidence as ev
from quern.operators import exploration as ex
from quern.sources import tables as tb
from quern.sources.graph import BRIDGE_SQL, bridge, table

from .embedded import JOBS_SQL, jobs
from .registry import on_graph, query
from .texts import EXACT

col, lit = F.col, F.lit
SAID = ["Acme Widgets Inc. sells Gadget X2000 in Boston, MA", "株式会社山田 は 東京 と 大阪", "no names here", "IBM and Sony Ltd", "日本電気株式会社 makes PC98", ""]
PATTERNS = [(n, k, p) for n, (k, p) in enumerate((k, p) for k, ps in ex.ENTITY_PATTERNS.items() for p in ps)]
SAID_SQL = "[" + ", ".join(f"'{s}'" for s in SAID) + f"][conv_id % {len(SAID)} + 1]"


@query("X4_entities", f"WITH h AS (SELECT conv_id || '-' || turn || '-' || role AS id, {SAID_SQL} || '. ' || text AS t FROM conversations), m AS (" + " UNION ALL ".join(f"SELECT id, {n} AS n, '{k}' AS kind, unnest(regexp_extract_all(t, '{p}', 1)) AS m FROM h" for n, k, p in PATTERNS) + ") SELECT id, m AS text, arg_min(kind, n) AS kind FROM m WHERE length(m) > 2 GROUP BY 1, 2")
def x4(spark, sf_dir):
    said = F.element_at(F.array(*[lit(s) for s in SAID]), (col("conv_id") % len(SAID) + 1).cast("int"))
    return ex.entities_in(table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn", "role").alias("id"), F.concat(said, lit(". "), "text").alias("text")))


COUNTERS = """
WITH e AS (SELECT user_id AS search_id, ts AS "at", event_id AS n, event_type IN ('click', 'signup') AS page, event_id % 40 = 0 AS p, event_id % 29 = 0 AS i, value > 50 AS useful, event_id % 7 = 0 AND user_id % 3 > 0 AS novel FROM events),
r AS (SELECT search_id, count(*) FILTER (novel)::DOUBLE / count(*) AS novelty FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY "at" DESC, n DESC) AS k FROM e WHERE NOT page) WHERE k <= 20 GROUP BY 1),
c AS (SELECT search_id, count(*) FILTER (page) AS pages, count(*) FILTER (NOT page) AS fragments, count(*) FILTER (NOT page AND useful) AS useful, count(*) FILTER (page AND i) AS sources, coalesce(bool_or(page AND p), false) AS has_primary FROM e GROUP BY 1),
d AS (SELECT c.*, round(coalesce(novelty, 1), 9) AS novelty, round(least(1, least(1, sources::DOUBLE / 3) * 0.7::DOUBLE + CASE WHEN has_primary THEN 0.3::DOUBLE ELSE 0 END), 9) AS score FROM c LEFT JOIN r USING (search_id)),
s AS (SELECT *, CASE WHEN score >= 0.8::DOUBLE THEN 'satisfied' WHEN sources > 0 THEN 'partial' WHEN novelty < 0.1::DOUBLE AND pages > 10 THEN 'exhausted' ELSE 'running' END AS status FROM d)
"""


def counters(spark, sf_dir):
    i, k = col("event_id"), col("event_type")
    e = table(spark, sf_dir, "events").select(col("user_id").alias("search_id"), col("ts").alias("at"), i.alias("n"), F.when(k.isin("click", "signup"), "page").otherwise("fragment").alias("kind"), lit("d").alias("domain"), (i % 40 == 0).alias("primary"), (i % 29 == 0).alias("independent"), (col("value") > 50).alias("useful"), ((i % 7 == 0) & (col("user_id") % 3 > 0)).alias("novel"))
    return ex.search_counters(e)


@query("X20_search_counters", COUNTERS + "SELECT * FROM s")
def x20(spark, sf_dir):
    return counters(spark, sf_dir)


@query("X21_exploration_status", COUNTERS + "SELECT count(*) FILTER (status = 'satisfied') AS satisfied_count, count(*) FILTER (status = 'partial') AS partial_count, count(*) FILTER (status = 'running') AS running_count, count(*) FILTER (status = 'exhausted') AS exhausted_count, sum(pages)::BIGINT AS total_pages, sum(fragments)::BIGINT AS total_fragments, count(*) FILTER (status IN ('running', 'partial')) = 0 AS finished, CASE WHEN count(*) FILTER (status = 'exhausted') > 0 THEN [count(*) FILTER (status = 'exhausted') || ' searches stopped by diminishing harvest'] ELSE [] END AS warnings FROM s")
def x21(spark, sf_dir):
    return ex.exploration_status(counters(spark, sf_dir))


SNAPSHOTS = "WITH t AS (SELECT 'u' || user_id % 60 AS url, ts AS \"at\", 'a' || chr(10) || 'b' || (event_id % 3) || chr(10) || 'c' || (user_id // 60 + event_id % 2) || chr(10) || event_type AS text FROM events) "


def snapshots(spark, sf_dir):
    s = lambda c: c.cast("string")
    i, u = col("event_id"), col("user_id")
    text = F.concat(lit("a\nb"), s(i % 3), lit("\nc"), s(F.floor(u / 60) + i % 2), lit("\n"), "event_type")
    return table(spark, sf_dir, "events").select(F.concat(lit("u"), s(u % 60)).alias("url"), col("ts").alias("at"), text.alias("text"))


@query("X30_archive_changes", SNAPSHOTS + ", l AS (SELECT url, \"at\", text, lag(text) OVER (PARTITION BY url ORDER BY \"at\", text) AS old FROM t), d AS (SELECT *, list_distinct(string_split(old, chr(10))) AS a, list_distinct(string_split(text, chr(10))) AS b FROM l WHERE old IS NOT NULL), e AS (SELECT *, CASE WHEN old = text THEN 1 ELSE round(2 * len(list_intersect(a, b))::DOUBLE / (len(a) + len(b)), 9) END AS similarity FROM d) SELECT url, \"at\", similarity, CASE WHEN old = text THEN 'content_unchanged' WHEN similarity < 0.5::DOUBLE THEN 'content_major_change' ELSE 'content_modified' END AS change FROM e")
def x30(spark, sf_dir):
    return ex.archive_changes(snapshots(spark, sf_dir))


@query("X31_sampled_snapshots", SNAPSHOTS + ", k AS (SELECT url, \"at\", row_number() OVER (PARTITION BY url ORDER BY \"at\") - 1 AS k, count(*) OVER (PARTITION BY url) AS n FROM (SELECT DISTINCT url, \"at\" FROM t)) SELECT url, \"at\" FROM k WHERE n <= 7 OR list_contains(list_transform(range(0, 7), lambda j: floor(j * (n - 1)::DOUBLE / 6 + 1e-9)::BIGINT), k)")
def x31(spark, sf_dir):
    return ex.sample_snapshots(snapshots(spark, sf_dir).select("url", "at").distinct(), 7)


@query("X33_best_links")
def x33(spark, sf_dir):
    return ex.best_links(ev.links(table(spark, sf_dir, "pages")), 3).select("page_id", "href", "kind", "priority", "place")


@query("X38_dedup_report", f"WITH RECURSIVE {EXACT}, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(id, reach) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach), l AS (SELECT id, min(reach) AS cluster FROM r GROUP BY 1), c AS (SELECT count(*) AS clusters, coalesce(sum(n - 1), 0) AS copies FROM (SELECT count(*) AS n FROM l GROUP BY cluster) WHERE n > 1) SELECT (SELECT count(*) FROM documents) AS original_count, ((SELECT count(*) FROM documents) - copies)::BIGINT AS deduplicated_count, clusters, round(copies::DOUBLE / (SELECT count(*) FROM documents), 9) AS duplicate_ratio FROM c")
def x38(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(col("doc_id").alias("id"), "text")
    return ex.dedup_report(t, dd.linked(*dd.exact_classes(t)))


AUTH = JOBS_SQL + ", a AS (SELECT id, CASE WHEN id % 9 > 0 THEN 'd' || id % 40 END AS domain, kind AS auth_type, CASE priority WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority, queued_at FROM jobs WHERE state = 'queued') "


def pending(spark, sf_dir):
    p = F.when(col("priority") == 0, "high").when(col("priority") == 1, "medium").otherwise("low")
    return jobs(spark, sf_dir).where("state = 'queued'").select("id", F.when(col("id") % 9 > 0, F.concat(lit("d"), (col("id") % 40).cast("string"))).alias("domain"), col("kind").alias("auth_type"), p.alias("priority"), "queued_at")


@query("X56_queue_by_domain", AUTH + "SELECT coalesce(domain, 'unknown') AS \"group\", count(*) AS items, list_sort(list(id)) AS ids, min(queued_at) AS oldest FROM a WHERE priority = 'low' GROUP BY 1")
def x56(spark, sf_dir):
    return ex.queue_by(pending(spark, sf_dir), "domain", "low")


@query("X56b_resolved_queue", JOBS_SQL + ", s AS (SELECT user_id AS id, arg_min(value > 50, (ts, event_id)) AS ok FROM events WHERE event_type = 'view' GROUP BY 1) SELECT j.id, CASE WHEN j.state = 'queued' AND ok IS NOT NULL THEN CASE WHEN ok THEN 'completed' ELSE 'failed' END WHEN j.state = 'queued' THEN 'pending' ELSE j.state END AS status FROM jobs j LEFT JOIN s ON s.id = j.id")
def x56b(spark, sf_dir):
    items = jobs(spark, sf_dir).select("id", F.when(col("state") == "queued", "pending").otherwise(col("state")).alias("status"))
    first = table(spark, sf_dir, "events").where("event_type = 'view'").select(col("user_id").alias("id"), (col("value") > 50).alias("success"), F.struct("ts", "event_id").alias("at"))
    return ex.resolve(items, first)


@query("A12_embedding_rows", "SELECT 'claim:' || vec_id || ':m1' AS id, 'claim' AS target_type, vec_id AS target_id, 'm1' AS model_id, len(embedding) AS dimension, round(embedding[1], 6) AS head FROM embeddings")
def a12(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(col("vec_id").alias("target_id"), "embedding")
    return ex.embedding_rows(v.union(v.where("target_id % 3 = 0")), "claim", "m1").select("id", "target_type", "target_id", "model_id", col("dimension").cast("long").alias("dimension"), F.round(col("embedding")[0], 6).alias("head"))


@query("X49_claim_embeddings", BRIDGE_SQL + "SELECT c.id AS claim_id, round(v.embedding[1], 6) AS head, len(v.embedding) AS dimension FROM g_claims c JOIN embeddings v ON v.vec_id = c.id WHERE c.task_id IN (1, 2)")
def x49(spark, sf_dir):
    """Embeddings of two tasks' claims, packed as a store holds them and unpacked again."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(tb.pack_vector)

    claims = bridge(spark, sf_dir).claims.where("task_id in (1, 2)").select(col("id").alias("claim_id"))
    v = table(spark, sf_dir, "embeddings").select(col("vec_id").alias("claim_id"), pack("embedding").alias("embedding_blob"))
    d = claims.join(tb.vectors_from_blobs(v), "claim_id")
    return d.select("claim_id", F.round(col("embedding")[0], 6).alias("head"), F.size("embedding").cast("long").alias("dimension"))


@query("B13_allow_listed", "SELECT event_id, '{\"ok\":' || (event_id % 2 = 0) || ',\"data\":{\"k\":' || json_extract_string(props, '$.k') || ',\"list\":[{\"a\":' || user_id || '}]}}' AS response FROM events")
def b13(spark, sf_dir):
    raw = F.concat(lit('{"secret":"x","ok":'), (col("event_id") % 2 == 0).cast("string"), lit(',"data":{"k":'), F.get_json_object("props", "$.k"), lit(',"path":"/etc","list":[{"a":'), col("user_id").cast("string"), lit(',"b":"hidden"}]},"trace":["t"]}'))
    return table(spark, sf_dir, "events").select("event_id", ex.allow_listed(raw, "ok boolean, data struct<k: int, list: array<struct<a: bigint>>>").alias("response"))


ROBOTS = [("user-agent", "*"), ("Disallow", "/a"), ("Allow", "/a/b"), ("disallow", "/*.pdf$"), ("Crawl-delay", "3"), ("user-agent", "other"), ("disallow", "/"), ("sitemap", "https://x/s.xml")]
PATHS = ["/", "/a", "/a/b/c", "/a/c", "/x.pdf", "/x.pdf?y", "/b"]


@query("X32_robots", "WITH p AS (SELECT page_id, ['/', '/a', '/a/b/c', '/a/c', '/x.pdf', '/x.pdf?y', '/b'][page_id % 7 + 1] AS path FROM pages) SELECT page_id, path, page_id % 2 = 1 OR path IN ('/', '/b', '/a/b/c', '/x.pdf?y') AS allowed, CASE WHEN page_id % 2 = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS delay FROM p")
def x32(spark, sf_dir):
    lines = spark.createDataFrame([("h0", n, f"{k}: {v} # note") for n, (k, v) in enumerate(ROBOTS)] + [("h1", 0, "User-agent: nobody"), ("h1", 1, "Disallow: /")], "domain string, pos int, value string")
    rules = tb.robots_rules(lines, "me")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(lit("h"), (col("page_id") % 2).cast("string")).alias("domain"), F.element_at(F.array(*[lit(x) for x in PATHS]), (col("page_id") % len(PATHS) + 1).cast("int")).alias("path"))
    d = ex.robots_allow(p, rules, tb.path_matches).join(ex.crawl_delay(rules), "domain", "left")
    return d.select("page_id", "path", "allowed", F.coalesce("delay", lit(1.0)).alias("delay"))


on_graph("G19_graph_json", lambda g: ex.graph_json(g.claims.select(F.concat(lit("claim:"), col("id").cast("string")).alias("id"), lit("claim").alias("kind")).union(g.fragments.select(F.concat(lit("fragment:"), col("id").cast("string")), lit("fragment"))), g.nli.select(F.concat(lit("fragment:"), col("source_id").cast("string")).alias("src"), F.concat(lit("claim:"), col("target_id").cast("string")).alias("dst"), "relation")), """
q_n AS (SELECT 'claim:' || id AS id, 'claim' AS kind FROM g_claims UNION ALL SELECT 'fragment:' || id, 'fragment' FROM g_fragments),
q_o AS (SELECT 'fragment:' || source_id AS id, count(*) AS n, '[' || string_agg('{"relation":"' || relation || '","dst":"claim:' || target_id || '"}', ',' ORDER BY relation, 'claim:' || target_id) || ']' AS e FROM g_nli GROUP BY 1),
q_i AS (SELECT 'claim:' || target_id AS id, count(*) AS n FROM g_nli GROUP BY 1)
SELECT q_n.id, '{"id":"' || q_n.id || '","kind":"' || kind || '","edges":' || coalesce(e, '[]') || ',"out":' || coalesce(q_o.n, 0) || ',"in":' || coalesce(q_i.n, 0) || '}' AS json FROM q_n LEFT JOIN q_o ON q_o.id = q_n.id LEFT JOIN q_i ON q_i.id = q_n.id""")
