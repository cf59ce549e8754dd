"""Registered queries: ingest and cache operators (A) on tables derived from the sample data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.sources import tables as tb
from quern.sources.graph import table

from .registry import query

col = F.col
WORK = ["canonical_id", "title", "citation_count", "reference_count", "is_open_access", "oa_url", "pdf_url"]


def works(spark, sf_dir, batch: bool):
    """Old works from even parts, new ones from parts divisible by three, twice each."""
    p = table(spark, sf_dir, "part").select(col("p_partkey").alias("k"), "p_name", "p_size")
    if not batch:
        return p.where("k % 2 = 0").select(col("k").alias("canonical_id"), col("p_name").alias("title"), (col("p_size") % 7).cast("long").alias("citation_count"), col("p_size").cast("long").alias("reference_count"), (col("k") % 4 == 0).alias("is_open_access"), F.when(col("k") % 5 == 0, "old").alias("oa_url"), F.lit(None).cast("string").alias("pdf_url"))
    p = p.where("k % 3 = 0").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("at"))
    return p.select(col("k").alias("canonical_id"), F.concat_ws("-", "p_name", "at").alias("title"), (col("p_size") % 11).cast("long").alias("citation_count"), col("at").cast("long").alias("reference_count"), F.when(col("k") % 9 == 0, F.lit(True)).alias("is_open_access"), F.when(col("at") == 1, "new").alias("oa_url"), F.when(col("k") % 6 == 0, F.concat(F.lit("p"), col("at").cast("string"))).alias("pdf_url"), "at")


WORKS_SQL = """WITH o AS (SELECT p_partkey AS k, p_name AS title, (p_size % 7)::BIGINT AS cc, p_size::BIGINT AS rc, p_partkey % 4 = 0 AS oa, CASE WHEN p_partkey % 5 = 0 THEN 'old' END AS oa_url, NULL::VARCHAR AS pdf, 0 AS step FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT p_partkey, p_name || '-' || step, (p_size % 11)::BIGINT, step::BIGINT, CASE WHEN p_partkey % 9 = 0 THEN true END, CASE WHEN step = 1 THEN 'new' END, CASE WHEN p_partkey % 6 = 0 THEN 'p' || step END, step FROM part, (VALUES (1), (2)) t(step) WHERE p_partkey % 3 = 0), u AS (SELECT * FROM o UNION ALL SELECT * FROM n)
SELECT k AS canonical_id, arg_min(title, step) AS title, max(cc) AS citation_count, max(rc) AS reference_count, arg_max(oa, step) AS is_open_access, arg_max(oa_url, step) AS oa_url, arg_max(pdf, step) AS pdf_url FROM u GROUP BY k"""


@query("A6_upsert_works", WORKS_SQL)
def a6(spark, sf_dir):
    return tb.upsert_works(works(spark, sf_dir, False), works(spark, sf_dir, True), "at")


@query("A1_scan", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def a1(spark, sf_dir):
    return tb.scan(spark, sf_dir, "nation").join(F.broadcast(tb.scan(spark, sf_dir, "region")), col("n_regionkey") == col("r_regionkey")).select("n_name", "r_name")


@query("A4_insert_or_replace", "SELECT event_type, user_id, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def a4(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    merged = tb.insert(old.groupBy("event_type", "user_id").agg(F.max("event_id").alias("event_id")), new, ["event_type", "user_id"], "event_id", replace=True)
    return merged.unionByName(old).groupBy("event_type", "user_id").agg(F.max("event_id").alias("event_id"))


@query("A5_update", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 99 ELSE p_size END AS p_size, p_name FROM part")
def a5(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    return tb.update(p, p.where("p_partkey % 7 = 0").select("p_partkey", F.lit(99).alias("p_size")), ["p_partkey"])


@query("A7_upsert_identifiers", "WITH o AS (SELECT 'openalex' AS provider, s_suppkey AS pid, s_suppkey AS c, CASE WHEN s_suppkey % 2 = 0 THEN 'd' || s_suppkey END AS doi, 'a1' AS arx FROM supplier WHERE s_suppkey % 3 > 0), n AS (SELECT 'openalex' AS provider, s_suppkey AS pid, s_suppkey + 1 AS c, CASE WHEN s_suppkey % 5 = 0 THEN 'n' || s_suppkey END AS doi, NULL::VARCHAR AS arx FROM supplier WHERE s_suppkey % 3 < 2) SELECT provider, pid AS provider_paper_id, coalesce(o.c, n.c) AS canonical_id, coalesce(n.doi, o.doi) AS doi, coalesce(n.arx, o.arx) AS arxiv_id FROM o FULL JOIN n USING (provider, pid)")
def a7(spark, sf_dir):
    k = col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    tag = lambda p: F.concat(F.lit(p), k.cast("string"))
    row = lambda c, doi, arx: [F.lit("openalex").alias("provider"), k.alias("provider_paper_id"), c.alias("canonical_id"), doi.alias("doi"), arx.alias("arxiv_id")]
    old = s.where("s_suppkey % 3 > 0").select(*row(k, F.when(k % 2 == 0, tag("d")), F.lit("a1")))
    new = s.where("s_suppkey % 3 < 2").select(*row(k + 1, F.when(k % 5 == 0, tag("n")), F.lit(None).cast("string")))
    return tb.upsert_identifiers(old, new)


@query("A8_claim_resources", "SELECT event_id, (ts, event_id) = (SELECT min((ts, event_id)) FROM events o WHERE o.user_id = e.user_id AND o.event_type = e.event_type) AS is_new FROM events e")
def a8(spark, sf_dir):
    r = table(spark, sf_dir, "events").select(col("event_type").alias("type"), col("user_id").alias("value"), col("ts").alias("claimed_at"), col("event_id").alias("worker"))
    return tb.claim_resources(r).select(col("worker").alias("event_id"), "is_new")


@query("A9_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def a9(spark, sf_dir):
    return tb.latest_state(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", col("event_type").alias("state"))


def cache(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (col("ts") + F.expr("interval 7 days")).alias("expires_at"))


@query("A10_live_cache", "SELECT event_id FROM events WHERE ts + INTERVAL 7 DAYS > TIMESTAMP '2024-01-20 00:00:00'")
def a10(spark, sf_dir):
    return tb.live(cache(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


@query("A11_cache_stats", "SELECT count(*) AS entries, count(*) FILTER (ts + INTERVAL 7 DAYS > TIMESTAMP '2024-01-20 00:00:00') AS live, count(*) FILTER (ts + INTERVAL 7 DAYS <= TIMESTAMP '2024-01-20 00:00:00') AS expired FROM events")
def a11(spark, sf_dir):
    return tb.cache_stats(cache(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp"))


@query("A20_sitemap", "SELECT page_id, [url] AS locs FROM pages")
def a20(spark, sf_dir):
    safe = F.replace(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit("<urlset><url><loc> "), safe, F.lit("</loc></url></urlset>"))
    return table(spark, sf_dir, "pages").select("page_id", F.transform(tb.sitemap_entries(xml), lambda e: e["loc"]).alias("locs"))
