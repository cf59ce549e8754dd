"""The evidence graph as DataFrames, and its derivation from the sample star schema."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NLI = ("supports", "refutes", "neutral")


@dataclass
class Graph:
    """Tables of an evidence graph.

    tasks(id, hypothesis, status, created_at), claims(id, task_id, claim_text,
    llm_claim_confidence), pages(id, url, domain, title, canonical_id, html_path),
    works(canonical_id, year, venue, doi, source_api), work_authors(canonical_id,
    position, name), fragments(id, page_id, heading_context, text_content,
    created_at), edges(id, source_type, source_id, target_type, target_id, relation,
    nli_edge_confidence, created_at), task_pages(task_id, page_id, depth, reason).
    """

    tasks: DataFrame
    claims: DataFrame
    pages: DataFrame
    works: DataFrame
    work_authors: DataFrame
    fragments: DataFrame
    edges: DataFrame
    task_pages: DataFrame

    @cached_property
    def nli(self) -> DataFrame:
        """Evidence edges, fragment to claim."""
        return self.edges.where((F.col("source_type") == "fragment") & (F.col("target_type") == "claim") & F.col("relation").isin(*NLI))

    @cached_property
    def origin(self) -> DataFrame:
        """Provenance edges, fragment to claim."""
        return self.edges.where((F.col("source_type") == "fragment") & (F.col("target_type") == "claim") & (F.col("relation") == "origin"))

    @cached_property
    def cites(self) -> DataFrame:
        """Citation edges, page to page."""
        return self.edges.where((F.col("source_type") == "page") & (F.col("target_type") == "page") & (F.col("relation") == "cites"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bridge(spark: SparkSession, sf_dir: str) -> Graph:
    """An evidence graph derived from the star schema by fixed rules; BRIDGE_SQL states the same rules."""
    t = lambda name: table(spark, sf_dir, name)
    lit, col = F.lit, F.col
    none = lambda kind: lit(None).cast(kind)
    customers = t("customer")
    n = customers.count()
    tasks = t("region").select(col("r_regionkey").cast("long").alias("id"), col("r_name").alias("hypothesis"), lit("exploring").alias("status"))
    claims = t("part").select(col("p_partkey").alias("id"), (col("p_partkey") % 5).alias("task_id"), col("p_name").alias("claim_text"), (col("p_size") * 20 / 1000).alias("llm_claim_confidence"))
    c = customers.join(F.broadcast(t("nation")), col("c_nationkey") == col("n_nationkey"))
    k = col("c_custkey")
    pages = c.select(
        k.alias("id"),
        F.when(k % 53 == 0, "JavaScript:void(0)").when(k % 59 == 0, "mailto:x").otherwise(F.concat(lit("https://"), "n_name", lit("/"), k.cast("string"))).alias("url"),
        col("n_name").alias("domain"),
        col("c_name").alias("title"),
        F.when(k % 7 != 0, k).alias("canonical_id"),
        F.when(k % 2 == 0, F.concat(lit("/p/"), k.cast("string"))).alias("html_path"),
    )
    works = customers.where(k % 7 != 0).select(
        k.alias("canonical_id"),
        F.when(k % 11 != 0, 1990 + k % 37).alias("year"),
        col("c_mktsegment").alias("venue"),
        F.when(k % 3 == 0, F.concat(lit("10.1000/"), k.cast("string"))).alias("doi"),
        F.when(k % 2 == 0, "openalex").otherwise("s2").alias("source_api"),
    )
    s = F.expr("s_suppkey div 3")
    work_authors = t("supplier").where(col("s_suppkey") % 3 <= s % 3).select(s.alias("canonical_id"), (col("s_suppkey") % 3).alias("position"), col("s_name").alias("name"))
    fragments = t("orders").select(col("o_orderkey").alias("id"), col("o_custkey").alias("page_id"), col("o_orderpriority").alias("heading_context"), F.concat(lit("order "), col("o_orderkey").cast("string")).alias("text_content"), col("o_orderdate").alias("created_at"))
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    pair = Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    tail = col("l_partkey") % 10
    kept = items.withColumn("rn", F.row_number().over(pair)).where(col("rn") == 1).where((tail != 0) & ~((col("l_returnflag") == "R") & tail.isin(1, 2)))
    dates = fragments.select(col("id").alias("o"), col("created_at").alias("at"))
    edge = lambda i, st, s_, tt, t_, r, conf, at: [i.alias("id"), lit(st).alias("source_type"), s_.alias("source_id"), lit(tt).alias("target_type"), t_.alias("target_id"), r.alias("relation"), conf.alias("nli_edge_confidence"), at.alias("created_at")]
    relation = F.when(col("l_returnflag") == "A", "supports").when(col("l_returnflag") == "R", "refutes").otherwise("neutral")
    conf = F.round(col("l_discount") * 10000).cast("long") / 1000
    nli = kept.select(*edge(F.concat(lit("n:"), col("l_orderkey").cast("string"), lit(":"), col("l_partkey").cast("string")), "fragment", col("l_orderkey"), "claim", col("l_partkey"), relation, conf, none("timestamp")))
    origin = items.groupBy("l_partkey").agg(F.min("l_orderkey").alias("o")).select(*edge(F.concat(lit("o:"), col("l_partkey").cast("string")), "fragment", col("o"), "claim", col("l_partkey"), lit("origin"), none("double"), none("timestamp")))
    o = t("orders").select(col("o_custkey").alias("a"), "o_orderkey").withColumn("b", (col("a") * 31 + col("o_orderkey")) % n)
    links = o.where("o_orderkey % 3 <> 0").select("a", "b").union(o.where("o_orderkey % 997 = 0").select("a", col("a").alias("b"))).union(o.where("o_orderkey % 50 = 1").select(col("b").alias("a"), col("a").alias("b")))
    links = links.where("b % 4 <> 0").distinct()
    cites = links.select(*edge(F.concat(lit("c:"), col("a").cast("string"), lit(":"), col("b").cast("string")), "page", col("a"), "page", col("b"), lit("cites"), none("double"), F.make_timestamp(lit(2024), lit(1), (col("a") % 28 + 1).cast("int"), lit(0), (col("b") % 60).cast("int"), lit(0))))
    task_pages = customers.where(k % 3 == 0).select((k % 5).alias("task_id"), k.alias("page_id"), (k % 4).alias("depth"), F.when(k % 2 == 0, "serp").otherwise("citation").alias("reason"))
    return Graph(tasks, claims, pages, works, work_authors, fragments, nli.unionByName(origin).unionByName(cites), task_pages)


#: The same derivation for the oracle: a prefix of common table expressions.
BRIDGE_SQL = """
WITH nn AS (SELECT count(*) AS n FROM customer),
g_tasks AS (SELECT r_regionkey::BIGINT AS id, r_name AS hypothesis, 'exploring' AS status FROM region),
g_claims AS (SELECT p_partkey AS id, p_partkey % 5 AS task_id, p_name AS claim_text, (p_size * 20)::DOUBLE / 1000 AS llm_claim_confidence FROM part),
g_pages AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 53 = 0 THEN 'JavaScript:void(0)' WHEN c_custkey % 59 = 0 THEN 'mailto:x' ELSE 'https://' || n_name || '/' || c_custkey END AS url, n_name AS domain, c_name AS title, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS canonical_id, CASE WHEN c_custkey % 2 = 0 THEN '/p/' || c_custkey END AS html_path FROM customer JOIN nation ON c_nationkey = n_nationkey),
g_works AS (SELECT c_custkey AS canonical_id, CASE WHEN c_custkey % 11 <> 0 THEN 1990 + c_custkey % 37 END AS year, c_mktsegment AS venue, CASE WHEN c_custkey % 3 = 0 THEN '10.1000/' || c_custkey END AS doi, CASE WHEN c_custkey % 2 = 0 THEN 'openalex' ELSE 's2' END AS source_api FROM customer WHERE c_custkey % 7 <> 0),
g_authors AS (SELECT s_suppkey // 3 AS canonical_id, s_suppkey % 3 AS position, s_name AS name FROM supplier WHERE s_suppkey % 3 <= (s_suppkey // 3) % 3),
g_fragments AS (SELECT o_orderkey AS id, o_custkey AS page_id, o_orderpriority AS heading_context, 'order ' || o_orderkey AS text_content, o_orderdate AS created_at FROM orders),
g_kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1 AND l_partkey % 10 <> 0 AND NOT (l_returnflag = 'R' AND l_partkey % 10 IN (1, 2))),
g_nli AS (SELECT 'n:' || l_orderkey || ':' || l_partkey AS id, 'fragment' AS source_type, l_orderkey AS source_id, 'claim' AS target_type, l_partkey AS target_id, CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'R' THEN 'refutes' ELSE 'neutral' END AS relation, round(l_discount * 10000)::BIGINT::DOUBLE / 1000 AS nli_edge_confidence, NULL::TIMESTAMP AS created_at FROM g_kept),
g_origin AS (SELECT 'o:' || l_partkey AS id, 'fragment' AS source_type, min(l_orderkey) AS source_id, 'claim' AS target_type, l_partkey AS target_id, 'origin' AS relation, NULL::DOUBLE AS nli_edge_confidence, NULL::TIMESTAMP AS created_at FROM lineitem GROUP BY l_partkey),
g_o AS (SELECT o_custkey AS a, o_orderkey, (o_custkey * 31 + o_orderkey) % n AS b FROM orders, nn),
g_links AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM g_o WHERE o_orderkey % 3 <> 0 UNION ALL SELECT a, a FROM g_o WHERE o_orderkey % 997 = 0 UNION ALL SELECT b, a FROM g_o WHERE o_orderkey % 50 = 1) WHERE b % 4 <> 0),
g_cites AS (SELECT 'c:' || a || ':' || b AS id, 'page' AS source_type, a AS source_id, 'page' AS target_type, b AS target_id, 'cites' AS relation, NULL::DOUBLE AS nli_edge_confidence, make_timestamp(2024, 1, a % 28 + 1, 0, b % 60, 0.0) AS created_at FROM g_links),
g_edges AS (SELECT * FROM g_nli UNION ALL SELECT * FROM g_origin UNION ALL SELECT * FROM g_cites),
g_task_pages AS (SELECT c_custkey % 5 AS task_id, c_custkey AS page_id, c_custkey % 4 AS depth, CASE WHEN c_custkey % 2 = 0 THEN 'serp' ELSE 'citation' END AS reason FROM customer WHERE c_custkey % 3 = 0),
g_author AS (SELECT canonical_id, count(*) AS authors, arg_min(name, position) AS first_author FROM g_authors GROUP BY canonical_id)
"""
