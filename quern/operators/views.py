"""The named relational views over an evidence graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.graph import Graph

col, lit = F.col, F.lit


def exact_sum(value: Column | str) -> Column:
    """A sum of fractions that no order of rows changes: nine decimals, added as decimals."""
    return F.coalesce(F.sum(F.col(value).cast("decimal(18,9)") if isinstance(value, str) else value.cast("decimal(18,9)")), lit(0)).cast("double")


def tally(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def author_display(g: Graph, df: DataFrame, no_work: str | None, no_author: str | None) -> DataFrame:
    """Adds author_display: the first author, 'et al.' with more; one aggregate instead of lookups per row."""
    a = g.work_authors.groupBy(col("canonical_id").alias("__w")).agg(F.count("*").alias("__n"), F.min_by("name", "position").alias("__first"))
    d = df.join(a, col("work_id") == col("__w"), "left")
    shown = F.when(col("work_id").isNull(), lit(no_work)).when(col("__n").isNull(), lit(no_author)).when(col("__n") == 1, col("__first")).otherwise(F.concat("__first", lit(" et al.")))
    return d.withColumn("author_display", shown).drop("__w", "__n", "__first")


def claim_evidence_summary(g: Graph) -> DataFrame:
    """Counts, confidences and the smoothed support ratio of each claim. Edges are aggregated before the join."""
    conf = F.coalesce(col("nli_edge_confidence"), lit(0.0))
    e = g.nli.groupBy(col("target_id").alias("t")).agg(
        tally(col("relation") == "supports").alias("support_count"),
        tally(col("relation") == "refutes").alias("refute_count"),
        tally(col("relation") == "neutral").alias("neutral_count"),
        F.count("id").alias("evidence_count"),
        F.max(conf).alias("mx"),
        (exact_sum(conf) / F.count("*")).alias("av"),
        exact_sum(F.when(col("relation") == "supports", conf).otherwise(lit(0.0))).alias("sw"),
        exact_sum(F.when(col("relation") == "refutes", conf).otherwise(lit(0.0))).alias("rw"),
    )
    d = g.claims.join(e, col("id") == col("t"), "left")
    zero = lambda c: F.coalesce(col(c), lit(0))
    s, r = F.coalesce(col("sw"), lit(0.0)), F.coalesce(col("rw"), lit(0.0))
    return d.select(
        "task_id",
        col("id").alias("claim_id"),
        "claim_text",
        *[zero(c).alias(c) for c in ("support_count", "refute_count", "neutral_count", "evidence_count")],
        F.coalesce("mx", lit(0.0)).alias("max_nli_edge_confidence"),
        F.coalesce("av", lit(0.0)).alias("avg_nli_edge_confidence"),
        s.alias("support_weight"),
        r.alias("refute_weight"),
        F.round((1.0 + s) / ((1.0 + s) + (1.0 + r)), 4).alias("nli_claim_support_ratio"),
    )


def contradictions(g: Graph) -> DataFrame:
    d = claim_evidence_summary(g).where("support_count > 0 and refute_count > 0")
    return d.select("task_id", "claim_id", "claim_text", "support_count", "refute_count", "neutral_count", "evidence_count", (F.least("support_count", "refute_count") / col("evidence_count")).alias("controversy_score"))


def unsupported_claims(g: Graph) -> DataFrame:
    """Claims without evidence: an anti-join, no aggregate."""
    return g.claims.join(g.nli.select(col("target_id").alias("t")), col("id") == col("t"), "left_anti").select("task_id", col("id").alias("claim_id"), "claim_text", lit(0).cast("long").alias("evidence_count"))


def located(g: Graph, edges: DataFrame) -> DataFrame:
    """Fragment-to-claim edges with claim, fragment, page and work columns."""
    e = edges.select(col("id").alias("edge_id"), col("source_id").alias("fragment_id"), col("target_id").alias("claim_id"), "relation", "nli_edge_confidence", col("created_at").alias("edge_created_at"))
    c = g.claims.select(col("id").alias("claim_id"), "task_id", "claim_text", "llm_claim_confidence")
    f = g.fragments.select(col("id").alias("fragment_id"), "page_id", "heading_context", "text_content")
    p = g.pages.select(col("id").alias("page_id"), "url", "domain", "title", col("canonical_id").alias("__c"))
    w = g.works.select(col("canonical_id").alias("work_id"), "year", "venue", "doi", "source_api")
    return e.join(c, "claim_id").join(f, "fragment_id").join(p, "page_id").join(w, col("__c") == col("work_id"), "left").drop("__c")


def claim_origins(g: Graph) -> DataFrame:
    d = author_display(g, located(g, g.origin), "unknown", "unknown")
    return d.select("task_id", "claim_id", "claim_text", col("edge_id").alias("origin_edge_id"), "fragment_id", col("text_content").alias("fragment_text"), "heading_context", "page_id", "url", "domain", col("title").alias("page_title"), "year", "venue", "doi", "source_api", "author_display")


def evidence_chain(g: Graph) -> DataFrame:
    d = author_display(g, located(g, g.nli), None, "unknown")
    return d.select("task_id", "edge_id", "relation", "nli_edge_confidence", "fragment_id", "heading_context", "page_id", "url", "domain", "claim_id", "claim_text", "year", "venue", "doi", "source_api", "author_display")


def citation_flow(g: Graph) -> DataFrame:
    return g.cites.select(col("source_id").alias("citing_page_id"), col("target_id").alias("cited_page_id"), "created_at")


def evidence_with_year(g: Graph) -> DataFrame:
    return located(g, g.nli).select("task_id", "claim_id", "claim_text", "relation", "fragment_id", "page_id", "domain", "year")


def orphan_sources(g: Graph) -> DataFrame:
    """Evidence pages that no page cites."""
    d = located(g, g.nli).select("task_id", "page_id", "url", "title", "domain").distinct()
    return d.join(g.cites.select(col("target_id").alias("page_id")), "page_id", "left_anti").withColumn("cited_by_count", lit(0).cast("long"))


def evidence_timeline(g: Graph) -> DataFrame:
    return evidence_with_year(g).groupBy("task_id", "year").agg(F.countDistinct("fragment_id").alias("fragment_count"), F.countDistinct("claim_id").alias("claim_count"))


def emerging_consensus(g: Graph, as_of_year: int) -> DataFrame:
    recent = F.coalesce(col("year") >= as_of_year - 2, lit(False))
    d = evidence_with_year(g).where("relation = 'supports'").groupBy("task_id", "claim_id", "claim_text").agg(tally(recent).alias("recent_support_count"), tally(~recent).alias("older_support_count"))
    return d.withColumn("support_trend", col("recent_support_count") - col("older_support_count"))


def outdated_evidence(g: Graph, as_of_year: int) -> DataFrame:
    d = evidence_with_year(g).where("relation = 'supports'").groupBy("task_id", "claim_id", "claim_text").agg(F.max("year").alias("newest_evidence_year"))
    return d.withColumn("years_since_update", as_of_year - col("newest_evidence_year"))


def degrees(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(out: page_id, citation_count), (in: page_id, cited_by_count)."""
    return (
        g.cites.groupBy(col("source_id").alias("page_id")).agg(F.count("*").alias("citation_count")),
        g.cites.groupBy(col("target_id").alias("page_id")).agg(F.count("*").alias("cited_by_count")),
    )


def source_authority(g: Graph) -> DataFrame:
    supports = g.nli.where("relation = 'supports'")
    d = located(g, supports).groupBy("task_id", "page_id", "url", "title", "domain", "year").agg(F.countDistinct("claim_id").alias("claims_supported"))
    out, into = degrees(g)
    d = d.join(out, "page_id", "left").join(into, "page_id", "left").fillna(0, ["citation_count", "cited_by_count"])
    return d.withColumn("authority_score", col("claims_supported") * 1.0 + col("cited_by_count") * lit(0.5) + col("citation_count") * lit(0.2)).withColumn("authority_score", F.round("authority_score", 6))


def source_impact(g: Graph) -> DataFrame:
    made = located(g, g.origin).groupBy("task_id", "page_id", "url", "title", "domain").agg(F.countDistinct("claim_id").alias("claims_generated"), (exact_sum("llm_claim_confidence") / F.count("llm_claim_confidence")).alias("avg"))
    backed = located(g, g.nli.where("relation = 'supports'")).groupBy("task_id", "page_id").agg(F.countDistinct("edge_id").alias("claims_supported"))
    d = made.join(backed, ["task_id", "page_id"], "left").fillna(0, ["claims_supported"])
    n = col("claims_generated")
    score = n + F.coalesce(col("avg"), lit(0.5)) * n * 0.5 + col("claims_supported") * 0.3
    return d.select("task_id", "page_id", "url", "title", "domain", "claims_generated", F.round("avg", 4).alias("avg_claim_confidence"), "claims_supported", F.round(score, 2).alias("impact_score"))


def citation_age_gap(g: Graph) -> DataFrame:
    y = g.pages.join(g.works.select("canonical_id", "year"), "canonical_id", "left").select("id", "year")
    c = citation_flow(g).select("citing_page_id", "cited_page_id")
    d = c.join(y.select(col("id").alias("citing_page_id"), col("year").alias("citing_year")), "citing_page_id").join(y.select(col("id").alias("cited_page_id"), col("year").alias("cited_year")), "cited_page_id")
    return d.withColumn("age_gap", col("citing_year") - col("cited_year"))


def evidence_freshness(g: Graph, as_of_year: int) -> DataFrame:
    recent = lambda r: F.max(F.when((col("relation") == r) & (col("year") >= as_of_year - 2), 1).otherwise(0))
    return evidence_with_year(g).where("year is not null").groupBy("task_id", "claim_id", "claim_text").agg(
        (F.sum(as_of_year - col("year")) / F.count("*")).alias("avg_evidence_age"), recent("supports").alias("has_recent_support"), recent("refutes").alias("has_recent_refutation")
    )


def bibliographic_coupling(g: Graph) -> DataFrame:
    """Pairs of pages cited by one page, with the number of pages citing both. Cites are filtered before the self-join."""
    c = g.cites.select(col("source_id").alias("s"), col("target_id").alias("t")).distinct()
    d = c.alias("a").join(c.alias("b"), (col("a.s") == col("b.s")) & (col("a.t") < col("b.t")))
    return d.groupBy(col("a.t").alias("page_a"), col("b.t").alias("page_b")).agg(F.count("*").alias("shared_citations"))


def citation_chains(g: Graph) -> DataFrame:
    """Two-step paths A cites B cites C; A may be C."""
    c = g.cites.select(col("source_id").alias("s"), col("target_id").alias("t"))
    t = g.pages.select("id", F.substring("title", 1, 60).alias("title"))
    d = c.select(col("s").alias("page_a"), col("t").alias("page_b")).join(c.select(col("s").alias("page_b"), col("t").alias("page_c")), "page_b")
    for x in "abc":
        d = d.join(t.select(col("id").alias(f"page_{x}"), col("title").alias(f"title_{x}")), f"page_{x}")
    return d.select("page_a", "title_a", "page_b", "title_b", "page_c", "title_c")


def reference_candidates(g: Graph, task_id) -> DataFrame:
    """Pages that the task's pages cite, can be fetched, and are neither queued nor a claim's origin in the task."""
    if task_id is None:
        raise ValueError("task_id is required")
    url = F.lower("url")
    ok = col("url").isNotNull() & ~url.startswith("javascript:") & ~url.startswith("mailto:") & ~url.startswith("#") & ~url.startswith("tel:")
    own = g.task_pages.where(col("task_id") == task_id)
    origin_pages = g.origin.join(g.claims.where(col("task_id") == task_id).select(col("id").alias("target_id")), "target_id", "left_semi").join(g.fragments.select(col("id").alias("source_id"), "page_id"), "source_id").select(col("page_id").alias("candidate_page_id"))
    p = g.pages.where(ok).select(col("id").alias("candidate_page_id"), col("url").alias("candidate_url"), col("domain").alias("candidate_domain"), col("html_path").alias("candidate_html_path"))
    e = g.edges.where((col("relation") == "cites") & (col("target_type") == "page") & (col("source_type") == "page")).select(col("id").alias("citation_edge_id"), col("source_id").alias("citing_page_id"), col("target_id").alias("candidate_page_id"), col("created_at").alias("citation_created_at"))
    sp = g.pages.select(col("id").alias("citing_page_id"), col("url").alias("citing_page_url"), col("domain").alias("citing_domain"))
    tp = own.select(col("page_id").alias("citing_page_id"), col("depth").alias("citing_depth"), col("reason").alias("citing_reason"))
    d = e.join(tp, "citing_page_id").join(sp, "citing_page_id").join(p, "candidate_page_id")
    return d.join(own.select(col("page_id").alias("candidate_page_id")), "candidate_page_id", "left_anti").join(origin_pages, "candidate_page_id", "left_anti")


def task_progress(tasks: DataFrame, queries: DataFrame, serp: DataFrame, pages: DataFrame, fragments: DataFrame, claims: DataFrame) -> DataFrame:
    """Distinct queries, pages, fragments and claims per task: a count per branch, no fan-out of all of them."""
    q = queries.select(col("id").alias("query_id"), "task_id")
    hit = q.join(serp.select("query_id", "url").distinct(), "query_id").join(pages.select(col("id").alias("page_id"), "url"), "url").select("task_id", "page_id").distinct()
    parts = {
        "query_count": q.groupBy("task_id").agg(F.countDistinct("query_id").alias("query_count")),
        "page_count": hit.groupBy("task_id").agg(F.count("*").alias("page_count")),
        "fragment_count": hit.join(fragments.select(col("id").alias("f"), "page_id"), "page_id").groupBy("task_id").agg(F.countDistinct("f").alias("fragment_count")),
        "claim_count": claims.groupBy("task_id").agg(F.countDistinct("id").alias("claim_count")),
    }
    d = tasks.select(col("id").alias("task_id"), "hypothesis", "status")
    for p in parts.values():
        d = d.join(p, "task_id", "left")
    return d.fillna(0, list(parts))


def task_metrics_summary(tasks: DataFrame, metrics: DataFrame) -> DataFrame:
    ratio = lambda n, d: F.when(col(d) > 0, col(n) / col(d)).otherwise(lit(0.0))
    d = tasks.select(col("id").alias("task_id"), "hypothesis", "status").join(metrics, "task_id", "left")
    return d.select("task_id", "hypothesis", "status", "total_queries", "total_pages_fetched", "useful_fragments", "total_claims", ratio("useful_fragments", "total_pages_fetched").alias("harvest_rate"), ratio("primary_sources", "total_sources").alias("primary_source_rate"), ratio("llm_time_ms", "total_time_ms").alias("llm_time_ratio"))


def active_engines(engines: DataFrame, as_of) -> DataFrame:
    """Engines that are not open, not cooling down and below their daily limit."""
    now = lit(as_of)
    ok = (col("status") != "open") & (col("cooldown_until").isNull() | (col("cooldown_until") < now)) & (col("daily_limit").isNull() | (col("daily_usage") < col("daily_limit")))
    return engines.where(ok).select("engine", "status", "weight", "success_rate_1h", "captcha_rate", "median_latency_ms", "daily_usage", "daily_limit")


def available_engines(engines: DataFrame, as_of) -> DataFrame:
    """Engines that are not open and not cooling down, whatever their use today."""
    return engines.where((col("status") != "open") & (col("cooldown_until").isNull() | (col("cooldown_until") < lit(as_of))))


def engines_by_weight(engines: DataFrame, as_of) -> DataFrame:
    """Active engines with their place by weight."""
    d = active_engines(engines, as_of)
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.desc("weight"), "engine")))  # a row per engine


def engine_health(engines: DataFrame) -> DataFrame:
    """Health figures with defaults where none is known."""
    known = {"success_rate_1h": 1.0, "success_rate_24h": 1.0, "captcha_rate": 0.0, "median_latency_ms": 1000.0, "http_error_rate": 0.0}
    return engines.select("engine", *[F.coalesce(col(k), lit(v)).alias(k) for k, v in known.items()])


def domain_cooldowns(domains: DataFrame, as_of) -> DataFrame:
    now = lit(as_of)
    return domains.where((col("cooldown_until") > now) | (col("skip_until") > now)).select("domain", "cooldown_until", "skip_until", "skip_reason", "block_score", "captcha_rate")


def latest(df: DataFrame, at: str, n: int, *ties: str) -> DataFrame:
    """The n rows with the latest time; ties by the named columns."""
    return df.orderBy(F.col(at).desc_nulls_last(), *ties).limit(n)
