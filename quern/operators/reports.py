"""Reporting queries over an evidence graph and over job and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.graph import Graph

from .views import claim_evidence_summary, contradictions, evidence_chain, exact_sum, located, tally

col, lit = F.col, F.lit


def by_evidence() -> list:
    return [F.desc("evidence_count"), F.desc("refute_count"), F.desc("nli_claim_support_ratio"), F.asc("claim_id")]


def top_claims(g: Graph, task_id, n: int) -> DataFrame:
    """The n claims of a task with most evidence, ranked. The limit comes first, so that few rows are numbered."""
    d = claim_evidence_summary(g).where(col("task_id") == task_id).orderBy(*by_evidence()).limit(n)
    return d.select(F.row_number().over(Window.orderBy(*by_evidence())).alias("rank"), "claim_id", "claim_text", "support_count", "refute_count", "evidence_count", "nli_claim_support_ratio")


def top_contradictions(g: Graph, task_id, n: int) -> DataFrame:
    return contradictions(g).where(col("task_id") == task_id).orderBy(F.desc("controversy_score"), F.desc("evidence_count"), "claim_id").limit(n).select("claim_id", "support_count", "refute_count", "controversy_score")


def chains_of(g: Graph, claims: DataFrame) -> DataFrame:
    return evidence_chain(g).join(claims.select("claim_id"), "claim_id", "left_semi")


def page_citations(g: Graph, task_id) -> DataFrame:
    """A row per evidence page of a task, with its work, authors and the claims it supports."""
    d = located(g, g.nli).where(col("task_id") == task_id)
    a = g.work_authors.groupBy(col("canonical_id").alias("work_id")).agg(F.count("*").alias("n"), F.min_by("name", "position").alias("first"))
    pages = d.groupBy("page_id", "url", "title", "year", "doi", "venue", "work_id").agg(F.countDistinct(F.when(col("relation") == "supports", col("claim_id"))).alias("claims_supported"))
    shown = F.when(col("n") == 1, col("first")).when(col("n") > 1, F.concat("first", lit(" et al.")))
    return pages.join(a, "work_id", "left").select("page_id", "url", "title", "year", "doi", "venue", shown.alias("author_display"), "claims_supported")


def flow_touching(g: Graph, pages: DataFrame) -> DataFrame:
    """Citations with either end among the pages: two semi-joins."""
    c = g.cites.select(col("source_id").alias("citing_page_id"), col("target_id").alias("cited_page_id"))
    p = pages.distinct()
    a = c.join(p.select(col("page_id").alias("citing_page_id")), "citing_page_id", "left_semi")
    b = c.join(p.select(col("page_id").alias("cited_page_id")), "cited_page_id", "left_semi")
    return a.unionByName(b).distinct()


def citation_index(g: Graph) -> DataFrame:
    authors = g.work_authors.select("canonical_id").distinct().withColumn("author", lit(True))
    d = g.pages.join(g.works.select("canonical_id", "doi", "year"), "canonical_id", "left").join(authors, "canonical_id", "left")
    return d.select(col("id").alias("page_id"), "url", col("doi").isNotNull().alias("has_doi"), col("author").isNotNull().alias("has_author"), col("year").isNotNull().alias("has_year"))


def pack_counts(g: Graph, task_id) -> DataFrame:
    """One row: what a task's evidence pack holds."""
    t = col("task_id") == task_id
    parts = [
        g.claims.where(t).agg(F.count("*").alias("claims")),
        located(g, g.nli).where(t).agg(F.count("*").alias("evidence_chains"), F.countDistinct("page_id").alias("sources")),
        contradictions(g).where(t).agg(F.count("*").alias("contradictions")),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out


def evidence_pack(g: Graph, task_id, claims: int = 30, contradicted: int = 15) -> dict[str, DataFrame]:
    """The frames of a task's evidence pack; ids pass between them as semi-joins, nothing is collected."""
    top = top_claims(g, task_id, claims)
    return {
        "top_claims": top,
        "contradictions": top_contradictions(g, task_id, contradicted),
        "evidence_chains": chains_of(g, top),
        "citations": page_citations(g, task_id),
        "citation_flow": flow_touching(g, g.task_pages.where(col("task_id") == task_id).select("page_id")),
        "citation_index": citation_index(g),
        "counts": pack_counts(g, task_id),
    }


def write_pack(pack: dict[str, DataFrame], path: str) -> None:
    """JSON sink: a folder of JSON lines per frame."""
    for name, d in pack.items():
        d.write.mode("overwrite").json(f"{path}/{name}")


def dashboard_claims(g: Graph, task_id, top: int = 30) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(*by_evidence()))
    return claim_evidence_summary(g).where(col("task_id") == task_id).withColumn("rank", rank).select("claim_id", "claim_text", "rank", (col("rank") <= top).alias("in_top"))


def dashboard_sources(g: Graph, task_id) -> DataFrame:
    e = g.edges.where(col("relation").isin("supports", "origin") & (col("source_type") == "fragment") & (col("target_type") == "claim"))
    return located(g, e).where(col("task_id") == task_id).groupBy("page_id", "url", "title", "domain", "year").agg(F.countDistinct("claim_id").alias("claims"))


def evidence_edges(g: Graph) -> DataFrame:
    return g.edges.where((col("source_type") == "fragment") & (col("target_type") == "claim"))


def dashboard_fragments(g: Graph, task_id, preview: int = 500) -> DataFrame:
    d = located(g, evidence_edges(g)).where(col("task_id") == task_id)
    return d.groupBy("fragment_id", "page_id").agg(F.substring(F.first("text_content"), 1, preview).alias("text"), F.sort_array(F.collect_set("claim_id")).alias("claim_ids"))


def dashboard_edges(g: Graph, task_id) -> DataFrame:
    """A task's evidence edges and the citations that touch its pages."""
    own = evidence_edges(g).join(g.claims.where(col("task_id") == task_id).select(col("id").alias("target_id")), "target_id", "left_semi")
    pages = own.join(g.fragments.select(col("id").alias("source_id"), "page_id"), "source_id").select("page_id").distinct().withColumn("here", lit(True))
    c = g.cites.join(pages.select(col("page_id").alias("source_id"), col("here").alias("a")), "source_id", "left").join(pages.select(col("page_id").alias("target_id"), col("here").alias("b")), "target_id", "left").where("a or b")
    pick = lambda d: d.select(col("id").alias("edge_id"), "source_type", "source_id", "target_type", "target_id", "relation")
    return pick(own).unionByName(pick(c))


def dashboard_contradictions(g: Graph) -> DataFrame:
    s, r = col("support_count"), col("refute_count")
    return claim_evidence_summary(g).where("refute_count > 0").select("task_id", "claim_id", "support_count", "refute_count", F.round(r / (s + r + 1), 3).alias("controversy"))


def dashboard_stats(g: Graph) -> DataFrame:
    return located(g, evidence_edges(g)).groupBy("task_id").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("page_id").alias("pages"), F.countDistinct("fragment_id").alias("fragments"))


def analysis_summary(g: Graph) -> DataFrame:
    return claim_evidence_summary(g).groupBy("task_id").agg(F.count("*").alias("claims"), F.round(exact_sum("nli_claim_support_ratio") / F.count("*"), 4).alias("mean_ratio"), F.max("nli_claim_support_ratio").alias("best_ratio"), F.sum("evidence_count").alias("evidence"))


def top_domains(g: Graph, task_id, n: int) -> DataFrame:
    d = located(g, g.nli).where(col("task_id") == task_id).groupBy("domain").agg(F.countDistinct("page_id").alias("pages"), tally(col("relation") == "supports").alias("supports"), tally(col("relation") == "refutes").alias("refutes"))
    return d.orderBy(F.desc("pages"), "domain").limit(n)


def task_page_union(g: Graph) -> DataFrame:
    """Pages of a task by either linkage, counted once."""
    return g.task_pages.select("task_id", "page_id").union(located(g, g.origin).select("task_id", "page_id")).distinct().groupBy("task_id").agg(F.count("*").alias("pages"))


def unjudged_pairs(g: Graph) -> DataFrame:
    n = g.nli.select("source_id", "target_id")
    return g.origin.join(n, ["source_id", "target_id"], "left_anti").select(col("source_id").alias("fragment_id"), col("target_id").alias("claim_id"))


def edge_corrections(g: Graph) -> DataFrame:
    """Corrected labels of a sample of edges, where they change one."""
    new = F.when(col("target_id") % 3 == 0, "supports").otherwise("refutes")
    return g.nli.where(col("source_id") % 101 == 0).select("id", col("relation").alias("old"), new.alias("new"), lit(1.0).alias("confidence")).where("old <> new")


def apply_corrections(edges: DataFrame, corrections: DataFrame) -> DataFrame:
    """Edges with the corrected relation and confidence where there is one: copy on write."""
    c = corrections.select(col("id"), col("new"), col("confidence"))
    d = edges.join(c, "id", "left").withColumn("relation", F.coalesce("new", "relation")).withColumn("nli_edge_confidence", F.coalesce("confidence", "nli_edge_confidence"))
    return d.select(*edges.columns)


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. max_by combines before the shuffle, so a hot key costs one row per task."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def jobs_pivot(jobs: DataFrame, states: list[str]) -> DataFrame:
    d = jobs.groupBy("kind").pivot("state", states).count().fillna(0)
    return d.withColumn("total", sum((col(s) for s in states[1:]), col(states[0])))


def milestones(pivot: DataFrame, kinds: list[str]) -> DataFrame:
    """Whether each kind is drained: it was queued once, and nothing of it waits or runs."""
    return pivot.where(col("kind").isin(*kinds)).select("kind", ((col("total") > 0) & (col("queued") + col("running") == 0)).alias("drained"))


def next_jobs(jobs: DataFrame, slots: int) -> DataFrame:
    """The jobs that take a kind's free slots: by priority, then age, then id."""
    k = F.row_number().over(Window.partitionBy("kind").orderBy("priority", "queued_at", "id"))
    return jobs.where("state = 'queued'").withColumn("k", k).where(col("k") <= slots).select("kind", "id", "priority")


def eta(jobs: DataFrame, limit: int, seconds: int) -> DataFrame:
    waiting, running = F.count_if(col("state") == "queued"), F.count_if(col("state") == "running")
    return jobs.groupBy("kind").agg((F.greatest(lit(0), waiting - (limit - running)) * seconds).alias("eta_s"))


def history(events: DataFrame, kind: str | None = None, since: str | None = None, n: int = 50) -> DataFrame:
    """The latest n rows under the given filters."""
    d = events
    if kind is not None:
        d = d.where(col("event_type") == kind)
    if since is not None:
        d = d.where(col("ts") >= lit(since).cast("timestamp"))
    return d.orderBy(F.desc("ts"), "event_id").limit(n)


def new_targets(targets: DataFrame, queued: DataFrame) -> DataFrame:
    """targets(input_json, ...) with doi, without those whose DOI a row of queued(input_json) names already."""
    doi = F.when(F.get_json_object("input_json", "$.target.kind") == "doi", F.lower(F.get_json_object("input_json", "$.target.doi")))
    t = targets.withColumn("doi", doi).where("doi is not null")
    return t.join(queued.select(doi.alias("doi")).where("doi is not null").distinct(), "doi", "left_anti")


def timeline_coverage(claims: DataFrame, enough: float = 0.9) -> DataFrame:
    """One row of counts over claims(claim_id, timeline_json): with a timeline that holds events, retracted, corrected; and the share."""
    t = F.from_json("timeline_json", "events array<struct<event_type: string, timestamp: string>>")["events"]
    any_of = lambda kind: F.coalesce(F.exists(t, lambda e: e["event_type"] == kind), F.lit(False))
    has = F.coalesce(F.size(t) > 0, F.lit(False))
    d = claims.agg(F.count("*").alias("claims"), F.count_if(has).alias("with_timeline"), F.count_if(any_of("retracted")).alias("retracted"), F.count_if(any_of("corrected")).alias("corrected"))
    share = F.when(F.col("claims") > 0, F.col("with_timeline") / F.col("claims")).otherwise(F.lit(0.0))
    return d.withColumn("coverage", F.round(share, 9)).withColumn("enough", share >= enough)
