"""Counters and status of searches, queues, archives and pages: folds over what has happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import satisfaction, search_status

col, lit = F.col, F.lit

# The shapes of entities in a hypothesis, by kind, in the order they are sought.
ENTITY_PATTERNS = {
    "organization": [
        r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Inc|Corp|Ltd|LLC|Co|会社|株式会社|有限会社)\.?)",
        r"(株式会社[^\s、。]+)",
        r"([^\s、。]+株式会社)",
    ],
    "location": [
        r"(東京|大阪|名古屋|福岡|札幌|横浜|神戸|京都)",
        r"([A-Z][a-z]+(?:,\s*[A-Z]{2})?)",
    ],
    "product": [
        r"([A-Z][a-zA-Z0-9]+(?:\s+[A-Z0-9][a-zA-Z0-9]*)*)",
    ],
}


def entities_in(hypotheses: DataFrame) -> DataFrame:
    """(id, text, kind) of hypotheses(id, text): matches of over two characters, each once per hypothesis, under the first kind that finds it."""
    mark = lambda kind, n: lambda m: F.struct(m.alias("m"), lit(kind).alias("kind"), lit(n).alias("n"))
    found = [F.transform(F.regexp_extract_all("text", lit(p), lit(1)), mark(k, n)) for n, (k, p) in enumerate((k, p) for k, ps in ENTITY_PATTERNS.items() for p in ps)]
    d = hypotheses.select("id", F.explode(F.concat(*found)).alias("e")).where(F.length("e.m") > 2)
    return d.groupBy("id", col("e.m").alias("text")).agg(F.min_by("e.kind", "e.n").alias("kind"))


def search_counters(events: DataFrame, last: int = 20) -> DataFrame:
    """A row per search of events(search_id, at, n, kind, domain, primary, independent, useful, novel): counts, score, novelty, status.

    Kinds are page and fragment. Novelty is that of the last fragments, 1 without any.
    """
    page, frag = col("kind") == "page", col("kind") == "fragment"
    recent = events.where(frag).withColumn("__k", F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("at"), F.desc("n")))).where(col("__k") <= last)
    novelty = recent.groupBy("search_id").agg((F.count_if("novel") / F.count("*")).alias("novelty"))
    d = events.groupBy("search_id").agg(
        F.count_if(page).alias("pages"), F.count_if(frag).alias("fragments"), F.count_if(frag & col("useful")).alias("useful"),
        F.count_if(page & col("independent")).alias("sources"), F.coalesce(F.max(page & col("primary")), lit(False)).alias("has_primary"),
    ).join(novelty, "search_id", "left")
    d = d.withColumn("novelty", F.round(F.coalesce("novelty", lit(1.0)), 9)).withColumn("score", F.round(satisfaction(col("sources"), col("has_primary")), 9))
    return d.withColumn("status", search_status(col("score"), col("novelty"), col("pages"), col("sources"), lit("running")))


def exploration_status(counters: DataFrame) -> DataFrame:
    """One row over search_counters(): searches by status, totals, whether all have ended, and warnings."""
    n = lambda s: F.count_if(col("status") == s).alias(f"{s}_count")
    d = counters.agg(*[n(s) for s in ("satisfied", "partial", "running", "exhausted")], F.coalesce(F.sum("pages"), lit(0)).alias("total_pages"), F.coalesce(F.sum("fragments"), lit(0)).alias("total_fragments"))
    return d.withColumn("finished", (col("running_count") == 0) & (col("partial_count") == 0)).withColumn("warnings", F.array_compact(F.array(F.when(col("exhausted_count") > 0, F.concat(col("exhausted_count").cast("string"), lit(" searches stopped by diminishing harvest"))))))


def archive_changes(snapshots: DataFrame) -> DataFrame:
    """(url, at, similarity, change) of consecutive snapshots(url, at, text): unchanged, modified, or major below a half; by their sets of lines."""
    w = Window.partitionBy("url").orderBy("at", "text")
    lines = lambda c: F.array_distinct(F.split(c, "\n"))
    d = snapshots.withColumn("__old", F.lag("text").over(w)).where("__old is not null").select("url", "at", lines(col("__old")).alias("a"), lines(col("text")).alias("b"), (col("__old") == col("text")).alias("__same"))
    both = F.size(F.array_intersect("a", "b"))
    d = d.withColumn("similarity", F.when(col("__same"), lit(1.0)).otherwise(F.round(2 * both / (F.size("a") + F.size("b")), 9)))
    return d.select("url", "at", "similarity", F.when(col("__same"), "content_unchanged").when(col("similarity") < 0.5, "content_major_change").otherwise("content_modified").alias("change"))


def sample_snapshots(snapshots: DataFrame, most: int) -> DataFrame:
    """At most `most` snapshots(url, at) of each url, evenly over its list, the first and the last among them."""
    n = snapshots.groupBy("url").agg(F.count("*").alias("__n"))
    d = snapshots.join(n, "url").withColumn("__k", F.row_number().over(Window.partitionBy("url").orderBy("at")) - 1)
    step = (col("__n") - 1) / lit(max(most - 1, 1))
    keep = (col("__n") <= most) | (F.floor(F.ceil(col("__k") / step - 1e-9) * step + 1e-9) == col("__k"))
    return d.where(keep).drop("__n", "__k")


def robots_allow(urls: DataFrame, rules: DataFrame, matches) -> DataFrame:
    """Adds allowed to urls(domain, path): no disallow of rules(domain, directive, value, pos) matches, or an allow longer than the first that does; matches(path, pattern) tells."""
    r = rules.where(col("directive").isin("allow", "disallow")).distinct()
    hit = urls.select("domain", "path").distinct().join(r, "domain").where(matches(col("path"), col("value")))
    deny = F.min_by(F.when(col("directive") == "disallow", F.length("value")), F.when(col("directive") == "disallow", col("pos")))
    best = F.max(F.when(col("directive") == "allow", F.length("value")))
    d = hit.groupBy("domain", "path").agg(deny.alias("__d"), best.alias("__a"))
    free = col("__d").isNull() | F.coalesce(col("__a") > col("__d"), lit(False))
    return urls.join(d, ["domain", "path"], "left").withColumn("allowed", free).drop("__d", "__a")


def crawl_delay(rules: DataFrame, least: float = 1.0) -> DataFrame:
    """(domain, delay): the largest crawl-delay of rules(domain, directive, value), `least` at least."""
    d = rules.groupBy("domain").agg(F.max(F.when(col("directive") == "crawl-delay", F.expr("try_cast(value as double)"))).alias("d"))
    return d.select("domain", F.greatest(lit(least), F.coalesce("d", lit(0.0))).alias("delay"))


def best_links(links: DataFrame, top: int = 20) -> DataFrame:
    """The `top` links(page_id, href, kind, priority, position) of each page by priority, in page order among equals."""
    w = Window.partitionBy("page_id").orderBy(F.desc("priority"), "position")
    return links.withColumn("place", F.row_number().over(w)).where(col("place") <= top)


def dedup_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: documents before and after, clusters of two and more, and the share of copies."""
    c = labels.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("clusters"), F.coalesce(F.sum(col("n") - 1), lit(0)).alias("copies"))
    d = docs.agg(F.count("*").alias("original_count")).crossJoin(c)  # a row each
    return d.select("original_count", (col("original_count") - col("copies")).alias("deduplicated_count"), "clusters", F.when(col("original_count") > 0, F.round(col("copies") / col("original_count"), 9)).otherwise(lit(0.0)).alias("duplicate_ratio"))


def queue_by(items: DataFrame, by: str, priority: str | None = None) -> DataFrame:
    """(group, items, ids, oldest) of pending items(id, domain, auth_type, priority, queued_at), by a column; missing ones are unknown."""
    d = items if priority is None else items.where(col("priority") == priority)
    return d.groupBy(F.coalesce(col(by), lit("unknown")).alias("group")).agg(F.count("*").alias("items"), F.sort_array(F.collect_list("id")).alias("ids"), F.min("queued_at").alias("oldest"))


def resolve(items: DataFrame, answers: DataFrame) -> DataFrame:
    """items(id, status) after answers(id, success, at): the first answer completes or fails a pending one."""
    first = answers.groupBy("id").agg(F.min_by("success", F.struct("at", "success")).alias("__s"))
    done = F.when((col("status") == "pending") & col("__s").isNotNull(), F.when(col("__s"), "completed").otherwise("failed")).otherwise(col("status"))
    return items.join(first, "id", "left").withColumn("status", done).drop("__s")


def embedding_rows(vectors: DataFrame, target_type: str, model: str) -> DataFrame:
    """(id, target_type, target_id, model_id, embedding, dimension) rows to store of vectors(target_id, embedding); one per target, named by type, target and model."""
    d = vectors.groupBy("target_id").agg(F.max("embedding").alias("embedding"))
    return d.select(F.concat_ws(":", lit(target_type), "target_id", lit(model)).alias("id"), lit(target_type).alias("target_type"), "target_id", lit(model).alias("model_id"), "embedding", F.size("embedding").alias("dimension"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A JSON document per node of nodes(id, kind) with its edges(src, dst, relation) out, sorted, and its degrees."""
    out = edges.groupBy(col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("relation", "dst"))).alias("edges"))
    into = edges.groupBy(col("dst").alias("id")).agg(F.count("*").alias("in"))
    d = nodes.join(out, "id", "left").join(into, "id", "left")
    e = F.coalesce("edges", F.array().cast(out.schema["edges"].dataType))
    return d.select("id", F.to_json(F.struct("id", "kind", e.alias("edges"), F.size(e).alias("out"), F.coalesce("in", lit(0)).alias("in"))).alias("json"))


def allow_listed(response: Column, schema: str) -> Column:
    """A JSON response reduced to the fields of a schema, nested ones too; null where it does not parse."""
    return F.to_json(F.from_json(response, schema))
