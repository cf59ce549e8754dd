"""Selecting evidence to judge, filtering citations, merging registries, resolving policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import local_impact

col, lit = F.col, F.lit


def nli_candidates(similar: DataFrame, origin_domains: DataFrame, judged: DataFrame, least: float = 0.55, top: int = 30, domains: int = 6, most: int = 20) -> DataFrame:
    """Pairs to judge per claim from similar(claim_id, fragment_id, domain, similarity).

    Above the least similarity and outside the claim's own domains, the `top` best;
    of these, fragments of the first `domains` domains seen; then what is not judged
    yet, `most` of it. Windows see a claim's candidates only.
    """
    d = similar.where(col("similarity") >= least).join(origin_domains, ["claim_id", "domain"], "left_anti")
    order = [F.desc("similarity"), F.asc("fragment_id")]
    rank = lambda: F.row_number().over(Window.partitionBy("claim_id").orderBy(*order))
    d = d.withColumn("k", rank()).where(col("k") <= top)
    d = d.withColumn("first", F.min("k").over(Window.partitionBy("claim_id", "domain")))
    d = d.withColumn("seen", F.dense_rank().over(Window.partitionBy("claim_id").orderBy("first"))).where(col("seen") <= domains)
    d = d.join(judged, ["claim_id", "fragment_id"], "left_anti").withColumn("k", rank()).where(col("k") <= most)
    return d.select("claim_id", "fragment_id", "domain", "similarity")


def accept_nli(judgements: DataFrame, existing: DataFrame, least: float = 0.6, neutral: bool = True) -> DataFrame:
    """New edges of judgements(claim_id, fragment_id, relation, confidence): confident enough, one per pair, not there yet."""
    ok = (col("relation").isin("supports", "refutes") & (col("confidence") >= least)) | (lit(neutral) & (col("relation") == "neutral"))
    best = judgements.where(ok).groupBy("claim_id", "fragment_id").agg(F.max_by(F.struct("relation", "confidence"), F.struct("confidence", "relation")).alias("b"))
    return best.select("claim_id", "fragment_id", "b.*").join(existing, ["claim_id", "fragment_id"], "left_anti")


def filter_citations(papers: DataFrame, least_citations: int = 1, first: int = 30, second: int = 10) -> DataFrame:
    """(query, id, stage1, stage2) of papers(query, id, citations, similarity, llm): by similarity and impact, then with the model's score."""
    d = local_impact(papers.where(F.coalesce(col("citations"), lit(0)) >= least_citations), "query")
    sim = F.least(lit(1.0), F.greatest(lit(0.0), col("similarity")))
    top = lambda by, n: (F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by), "id")) <= n)
    d = d.withColumn("stage1", F.round(0.5 * sim + 0.5 * col("impact"), 9))
    d = d.withColumn("__t", top("stage1", first)).where("__t").withColumn("stage2", F.round(0.5 * col("llm") + 0.3 * sim + 0.2 * col("impact"), 9))
    return d.withColumn("__t", top("stage2", second)).where("__t").select("query", "id", "stage1", "stage2")


def merge_registry(api: DataFrame, serp: DataFrame) -> DataFrame:
    """(canonical_id, source, title, needs_fetch): papers known from an API, from search results, or both; without an abstract they need a fetch."""
    a = api.groupBy("canonical_id").agg(F.min("title").alias("t"), F.max("abstract").alias("abstract"), lit(True).alias("a"))
    s = serp.groupBy("canonical_id").agg(F.min("title").alias("u"), lit(True).alias("s"))
    d = a.join(s, "canonical_id", "full_outer")
    return d.select("canonical_id", F.when(col("a") & col("s"), "both").when(col("a"), "api").otherwise("serp").alias("source"), F.coalesce("t", "u").alias("title"), col("abstract").isNull().alias("needs_fetch"))


def domain_policy(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, category, pattern): for each host the rule of rules(pattern, category, priority) that decides.

    A host meets the rules of itself and of the domains above it by equality, not every
    rule. The highest priority wins, then the longest pattern.
    """
    parts = F.split("host", r"\.")
    up = F.transform(F.sequence(lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    h = hosts.select("host").distinct().select("host", F.explode(up).alias("key"))
    r = rules.select(F.regexp_replace("pattern", r"^\*\.", "").alias("key"), "pattern", "category", "priority")
    best = h.join(r, "key").groupBy("host").agg(F.max_by(F.struct("category", "pattern"), F.struct(col("priority"), F.length("key"), F.col("pattern"))).alias("b"))
    return hosts.select("host").distinct().join(best, "host", "left").select("host", F.coalesce("b.category", lit("unverified")).alias("category"), "b.pattern")


def entity_matches(names: DataFrame, entities: DataFrame, aliases: DataFrame, least: float = 0.7) -> DataFrame:
    """(name, entity, score) with the best match of names(name): canonical 1, alias 0.95, else similar tokens, blocked on the first one."""
    from quern.functions.identity import name_parts, name_similarity

    from .iteration import settle

    n = names.select("name").distinct().withColumn("p", name_parts(col("name")))
    e = entities.select(col("id").alias("entity"), name_parts(col("name")).alias("q"))
    same = n.join(e, col("p.canonical") == col("q.canonical")).select("name", "entity", lit(1.0).alias("score"))
    al = aliases.select(col("entity_id").alias("entity"), name_parts(col("alias")).alias("q"))
    by_alias = n.join(al, col("p.canonical") == col("q.canonical")).select("name", "entity", lit(0.95).alias("score"))
    # nothing that is merely similar comes before a name that is known, and so only the others are compared
    left = n.join(same.union(by_alias).select("name").distinct(), "name", "left_anti")
    left = settle(left, "unknown")  # else the plan may compare first and leave out later
    near = left.withColumn("t", col("p.tokens")[0]).join(e.withColumn("t", col("q.tokens")[0]), "t").select("name", "entity", name_similarity(col("p"), col("q")).alias("score")).where(col("score") >= least)
    every = same.union(by_alias).union(near.withColumn("score", F.least(lit(0.94), col("score"))))
    return every.groupBy("name").agg(F.max_by(F.struct("entity", "score"), F.struct(col("score"), -col("entity"))).alias("m")).select("name", "m.entity", "m.score")


def html_fragments(pages: DataFrame, least: int = 20) -> DataFrame:
    """(page_id, position, kind, heading, text, text_hash) of the headings and paragraphs of pages(page_id, html), in Arrow batches.

    Scripts and styles go; paragraphs shorter than `least` characters too; a paragraph
    carries the heading it stands under.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import html as h
        import re

        drop = re.compile(r"(?is)<(script|style|noscript|head)\b.*?</\1\s*>|<!--.*?-->")
        part = re.compile(r"(?is)<(h[1-6]|p|li|blockquote|td)\b[^>]*>(.*?)(?=</\1|<(?:h[1-6]|p|li|blockquote|td|/article|/body)\b|\Z)")
        for frame in it:
            rows = []
            for page, doc in zip(frame["page_id"], frame["html"], strict=True):
                heading, k = None, 0
                for m in part.finditer(drop.sub(" ", doc or "")):
                    text = " ".join(h.unescape(re.sub(r"<[^>]*>", " ", m[2])).split())
                    if m[1][0].lower() == "h" and text:
                        heading, kind = text, "heading"
                    elif len(text) >= least:
                        kind = "paragraph"
                    else:
                        continue
                    rows.append((page, k, kind, heading, text))
                    k += 1
            yield pd.DataFrame(rows, columns=["page_id", "position", "kind", "heading", "text"]).astype({"position": "int32"})

    d = pages.select("page_id", "html").mapInPandas(run, "page_id long, position int, kind string, heading string, text string")
    return d.withColumn("text_hash", F.substring(F.sha2("text", 256), 1, 32))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href, text, kind, priority) of each link, by where it stands in the page."""
    from collections.abc import Iterator

    import pandas as pd

    from quern.functions.identity import link_priority

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import html as h
        import re

        tag = re.compile(r"""(?is)<(/?)(nav|aside|footer|header|h[1-6]|article|main|a)\b([^>]*)>""")
        href = re.compile(r"""(?is)href\s*=\s*["']([^"']*)["']""")
        for frame in it:
            rows = []
            for page, doc in zip(frame["page_id"], frame["html"], strict=True):
                open_, k, start, target = [], 0, None, None
                for m in tag.finditer(doc or ""):
                    name = m[2].lower()
                    if name != "a":
                        open_ = open_[: len(open_) - open_[::-1].index(name) - 1] if m[1] and name in open_ else open_ + ([] if m[1] else [name])
                    elif not m[1]:
                        found = href.search(m[3])
                        start, target = m.end(), h.unescape(found[1]) if found else None
                    elif start is not None and target is not None:
                        text = " ".join(h.unescape(re.sub(r"<[^>]*>", " ", doc[start : m.start()])).split())
                        kind = "navigation" if "nav" in open_ or "header" in open_ or "footer" in open_ else "sidebar" if "aside" in open_ else "heading" if any(x[0] == "h" and x[1:].isdigit() for x in open_) else "body"
                        rows.append((page, k, target, text, kind))
                        k, start, target = k + 1, None, None
            yield pd.DataFrame(rows, columns=["page_id", "position", "href", "text", "kind"]).astype({"position": "int32"})

    d = pages.select("page_id", "html").mapInPandas(run, "page_id long, position int, href string, text string, kind string")
    return d.withColumn("priority", F.round(link_priority(col("kind"), col("text")), 6))


def bfs(start: DataFrame, edges: DataFrame, depth: int = 2, most: int = 50) -> DataFrame:
    """(id, depth): nodes reached over edges(src, dst, priority) within `depth` steps; each step takes the `most` best new ones."""
    from .iteration import settle

    seen = settle(start.select("id").distinct().withColumn("depth", lit(0)), "frontier")
    front = seen
    for k in range(1, depth + 1):
        nxt = edges.join(front.select(col("id").alias("src")), "src", "left_semi").groupBy(col("dst").alias("id")).agg(F.max("priority").alias("p")).join(seen.select("id"), "id", "left_anti")
        front = settle(nxt.orderBy(F.desc("p"), "id").limit(most).select("id", lit(k).alias("depth")), "frontier")
        seen = seen.union(front)
    return seen


def similar_queries(asked: DataFrame, past: DataFrame, newest: int = 10, least: float = 0.3, top: int = 5, harvest: float = 0.2) -> DataFrame:
    """(query_id, conv_id, overlap) of the newest fruitful past(conv_id, w, harvest) whose words overlap asked(query_id, w) by over `least`.

    The newest few are one small table, which meets the queries by broadcast.
    """
    few = past.where((F.col("harvest") > harvest) & (F.size("w") > 0)).orderBy(F.desc("conv_id")).limit(newest).select("conv_id", F.col("w").alias("pw"))
    d = asked.where(F.size("w") > 0).join(F.broadcast(few), F.col("query_id") != F.col("conv_id"))
    d = d.select("query_id", "conv_id", F.round(F.size(F.array_intersect("w", "pw")) / F.least(F.size("w"), F.size("pw")), 9).alias("overlap")).where(F.col("overlap") > least)
    w = Window.partitionBy("query_id").orderBy(F.desc("conv_id"))
    return d.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= top).drop("__k")
