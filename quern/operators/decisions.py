"""Rules, cooldowns, verification, arms, calibrations, identifiers and report tables: small decisions over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

col, lit = F.col, F.lit


def active_rules(rules: DataFrame) -> DataFrame:
    """rules(id, domain_pattern, decision, reason, is_active, updated_at) in force, with their place, newest first."""
    d = rules.where("is_active").select(col("id").alias("rule_id"), "domain_pattern", "decision", F.coalesce("reason", lit("")).alias("reason"), "updated_at")
    return d.withColumn("place", F.rank().over(Window.orderBy(F.desc_nulls_last("updated_at"), "rule_id")))  # rules are made by hand, few


def set_cooldowns(domains: DataFrame, cooldowns: DataFrame, now: Column) -> DataFrame:
    """domains(domain, cooldown_until, skip_reason) after cooldowns(domain, minutes, reason); the longest of a domain counts."""
    c = cooldowns.groupBy("domain").agg(F.max_by(F.struct("minutes", "reason"), F.struct("minutes", "reason")).alias("c"))
    until = F.timestamp_add("MINUTE", col("c.minutes"), now)
    return domains.join(c, "domain", "left").select("domain", F.when(col("c").isNotNull(), until).otherwise(col("cooldown_until")).alias("cooldown_until"), F.when(col("c").isNotNull(), col("c.reason")).otherwise(col("skip_reason")).alias("skip_reason"))


def cooling_down(until: Column, now: Column) -> Column:
    """True while a cooldown lasts; false without one."""
    return F.coalesce(now < until, lit(False))


# How likely a blocked domain is to be let in again, by why it is blocked.
UNBLOCK_RISK = {"dangerous_pattern": "high", "high_rejection_rate": "low", "denylist": "low", "manual": "low", "unknown": "high"}


def blocked_domains(states: DataFrame, rules: DataFrame) -> DataFrame:
    """(domain, reason, unblock_risk, restored) of states(domain, blocked, reason, at) whose last state is blocked.

    A domain's latest rule of rules(domain, decision, at) may unblock it.
    """
    last = states.groupBy("domain").agg(F.max_by(F.struct("blocked", "reason", "at"), F.struct("at", "blocked")).alias("s"))
    rule = rules.groupBy("domain").agg(F.max_by(F.struct("decision", "at"), F.struct("at", "decision")).alias("r"))
    risk = F.create_map(*[x for k, v in UNBLOCK_RISK.items() for x in (lit(k), lit(v))])
    d = last.join(rule, "domain", "left").where("s.blocked")
    return d.select("domain", col("s.reason").alias("reason"), F.coalesce(risk[col("s.reason")], lit("high")).alias("unblock_risk"), F.coalesce((col("r.decision") == "unblock") & (col("r.at") > col("s.at")), lit(False)).alias("restored"))


def verification_meta(results: DataFrame) -> DataFrame:
    """One row over results(claim_id, domain, status, category, promotion): counts by status, domains by category, warnings, quality."""
    n = lambda s: F.count_if(col("status") == s).alias(s)
    names = lambda c: F.sort_array(F.collect_set(F.when(col("category") == c, col("domain"))))
    d = results.agg(n("verified"), n("pending"), n("rejected"), names("blocked").alias("blocked"), names("unverified").alias("unverified"), F.count_if(col("promotion") == "demoted").alias("warnings"), F.max(col("category") == "blocked").alias("__b"))
    return d.withColumn("data_quality", F.when(col("__b"), "degraded").otherwise("normal")).drop("__b")


EVENT = "event_type string, timestamp string, source_url string, notes string, confidence double"


def save_timelines(events: DataFrame) -> DataFrame:
    """(claim_id, timeline_json) of events(claim_id, event_type, timestamp, source_url, notes, confidence), oldest first."""
    e = F.sort_array(F.collect_list(F.struct("timestamp", "event_type", "source_url", "notes", "confidence")))
    e = F.transform(e, lambda x: F.struct(x["event_type"].alias("event_type"), x["timestamp"].alias("timestamp"), x["source_url"].alias("source_url"), x["notes"].alias("notes"), x["confidence"].alias("confidence")))
    return events.groupBy("claim_id").agg(e.alias("events")).select("claim_id", F.to_json(F.struct("claim_id", "events")).alias("timeline_json"))


def load_timelines(claims: DataFrame) -> DataFrame:
    """The events of claims(claim_id, timeline_json), a row each; broken or missing JSON gives none."""
    t = F.from_json("timeline_json", f"claim_id string, events array<struct<{', '.join(x.replace(' ', ':', 1) for x in EVENT.split(', '))}>>")
    return claims.select("claim_id", F.explode(t["events"]).alias("e")).select("claim_id", "e.*")


#: Priority boosts of arms; any other counts as medium.
BOOSTS = {"high": 1.5, "medium": 1.0, "low": 0.7}


def arms(registered: DataFrame, observed: DataFrame, most: int | None = None) -> DataFrame:
    """(search_id, boost, budget, pulls, reward) of registered(search_id, priority, budget, at) after observed(search_id, useful).

    The first registration of a search counts; what is seen of others counts for nothing.
    """
    boost = F.create_map(*[x for k, v in BOOSTS.items() for x in (lit(k), lit(v))])
    first = registered.groupBy("search_id").agg(F.min_by(F.struct("priority", "budget"), F.struct("at", "priority")).alias("r"))
    seen = observed.groupBy("search_id").agg(F.count("*").alias("pulls"), F.count_if("useful").alias("reward"))
    budget = F.coalesce(col("r.budget"), lit(0))
    d = first.join(seen, "search_id", "left")
    return d.select("search_id", F.coalesce(boost[col("r.priority")], lit(1.0)).alias("boost"), (F.least(budget, lit(most)) if most is not None else budget).alias("budget"), F.coalesce("pulls", lit(0)).alias("pulls"), F.coalesce("reward", lit(0)).alias("reward"))


#: A fit whose score exceeds that of the one in force by more than this share of it is rolled back.
DEGRADATION = 0.05


def calibration_history(fits: DataFrame, worse: float = DEGRADATION) -> DataFrame:
    """(source, version, brier, rolled_back, in_force) of fits(source, version, brier): what is in force after each fit.

    Each fit is held against the one in force, so a source's fits are folded in order;
    they are as many as there were calibrations, so few.
    """
    kind = fits.schema["version"].dataType.simpleString()
    done = F.array().cast(f"array<struct<version:{kind},brier:double,rolled_back:boolean,in_force:{kind},own:double>>")

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, lit(-1))
        bad = F.coalesce((last["own"] > 0) & ((x["brier"] - last["own"]) / last["own"] > worse), lit(False))
        now = F.struct(x["version"].alias("version"), x["brier"].alias("brier"), bad.alias("rolled_back"), F.when(bad, last["in_force"]).otherwise(x["version"]).alias("in_force"), F.when(bad, last["own"]).otherwise(x["brier"]).alias("own"))
        return F.concat(a, F.array(now))

    d = fits.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("version", "brier"))).alias("l"))
    return d.select("source", F.explode(F.aggregate("l", done, step)).alias("x")).select("source", "x.version", "x.brier", "x.rolled_back", "x.in_force")


def roll_back(history: DataFrame, source: str, version: int) -> DataFrame:
    """The history with one version of a source in force from its last fit on."""
    last = F.max("version").over(Window.partitionBy("source"))
    return history.withColumn("in_force", F.when((col("source") == source) & (col("version") == last), lit(version)).otherwise(col("in_force")))


def calibration_stats(history: DataFrame) -> DataFrame:
    """A row per source: fits, rollbacks, the version in force and its score, the mean score."""
    now = history.groupBy("source").agg(F.count("*").alias("fits"), F.count_if("rolled_back").alias("rollbacks"), F.max_by("in_force", "version").alias("in_force"), F.avg(col("brier").cast("decimal(18,9)")).cast("double").alias("mean_brier"))
    return now.join(history.select("source", col("version").alias("in_force"), col("brier").alias("brier_in_force")), ["source", "in_force"])


def resolve_identifiers(ids: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """ids(kind, value) with the doi that crosswalk(kind, value, doi) gives; arXiv ids without one take their standard DOI, DOIs stand for themselves."""
    value = F.lower(F.trim("value"))
    bare = F.when(col("kind") == "pmcid", F.concat(lit("pmc"), F.regexp_replace(value, "^pmc", ""))).when(col("kind") == "arxiv", F.regexp_replace(F.regexp_replace(value, "^arxiv:", ""), r"v\d+$", "")).otherwise(value)
    known = crosswalk.groupBy("kind", bare.alias("bare")).agg(F.min(F.lower("doi")).alias("known"))
    d = ids.withColumn("bare", bare).join(known, ["kind", "bare"], "left")
    arxiv = F.when(col("kind") == "arxiv", F.concat(lit("10.48550/arxiv."), "bare"))
    return d.select("kind", "value", F.coalesce("known", F.when(col("kind") == "doi", col("bare")), arxiv).alias("doi"), F.when(col("known").isNotNull(), "crosswalk").when(col("kind").isin("doi", "arxiv"), "rule").otherwise("none").alias("by"))


def merge_entities(entities: DataFrame, found: DataFrame) -> DataFrame:
    """entities(entity_id, name, confidence, address) after found(entity_id, name, confidence, address, at): the last found overwrites the confidence, an address fills an empty one only, new ones are added."""
    last = found.groupBy("entity_id").agg(F.max_by(F.struct("name", "confidence"), "at").alias("f"), F.min_by("address", F.when(F.length("address") > 0, col("at"))).alias("fa"))
    d = entities.join(last, "entity_id", "full_outer")
    return d.select("entity_id", F.coalesce("name", "f.name").alias("name"), F.coalesce("f.confidence", "confidence").alias("confidence"), F.coalesce(F.when(F.length("address") > 0, col("address")), col("fa")).alias("address"))


def footnotes_without_trace(footnotes: DataFrame) -> DataFrame:
    """(number, preview, reason) of footnotes(number, content) that name no page."""
    text = F.when(F.length("content") > 100, F.concat(F.substring("content", 1, 100), lit("..."))).otherwise(col("content"))
    return footnotes.where(~col("content").rlike(r"page_id=[^\s,.\]]")).select("number", text.alias("preview"), lit("Missing page_id in footnote").alias("reason"))


def unknown_urls(used: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct urls of used(url) that neither begin, nor are the beginning of, an address of index(url); DOIs pass.

    Addresses that begin alike share their scheme and host, or one is no longer than that: both meet by key.
    """
    bare = F.regexp_replace("url", "/+$", "")
    site = F.regexp_extract(col("b"), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    u = used.where(~col("url").startswith("DOI:") & ~col("url").contains("doi.org")).select("url", bare.alias("b")).distinct().withColumn("site", site)
    i = index.select(bare.alias("b")).distinct().withColumn("site", site).select(col("b").alias("ib"), "site")
    known = u.join(i, "site").where(col("b").startswith(col("ib")) | col("ib").startswith(col("b"))).select("url")
    return u.join(known, "url", "left_anti").select("url")


def finding_citations(findings: DataFrame, claim_pages: DataFrame, numbers: DataFrame) -> DataFrame:
    """(claim_id, citations) of findings(claim_id): the numbers of the pages it rests on, as footnote marks in order; a dash for none."""
    d = claim_pages.join(numbers, "page_id").groupBy("claim_id").agg(F.sort_array(F.collect_set("n")).alias("n"))
    marks = F.array_join(F.transform("n", lambda x: F.concat(lit("[^"), x.cast("string"), lit("]"))), "")
    return findings.select("claim_id").distinct().join(d, "claim_id", "left").select("claim_id", F.coalesce(marks, lit("-")).alias("citations"))


def adoption(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, status) of nodes(id) after changes(id, status, at): the latest, else adopted."""
    last = changes.groupBy("id").agg(F.max_by("status", F.struct("at", "status")).alias("status"))
    return nodes.select("id").join(last, "id", "left").select("id", F.coalesce("status", lit("adopted")).alias("status"))


def paper_citations(papers: DataFrame, references: DataFrame, pages: DataFrame) -> DataFrame:
    """New cites edges (source_id, target_id, context) of papers(paper_id): references(citing, cited, context) next to a paper, both ends mapped by pages(paper_id, page_id).

    Ids without a page are skipped, a page that cites itself too; a pair appears once.
    """
    own = papers.select("paper_id").distinct()
    near = references.join(own.select(col("paper_id").alias("citing")), "citing", "left_semi").union(references.join(own.select(col("paper_id").alias("cited")), "cited", "left_semi").select(*references.columns))
    page = lambda end, name: pages.select(col("paper_id").alias(end), col("page_id").alias(name))
    d = near.join(page("citing", "source_id"), "citing").join(page("cited", "target_id"), "cited").where("source_id != target_id")
    return d.groupBy("source_id", "target_id").agg(F.min("context").alias("context"))


def placeholders(references: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, url, title) rows to add for cited papers of references(cited, title, doi) that have no page yet."""
    d = references.groupBy("cited").agg(F.max("title").alias("title"), F.max(F.lower("doi")).alias("doi"))
    d = d.join(pages.select(col("paper_id").alias("cited")), "cited", "left_anti")
    return d.select(col("cited").alias("paper_id"), F.coalesce(F.concat(lit("https://doi.org/"), "doi"), F.concat(lit("urn:paper:"), col("cited").cast("string"))).alias("url"), "title")
