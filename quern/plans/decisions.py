"""Registered queries: rules, cooldowns, verification, arms, calibrations, identifiers and report tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quern.functions import places as pl
from quern.operators import decisions as de
from quern.operators import quality as qu
from quern.operators import state as st
from quern.operators import views as vw
from quern.sources.graph import table

from .registry import on_graph, query
from .relational import ENGINES_SQL, engines

col, lit = F.col, F.lit


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def pick(values, at):
    """An element of a list of literals by a number."""
    return F.element_at(F.array(*[lit(x) for x in values]), (at % len(values) + 1).cast("int"))


def sql_pick(values, at):
    return "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in values) + f"][({at}) % {len(values)} + 1]"


@query("S22_active_rules", "WITH r AS (SELECT event_id AS id, '*.d' || user_id || '.org' AS domain_pattern, CASE WHEN event_type = 'click' THEN 'block' ELSE 'unblock' END AS decision, CASE WHEN event_id % 2 = 0 THEN 'by hand' END AS reason, event_type <> 'view' AS is_active, ts AS updated_at FROM events WHERE event_type IN ('click', 'signup', 'view')) SELECT id AS rule_id, domain_pattern, decision, coalesce(reason, '') AS reason, updated_at, rank() OVER (ORDER BY updated_at DESC, id) AS place FROM r WHERE is_active")
def s22(spark, sf_dir):
    k = col("event_type")
    r = events(spark, sf_dir).where(k.isin("click", "signup", "view"))
    r = r.select(col("event_id").alias("id"), F.concat(lit("*.d"), col("user_id").cast("string"), lit(".org")).alias("domain_pattern"), F.when(k == "click", "block").otherwise("unblock").alias("decision"), F.when(col("event_id") % 2 == 0, "by hand").alias("reason"), (k != "view").alias("is_active"), col("ts").alias("updated_at"))
    return de.active_rules(r).withColumn("place", col("place").cast("long"))


@query("S36_engines_by_weight", ENGINES_SQL + "SELECT engine, weight, row_number() OVER (ORDER BY weight DESC, engine) AS place FROM engines WHERE status <> 'open' AND (cooldown_until IS NULL OR cooldown_until < TIMESTAMP '2024-02-20 00:00:00') AND (daily_limit IS NULL OR daily_usage < daily_limit)")
def s36(spark, sf_dir):
    return vw.engines_by_weight(engines(spark, sf_dir), datetime(2024, 2, 20)).select("engine", "weight", col("place").cast("long").alias("place"))


@query("X27_engine_health", "SELECT event_type || user_id AS engine, coalesce(CASE WHEN count(*) % 2 = 0 THEN count(*) FILTER (event_id % 3 > 0)::DOUBLE / count(*) END, 1.0::DOUBLE) AS success_rate_1h, coalesce(CASE WHEN count(*) % 3 = 0 THEN 0.5::DOUBLE END, 1.0::DOUBLE) AS success_rate_24h, coalesce(CASE WHEN count(*) % 5 = 0 THEN 0.25::DOUBLE END, 0.0::DOUBLE) AS captcha_rate, coalesce(CASE WHEN count(*) % 2 = 1 THEN max(value) END, 1000.0::DOUBLE) AS median_latency_ms, coalesce(CASE WHEN count(*) % 4 = 0 THEN 0.5::DOUBLE END, 0.0::DOUBLE) AS http_error_rate FROM events GROUP BY event_type, user_id")
def x27(spark, sf_dir):
    n = F.count("*")
    e = events(spark, sf_dir).groupBy(F.concat("event_type", col("user_id").cast("string")).alias("engine")).agg(F.when(n % 2 == 0, F.count_if(col("event_id") % 3 > 0) / n).alias("success_rate_1h"), F.when(n % 3 == 0, 0.5).alias("success_rate_24h"), F.when(n % 5 == 0, 0.25).alias("captcha_rate"), F.when(n % 2 == 1, F.max("value")).alias("median_latency_ms"), F.when(n % 4 == 0, 0.5).alias("http_error_rate"))
    return vw.engine_health(e)


NOW = datetime(2024, 1, 20)


@query("X25_domain_cooldowns", "WITH d AS (SELECT user_id, max(ts) FILTER (event_type = 'error') AS c FROM events GROUP BY 1), s AS (SELECT user_id, max((event_id % 50 * 60)) AS minutes FROM events WHERE event_type = 'signup' AND event_id % 3 = 0 GROUP BY 1), x AS (SELECT 'u' || user_id AS domain, CASE WHEN minutes IS NOT NULL THEN TIMESTAMP '2024-01-20 00:00:00' + minutes * INTERVAL 1 MINUTE ELSE c END AS cooldown_until FROM d LEFT JOIN s USING (user_id)) SELECT domain, cooldown_until, coalesce(TIMESTAMP '2024-01-20 00:00:00' < cooldown_until, false) AS cooling FROM x")
def x25(spark, sf_dir):
    e, name = events(spark, sf_dir), F.concat(lit("u"), col("user_id").cast("string")).alias("domain")
    d = e.groupBy(name).agg(F.max(F.when(col("event_type") == "error", col("ts"))).alias("cooldown_until"), lit("errors").alias("skip_reason"))
    s = e.where("event_type = 'signup' and event_id % 3 = 0").select(name, (col("event_id") % 50 * 60).alias("minutes"), lit("set").alias("reason"))
    return de.set_cooldowns(d, s, lit(NOW)).select("domain", "cooldown_until", de.cooling_down(col("cooldown_until"), lit(NOW)).alias("cooling"))


REASONS = list(de.UNBLOCK_RISK) + ["other"]


@query("X39_blocked_domains", f"WITH s AS (SELECT user_id, max((ts, event_id)) FILTER (event_type IN ('error', 'signup')) AS m FROM events GROUP BY 1), l AS (SELECT s.user_id, e.ts, e.event_type = 'error' AS blocked, {sql_pick(REASONS, 'e.event_id')} AS reason FROM s JOIN events e ON e.user_id = s.user_id AND e.event_id = s.m[2] AND e.ts = s.m[1]), r AS (SELECT user_id, max((ts, event_id)) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT 'u' || l.user_id AS domain, reason, CASE reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in de.UNBLOCK_RISK.items()) + " ELSE 'high' END AS unblock_risk, coalesce(r.m[2] % 2 = 0 AND r.m[1] > l.ts, false) AS restored FROM l LEFT JOIN r USING (user_id) WHERE blocked")
def x39(spark, sf_dir):
    e, name = events(spark, sf_dir), F.concat(lit("u"), col("user_id").cast("string")).alias("domain")
    # an event's number breaks ties of time, as a part of the time itself would
    s = e.where(col("event_type").isin("error", "signup")).groupBy(name).agg(F.max_by(F.struct((col("event_type") == "error").alias("blocked"), pick(REASONS, col("event_id")).alias("reason"), col("ts").alias("at")), F.struct("ts", "event_id")).alias("x")).select("domain", "x.*")
    r = e.where("event_type = 'purchase'").groupBy(name).agg(F.max_by(F.struct(F.when(col("event_id") % 2 == 0, "unblock").otherwise("block").alias("decision"), col("ts").alias("at")), F.struct("ts", "event_id")).alias("x")).select("domain", "x.*")
    return de.blocked_domains(s, r)


VERIFIED, CATEGORIES = ["verified", "pending", "rejected"], ["trusted", "academic", "unverified", "blocked", "low"]
WHERE_BLOCKED = "category = 'blocked'"


@query("X40_verification_meta", f"WITH r AS (SELECT 'u' || user_id AS domain, {sql_pick(VERIFIED, 'event_id')} AS status, {sql_pick(CATEGORIES, 'user_id')} AS category, event_id % 10 = 0 AS demoted FROM events) SELECT count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'rejected') AS rejected, list_sort(list(DISTINCT domain) FILTER ({WHERE_BLOCKED})) AS blocked, list_sort(list(DISTINCT domain) FILTER (category = 'unverified')) AS unverified, count(*) FILTER (demoted) AS warnings, CASE WHEN count(*) FILTER ({WHERE_BLOCKED}) > 0 THEN 'degraded' ELSE 'normal' END AS data_quality FROM r")
def x40(spark, sf_dir):
    i = col("event_id")
    return de.verification_meta(events(spark, sf_dir).select(i.alias("claim_id"), F.concat(lit("u"), col("user_id").cast("string")).alias("domain"), pick(VERIFIED, i).alias("status"), pick(CATEGORIES, col("user_id")).alias("category"), F.when(i % 10 == 0, "demoted").otherwise("unchanged").alias("promotion")))


@query("X41_timelines", "SELECT user_id AS claim_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE WHEN event_id % 3 = 0 THEN 'https://x.example/?a=\"' || event_id END AS source_url, round(value, 3) AS confidence FROM events")
def x41(spark, sf_dir):
    e = events(spark, sf_dir).select(col("user_id").alias("claim_id"), "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.when(col("event_id") % 3 == 0, F.concat(lit('https://x.example/?a="'), col("event_id").cast("string"))).alias("source_url"), lit(None).cast("string").alias("notes"), F.round("value", 3).alias("confidence"))
    return de.load_timelines(de.save_timelines(e)).drop("notes")


PRIORITIES = ["high", "medium", "low", "urgent"]


@query("X54_arms", f"WITH r AS (SELECT user_id, min((ts, {sql_pick(PRIORITIES, 'event_id')}, event_id % 300)) AS m FROM events WHERE event_type = 'signup' GROUP BY 1), o AS (SELECT user_id, count(*) AS pulls, count(*) FILTER (value > 50) AS reward FROM events WHERE event_type = 'view' GROUP BY 1) SELECT user_id AS search_id, CASE m[2] WHEN 'high' THEN 1.5::DOUBLE WHEN 'low' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS boost, least(m[3], 200) AS budget, coalesce(pulls, 0) AS pulls, coalesce(reward, 0) AS reward FROM r LEFT JOIN o USING (user_id)")
def x54(spark, sf_dir):
    e, i = events(spark, sf_dir), col("event_id")
    r = e.where("event_type = 'signup'").select(col("user_id").alias("search_id"), pick(PRIORITIES, i).alias("priority"), (i % 300).alias("budget"), col("ts").alias("at"))
    return de.arms(r, e.where("event_type = 'view'").select(col("user_id").alias("search_id"), (col("value") > 50).alias("useful")), 200)


BAD = "(g.own > 0 AND (n.brier - g.own) / g.own > 0.05::DOUBLE)"
FITS = f"WITH RECURSIVE f AS (SELECT event_type AS source, user_id AS version, round((2 + sin(user_id)::DOUBLE) / (3 + count(*)), 6) AS brier FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY version) AS k FROM f), g AS (SELECT source, version, brier, k, false AS rolled_back, version AS in_force, brier AS own FROM n WHERE k = 1 UNION ALL SELECT n.source, n.version, n.brier, n.k, {BAD}, CASE WHEN {BAD} THEN g.in_force ELSE n.version END, CASE WHEN {BAD} THEN g.own ELSE n.brier END FROM n JOIN g ON n.source = g.source AND n.k = g.k + 1), h AS (SELECT source, version, brier, rolled_back, in_force FROM g) "


def history(spark, sf_dir):
    f = events(spark, sf_dir).groupBy(col("event_type").alias("source"), col("user_id").alias("version")).agg(F.count("*").alias("n")).select("source", "version", F.round((2 + F.sin("version")) / (3 + col("n")), 6).alias("brier"))
    return de.calibration_history(f)


@query("C7_calibration_history", FITS + "SELECT * FROM h")
def c7(spark, sf_dir):
    return history(spark, sf_dir).select("source", "version", "brier", "rolled_back", "in_force")


@query("C7b_calibration_stats", FITS + ", s AS (SELECT source, count(*) AS fits, count(*) FILTER (rolled_back) AS rollbacks, arg_max(in_force, version) AS in_force, round(sum(brier::DECIMAL(18,9))::DOUBLE / count(*), 6) AS mean_brier FROM h GROUP BY 1) SELECT s.*, h.brier AS brier_in_force FROM s JOIN h ON h.source = s.source AND h.version = s.in_force")
def c7b(spark, sf_dir):
    return de.calibration_stats(history(spark, sf_dir)).withColumn("mean_brier", F.round("mean_brier", 6))


KINDS = ["doi", "pmid", "pmcid", "arxiv"]


@query("X44_identifiers", "WITH i AS (SELECT p_partkey AS k, ['doi', 'pmid', 'pmcid', 'arxiv'][p_partkey % 4 + 1] AS kind, CASE p_partkey % 4 WHEN 0 THEN ' 10.1/AB' || p_partkey WHEN 1 THEN '' || p_partkey WHEN 2 THEN 'PMC' || p_partkey ELSE 'arXiv:2401.' || p_partkey || 'v2' END AS value FROM part), c AS (SELECT k FROM i WHERE k % 3 = 0) SELECT kind, value, CASE WHEN c.k IS NOT NULL THEN '10.9/x' || i.k WHEN kind = 'doi' THEN '10.1/ab' || i.k WHEN kind = 'arxiv' THEN '10.48550/arxiv.2401.' || i.k END AS doi, CASE WHEN c.k IS NOT NULL THEN 'crosswalk' WHEN kind IN ('doi', 'arxiv') THEN 'rule' ELSE 'none' END AS \"by\" FROM i LEFT JOIN c ON c.k = i.k")
def x44(spark, sf_dir):
    k = col("p_partkey")
    t = k.cast("string")
    value = F.when(k % 4 == 0, F.concat(lit(" 10.1/AB"), t)).when(k % 4 == 1, t).when(k % 4 == 2, F.concat(lit("PMC"), t)).otherwise(F.concat(lit("arXiv:2401."), t, lit("v2")))
    i = table(spark, sf_dir, "part").select(k, pick(KINDS, k).alias("kind"), value.alias("value"))
    cross = i.where("p_partkey % 3 = 0").select("kind", F.when(col("kind") == "pmcid", t).when(col("kind") == "arxiv", F.concat(lit("2401."), t)).otherwise(col("value")).alias("value"), F.concat(lit("10.9/X"), t).alias("doi"))
    return de.resolve_identifiers(i.select("kind", "value"), cross)


@query("X42_merged_entities", "WITH e AS (SELECT s_suppkey AS entity_id, s_name AS name, 0.5::DOUBLE AS confidence, CASE WHEN s_suppkey % 2 = 0 THEN 'street ' || s_suppkey ELSE '' END AS address FROM supplier), f AS (SELECT user_id AS entity_id, 'found ' || event_type AS name, (event_id % 100)::DOUBLE / 100 AS confidence, CASE WHEN event_id % 3 = 0 THEN 'road ' || event_id END AS address, event_id AS t FROM events), l AS (SELECT entity_id, arg_max(name, t) AS n, arg_max(confidence, t) AS c, arg_min(address, t) FILTER (address IS NOT NULL) AS a FROM f GROUP BY 1) SELECT coalesce(e.entity_id, l.entity_id) AS entity_id, coalesce(name, n) AS name, coalesce(c, confidence) AS confidence, coalesce(CASE WHEN length(address) > 0 THEN address END, a) AS address FROM e FULL JOIN l ON e.entity_id = l.entity_id")
def x42(spark, sf_dir):
    k, i = col("s_suppkey"), col("event_id")
    e = table(spark, sf_dir, "supplier").select(k.alias("entity_id"), col("s_name").alias("name"), lit(0.5).alias("confidence"), F.when(k % 2 == 0, F.concat(lit("street "), k.cast("string"))).otherwise("").alias("address"))
    f = events(spark, sf_dir).select(col("user_id").alias("entity_id"), F.concat(lit("found "), "event_type").alias("name"), (i % 100 / 100).alias("confidence"), F.when(i % 3 == 0, F.concat(lit("road "), i.cast("string"))).alias("address"), i.alias("at"))
    return de.merge_entities(e, f)


@query("W6_untraced_footnotes", "WITH f AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN text || ' page_id=p' || conv_id ELSE text END AS content FROM conversations) SELECT conv_id || '-' || turn || '-' || role AS number, CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END AS preview, 'Missing page_id in footnote' AS reason FROM f WHERE NOT regexp_matches(content, 'page_id=[^\\s,.\\]]')")
def w6(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return de.footnotes_without_trace(c.select(F.concat_ws("-", "conv_id", "turn", "role").alias("number"), F.when(col("turn") % 2 == 0, F.concat("text", lit(" page_id=p"), col("conv_id").cast("string"))).otherwise(col("text")).alias("content")))


@query("X50_unknown_final_urls", "WITH u AS (SELECT DISTINCT CASE page_id % 5 WHEN 0 THEN url || '/' WHEN 1 THEN url || '/more' WHEN 2 THEN 'https://doi.org/10.1/' || page_id WHEN 3 THEN regexp_extract(url, '^[a-z]+://[^/]+') ELSE 'https://nowhere.example/' || page_id END AS url FROM pages), i AS (SELECT url FROM pages WHERE page_id % 2 = 0) SELECT url FROM u WHERE NOT contains(url, 'doi.org') AND NOT EXISTS (SELECT 1 FROM i WHERE starts_with(rtrim(u.url, '/'), rtrim(i.url, '/')) OR starts_with(rtrim(i.url, '/'), rtrim(u.url, '/')))")
def x50(spark, sf_dir):
    p, k, u = table(spark, sf_dir, "pages"), col("page_id") % 5, col("url")
    t = col("page_id").cast("string")
    used = F.when(k == 0, F.concat(u, lit("/"))).when(k == 1, F.concat(u, lit("/more"))).when(k == 2, F.concat(lit("https://doi.org/10.1/"), t)).when(k == 3, F.regexp_extract(u, "^([a-z]+://[^/]+)", 1)).otherwise(F.concat(lit("https://nowhere.example/"), t))
    return de.unknown_urls(p.select(used.alias("url")), p.where("page_id % 2 = 0").select("url"))


on_graph("X51_finding_citations", lambda g: de.finding_citations(g.claims.select(col("id").alias("claim_id")), vw.located(g, g.origin).select("claim_id", "page_id"), vw.located(g, g.origin).select("page_id").distinct().where("page_id % 3 > 0").select("page_id", (col("page_id") % 1000).alias("n"))), "SELECT c.id AS claim_id, coalesce(array_to_string(list_transform(list_sort(list(DISTINCT f.page_id % 1000) FILTER (f.page_id % 3 > 0)), lambda n: '[^' || n || ']'), ''), '-') AS citations FROM g_claims c LEFT JOIN g_origin o ON o.target_id = c.id LEFT JOIN g_fragments f ON f.id = o.source_id GROUP BY 1")
on_graph("G8_adoption", lambda g: de.adoption(g.claims, g.nli.where("relation != 'neutral'").select(col("target_id").alias("id"), F.when(col("relation") == "refutes", "rejected").otherwise("adopted").alias("status"), col("id").alias("at"))), "SELECT c.id, CASE WHEN arg_max(n.relation, n.id) = 'refutes' THEN 'rejected' ELSE 'adopted' END AS status FROM g_claims c LEFT JOIN g_nli n ON n.target_id = c.id AND n.relation <> 'neutral' GROUP BY 1")

REFS = "WITH r AS (SELECT l_partkey AS citing, l_suppkey AS cited, l_orderkey AS o FROM lineitem), p AS (SELECT s_suppkey AS paper_id, s_suppkey + 1000 AS page_id FROM supplier WHERE s_suppkey % 4 > 0) "


def refs(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(col("l_partkey").alias("citing"), col("l_suppkey").alias("cited"), F.concat(lit("in "), col("l_orderkey").cast("string")).alias("context"))
    return r, table(spark, sf_dir, "supplier").where("s_suppkey % 4 > 0").select(col("s_suppkey").alias("paper_id"), (col("s_suppkey") + 1000).alias("page_id"))


@query("G20_paper_citations", REFS + "SELECT a.page_id AS source_id, b.page_id AS target_id, min('in ' || o) AS context FROM r JOIN p a ON a.paper_id = citing JOIN p b ON b.paper_id = cited WHERE (citing % 3 = 0 OR cited % 3 = 0) AND citing <> cited GROUP BY 1, 2")
def g20(spark, sf_dir):
    r, p = refs(spark, sf_dir)
    own = table(spark, sf_dir, "part").select(col("p_partkey").alias("paper_id")).where("paper_id % 3 = 0")
    return de.paper_citations(own, r, p)


@query("X15_placeholders", REFS + "SELECT citing AS paper_id, CASE WHEN citing % 2 = 0 THEN 'https://doi.org/10.1/ab' || citing ELSE 'urn:paper:' || citing END AS url, 'Paper ' || citing AS title FROM (SELECT DISTINCT citing FROM r) WHERE citing NOT IN (SELECT paper_id FROM p)")
def x15(spark, sf_dir):
    r, p = refs(spark, sf_dir)
    t = col("citing").cast("string")
    return de.placeholders(r.select(col("citing").alias("cited"), F.concat(lit("Paper "), t).alias("title"), F.when(col("citing") % 2 == 0, F.concat(lit("10.1/AB"), t)).alias("doi")), p)


ADDRESSES = ["1-2-3 Chiyoda, 東京都 〒100-0001, Japan", "350 Fifth Ave, New York, NY 10118-0110, USA", "10 Downing St, London SW1A 2AA, England", "Hauptstr. 5,  80331 München, Deutschland", "北海道札幌市 060-8588 日本", "nowhere at all", "12 Rue X, 75001 Paris, FRANCE", "1 Orchard Rd 238823 Singapore", ""]
HINTS = [None, "jp", "Japan", "zz", "xyz"]
COUNTRY_SQL = "CASE " + " ".join("WHEN " + " OR ".join("contains(lower(a), '" + x.replace("'", "''") + "')" for x in v) + f" THEN '{k}'" for k, v in pl.COUNTRIES.items()) + " END"
NAMED_SQL = "CASE " + " ".join(f"WHEN lower(h) IN ('{k}', " + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + f") THEN '{k}'" for k, v in pl.COUNTRIES.items()) + " WHEN regexp_matches(lower(h), '^[a-z]{2}$') THEN lower(h) END"
POSTAL_SQL = "CASE " + " ".join(f"WHEN regexp_extract(a, '(?i){p}', 1) <> '' THEN regexp_extract(a, '(?i){p}', 1)" for p in pl.POSTAL) + " END"
REGION_SQL = "CASE " + " ".join(f"WHEN c = 'jp' AND contains(a, '{k}') THEN '{v}'" for k, v in pl.PREFECTURES.items()) + " END"


@query("F11_addresses", f"WITH d AS (SELECT s_suppkey, regexp_replace(trim({sql_pick(ADDRESSES, 's_suppkey')}), '\\s+', ' ', 'g') AS a, {sql_pick(HINTS, 's_suppkey // 9')} AS h FROM supplier), e AS (SELECT *, CASE WHEN length(h) > 0 THEN {NAMED_SQL} ELSE {COUNTRY_SQL} END AS c, {POSTAL_SQL} AS p FROM d), f AS (SELECT *, {REGION_SQL} AS r FROM e) SELECT s_suppkey, c AS country, r AS region, p AS postal_code, CASE WHEN concat_ws(', ', r, p, upper(c)) <> '' THEN concat_ws(', ', r, p, upper(c)) ELSE a END AS normalized FROM f")
def f11(spark, sf_dir):
    k = col("s_suppkey")
    x = pl.address_parts(pick(ADDRESSES, k), pick(HINTS, F.floor(k / 9)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", x.alias("x")).select("s_suppkey", "x.*")


HYPOTHESES = ["DPP-4 inhibitors are effective", "The sglt2 inhibitor works", "GLP-1 receptor agonists help", "glp1 agonist", "we saw Dapagliflozin act", "Metformin reduces sugar", "Coffee", "42 is the answer to all of it", ""]
NAMES = [("DPP-4 Inhibitors", "DPP4i"), ("SGLT2 Inhibitors", "sglt2i"), ("GLP-1 Receptor Agonists", "GLP1RA"), ("GLP1 Receptor Agonists", "glp1RA"), ("Dapagliflozin", "Dapaglif"), ("Metformin reduces", "Metformi"), ("Coffee", "Coffee"), ("42 is the answer to", "42 is th"), ("", "")]


@query("X47_drug_classes", f"SELECT p_partkey, {sql_pick([a for a, _ in NAMES], 'p_partkey')} AS name, {sql_pick([b for _, b in NAMES], 'p_partkey')} AS short FROM part")
def x47(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", pl.drug_class(pick(HYPOTHESES, col("p_partkey"))).alias("x")).select("p_partkey", "x.name", "x.short")


@query("T4_half_open_breaker")
def t4(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    return st.half_open_breaker(e, "user_id", "ts", ["ts", "event_id"], col("event_type") == "error").select("event_id", "user_id", "state", "failures", "total", "until")


@query("T4b_breaker_states")
def t4b(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    f = st.half_open_breaker(e, "user_id", "ts", ["ts", "event_id"], col("event_type") == "error")
    return st.state_at(f, "user_id", ["ts", "event_id"], lit(NOW))


@query("H9_page_features")
def h9_pages(spark, sf_dir):
    return qu.page_features(table(spark, sf_dir, "pages").select("page_id", "html"))


@query("H11_page_issues")
def h11_pages(spark, sf_dir):
    return qu.page_issues(qu.page_features(table(spark, sf_dir, "pages").select("page_id", "html"))).select("page_id", "issues", "score", "penalty", "reason")
