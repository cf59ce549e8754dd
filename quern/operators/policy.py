"""Policies of engines and domains: adjustment cycles, what they change, runtime state; figures of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

col, lit = F.col, F.lit

# Least, most and first value of each parameter, its steps up and down, and the seconds between two changes.
BOUNDS = {
    "engine_weight": (0.1, 2.0, 1.0, 0.1, 0.2),
    "engine_qps": (0.1, 0.5, 0.25, 0.05, 0.1),
    "headful_ratio": (0.0, 0.5, 0.1, 0.05, 0.05),
    "tor_usage_ratio": (0.0, 0.2, 0.0, 0.02, 0.05),
    "domain_cooldown": (30.0, 240.0, 60.0, 30.0, 15.0),
}
HYSTERESIS_S = 300
# Figures of a task, each a share of two counters; duplicates are what is not useful.
RATIOS = {
    "harvest_rate": ("useful_fragments", "total_pages_fetched"),
    "duplicate_rate": ("useful_fragments", "total_fragments"),
    "domain_diversity": ("unique_domains", "total_sources"),
    "tor_usage_rate": ("tor_requests", "total_requests"),
    "headful_rate": ("headful_requests", "total_requests"),
    "referer_match_rate": ("referer_matched", "total_requests"),
    "cache_304_rate": ("cache_304_hits", "revisit_count"),
    "captcha_rate": ("captcha_count", "total_requests"),
    "http_error_403_rate": ("error_403_count", "total_requests"),
    "http_error_429_rate": ("error_429_count", "total_requests"),
    "primary_source_rate": ("primary_sources", "total_sources"),
    "citation_loop_rate": ("citation_loops_detected", "total_citations"),
    "contradiction_rate": ("contradictions_found", "total_claims"),
    "timeline_coverage": ("claims_with_timeline", "total_claims"),
    "aggregator_rate": ("aggregator_sources", "total_sources"),
    "llm_time_ratio": ("llm_time_ms", "total_time_ms"),
}


def _rule(kind: str, parameter: str) -> tuple[Column, Column]:
    """Direction (1, -1 or 0) and reason of one parameter over the rates of its target and its value."""
    s, c, e403, e429, v = (col(x) for x in ("success_rate", "captcha_rate", "error_403_rate", "error_429_rate", "value"))
    errors = c + e403 + e429
    show = lambda *xs: F.concat(*[F.format_string("%.2f", x) if isinstance(x, Column) else lit(x) for x in xs])
    rules = {
        "engine_weight": [(s < 0.5, -1, show("Low success rate: ", s)), (s > 0.9, 1, show("High success rate: ", s))],
        "engine_qps": [(s < 0.7, -1, show("Reducing QPS due to low success rate: ", s))],
        "headful_ratio": [(errors > 0.3, 1, show("High error rate: ", errors)), ((errors < 0.05) & (v > BOUNDS["headful_ratio"][2]), -1, show("Low error rate: ", errors))],
        "tor_usage_ratio": [((e403 > 0.2) | (e429 > 0.2), 1, show("High block rate - considering Tor: 403=", e403, ", 429=", e429))],
        "domain_cooldown": [(c > 0.3, 1, show("High CAPTCHA rate: ", c))],
    }[parameter]
    way, why = lit(0), lit(None).cast("string")
    for test, d, text in reversed(rules):
        way, why = F.when(test, d).otherwise(way), F.when(test, text).otherwise(why)
    return way, why


def policy_updates(metrics: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """(target_type, target_id, parameter, old_value, new_value, reason) of one cycle over all targets.

    metrics(target_type, target_id, success_rate, captcha_rate, error_403_rate,
    error_429_rate); missing rates are 0.5 for success and 0 else. state(target_type,
    target_id, parameter, value, changed_at) holds what was set; a parameter changed less
    than the interval ago rests, one never set has its first value and may change only
    after an interval, so it rests too. Values stay within their bounds; no change, no row.
    """
    d = metrics.select("target_type", "target_id", F.coalesce("success_rate", lit(0.5)).alias("success_rate"), *[F.coalesce(c, lit(0.0)).alias(c) for c in ("captcha_rate", "error_403_rate", "error_429_rate")])
    d = d.join(state, ["target_type", "target_id"])
    may = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp("changed_at") >= HYSTERESIS_S
    out = None
    for p, (low, high, _, up, down) in BOUNDS.items():
        kind = "engine" if p.startswith("engine") else "domain"
        way, why = _rule(kind, p)
        x = d.where((col("target_type") == kind) & (col("parameter") == p) & may).withColumn("__w", way).withColumn("reason", why)
        moved = F.when(col("__w") > 0, col("value") + up).when(col("__w") < 0, col("value") - down)
        x = x.withColumn("new_value", F.round(F.greatest(lit(low), F.least(lit(high), moved)), 9)).where((col("__w") != 0) & (col("new_value") != col("value")))
        x = x.select("target_type", "target_id", "parameter", col("value").alias("old_value"), "new_value", "reason")
        out = x if out is None else out.unionByName(x)
    return out


def first_state(targets: DataFrame, at: Column) -> DataFrame:
    """The state of targets(target_type, target_id) that have none: every parameter of their type at its first value, set now."""
    rows = F.array(*[F.struct(lit("engine" if p.startswith("engine") else "domain").alias("t"), lit(p).alias("parameter"), lit(b[2]).alias("value")) for p, b in BOUNDS.items()])
    return targets.select("target_type", "target_id", F.explode(rows).alias("r")).where("r.t = target_type").select("target_type", "target_id", "r.parameter", "r.value", at.cast("timestamp").alias("changed_at"))


def apply_updates(state: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """state with the new values of updates, changed now."""
    k = ["target_type", "target_id", "parameter"]
    d = state.join(updates.select(*k, "new_value"), k, "left")
    hit = col("new_value").isNotNull()
    return d.select(*k, F.coalesce("new_value", "value").alias("value"), F.when(hit, now.cast("timestamp")).otherwise(col("changed_at")).alias("changed_at"))


def persist_updates(rows: DataFrame, key: str, updates: DataFrame, columns: dict[str, str], now: Column) -> DataFrame:
    """rows(key, ..., updated_at) of engines or domains with the parameters that they store under columns; others have no column there."""
    d = rows
    u = updates.where(col("parameter").isin(list(columns)))
    for p, c in columns.items():
        x = u.where(col("parameter") == p).select(col("target_id").alias(key), col("new_value").alias("__n"))
        d = d.join(x, key, "left").withColumn(c, F.coalesce(col("__n").cast(rows.schema[c].dataType), col(c))).drop("__n")
    hit = u.select(col("target_id").alias(key)).distinct().withColumn("__h", lit(True))
    return d.join(hit, key, "left").withColumn("updated_at", F.when(col("__h"), now.cast("timestamp")).otherwise(col("updated_at"))).select(*rows.columns)


def learned(policies: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """policies(domain, ...) with the last known value of each field of changes(domain, at, ...); domains without a policy are ignored."""
    last = changes.groupBy("domain").agg(*[F.max_by(c, F.when(col(c).isNotNull(), col("at"))).alias(f"__{c}") for c in fields])
    return policies.join(last, "domain", "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else col(c) for c in policies.columns])


def evaluations(history: DataFrame, source: str | None = None, since: Column | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The newest evaluations of history(id, source, evaluated_at, ...), of one source and since a time if given; and the count of all of that source."""
    d = history if source is None else history.where(col("source") == source)
    rows = d if since is None else d.where(col("evaluated_at") >= since)
    return rows.orderBy(F.desc("evaluated_at"), F.desc("id")).limit(limit), d.agg(F.count("*").alias("total_count"))


def task_counters(events: DataFrame) -> DataFrame:
    """Counters per task of events(task_id, kind, domain, flags, n): what RATIOS divide.

    Kinds are query, page, error, fragments, claim, citation, llm_time and time. Flags are
    names such as tor, headful, referer, revisit, not_modified, primary, aggregator,
    useful, timeline, contradiction, loop, captcha, 403 and 429; n is an amount. Pages not
    modified count on revisits only; fragments carry their amount and how many are useful
    in n and useful.
    """
    k, has = col("kind"), lambda f: F.array_contains("flags", f)
    page = k == "page"
    amount = lambda c, x="n": F.coalesce(F.sum(F.when(c, col(x))), lit(0)).cast("long")
    counts = {
        "total_queries": k == "query", "total_pages_fetched": page, "total_requests": page, "total_sources": page,
        "tor_requests": page & has("tor"), "headful_requests": page & has("headful"), "referer_matched": page & has("referer"),
        "revisit_count": page & has("revisit"), "cache_304_hits": page & has("revisit") & has("not_modified"), "primary_sources": page & has("primary"), "aggregator_sources": page & has("aggregator"),
        "captcha_count": (k == "error") & has("captcha"), "error_403_count": (k == "error") & has("403"), "error_429_count": (k == "error") & has("429"),
        "total_claims": k == "claim", "claims_with_timeline": (k == "claim") & has("timeline"), "contradictions_found": (k == "claim") & has("contradiction"),
        "total_citations": k == "citation", "citation_loops_detected": (k == "citation") & has("loop"),
    }
    sums = {"total_fragments": amount(k == "fragments"), "useful_fragments": amount(k == "fragments", "useful"), "llm_time_ms": amount(k == "llm_time"), "total_time_ms": amount(k == "time")}
    return events.groupBy("task_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()], *[c.alias(n) for n, c in sums.items()], F.countDistinct(F.when(page, F.lower("domain"))).alias("unique_domains"))


def task_figures(counters: DataFrame) -> DataFrame:
    """(task_id, figures) of task_counters(): each ratio, 0 where nothing was counted below it."""
    share = lambda n, d: F.when(col(d) > 0, (1 - col(n) / col(d)) if (n, d) == RATIOS["duplicate_rate"] else col(n) / col(d)).otherwise(lit(0.0))
    return counters.select("task_id", *[F.round(share(*nd), 9).alias(m) for m, nd in RATIOS.items()])
