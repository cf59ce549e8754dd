"""Registered queries: ranking (V), scores (C), state (T), validation (W) and further operators (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import urls
from quern.operators import ranking as rk
from quern.operators import scoring as sc
from quern.operators import state as st
from quern.operators import validate as va
from quern.operators import views as vw
from quern.operators.reports import jobs_pivot, milestones
from quern.sources.graph import table

from .embedded import JOBS_SQL, STATES, jobs
from .registry import on_graph, query
from .relational import LOCATED

col = F.col
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(col("vec_id").alias("id"), "embedding", "label")


def asked(spark, sf_dir):
    """The vectors that are searched for: every row whose id is divisible by 100."""
    return vectors(spark, sf_dir).where("id % 100 = 0").select(col("id").alias("query_id"), col("embedding").alias("query"))


def _dot(a, b):
    return f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: z[1] * z[2])), lambda s, x: s + x)"


SEARCH = f"WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS id, round({_dot('embedding', 'q')} / (sqrt({_dot('embedding', 'embedding')}) * sqrt({_dot('q', 'q')})), 6) AS similarity FROM embeddings, q) SELECT query_id, id, similarity FROM s WHERE similarity >= -1{{scope}} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10"


@query("V1_vector_search", SEARCH.format(scope=""))
def v1(spark, sf_dir):
    return rk.vector_searches(vectors(spark, sf_dir).select("id", "embedding"), asked(spark, sf_dir), 10, -1.0)


@query("V1b_vector_search_in_scope", SEARCH.format(scope=" AND id IN (SELECT p_partkey FROM part WHERE p_partkey % 5 = 1)"))
def v1b(spark, sf_dir):
    scope = table(spark, sf_dir, "part").where("p_partkey % 5 = 1").select(col("p_partkey").alias("id"))
    return rk.vector_searches(vectors(spark, sf_dir).select("id", "embedding"), asked(spark, sf_dir), 10, -1.0, scope)


BM25_TERMS = "the worthless und de"


@query("V6_bm25", rf"""WITH d AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), n AS (SELECT count(*) AS n, sum(len(w))::DOUBLE / count(*) AS avg FROM d), df AS (SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct(w)) AS term FROM d) GROUP BY 1), idf AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, n), m AS (SELECT avg(idf) AS mean FROM idf),
t AS (SELECT id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM d) WHERE term IN ('the', 'worthless', 'und', 'de') GROUP BY 1, 2)
SELECT id, round(sum(CASE WHEN idf < 0 THEN 0.25::DOUBLE * mean ELSE idf END * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * l / avg))), 4) AS score FROM t JOIN idf USING (term), m, n GROUP BY 1""")
def v6(spark, sf_dir):
    d = rk.bm25(table(spark, sf_dir, "documents").select(col("doc_id").alias("id"), "text"), BM25_TERMS)
    return d.select("id", F.round("score", 4).alias("score"))


@query("V5_local_impact", "WITH c AS (SELECT user_id, event_type, (event_id % 17) AS citations, event_id FROM events) SELECT event_id, CASE WHEN count(*) OVER w = 1 THEN 0.5::DOUBLE ELSE (rank() OVER (PARTITION BY event_type ORDER BY citations) - 1 + (count(*) OVER (PARTITION BY event_type, citations) - 1) / 2.0::DOUBLE) / (count(*) OVER w - 1) END AS impact FROM c WINDOW w AS (PARTITION BY event_type)")
def v5(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", "event_type", (col("event_id") % 17).alias("citations"))
    return rk.local_impact(d, "event_type").select("event_id", "impact")


@query("V8_rank_candidates", "WITH s AS (SELECT event_type AS query, event_id AS id, (event_id * 37 % 100)::DOUBLE / 10 AS bm25, (event_id * 53 % 100)::DOUBLE / 100 AS embedding, CASE event_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.75::DOUBLE ELSE 0.4::DOUBLE END AS weight FROM events), k AS (SELECT *, 0.3::DOUBLE * bm25 + 0.7::DOUBLE * embedding AS c FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, id) AS n FROM s) WHERE n <= 150) SELECT query, id, round(c, 9) AS combined, round(c * weight, 9) AS final, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM k")
def v8(spark, sf_dir):
    i = col("event_id")
    s = table(spark, sf_dir, "events").select(col("event_type").alias("query"), i.alias("id"), ((i * 37 % 100) / 10).alias("bm25"), ((i * 53 % 100) / 100).alias("embedding"), F.when(i % 3 == 0, 1.0).when(i % 3 == 1, 0.75).otherwise(0.4).alias("weight"))
    return rk.rank_candidates(s)


@query("V9_knee")
def v9(spark, sf_dir):
    return rk.cut_at_knee(v8(spark, sf_dir))


@query("V10_category_weights", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.4 WHEN 2 THEN 0.3 ELSE 0.0 END::DOUBLE AS weight FROM pages")
def v10(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("academic", "low", "strange", "blocked")]), (col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", urls.category_weight(kind, col("url")).alias("weight"))


@query("V12_semantic_knn", f"WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round({_dot('a.embedding', 'b.embedding')} / (sqrt({_dot('a.embedding', 'a.embedding')}) * sqrt({_dot('b.embedding', 'b.embedding')})), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) SELECT a, count(*) AS near, max(similarity) AS best FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS k FROM p WHERE similarity >= 0.2) WHERE k <= 8 GROUP BY 1")
def v12(spark, sf_dir):
    d = rk.knn(vectors(spark, sf_dir).select("id", "embedding"), 8, 0.2)
    return d.groupBy("a").agg(F.count("*").alias("near"), F.round(F.max("similarity"), 6).alias("best"))


@query("V11_pca_layout")
def v11(spark, sf_dir):
    return rk.pca_layout(vectors(spark, sf_dir).select("id", "embedding"))


@query("V15_full_text", rf"SELECT doc_id AS id FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE list_contains(w, 'the') AND list_contains(w, 'and')")
def v15(spark, sf_dir):
    return rk.match_all(table(spark, sf_dir, "documents").select(col("doc_id").alias("id"), "text"), ["The", "and"])


def samples(spark, sf_dir):
    return table(spark, sf_dir, "labels").select((col("doc_id") * 37 % 100 / 100.0).alias("p"), col("quality").alias("y"))


SAMPLES = "WITH s AS (SELECT (doc_id * 37 % 100)::DOUBLE / 100 AS p, quality AS y FROM labels) "
BINS = SAMPLES + ", b AS (SELECT least(10, ceil(round(p * 10, 9)))::INT AS bin, count(*) AS n, sum(y)::DOUBLE / count(*) AS acc, sum(p::DECIMAL(18,9))::DOUBLE / count(*) AS conf FROM s WHERE p > 0 GROUP BY 1), r AS (SELECT i::INT AS bin, coalesce(n, 0) AS n, coalesce(round(acc, 9), 0) AS accuracy, coalesce(round(conf, 9), 0) AS confidence FROM range(1, 11) t(i) LEFT JOIN b ON b.bin = i) "


@query("C1_brier", SAMPLES + "SELECT round(sum(((p - y) * (p - y))::DECIMAL(18,9))::DOUBLE / count(*), 9) AS brier FROM s")
def c1(spark, sf_dir):
    return sc.brier(samples(spark, sf_dir))


@query("C2_reliability", BINS + "SELECT * FROM r")
def c2(spark, sf_dir):
    return sc.reliability(samples(spark, sf_dir))


@query("C2b_ece", BINS + "SELECT round(sum((abs(accuracy - confidence) * n)::DECIMAL(18,9))::DOUBLE / (SELECT count(*) FROM s), 6) AS ece FROM r")
def c2b(spark, sf_dir):
    return sc.ece(samples(spark, sf_dir))


def _fit(spark, sf_dir):
    return samples(spark, sf_dir).select(sc.logit(F.least(F.greatest(col("p"), F.lit(0.01)), F.lit(0.99))).alias("logit"), "y")


@query("C3_platt")
def c3(spark, sf_dir):
    a, b = sc.platt(_fit(spark, sf_dir))
    return spark.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("b"))


@query("C4_temperature")
def c4(spark, sf_dir):
    return spark.range(1).select(F.lit(sc.temperature(_fit(spark, sf_dir))).alias("t"))


@query("C6_calibrate", "SELECT doc_id, round(1 / (1 + exp(-(1.5::DOUBLE * ln(c / (1 - c)) - 0.25::DOUBLE))), 9) AS p FROM (SELECT doc_id, least(greatest((doc_id * 37 % 100)::DOUBLE / 100, 1e-10), 1 - 1e-10) AS c FROM labels)")
def c6(spark, sf_dir):
    p = col("doc_id") * 37 % 100 / 100.0
    return table(spark, sf_dir, "labels").select("doc_id", F.round(sc.calibrate(p, F.lit(1.5), F.lit(-0.25)), 9).alias("p"))


@query("C8_engine_weight", "WITH e AS (SELECT event_type, count(*) FILTER (event_id % 3 > 0)::DOUBLE / count(*) AS s1, count(*) FILTER (event_id % 5 > 0)::DOUBLE / count(*) AS s24, count(*) FILTER (event_id % 11 = 0)::DOUBLE / count(*) AS cap, (count(*) % 40)::DOUBLE AS h FROM events GROUP BY 1), t AS (SELECT *, greatest(0.1::DOUBLE, 1 - h / 48) AS trust, 0.9::DOUBLE * (0.6::DOUBLE * s1 + 0.4::DOUBLE * s24) * (1 - cap * 0.5::DOUBLE) * (1 / (1 + 250::DOUBLE / 1000)) AS raw FROM e) SELECT event_type, round(greatest(0.1::DOUBLE, least(1, trust * raw + (1 - trust) * 0.9::DOUBLE)), 9) AS weight FROM t")
def c8(spark, sf_dir):
    n, i = F.count("*"), col("event_id")
    e = table(spark, sf_dir, "events").groupBy("event_type").agg((F.count_if(i % 3 > 0) / n).alias("s1"), (F.count_if(i % 5 > 0) / n).alias("s24"), (F.count_if(i % 11 == 0) / n).alias("cap"), (n % 40).cast("double").alias("h"))
    return e.select("event_type", F.round(sc.engine_weight(F.lit(0.9), col("s1"), col("s24"), col("cap"), F.lit(250.0), col("h")), 9).alias("weight"))


BEFORE = ["pending", "running", "partial", "skipped"]
SCORE = "least(1, least(1, s::DOUBLE / 3) * 0.7::DOUBLE + CASE WHEN p > 0 THEN 0.3::DOUBLE ELSE 0 END)"


@query("C9_satisfaction", f"WITH d AS (SELECT user_id, count(DISTINCT event_type) - 1 - user_id % 4 AS n, count(*) FILTER (event_type = 'purchase') AS p, count(*) AS pages FROM events GROUP BY 1), e AS (SELECT *, greatest(0, n) AS s, {BEFORE}[user_id % 4 + 1] AS before FROM d) SELECT user_id, round({SCORE}, 9) AS score, CASE WHEN before = 'skipped' THEN before WHEN {SCORE} >= 0.8::DOUBLE THEN 'satisfied' WHEN s > 0 THEN 'partial' WHEN p / (pages + 1.0::DOUBLE) < 0.1::DOUBLE AND pages > 10 THEN 'exhausted' ELSE before END AS status FROM e")
def c9(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id").agg((F.countDistinct("event_type") - 1).alias("k"), F.count_if(col("event_type") == "purchase").alias("p"), F.count("*").alias("pages"))
    d = d.withColumn("s", F.greatest(F.lit(0), col("k") - col("user_id") % 4)).withColumn("before", F.element_at(F.array(*[F.lit(x) for x in BEFORE]), (col("user_id") % 4 + 1).cast("int")))
    score = sc.satisfaction(col("s"), col("p") > 0)
    return d.select("user_id", F.round(score, 9).alias("score"), sc.search_status(score, col("p") / (col("pages") + 1.0), col("pages"), col("s"), col("before")).alias("status"))


@query("C12_ucb", "WITH a AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS pulls, (count(*) FILTER (event_type = 'purchase'))::DOUBLE AS reward, CASE user_id % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS boost FROM events GROUP BY 1) SELECT user_id, pulls, round(CASE WHEN pulls = 0 THEN 1e308 ELSE (reward / pulls + sqrt(2::DOUBLE) * sqrt(ln((SELECT sum(pulls) FROM a)) / pulls)) * boost END, 6) AS score FROM a")
def c12(spark, sf_dir):
    boost = F.when(col("user_id") % 3 == 0, 1.5).when(col("user_id") % 3 == 1, 1.0).otherwise(0.7)
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(col("event_type") != "error").alias("pulls"), F.count_if(col("event_type") == "purchase").cast("double").alias("reward")).withColumn("boost", boost)
    return sc.ucb(a).select("user_id", "pulls", F.round("score", 6).alias("score"))


@query("C12b_allocation")
def c12b(spark, sf_dir):
    return sc.allocate(c12(spark, sf_dir), 1000)


on_graph("C13_verification", lambda g: vw.claim_evidence_summary(g).join(vw.located(g, g.nli.where("relation = 'supports'")).groupBy("claim_id").agg(F.countDistinct("page_id").alias("sources")), "claim_id", "left").select("claim_id", sc.verification_outcome(col("refute_count"), F.coalesce("sources", F.lit(0))).alias("outcome")), LOCATED + "SELECT c.id AS claim_id, CASE WHEN count(*) FILTER (relation = 'refutes') > 0 THEN 'pending' WHEN count(DISTINCT page_id) FILTER (relation = 'supports') >= 2 THEN 'verified' ELSE 'pending' END AS outcome FROM g_claims c LEFT JOIN q_ev ON q_ev.claim_id = c.id GROUP BY 1")


@query("C14_freshness", "SELECT event_id, round(0.8::DOUBLE * (1 - 0.5::DOUBLE * p), 9) AS confidence FROM (SELECT event_id, CASE WHEN d < 7 THEN 0 WHEN d < 30 THEN 0.2::DOUBLE * (d - 7) / 23 WHEN d < 180 THEN 0.2::DOUBLE + 0.3::DOUBLE * (d - 30) / 150 WHEN d < 365 THEN 0.5::DOUBLE + 0.2::DOUBLE * (d - 180) / 185 ELSE least(1, 0.7::DOUBLE + 0.3::DOUBLE * least((d - 365)::DOUBLE / 730, 1)) END AS p FROM (SELECT event_id, event_id % 1500 AS d FROM events))")
def c14(spark, sf_dir):
    p = sc.freshness_penalty(col("event_id") % 1500)
    return table(spark, sf_dir, "events").select("event_id", F.round(sc.with_freshness(F.lit(0.8), p), 9).alias("confidence"))


@query("C15_sitemap_score", "SELECT event_id, round(least(1, (event_id % 10)::DOUBLE / 10 + CASE WHEN event_id % 50 < 7 THEN 0.2::DOUBLE WHEN event_id % 50 < 30 THEN 0.1::DOUBLE ELSE 0 END + CASE event_type WHEN 'click' THEN 0.2::DOUBLE WHEN 'view' THEN 0.1::DOUBLE ELSE 0 END), 9) AS score FROM events")
def c15(spark, sf_dir):
    i = col("event_id")
    freq = F.when(col("event_type") == "click", "Daily").when(col("event_type") == "view", "weekly")
    return table(spark, sf_dir, "events").select("event_id", F.round(sc.sitemap_score((i % 10) / 10, i % 50, freq), 9).alias("score"))


@query("C17_backoff", "SELECT event_id, least(60, pow(2, event_id % 9))::DOUBLE AS delay, least(120, 30 * pow(2, (event_id % 13) // 3))::INT AS cooldown, (SELECT coalesce(sum(least(60, pow(2, k))), 0) FROM range(0, event_id % 9) t(k))::DOUBLE AS total FROM events")
def c17(spark, sf_dir):
    i = col("event_id")
    return table(spark, sf_dir, "events").select("event_id", sc.backoff(i % 9).alias("delay"), sc.cooldown_minutes(i % 13).alias("cooldown"), sc.total_backoff(i % 9).alias("total"))


@query("C22_daily_budget", "SELECT user_id, ts::DATE AS day, count(*) AS used, count(*) < 5 AS allowed FROM events GROUP BY 1, 2")
def c22(spark, sf_dir):
    return st.daily_budget(table(spark, sf_dir, "events"), "user_id", "ts", 5)


@query("C23_llm_budget", "SELECT event_id, (event_id % 100 + 5 < 30) OR (event_id % 20 + 5)::DOUBLE / (event_id % 100 + 5) <= 0.3::DOUBLE AS allowed FROM events")
def c23(spark, sf_dir):
    i = col("event_id")
    return table(spark, sf_dir, "events").select("event_id", sc.llm_budget(i % 20, i % 100, F.lit(5)).alias("allowed"))


OK = "CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END::DOUBLE"


@query("T1_ema", f"SELECT event_type, round(list_reduce(list_prepend(1.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda e, x: 0.1::DOUBLE * x + 0.9::DOUBLE * e), 5) AS ema, count(*) AS n FROM events GROUP BY 1")
def t1(spark, sf_dir):
    return st.ema(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], col("value"), 0.1, 1.0).withColumn("ema", F.round("ema", 5))


@query("T2_domain_metrics", f"SELECT user_id, round(list_reduce(list_prepend(1.0::DOUBLE, list({OK} ORDER BY ts, event_id)), lambda e, x: 0.1::DOUBLE * x + 0.9::DOUBLE * e), 6) AS success_1h, round(list_reduce(list_prepend(1.0::DOUBLE, list({OK} ORDER BY ts, event_id)), lambda e, x: 0.01::DOUBLE * x + 0.99::DOUBLE * e), 6) AS success_24h, count(*) AS requests FROM events GROUP BY 1")
def t2(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ok = F.when(col("event_type") != "error", 1.0).otherwise(0.0)
    a = st.ema(e, "user_id", ["ts", "event_id"], ok, 0.1, 1.0).select("user_id", F.round("ema", 6).alias("success_1h"), col("n").alias("requests"))
    return a.join(st.ema(e, "user_id", ["ts", "event_id"], ok, 0.01, 1.0).select("user_id", F.round("ema", 6).alias("success_24h")), "user_id")


LAST = "WITH l AS (SELECT user_id, max((ts, event_id)) FILTER (event_type <> 'error') AS ok FROM events GROUP BY 1), f AS (SELECT e.user_id, count(*) FILTER (event_type = 'error' AND (l.ok IS NULL OR (ts, event_id) > l.ok)) AS failures FROM events e JOIN l USING (user_id) GROUP BY 1) "


@query("T5_consecutive_failures", LAST + "SELECT * FROM f")
def t5(spark, sf_dir):
    return st.consecutive_failures(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], col("event_type") == "error")


@query("T3_breaker", LAST + "SELECT user_id, CASE WHEN failures >= 2 THEN 'open' ELSE 'closed' END AS state, failures FROM f")
def t3(spark, sf_dir):
    return st.breaker(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], col("event_type") == "error")


@query("T5b_streaks", "SELECT event_id, sum(f) OVER (PARTITION BY user_id, g ORDER BY ts, event_id)::BIGINT AS streak FROM (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)")
def t5b(spark, sf_dir):
    return st.streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], col("event_type") == "error").select("event_id", "streak")


@query("T6_novelty", "SELECT event_id, (sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w)::DOUBLE / count(*) OVER w AS novelty FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def t6(spark, sf_dir):
    return st.novelty(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], col("event_type") == "view").select("event_id", "novelty")


@query("T7_stop", "SELECT event_id, value < 20 AND coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id) < 20, false) AS stop FROM events")
def t7(spark, sf_dir):
    return st.should_stop(table(spark, sf_dir, "events").withColumn("novelty", col("value")), "user_id", "event_id", 20.0).select("event_id", "stop")


@query("T8_harvest", "SELECT user_id, count(*) FILTER (event_type = 'purchase')::DOUBLE / count(*) AS harvest FROM events GROUP BY 1")
def t8(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(col("event_type") == "purchase") / F.count("*")).alias("harvest"))


@query("T9_pagination", "SELECT event_id, CASE WHEN event_id % 12 >= 10 THEN 'max_pages' WHEN (event_id % 7)::DOUBLE / 10 < 0.1::DOUBLE THEN 'novelty' WHEN (event_id % 5)::DOUBLE / 50 < 0.05::DOUBLE THEN 'harvest' END AS stop FROM events")
def t9(spark, sf_dir):
    i = col("event_id")
    return table(spark, sf_dir, "events").select("event_id", st.pagination_stop(i % 12, (i % 7) / 10, (i % 5) / 50).alias("stop"))


@query("T10_timeline", "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS confirmations, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS retracted FROM events GROUP BY 1")
def t10(spark, sf_dir):
    return st.timeline(table(spark, sf_dir, "events"), "user_id", "ts", "event_type")


@query("T11_daily_usage", "SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2")
def t11(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("T15_tumbling", "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t15(spark, sf_dir):
    return st.tumbling(table(spark, sf_dir, "events"), "ts", "6 hours", "event_type")


@query("T15b_sessions", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS \"end\", count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES > ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def t15b(spark, sf_dir):
    return st.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


REPORT = "'Claim ' || conv_id || ' at https://x.example/' || (conv_id % 50) || ' is ' || (turn * 7 % 13) || '.5% [[p' || (turn % 3) || ']] and [[p' || (conv_id % 2) || ']]. '"


def reports(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.expr(f"concat({REPORT}, text)").alias("text"))


def index(spark, sf_dir):
    # fifty addresses, ten of which no report uses
    return spark.range(0, 50).select(F.concat(F.lit("https://x.example/"), F.when(col("id") < 40, col("id")).otherwise(col("id") + 50).cast("string")).alias("url"))


REPORTS = f"WITH r AS (SELECT conv_id || '-' || turn AS id, {REPORT} || text AS text FROM conversations), i AS (SELECT 'https://x.example/' || CASE WHEN k < 40 THEN k ELSE k + 50 END AS url FROM range(0, 50) t(k)), u AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, 'https?://[^\\s<>)\\]\"'']+')) AS url FROM r) "


@query("W1_report_urls", REPORTS + "SELECT * FROM u")
def w1(spark, sf_dir):
    return va.urls_in(reports(spark, sf_dir))


@query("W2_unknown_urls", REPORTS + "SELECT * FROM u WHERE url NOT IN (SELECT url FROM i)")
def w2(spark, sf_dir):
    return va.unknown_urls(reports(spark, sf_dir), index(spark, sf_dir))


@query("W3_unsupported_numbers", REPORTS + ", e AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\d+(?:\\.\\d+)?%?')) AS number FROM documents) SELECT DISTINCT id, number FROM (SELECT id, unnest(regexp_extract_all(text, '\\d+(?:\\.\\d+)?%?')) AS number FROM r) WHERE length(number) > 2 AND number NOT IN (SELECT number FROM e)")
def w3(spark, sf_dir):
    return va.unsupported_numbers(reports(spark, sf_dir), table(spark, sf_dir, "documents"))


@query("W5_closest_url", REPORTS + "SELECT DISTINCT u.url, s.k AS suggestion FROM u LEFT JOIN (SELECT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS h, min(url) AS k FROM i GROUP BY 1) s ON s.h = lower(regexp_extract(u.url, '://([^/?#]+)', 1)) WHERE u.url NOT IN (SELECT url FROM i)")
def w5(spark, sf_dir):
    return va.closest_url(w2(spark, sf_dir), index(spark, sf_dir))


@query("W7_citation_numbers", REPORTS + ", t AS (SELECT id, regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1) AS t FROM r), p AS (SELECT id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM t) SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY min(pos))::INT AS number FROM p GROUP BY id, token")
def w7(spark, sf_dir):
    return va.citation_numbers(reports(spark, sf_dir))


@query("W9_unused_sources", REPORTS + "SELECT url FROM i WHERE url NOT IN (SELECT url FROM u)")
def w9(spark, sf_dir):
    return va.unused_sources(index(spark, sf_dir), reports(spark, sf_dir))


@query("W4_unknown_claims")
def w4(spark, sf_dir):
    return va.unknown_claims(reports(spark, sf_dir), table(spark, sf_dir, "benchmark"))


on_graph("W10_claim_pages", lambda g: vw.located(g, g.nli).groupBy("claim_id").agg(F.sort_array(F.collect_set("page_id")).alias("pages")), LOCATED + "SELECT claim_id, list_sort(list(DISTINCT page_id)) AS pages FROM q_ev GROUP BY 1")


@query("X2_recommended_engines", JOBS_SQL + "SELECT kind, count(*) FILTER (state = 'completed')::DOUBLE / count(*) AS rate FROM jobs GROUP BY 1 ORDER BY rate * count(*) DESC, kind LIMIT 5")
def x2(spark, sf_dir):
    d = jobs(spark, sf_dir).groupBy("kind").agg((F.count_if(col("state") == "completed") / F.count("*")).alias("rate"), F.count("*").alias("n"))
    return d.orderBy(F.desc(col("rate") * col("n")), "kind").limit(5).select("kind", "rate")


@query("X3_high_success_domains", "SELECT user_id, count(*) FILTER (event_type <> 'error')::DOUBLE / count(*) AS rate FROM events GROUP BY 1 HAVING count(*) > 5 AND rate > 0.8::DOUBLE ORDER BY rate DESC, user_id LIMIT 10")
def x3(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(col("event_type") != "error") / F.count("*")).alias("rate"), F.count("*").alias("n"))
    return d.where("n > 5 and rate > 0.8D").orderBy(F.desc("rate"), "user_id").limit(10).select("user_id", "rate")


@query("X6_milestones", JOBS_SQL + "SELECT kind, count(*) FILTER (state IN ('queued', 'running')) = 0 AS drained FROM jobs WHERE kind IN ('click', 'error') GROUP BY 1")
def x6(spark, sf_dir):
    return milestones(jobs_pivot(jobs(spark, sf_dir), STATES), ["click", "error"])


@query("X7_progress", JOBS_SQL + "SELECT kind, state, count(*) AS n FROM jobs GROUP BY 1, 2")
def x7(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("kind", "state").agg(F.count("*").alias("n"))


@query("X48_task_colour", "SELECT user_id, ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 8 AS colour FROM (SELECT DISTINCT user_id FROM events)")
def x48(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id").distinct()
    return d.select("user_id", (F.conv(F.substring(F.md5(col("user_id").cast("string")), 1, 8), 16, 10).cast("long") % 8).alias("colour"))
