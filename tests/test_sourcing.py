"""Search rows, papers, citations, policies and query operators on small fixtures: branches, nulls, repeats, empty tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from oracle import compare
from quern import plans
from quern.functions import queries as qu
from quern.operators import policy as po
from quern.operators import sourcing as so

NOW = datetime(2024, 1, 1, 12)


def rows(d, *cols):
    return sorted((tuple(r) for r in (d.select(*cols) if cols else d).collect()), key=repr)


def test_route_prefers_openalex_then_s2_then_doi(spark):
    sha = "a" * 40
    urls = ["https://doi.org/10.1234/AB", "https://openalex.org/W1", f"https://www.semanticscholar.org/paper/x/{sha}", "https://pmc.ncbi.nlm.nih.gov/articles/PMC7", "https://pmc.ncbi.nlm.nih.gov/articles/PMC8", None, ""]
    d = so.route_rows(spark.createDataFrame(list(enumerate(urls)), "id int, url string"), spark.createDataFrame([("pmcid", "PMC8", "10.9/z"), ("pmcid", "PMC8", "10.9/a"), ("pmid", "7", "10.9/q")], "kind string, value string, doi string"))
    assert rows(d, "id", "route", "api", "api_id") == [
        (0, "complement", "semantic_scholar", "DOI:10.1234/AB"), (1, "complement", "openalex", "openalex:W1"), (2, "complement", "semantic_scholar", f"s2:{sha}"),
        (3, "fetch", None, None), (4, "complement", "semantic_scholar", "DOI:10.9/a"), (5, "fetch", None, None), (6, "fetch", None, None),
    ]


def test_complement_asks_the_other_service_only_without_abstract(spark):
    routes = spark.createDataFrame([(1, "10.1/a", "semantic_scholar", "DOI:10.1/a"), (2, "10.1/b", "semantic_scholar", "DOI:10.1/b"), (3, None, "openalex", "openalex:W3"), (4, None, "semantic_scholar", "PMID:4"), (5, "10.1/e", "semantic_scholar", "DOI:10.1/e")], "id int, doi string, api string, api_id string").withColumn("route", F.lit("complement"))
    papers = spark.createDataFrame(
        [("semantic_scholar", "DOI:10.1/a", "p1", "10.1/a", "text"), ("openalex", "https://doi.org/10.1/a", "q1", None, "not asked"), ("semantic_scholar", "DOI:10.1/b", "p2", None, ""), ("openalex", "https://doi.org/10.1/b", "q2", None, None),
         ("openalex", "openalex:W3", "p3", "10.1/c", None), ("semantic_scholar", "DOI:10.1/c", "q3", None, "found"), ("openalex", "https://doi.org/10.1/e", "q5", None, "only here")],
        "api string, api_id string, paper_id string, doi string, abstract string",
    )
    assert rows(so.complement(routes, papers)) == [(1, "semantic_scholar", "p1", "text"), (2, "openalex", "q2", None), (3, "semantic_scholar", "q3", "found"), (5, "openalex", "q5", "only here")]


@pytest.mark.parametrize("name", ["X13_routed_rows", "X13b_complemented"])
def test_rows_that_share_an_address_equal_their_sql(spark, tmp_path, name):
    # arXiv addresses repeat every 700,000 events
    ids = [k + 700_000 * n for k in (1, 2, 3, 7, 10, 24, 45, 66) for n in range(4)]
    spark.createDataFrame([(k,) for k in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert compare(spark, str(tmp_path), plans.QUERIES[name], plans.ORACLE[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")) is None


@pytest.mark.parametrize(("direction", "depth", "want"), [("references", 1, {(1, 2)}), ("citations", 1, {(9, 1)}), ("both", 1, {(1, 2), (9, 1)}), ("references", 3, {(1, 2), (2, 3), (3, 1)}), ("both", 2, {(1, 2), (9, 1), (2, 3), (9, 8), (3, 1)}), ("both", 0, set())])
def test_citation_graph(spark, direction, depth, want):
    edges = [(1, 2), (2, 3), (3, 1), (9, 1), (9, 8), (7, 6)]
    if direction == "both" and depth == 1 or direction == "citations":
        want = want | {(3, 1)}
    refs = spark.createDataFrame([(a, b, api) for a, b in edges for api in ("openalex", "semantic_scholar")], "citing int, cited int, api string")
    got = so.citation_graph(spark.createDataFrame([(1,), (1,)], "paper_id int"), refs, depth, direction).collect()
    assert sorted((r.citing, r.cited) for r in got) == sorted(want) and {r.api for r in got} <= {"semantic_scholar"}


def test_citation_graph_refuses_other_directions(spark):
    with pytest.raises(ValueError, match="direction"):
        so.citation_graph(spark.createDataFrame([], "paper_id int"), spark.createDataFrame([], "citing int, cited int, api string"), 1, "up")


def test_abstracts_of_one_address_and_of_equal_beginnings(spark):
    papers = spark.createDataFrame([("a", "https://x/1", None, "A", "same"), ("b", "https://x/1", None, "B", "other"), ("c", None, "10.1/c", "C", "same"), ("d", None, None, "D", None), ("e", "", "", "E", "own"), ("f", "https://known", None, "F", "text")], "paper_id string, oa_url string, doi string, title string, abstract string")
    got = so.abstract_rows(papers, spark.createDataFrame([(5, "https://known"), (6, "https://known")], "page_id int, url string"))
    assert rows(got["pages"], "url", "paper_id") == [("https://doi.org/10.1/c", "c"), ("https://paper/e", "e"), ("https://x/1", "a")]
    assert rows(got["fragments"], "url", "is_novel") == [("https://doi.org/10.1/c", True), ("https://paper/e", True), ("https://x/1", False)]
    assert rows(got["mapped"], "paper_id", "page_id") == [("a", None), ("b", None), ("c", None), ("e", None), ("f", 5)]


def test_first_provider(spark):
    a = spark.createDataFrame([("q", "a", 1, "unhealthy", True, None), ("q", "b", 2, "ok", False, "down"), ("q", "c", 3, "ok", True, None), ("r", "a", 1, "unhealthy", True, None), ("s", "a", 1, "ok", False, "x"), ("s", "b", 2, "ok", False, None)], "query string, provider string, position int, state string, ok boolean, error string")
    assert rows(so.first_ok(a)) == [("q", "c", None), ("r", "none", "All providers failed: No providers available"), ("s", "none", "All providers failed: a: x; b: None")]


def test_refutation_status_at_the_budget(spark):
    j = [("q", k, f"u{k}", "p" * 300, "refutes" if k == 20 else "neutral", 0.9, True) for k in range(1, 21)] + [("r", 1, "u", "p", "refutes", 0.6, True), ("s", 1, "u", "text", "refutes", 0.61, True), ("t", 1, "u", None, "refutes", 0.9, True)]
    got = so.refutation_outcome(spark.createDataFrame(j, "query string, position int, url string, passage string, stance string, confidence double, ok boolean"))
    assert rows(got["status"], "query", "pages", "status", "satisfaction") == [("q", 15, "exhausted", 0.0), ("r", 1, "partial", 0.0), ("s", 1, "satisfied", round(1 / 3, 9)), ("t", 1, "partial", 0.0)]
    assert rows(got["refutations"], "query", "text") == [("s", "text")]


def test_policy_rests_and_stays_in_bounds(spark):
    m = spark.createDataFrame([("engine", "e", 0.4, None, None, None), ("domain", "d", None, 0.4, 0.0, 0.25), ("domain", "calm", None, 0.0, 0.0, 0.0), ("engine", "new", 0.1, None, None, None)], "target_type string, target_id string, success_rate double, captcha_rate double, error_403_rate double, error_429_rate double")
    old, just = datetime(2024, 1, 1, 11, 55), datetime(2024, 1, 1, 11, 55, 1)
    state = [("engine", "e", "engine_weight", 0.2, old), ("engine", "e", "engine_qps", 0.1, old), ("domain", "d", "headful_ratio", 0.48, old), ("domain", "d", "tor_usage_ratio", 0.0, just), ("domain", "d", "domain_cooldown", 60.0, old), ("domain", "calm", "headful_ratio", 0.3, old), ("domain", "calm", "domain_cooldown", 90.0, old)]
    st = spark.createDataFrame(state, "target_type string, target_id string, parameter string, value double, changed_at timestamp")
    u = po.policy_updates(m, st, F.lit(NOW))
    assert rows(u) == [
        ("domain", "calm", "headful_ratio", 0.3, 0.25, "Low error rate: 0.00"),
        ("domain", "d", "domain_cooldown", 60.0, 90.0, "High CAPTCHA rate: 0.40"),
        ("domain", "d", "headful_ratio", 0.48, 0.5, "High error rate: 0.65"),
        ("engine", "e", "engine_weight", 0.2, 0.1, "Low success rate: 0.40"),
    ]
    after = po.apply_updates(st, u, F.lit(NOW))
    assert after.where("value = 0.5 or value = 90.0").where(F.col("changed_at") == F.lit(NOW)).count() == 2 and after.count() == len(state)
    assert po.policy_updates(m, after, F.lit(NOW)).where("target_id <> 'd'").count() == 0
    assert po.first_state(m, F.lit(NOW)).groupBy("target_id").count().where("count in (2, 3)").count() == 4


def test_save_keeps_derived_edges_out(spark):
    stored = spark.createDataFrame([("1", "cites"), ("2", "supports")], "id string, relation string")
    graph = spark.createDataFrame([("2", "refutes"), ("3", "evidence_source"), ("4", None)], "id string, relation string")
    assert rows(so.edges_to_save(graph, stored)) == [("1", "cites"), ("2", "refutes"), ("4", None)]


def test_ingest_plan(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "c"), (1, "n"), (2, "a")], "task_id int, url string")
    p = spark.createDataFrame([(10, "a", "h"), (11, "b", ""), (12, "c", "h")], "page_id int, url string, html_path string")
    assert rows(so.ingest_plan(t, p, spark.createDataFrame([(1, 10), (1, 10), (2, 12)], "task_id int, page_id int")), "task_id", "url", "action") == [(1, "a", "skip"), (1, "b", "fetch"), (1, "c", "reprocess"), (1, "n", "ingest"), (2, "a", "reprocess")]


CASES = [
    ("x site:a.org", "default", "x site:a.org"),
    ('intitle:"a b" c', "bing", "c intitle:a b"),
    ("after:2024 x", "duckduckgo", "x"),
    ("after:2024-01-05 x", "google", "x after:2024-01-05"),
    ("temp -5 well-known -ads", "default", "temp -5 well-known -ads"),
    ("日本 -広告 +必須", "default", "日本 -広告 +必須"),
    ("", "default", ""),
    (None, "default", ""),
]


@pytest.mark.parametrize(("q", "engine", "want"), CASES)
def test_query_operators(spark, q, engine, want):
    d = spark.createDataFrame([(q,)], "q string").select(qu.write_query(qu.parse_operators(F.col("q")), engine).alias("w"))
    assert d.first().w == want


def test_build_query(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    w = qu.build_query(F.lit("AI規制"), {"site": a("go.jp"), "filetype": a("pdf"), "intitle": a(""), "exclude": a("draft", "old")})
    assert spark.range(1).select(w.alias("w")).first().w == "AI規制 site:go.jp filetype:pdf -draft -old"
    assert "date_after" in qu.supported_operators("Google") and "date_after" not in qu.supported_operators("bing")


def test_templates_and_notes(spark):
    d = spark.createDataFrame([("最新の研究",), (None,), ("IR",)], "h string")
    t = qu.templates_for(F.col("h"))
    got = d.select(t.alias("t"), qu.template_hints(t).alias("o"), qu.notes_for(F.array(F.lit("location")), t).alias("n")).collect()
    assert [r.t for r in got] == [["academic", "news"], ["academic", "government"], ["academic", "government"]]
    assert got[0].o[-1] == "報道" and got[1].o.count("filetype:pdf") == 1 and got[0].n.startswith("地名")


def test_empty_tables(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert so.route_rows(e("id int, url string"), e("kind string, value string, doi string")).count() == 0
    assert so.first_ok(e("query string, provider string, position int, state string, ok boolean, error string")).count() == 0
    assert so.citation_graph(e("paper_id int"), e("citing int, cited int, api string"), 2).count() == 0
    c = po.task_counters(e("task_id int, kind string, domain string, flags array<string>, n long, useful long"))
    assert po.task_figures(c).count() == 0
