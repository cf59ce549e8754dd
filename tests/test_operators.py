"""Golden cases by hand, and operators that no SQL checks against plain computations."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import urls
from quern.operators import dedup, graph, ranking, reports, scoring, validate, views
from quern.sources import tables
from quern.sources.graph import Graph

EDGE = "id string, source_type string, source_id string, target_type string, target_id string, relation string, nli_edge_confidence double, created_at timestamp"


def make(spark, edges=(), claims=(), pages=(), fragments=(), task_pages=(), works=(), authors=()):
    f = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return Graph(
        f([("t", "h", "open")], "id string, hypothesis string, status string"), f(claims, "id string, task_id string, claim_text string, llm_claim_confidence double"), f(pages, "id string, url string, domain string, title string, canonical_id string, html_path string"),
        f(works, "canonical_id string, year int, venue string, doi string, source_api string"), f(authors, "canonical_id string, position int, name string"), f(fragments, "id string, page_id string, heading_context string, text_content string, created_at timestamp"),
        f([(*e, None) for e in edges], EDGE), f(task_pages, "task_id string, page_id string, depth int, reason string"),
    )


def nli(i, frag, claim, rel, conf):
    return (i, "fragment", frag, "claim", claim, rel, conf)


def cite(a, b):
    return (f"{a}>{b}", "page", a, "page", b, "cites", None)


def page(i, domain="d", work=None, path=None):
    return (i, f"https://{domain}/{i}", domain, i, work, path)


def test_confidence_golden(spark):
    g = make(spark, [nli("1", "f1", "c", "supports", 0.9), nli("2", "f2", "c", "supports", 0.9), nli("3", "f3", "c", "refutes", 0.8)], [("c", "t", "x", 0.5), ("none", "t", "y", 0.5)], [page("p1"), page("p2"), page("p3")], [(f"f{i}", f"p{i}", "", "", None) for i in (1, 2, 3)])
    got = {r.claim_id: r for r in graph.claim_confidence(g).collect()}
    assert got["c"].confidence == 0.609 and (got["c"].supporting, got["c"].refuting, got["c"].independent_sources) == (2, 1, 3)
    assert got["none"].confidence == 0.5
    s = {r.claim_id: r for r in views.claim_evidence_summary(g).collect()}
    assert s["c"].nli_claim_support_ratio == round(2.8 / 4.6, 4) and s["none"].evidence_count == 0 and s["none"].nli_claim_support_ratio == 0.5


def test_reference_candidates_golden(spark):
    pages = [page("citing"), page("c1"), page("c2", path="/x"), page("c3", path="/x"), page("c4"), ("js", "JavaScript:void(0)", "d", "t", None, None)]
    edges = [cite("citing", c) for c in ("c1", "c2", "c3", "c4", "js")] + [("o", "fragment", "f3", "claim", "cl3", "origin", None)]
    g = make(spark, edges, [("cl3", "t1", "x", 0.5)], pages, [("f3", "c3", "", "", None)], [("t1", "citing", 0, "serp"), ("t1", "c4", 1, "citation")])
    assert {r.candidate_page_id for r in views.reference_candidates(g, "t1").collect()} == {"c1", "c2"}
    with pytest.raises(ValueError):
        views.reference_candidates(g, None)


def test_source_impact_golden(spark):
    edges = [("o1", "fragment", "f1", "claim", "a", "origin", None), ("o2", "fragment", "f2", "claim", "b", "origin", None), nli("s", "f2", "a", "supports", 0.9)]
    g = make(spark, edges, [("a", "t", "x", 0.85), ("b", "t", "y", 0.9)], [page("p1"), page("p2")], [("f1", "p1", "", "", None), ("f2", "p2", "", "", None)])
    got = {r.page_id: r.impact_score for r in views.source_impact(g).collect()}
    assert abs(got["p1"] - 1.425) <= 0.006 and got["p2"] == 1.75


def test_penalties_and_integrity(spark):
    pages = [page(x, d) for x, d in (("a", "x"), ("b", "y"), ("c", "z"), ("d", "w"), ("e", "w"), ("f", "q"))]
    g = make(spark, [cite("a", "b"), cite("b", "a"), cite("c", "c"), cite("d", "e")], pages=pages)
    got = {r.page_id: r.penalty for r in graph.citation_penalties(g).collect()}
    assert got == {"a": 0.06, "b": 0.06, "c": pytest.approx(0.2 * 0.3 * 0.3 * 0.1), "d": 0.5, "e": 0.6, "f": 1.0}
    r = graph.integrity(g).first()
    assert (r.pages, r.problematic, r.penalised, r.integrity) == (6, 4, 5, round(1 - 4 / 6, 3))


def test_loops_against_search(spark):
    r = random.Random(5)
    e = {(r.randrange(9), r.randrange(9)) for _ in range(24)}
    found = set()

    def walk(path):
        for a, b in e:
            if a == path[-1]:
                if b == path[0]:
                    found.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < 5:
                    walk([*path, b])

    for s in range(9):
        walk([s])
    g = make(spark, [cite(str(a), str(b)) for a, b in e])
    assert {tuple(map(int, x.path)) for x in graph.citation_loops(g.cites, 5).collect()} == found


def test_pagerank_and_betweenness(spark):
    r = random.Random(7)
    n, e = 12, {(r.randrange(12), r.randrange(12)) for _ in range(30)}
    rank = [1 / n] * n
    out = {a: [y for x, y in e if x == a] for a in range(n)}
    for _ in range(100):
        new = [0.15 / n + 0.85 * (sum(rank[a] / len(out[a]) for a in range(n) if b in out[a]) + sum(rank[a] for a in range(n) if not out[a]) / n) for b in range(n)]
        done = sum(abs(x - y) for x, y in zip(rank, new, strict=True)) < n * 1e-6
        rank = new
        if done:
            break
    edges = spark.createDataFrame(sorted(e), "src long, dst long")
    got = {x.id: x["rank"] for x in graph.pagerank(spark.range(n), edges).collect()}
    assert all(abs(got[k] - rank[k]) < 1e-9 for k in range(n)) and abs(sum(got.values()) - 1) < 1e-6
    # betweenness: all shortest paths, counted one by one
    want = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        paths, level, far = {s: [[s]]}, [s], {s}
        while level:
            nxt = {}
            for x in level:
                for y in set(out[x]) - far:
                    nxt.setdefault(y, []).extend([*p, y] for p in paths[x])
            paths |= nxt
            far |= set(nxt)
            level = list(nxt)
        for t, ps in paths.items():
            for p in ps:
                for v in p[1:-1]:
                    want[v] += 1 / len(ps) if t != s else 0
    nodes = {x for p in e for x in p}
    got = {x.id: x.betweenness for x in graph.betweenness(edges).collect()}
    assert got == pytest.approx({v: want[v] / ((len(nodes) - 1) * (len(nodes) - 2)) for v in nodes}, abs=1e-9)


def test_similar_pairs_and_clusters(spark):
    texts = [(1, "one two three four five six"), (2, "one two three four five six"), (3, "one two three four five seven"), (4, "nothing like the others at all"), (5, ""), (6, "ab")]
    docs = spark.createDataFrame(texts, "id long, text string")
    p = {(r.a, r.b): r.similarity for r in dedup.similar_pairs(docs, 0.5).collect()}
    assert p[1, 2] == 1.0 and p[1, 3] == pytest.approx(0.6) and len(p) == 2
    lab = dedup.clusters(spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 60), (60, 55)], "a long, b long"))
    assert {r.id: r.cluster for r in lab.collect()} == {**dict.fromkeys(range(31), 0), 50: 50, 60: 50, 55: 50}
    labels = dedup.clusters(dedup.similar_pairs(docs, 0.5))
    assert sorted(r.id for r in dedup.deduplicate(docs, labels, "longest").collect()) == [3, 4, 5, 6]
    assert sorted(r.id for r in dedup.deduplicate(docs, labels).collect()) == [1, 4, 5, 6]
    assert dedup.duplicate_ratio(docs, labels).first().ratio == pytest.approx(2 / 6)
    assert {(r.a, r.b, r.distance) for r in dedup.simhash_pairs(docs).collect()} >= {(1, 2, 0)}
    assert dedup.similarity_ratio(spark.createDataFrame([(1, "abcd", "bcde"), (2, None, "")], "id long, old string, new string")).orderBy("id").collect()[0].ratio == 0.75


def test_knee():
    assert 2 <= ranking.knee([0.95, 0.90, 0.85, 0.50, 0.30, 0.20]) <= 6
    assert ranking.knee([0.5] * 10) == 3 and ranking.knee([0.9, 0.1]) == 2 and ranking.knee([]) == 0
    assert ranking.knee([1 / (k + 1) for k in range(80)]) <= 50


def test_bm25(spark):
    docs = [(1, "the cat sat on the mat"), (2, "the dog"), (3, "cat and dog and cat"), (4, "")]
    got = {r.id: r.score for r in ranking.bm25(spark.createDataFrame(docs, "id long, text string"), "cat mat").collect()}
    toks = {i: t.split() for i, t in docs}
    n, avg = 4, sum(map(len, toks.values())) / 4
    df = {}
    for w in toks.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    want = {i: sum((idf[q] if idf[q] >= 0 else 0.25 * mean) * w.count(q) * 2.5 / (w.count(q) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for q in ("cat", "mat") if q in w) for i, w in toks.items() if {"cat", "mat"} & set(w)}
    assert got == pytest.approx(want)


def test_calibration(spark):
    r = random.Random(3)
    rows = [(x := r.gauss(0, 2), int(r.random() < 1 / (1 + math.exp(-x / 2)))) for _ in range(400)]
    s = spark.createDataFrame(rows, "logit double, y int").coalesce(2).cache()
    a = b = 0.0
    for _ in range(100):
        e = [(1 / (1 + math.exp(-(a * x + b))) - y, x) for x, y in rows]
        a, b = a - 0.01 * sum(d * x for d, x in e) / 400, b - 0.01 * sum(d for d, _ in e) / 400
    assert scoring.platt(s, steps=100) == pytest.approx((a, b), abs=1e-9)
    assert 1.0 < scoring.temperature(s) <= 10
    none = spark.createDataFrame([], "logit double, y int")
    assert scoring.platt(none) == (0.0, 0.0) and scoring.temperature(none) == 1.0
    v = spark.createDataFrame([("s", 1, 0.2), ("s", 2, 0.205), ("s", 3, 0.3)], "source string, version int, brier double")
    assert [x.rolled_back for x in scoring.last_valid(v).orderBy("version").collect()] == [False, False, True]


def test_ingest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, t string")
    new = spark.createDataFrame([("b", 3, "z"), ("c", 4, "p"), ("c", 5, "q")], "k string, v int, t string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(tables.insert(old, new, ["k"], "v")) == [("a", 1, "x"), ("b", 2, "y"), ("c", 4, "p")]
    assert rows(tables.insert(old, new, ["k"], "v", replace=True)) == [("a", 1, "x"), ("b", 3, "z"), ("c", 5, "q")]
    assert rows(tables.update(old, spark.createDataFrame([("a", None)], "k string, v int"), ["k"])) == [("a", None, "x"), ("b", 2, "y")]
    w = "canonical_id string, title string, citation_count int, reference_count int, is_open_access boolean, oa_url string, pdf_url string"
    works = spark.createDataFrame([("d", "first", 5, 1, True, "u", None)], w)
    batch = spark.createDataFrame([("d", "second", 3, 9, None, None, "p", 1), ("d", "third", 4, 2, False, None, None, 2), ("e", "new", 0, 0, None, None, None, 1)], w + ", at int")
    assert rows(tables.upsert_works(works, batch, "at")) == [("d", "first", 5, 9, False, "u", "p"), ("e", "new", 0, 0, None, None, None)]
    req = spark.createDataFrame([("doi", "1", 5, "w2"), ("doi", "1", 5, "w1"), ("url", "z", 1, "w3")], "type string, value string, claimed_at int, worker string")
    assert {(r.worker, r.is_new) for r in tables.claim_resources(req).collect()} == {("w1", True), ("w2", False), ("w3", True)}
    blob = spark.createDataFrame([(1, bytearray(tables.pack_vector([0.5, -2.0]))), (2, None)], "id long, embedding_blob binary")
    assert [r.embedding for r in tables.vectors_from_blobs(blob).orderBy("id").collect()] == [[0.5, -2.0], None] and tables.unpack_vector(tables.pack_vector([1.5])) == [1.5]


def test_sources(spark):
    d = spark.createDataFrame([({"world": [1], "hello": [0, 2]},), ({},)], "i map<string,array<int>>")
    assert [r[0] for r in d.select(tables.abstract_text(F.col("i"))).collect()] == ["hello world hello", None]
    cdx = spark.createDataFrame([("k 20240102030405 http://x text/html - D 1",), ("short",), ("k notatime http://x text/html 200 D 1",)], "value string")
    assert [tuple(r) for r in tables.cdx_snapshots(cdx).collect()] == [("http://x", datetime(2024, 1, 2, 3, 4, 5), "text/html", 200)]
    xml = "<urlset><url><loc> http://a </loc><priority>0.8</priority></url><url><loc>http://b</loc><changefreq>daily</changefreq></url></urlset>"
    got = spark.createDataFrame([(xml,)], "x string").select(tables.sitemap_entries(F.col("x")).alias("e")).first().e
    assert [(e.loc, e.changefreq, e.priority) for e in got] == [("http://a", None, 0.8), ("http://b", "daily", 0.5)]
    lines = ["# c", "User-agent: other", "Disallow: /no", "User-agent: *", "Disallow: /private # x", "Allow: /private/ok", "Sitemap: http://s"]
    r = tables.robots_rules(spark.createDataFrame([("d", k, v) for k, v in enumerate(lines)], "domain string, pos int, value string"), "bot")
    assert sorted((x.directive, x.value) for x in r.collect()) == [("allow", "/private/ok"), ("disallow", "/private"), ("sitemap", "http://s")]
    cases = [("/private/x", "/private", True), ("/a.php?x", "/*.php$", False), ("/a.php", "/*.php$", True), ("/x", "", False), ("/a+b", "/a+", True)]
    p = spark.createDataFrame(cases, "path string, pattern string, want boolean")
    assert [x.got for x in p.select(tables.path_matches(F.col("path"), F.col("pattern")).alias("got")).collect()] == [c[2] for c in cases]


def test_text_and_urls(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(urls.canonical_id(F.lit("https://doi.org/10.1234/AbC?x"))) == "doi:10.1234/abc"
    assert one(urls.normalise(F.lit("HTTP://Ex.COM:80/Path?b=2&a=1#f"))) == "http://ex.com:80/Path?a=1&b=2"
    assert one(urls.source_tag(F.lit("https://arxiv.org/abs/1"))) == "academic" and one(urls.source_tag(F.lit("https://q.example"))) == "unknown"
    assert one(urls.domain(F.lit("http://u:p@Host.ORG:8080/x"))) == "host.org" and one(urls.domain_matches(F.lit("a.b.org"), F.lit("*.b.org")))
    assert one(tx.word_shingles(F.lit("a b"))) == ["a b"] and one(tx.word_shingles(F.lit("  "))) == [] and len(one(tx.word_shingles(F.lit("a b c d")))) == 2
    assert one(tx.polarity(F.lit("It is NOT so"))) == "negative" and one(tx.claim_type(F.lit("30% of cases"))) == "quantitative"
    assert one(tx.paragraphs(F.lit("a\n\n  b \n \nc"))) == ["a", "b", "c"]
    assert one(tx.burstiness(F.array(F.lit(5), F.lit(5)))) == 0.0 and one(tx.uniformity(F.array(*[F.lit(x) for x in (5, 5, 5)]))) == 1.0


def test_validation(spark):
    r = spark.createDataFrame([("r", "See http://a/1 and http://b/2. It rose 12.5% in 2024. [[p]] [[q]] [[p]]. The quick brown fox jumps over the lazy dog today.")], "id string, text string")
    idx = spark.createDataFrame([("http://a/1",), ("http://b/9",)], "url string")
    unknown = validate.unknown_urls(r, idx)
    assert [x.url for x in unknown.collect()] == ["http://b/2."] or [x.url for x in unknown.collect()] == ["http://b/2"]
    assert {x.number for x in validate.unsupported_numbers(r, spark.createDataFrame([("in 2024",)], "text string")).collect()} == {"12.5%"}
    assert {(x.token, x.number) for x in validate.citation_numbers(r).collect()} == {("p", 1), ("q", 2)}
    said = [x.sentence for x in validate.unknown_claims(r, spark.createDataFrame([("the quick brown fox jumps over a lazy dog",)], "text string")).collect()]
    assert not any("quick brown" in s for s in said)
    assert [x.url for x in validate.unused_sources(idx, r).collect()] == ["http://b/9"]


def test_pack_and_corrections(spark, tmp_path):
    g = make(spark, [nli("1", "f1", "c", "supports", 0.9)], [("c", "t", "x", 0.5)], [page("p1", work="w")], [("f1", "p1", "", "", None)], [("t", "p1", 0, "serp")], [("w", 2020, "v", "10.1/x", "s2")], [("w", 1, "Second"), ("w", 0, "First")])
    pack = reports.evidence_pack(g, "t")
    assert pack["citations"].first().author_display == "First et al." and pack["counts"].first().evidence_chains == 1
    reports.write_pack(pack, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/top_claims").count() == 1
    fix = spark.createDataFrame([("1", "refutes", 1.0)], "id string, new string, confidence double")
    assert [(r.relation, r.nli_edge_confidence) for r in reports.apply_corrections(g.edges, fix).collect()] == [("refutes", 1.0)]
