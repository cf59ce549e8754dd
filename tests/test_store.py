"""Stores and their migrations, SQL names, the tool registry, isolated sessions, headings, names and job cancellation."""

import pytest
from pyspark.sql import functions as F

from quern import api
from quern.functions import identity as idn
from quern.functions import rules as ru
from quern.operators import sourcing as so
from quern.session import isolated
from quern.sources import schema as sm
from quern.sources.graph import bridge

SF = "/root/testdata/sf0.001"


def test_store_from_the_first_version(spark, tmp_path):
    folder = str(tmp_path / "s")
    assert sm.stored_version(spark, folder) is None
    with pytest.raises(ValueError, match="no store"):
        sm.migrate(spark, folder)
    sm.create(spark, folder, 0)
    sm.create(spark, folder)
    assert sm.stored_version(spark, folder) == 0
    spark.createDataFrame([("c", "t", "x", 0.5)], sm.columns("claims", 0)).write.mode("append").parquet(f"{folder}/claims/v0")
    assert sm.load(spark, folder).claims.first().status == "adopted"
    with pytest.raises(ValueError, match="migrate"):
        sm.save(sm.load(spark, folder), folder)
    assert sm.migrate(spark, folder) == [1, 2, 3, 4] and sm.migrate(spark, folder) == []
    g = bridge(spark, SF)
    g.edges = g.edges.withColumn("relation", F.when(F.col("relation") == "neutral", "evidence_source").otherwise(F.col("relation")))
    sm.save(g, folder)
    back = sm.load(spark, folder)
    assert back.claims.count() == g.claims.count() + 1 and back.pages.columns[-2:] == ["canonical_id", "html_path"]
    assert back.edges.count() == g.edges.where("relation <> 'evidence_source'").count() < g.edges.count()


SQL = [
    ("SELECT iif(1 < 2, 'a', 'b') AS x", "a"),
    ("SELECT json_extract('{\"a\": 3}', '$.a') AS x", "3"),
    ("SELECT group_concat(v) AS x FROM VALUES (1), (2) t(v)", "1,2"),
    ("SELECT group_concat(DISTINCT v, ' / ') AS x FROM VALUES ('p'), ('p') t(v)", "p"),
    ("SELECT total(v) AS x FROM VALUES (1), (2) t(v)", 3.0),
    ("SELECT total(v) AS x FROM VALUES (1) t(v) WHERE v > 1", 0.0),
    ("SELECT strftime('%Y-%mT%H', '2024-02-03 04:05:06') AS x", "2024-02T04"),
    ("SELECT datetime('2024-02-03') AS x", "2024-02-03 00:00:00"),
    ("SELECT ifnull(NULL, instr('abc', 'c')) AS x", 3),
    ("SELECT 'iif(1, total(2))' AS x", "iif(1, total(2))"),
    ("SELECT iif(total(v) > 2, group_concat(iif(v > 1, 'b', 'a'), ')'), '') AS x FROM VALUES (1), (2) t(v)", "a)b"),
]


@pytest.mark.parametrize(("sql", "want"), SQL)
def test_sql_names(spark, sql, want):
    got = api.query_sql(spark, sql, timeout_ms=2000)
    assert got["ok"] and got["rows"] == [{"x": want}]


def test_sql_names_refused(spark):
    for sql in ("SELECT strftime('%Q', 'now')", "SELECT strftime(x, 'now')", "SELECT total(1"):
        assert not api.query_sql(spark, sql)["ok"]
    assert api.query_sql(spark, "SELECT length(datetime('now')) AS n", timeout_ms=2000)["rows"] == [{"n": 19}]


def test_tools(spark):
    t = api.tools(spark, bridge(spark, SF), spark.createDataFrame([(1, [1.0, 0.0])], "id int, embedding array<double>"))
    assert api.call(t, "list_views")["count"] > 10
    assert api.call(t, "query_view", {"view": "contradictions", "task_id": 1, "limit": 2})["ok"]
    assert not api.call(t, "query_view", {"view": "emerging_consensus"})["ok"]
    assert api.call(t, "query_view", {"view": "emerging_consensus", "params": {"as_of_year": 2026}, "limit": 1})["ok"]
    assert api.call(t, "vector_search", {"query": [1.0, 0.0]})["total_searched"] == 1
    for name, args in (("nothing", {}), ("query_sql", {}), ("list_views", {"x": 1})):
        assert not api.call(t, name, args)["ok"]


def test_isolated_sessions_share_no_views(spark):
    one = isolated(spark)
    one.range(1).createOrReplaceTempView("only_here")
    assert "only_here" in {t.name for t in one.catalog.listTables()} and "only_here" not in {t.name for t in spark.catalog.listTables()}


def test_paragraph_headings(spark):
    html = "<p>a</p><H1>Top</H1><p>b</p><p>c</p><h3>Deep</h3><p>d</p><h2> </h2><p>e</p><h2>Next</h2><p>f</p>"
    got = spark.createDataFrame([(html,)], "h string").select(F.explode(ru.paragraph_headings(F.col("h"))).alias("p")).select("p.*").collect()
    assert [(r.position, [(x.level, x.text) for x in r.hierarchy], r.context, r.element) for r in got] == [
        (0, [], None, 0), (1, [(1, "Top")], "Top", 0), (2, [(1, "Top")], "Top", 1), (3, [(1, "Top"), (3, "Deep")], "Deep", 0), (4, [(1, "Top"), (3, "Deep")], "Deep", 1), (5, [(1, "Top"), (2, "Next")], "Next", 0),
    ]
    long = "<h1>t</h1>" + "<p>x</p>" * 5000
    d = spark.createDataFrame([(None,), ("",), (long,)], "h string").select(F.size(ru.paragraph_headings(F.col("h"))).alias("n"))
    assert [r.n for r in d.collect()][1:] == [0, 5000]


def test_names(spark):
    names = ["  Acme,  Inc. ", "Co Op Ltd.", "株式会社", "（有）青木", "ＡＢＣ　ｃｏｍｐａｎｙ", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(idn.normalised_name(F.col("n")).alias("x"), idn.normalised_name(F.col("n"), False).alias("y")).collect()
    assert [(r.x.canonical, r.x.legal_form, r.x.language) for r in got] == [("acme inc", "inc", "en"), ("co op ltd", "ltd", "en"), (" KK", "KK", "ja"), ("青木 YK", "YK", "ja"), ("abc co", "co", None), ("", None, None)]
    assert got[0].y.legal_form is None and got[0].y.tokens == ["acme", "inc"]


def test_cancel_and_candidates_refuse_nonsense(spark):
    with pytest.raises(ValueError, match="not both"):
        so.candidate_targets(spark.range(1), spark.range(1), spark.range(1))
    jobs = spark.createDataFrame([(1, 1, "serp", "queued"), (2, 1, "target_queue", "running"), (3, 1, "target_queue", "completed"), (4, 2, "serp", "queued"), (5, 1, "serp", "running")], "id int, task_id int, kind string, state string")
    stops = spark.createDataFrame([(1, "graceful", "all_jobs"), (1, "immediate", "target_queue_only")], "task_id int, mode string, scope string")
    assert {r.id: r.state for r in so.cancel_jobs(jobs, stops).collect()} == {1: "cancelled", 2: "cancelled", 3: "completed", 4: "queued", 5: "running"}
