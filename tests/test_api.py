import pytest
from pyspark.sql import functions as F

from quern import api
from quern.sources.graph import bridge

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    g = bridge(spark, SF)
    api.register(g, 2026)
    return g


@pytest.mark.parametrize("sql", ["SELECT 1; SELECT 2", "DROP TABLE x", "insert into t values (1)", "CREATE VIEW v AS SELECT 1", "select load_extension('x')", "PRAGMA x", "", "SET a=b", "SHOW TABLES", "DESCRIBE claims"])
def test_refused(spark, graph, sql):
    assert api.query_sql(spark, sql)["ok"] is False


def test_limits_and_truncation(spark, graph):
    got = api.query_sql(spark, "SELECT id FROM claims LIMIT 1000;", limit=3, timeout_ms=2000)
    assert got["ok"] and got["row_count"] == 3 and got["truncated"] and got["columns"] == ["id"]
    assert api.query_sql(spark, "SELECT * FROM (SELECT id FROM claims LIMIT 2)", timeout_ms=2000)["row_count"] == 2
    for bad in (0, 201, -1, True, "5"):
        assert not api.query_sql(spark, "SELECT 1", limit=bad)["ok"]
    assert not api.query_sql(spark, "SELECT 1", timeout_ms=2001)["ok"]
    assert api.strip_limit("SELECT 1 LIMIT 5 OFFSET 2 ;") == "SELECT 1"


def test_values_hints_schema(spark, graph):
    assert api.query_sql(spark, "SELECT X'00ff' AS b, :x AS q", args={"x": "it's"}, timeout_ms=2000)["rows"] == [{"b": "00ff", "q": "it's"}]
    got = api.query_sql(spark, "SELECT nli_claim_support_ratio FROM claims")
    assert not got["ok"] and "claim_evidence_summary" in got["hint"]
    got = api.query_sql(spark, "SELECT 1 AS a", include_schema=True, timeout_ms=2000)
    assert any(t["name"] == "claims" and {"name": "task_id", "type": "bigint"} in t["columns"] for t in got["schema"])


def test_timeout(spark, graph):
    got = api.query_sql(spark, "SELECT count(*) AS n FROM range(100000000) a JOIN range(2000) b ON a.id % 7 <= b.id % 5", timeout_ms=200)
    assert got == {"ok": False, "error": "interrupted", "hint": got["hint"]}


def test_views(spark, graph):
    assert api.list_views()["count"] == 17
    got = api.query_view(graph, "contradictions", task_id=1, limit=5)
    assert got["ok"] and got["row_count"] == 5 and {r["task_id"] for r in got["rows"]} == {1}
    scores = [r["controversy_score"] for r in got["rows"]]
    assert scores == sorted(scores, reverse=True)
    assert not api.query_view(graph, "reference_candidates")["ok"]
    assert not api.query_view(graph, "nothing")["ok"] and not api.query_view(graph, "contradictions", colour="red")["ok"]
    assert not api.query_view(graph, "outdated_evidence")["ok"] and api.query_view(graph, "outdated_evidence", as_of_year=2026)["ok"]
    assert api.query_view(graph, "unsupported_claims", task_id=-1)["rows"] == []


def test_vector_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0], "a" * 300), (2, [0.9, 0.1, 0.0], "b"), (3, [0.0, 1.0, 0.0], "c"), (4, [1.0, 0.0], "short"), (5, [0.0, 0.0, 0.0], "zero")], "id long, embedding array<float>, text string")
    got = api.vector_search(v, [1.0, 0.0, 0.0], top_k=2, min_similarity=0.5)
    assert [r["id"] for r in got["results"]] == [1, 2] and len(got["results"][0]["preview"]) == 200 and got["total_searched"] == 5
    assert [r["id"] for r in api.vector_search(v, [1.0, 0.0, 0.0], scope=spark.createDataFrame([(3,)], "id long"))["results"]] == [3]
    assert not api.vector_search(v, [1.0], top_k=51)["ok"] and not api.vector_search(v.where(F.lit(False)), [1.0])["ok"]
