"""The query surface: guarded read-only SQL, named views with typed parameters, vector search."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quern.operators import ranking, views
from quern.sources.graph import Graph

LIMITS, TIMEOUTS_MS = (1, 200, 50), (1, 2000, 300)  # least, most, default
TOP_K = (1, 50, 10)

# Keywords that no read-only statement needs.
FORBIDDEN = ["ATTACH", "DETACH", "load_extension", "CREATE", "DROP", "ALTER", "INSERT", "UPDATE", "DELETE", "REPLACE", "PRAGMA"]
#: Hints by what an unresolved name contains.
HINTS = {
    "nli_claim_support_ratio": "it is a column of the view claim_evidence_summary",
    "support_count": "support and refute counts are columns of the view claim_evidence_summary",
    "refute_count": "support and refute counts are columns of the view claim_evidence_summary",
    "evidence_count": "evidence counts are columns of the view claim_evidence_summary",
    "controversy_score": "it is a column of the view contradictions",
    "task_id": "pages, fragments and edges have no task; start from claims.task_id and follow edges",
    "author": "authors are rows of work_authors, by canonical_id",
    "metadata": "bibliographic columns are in works; pages lead there by canonical_id",
    "paper": "bibliographic columns are in works; pages lead there by canonical_id",
}


class QueryError(ValueError):
    """A request that is refused before it runs."""


def bounded(value: int | None, bounds: tuple[int, int, int], name: str) -> int:
    low, high, default = bounds
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise QueryError(f"{name} must be an integer from {low} to {high}")
    return value


def validate_sql(sql: str) -> None:
    """Refuses several statements and the forbidden keywords."""
    if not isinstance(sql, str) or not sql.strip():
        raise QueryError("sql must not be empty")
    if ";" in sql.strip().rstrip(";"):
        raise QueryError("Multiple statements are not allowed")
    for word in FORBIDDEN:
        if re.search(rf"\b{word}\b", sql, re.IGNORECASE):
            raise QueryError(f"Forbidden SQL keyword: {word}")


def require_query(spark: SparkSession, sql: str) -> None:
    """Refuses what parses to a command rather than a query."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    names = re.findall(r"^[\s:+|'-]*([A-Za-z]+)", plan.toString(), re.MULTILINE)
    if any(n.endswith("Command") or n.startswith(("Set", "Create", "Drop", "Insert", "Alter", "Refresh", "Cache", "Uncache", "Clear", "Use", "Show", "Describe")) and n not in ("SetOperation",) for n in names[:1]):
        raise QueryError("Only queries are allowed")


def strip_limit(sql: str) -> str:
    """The statement without its final LIMIT, whose place the caller's limit takes."""
    return re.sub(r"\s+LIMIT\s+\d+(?:\s*,\s*\d+|\s+OFFSET\s+\d+)?\s*;?\s*$", "", sql.strip().rstrip(";"), flags=re.IGNORECASE)


# Conversions of strftime and what date_format calls them.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%%": "%"}


def _call_end(sql: str, start: int) -> tuple[int, list[str]]:
    """The end of a call whose arguments begin at start, and the arguments."""
    depth, quote, args, last, i = 1, None, [], start, start
    while i < len(sql):
        c = sql[i]
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        if not quote and (depth == 0 or (depth == 1 and c == ",")):
            args.append(sql[last:i].strip())
            last = i + 1
            if depth == 0:
                return i + 1, args if args != [""] else []
        i += 1
    raise QueryError("unbalanced parentheses")


def _rewritten(name: str, args: list[str]) -> str | None:
    """What Spark calls a function that it lacks or knows by another name; None to leave a call as it is."""
    if name == "iif":
        return f"if({', '.join(args)})"
    if name == "json_extract" and len(args) == 2:
        return f"get_json_object({', '.join(args)})"
    if name == "total" and len(args) == 1:
        return f"coalesce(cast(sum({args[0]}) as double), 0.0D)"
    if name == "group_concat" and args:
        distinct = re.match(r"(?i)distinct\s+", args[0])
        value = args[0][distinct.end() :] if distinct else args[0]
        return f"listagg({'DISTINCT ' if distinct else ''}cast({value} as string), {args[1] if len(args) > 1 else repr(',')})"
    if name in ("datetime", "strftime", "date") and args:
        at = args[-1] if name != "strftime" else args[1] if len(args) > 1 else "'now'"
        when = "current_timestamp()" if at.lower() == "'now'" else f"cast({at} as timestamp)"
        if name == "strftime" and not re.fullmatch(r"'[^']*'", args[0]):
            raise QueryError("strftime needs a literal format")
        form = {"datetime": "yyyy-MM-dd HH:mm:ss", "date": "yyyy-MM-dd"}.get(name) or _date_format(args[0][1:-1])
        return f"date_format({when}, '{form}')" if name == "strftime" or len(args) == 1 else None
    return None


def _date_format(form: str) -> str:
    out = ""
    for part in re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", form):
        if part[0] == "%" and part not in STRFTIME:
            raise QueryError(f"strftime knows no {part}")
        out += STRFTIME[part] if part[0] == "%" else f"\'\'{part}\'\'" if part.isalpha() else part
    return out


def sqlite_names(sql: str) -> str:
    """The statement with iif, json_extract, total, group_concat, datetime, date and strftime as Spark has them; literals and quoted names stay. ifnull, instr, substr and printf are Spark's own."""
    out, i = "", 0
    token = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|\b(iif|json_extract|total|group_concat|datetime|date|strftime)\s*\(", re.IGNORECASE)
    while m := token.search(sql, i):
        out += sql[i : m.start()]
        if not m[1]:
            out, i = out + m[0], m.end()
            continue
        i, args = _call_end(sql, m.end())
        args = [sqlite_names(a) for a in args]
        new = _rewritten(m[1].lower(), args)
        out += new if new is not None else f"{m[1]}({', '.join(args)})"
    return out + sql[i:]


def hint(message: str) -> str | None:
    if not re.search(r"UNRESOLVED|TABLE_OR_VIEW_NOT_FOUND|cannot be resolved|not found", message):
        return None
    return next((h for k, h in HINTS.items() if k in message.split("SQLSTATE")[0].split("Did you mean")[0]), None)


def hex_bytes(df: DataFrame) -> DataFrame:
    """Binary columns as lower-case hex."""
    return df.select(*[F.lower(F.hex(F.col(f"`{f.name}`"))).alias(f.name) if isinstance(f.dataType, BinaryType) else F.col(f"`{f.name}`") for f in df.schema])


def fetch(df: DataFrame, limit: int, timeout_ms: int) -> dict[str, Any]:
    """Up to `limit` rows of df, one more read to tell whether it was cut, cancelled after the time."""
    sc = df.sparkSession.sparkContext
    group, late = f"quern-{uuid.uuid4().hex}", threading.Event()

    def cancel():
        late.set()
        # also what the group has not started yet: planning may take longer than the limit
        sc._jsc.sc().cancelJobGroupAndFutureJobs(group)

    timer = threading.Timer(timeout_ms / 1000, cancel)
    began = time.monotonic()
    sc.setJobGroup(group, "query", interruptOnCancel=True)
    timer.start()
    try:
        rows = [r.asDict(recursive=True) for r in hex_bytes(df).limit(limit + 1).collect()]
    except Exception as e:
        if late.is_set():
            return {"ok": False, "error": "interrupted", "hint": f"the query took over {timeout_ms} ms; narrow it"}
        raise e
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    return {"ok": True, "rows": rows[:limit], "row_count": min(len(rows), limit), "columns": df.columns, "truncated": len(rows) > limit, "elapsed_ms": round((time.monotonic() - began) * 1000)}


def query_sql(spark: SparkSession, sql: str, limit: int | None = None, timeout_ms: int | None = None, include_schema: bool = False, args: dict[str, Any] | None = None) -> dict[str, Any]:
    """Runs one read-only query. Values go in args and are bound to :name markers, never formatted into the text."""
    try:
        n, ms = bounded(limit, LIMITS, "limit"), bounded(timeout_ms, TIMEOUTS_MS, "timeout_ms")
        validate_sql(sql)
        text = sqlite_names(strip_limit(sql))
        require_query(spark, text)
        out = fetch(spark.sql(text, args=args) if args else spark.sql(text), n, ms)
    except QueryError as e:
        return {"ok": False, "error": str(e)}
    except PySparkException as e:
        return {"ok": False, "error": str(e).split("\n")[0]} | ({"hint": h} if (h := hint(str(e))) else {})
    if include_schema and out["ok"]:
        out["schema"] = schema(spark)
    return out


def schema(spark: SparkSession) -> list[dict[str, Any]]:
    """Tables and views of the session with their columns."""
    return [{"name": t.name, "columns": [{"name": c.name, "type": c.dataType} for c in spark.catalog.listColumns(t.name)]} for t in spark.catalog.listTables() if t.name]


@dataclass(frozen=True)
class View:
    """A named view: what makes it, its parameters with defaults (... for required), and its order."""

    build: Callable[..., DataFrame]
    description: str
    params: dict[str, Any] = field(default_factory=dict)
    order: tuple[str, ...] = ()
    by_task: bool = True


VIEWS: dict[str, View] = {
    "claim_evidence_summary": View(views.claim_evidence_summary, "Evidence counts, weights and support ratio by claim", order=("-evidence_count", "claim_id")),
    "contradictions": View(views.contradictions, "Claims with support and refutation", order=("-controversy_score", "claim_id")),
    "unsupported_claims": View(views.unsupported_claims, "Claims without evidence", order=("claim_id",)),
    "claim_origins": View(views.claim_origins, "Where claims came from", order=("claim_id",)),
    "evidence_chain": View(views.evidence_chain, "Fragment, page and work behind each evidence edge", order=("claim_id", "edge_id")),
    "citation_flow": View(views.citation_flow, "Which page cites which", order=("citing_page_id", "cited_page_id"), by_task=False),
    "orphan_sources": View(views.orphan_sources, "Evidence pages that nothing cites", order=("page_id",)),
    "evidence_timeline": View(views.evidence_timeline, "Evidence by year of publication", order=("year",)),
    "emerging_consensus": View(views.emerging_consensus, "Recent against older support", {"as_of_year": ...}, ("-support_trend", "claim_id")),
    "outdated_evidence": View(views.outdated_evidence, "Years since the newest support", {"as_of_year": ...}, ("-years_since_update", "claim_id")),
    "source_authority": View(views.source_authority, "Pages by claims supported and citations", order=("-authority_score", "page_id")),
    "source_impact": View(views.source_impact, "Pages by claims generated and corroborated", order=("-impact_score", "page_id")),
    "citation_age_gap": View(views.citation_age_gap, "Years between citing and cited works", order=("-age_gap", "citing_page_id", "cited_page_id"), by_task=False),
    "evidence_freshness": View(views.evidence_freshness, "Mean age of evidence and recent findings", {"as_of_year": ...}, ("avg_evidence_age", "claim_id")),
    "bibliographic_coupling": View(views.bibliographic_coupling, "Pages that are cited together", order=("-shared_citations", "page_a", "page_b"), by_task=False),
    "citation_chains": View(views.citation_chains, "Two citations in a row", order=("page_a", "page_b", "page_c"), by_task=False),
    "reference_candidates": View(views.reference_candidates, "Cited pages that a task has not processed", {"task_id": ...}, ("citing_depth", "-citation_created_at"), by_task=False),
}


def list_views() -> dict[str, Any]:
    return {"ok": True, "views": [{"name": n, "description": v.description} for n, v in VIEWS.items()], "count": len(VIEWS)}


def view(graph: Graph, name: str, task_id: Any = None, **params: Any) -> DataFrame:
    """The named view as a DataFrame, restricted to a task where it has one, in its order."""
    if name not in VIEWS:
        raise QueryError(f"Unknown view {name}; there are {', '.join(VIEWS)}")
    v = VIEWS[name]
    if "task_id" in v.params:
        params["task_id"] = task_id
    if extra := set(params) - set(v.params):
        raise QueryError(f"{name} takes no {', '.join(sorted(extra))}")
    given = {}
    for k, default in v.params.items():
        given[k] = params.get(k) if params.get(k) is not None else default
        if given[k] is ...:
            raise QueryError(f"{name} needs {k}")
    d = v.build(graph, **given)
    if v.by_task and task_id is not None:
        d = d.where(F.col("task_id") == task_id)
    return d.orderBy(*[F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in v.order])


def query_view(graph: Graph, name: str, task_id: Any = None, limit: int | None = None, timeout_ms: int = 60_000, **params: Any) -> dict[str, Any]:
    try:
        return fetch(view(graph, name, task_id, **params), bounded(limit, LIMITS, "limit"), timeout_ms)
    except QueryError as e:
        return {"ok": False, "error": str(e)}


def register(graph: Graph, as_of_year: int) -> None:
    """Makes tables and views of a graph available to query_sql under their names."""
    for name in graph.__dataclass_fields__:
        getattr(graph, name).createOrReplaceTempView(name)
    for name, v in VIEWS.items():
        if "task_id" not in v.params:
            v.build(graph, **{k: as_of_year for k in v.params}).createOrReplaceTempView(name)


def vector_search(vectors: DataFrame, query: list[float], top_k: int | None = None, min_similarity: float = 0.0, scope: DataFrame | None = None) -> dict[str, Any]:
    """The nearest of vectors(id, embedding, text); text is cut to a preview of 200 characters."""
    try:
        k = bounded(top_k, TOP_K, "top_k")
        if not query:
            raise QueryError("the query vector is empty")
    except QueryError as e:
        return {"ok": False, "error": str(e)}
    total = (vectors if scope is None else vectors.join(scope.select("id"), "id", "left_semi")).count()
    if not total:
        return {"ok": False, "error": "there are no embeddings to search"}
    found = ranking.vector_search(vectors.select("id", "embedding"), query, k, min_similarity, scope)
    if "text" in vectors.columns:
        found = found.join(vectors.select("id", F.substring("text", 1, 200).alias("preview")), "id", "left").orderBy(F.desc("similarity"), "id")
    return {"ok": True, "results": [r.asDict() for r in found.collect()], "total_searched": total}


@dataclass(frozen=True)
class Tool:
    """A callable by name: what runs it and the arguments that it takes, True for required ones."""

    run: Callable[..., dict[str, Any]]
    description: str
    args: dict[str, bool] = field(default_factory=dict)


def tools(spark: SparkSession, graph: Graph, vectors: DataFrame | None = None) -> dict[str, Tool]:
    """The query surface by name, over one graph."""
    out = {
        "query_sql": Tool(lambda **a: query_sql(spark, **a), "One read-only SQL query", {"sql": True, "limit": False, "timeout_ms": False, "include_schema": False, "args": False}),
        "query_view": Tool(lambda view, params=None, **a: query_view(graph, view, **a, **(params or {})), "A named view", {"view": True, "task_id": False, "params": False, "limit": False, "timeout_ms": False}),
        "list_views": Tool(list_views, "The views"),
        "schema": Tool(lambda: {"ok": True, "tables": schema(spark)}, "Tables and columns"),
    }
    if vectors is not None:
        out["vector_search"] = Tool(lambda **a: vector_search(vectors, **a), "The nearest vectors", {"query": True, "top_k": False, "min_similarity": False})
    return out


def call(registry: dict[str, Tool], name: str, args: dict[str, Any] | None = None) -> dict[str, Any]:
    """Runs a tool by name; unknown names and wrong or missing arguments come back as errors."""
    if name not in registry:
        return {"ok": False, "error": f"Unknown tool {name}; there are {', '.join(sorted(registry))}"}
    tool, given = registry[name], dict(args or {})
    if missing := [k for k, required in tool.args.items() if required and given.get(k) is None]:
        return {"ok": False, "error": f"{name} needs {', '.join(missing)}"}
    if extra := sorted(set(given) - set(tool.args)):
        return {"ok": False, "error": f"{name} takes no {', '.join(extra)}"}
    return tool.run(**given)
