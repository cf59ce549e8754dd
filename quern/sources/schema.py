"""Schemas of a stored graph: its tables as Parquet folders, numbered migrations, and what opens a store of any version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .graph import Graph

#: Columns of each table in the first version.
FIRST = {
    "tasks": "id string, hypothesis string, status string, created_at timestamp",
    "claims": "id string, task_id string, claim_text string, llm_claim_confidence double",
    "pages": "id string, url string, domain string, title string",
    "works": "canonical_id string, year int, venue string, doi string, source_api string",
    "work_authors": "canonical_id string, position int, name string",
    "fragments": "id string, page_id string, heading_context string, text_content string, created_at timestamp",
    "edges": "id string, source_type string, source_id string, target_type string, target_id string, relation string, nli_edge_confidence double",
    "task_pages": "task_id string, page_id string, depth int, reason string",
}


@dataclass(frozen=True)
class Migration:
    """A column added to a table; rows of earlier versions hold its default."""

    number: int
    table: str
    column: str
    type: str
    default: str | None = None


MIGRATIONS = [
    Migration(1, "pages", "canonical_id", "string"),
    Migration(2, "pages", "html_path", "string"),
    Migration(3, "edges", "created_at", "timestamp"),
    Migration(4, "claims", "status", "string", "adopted"),
]
LATEST = len(MIGRATIONS)


def columns(table: str, version: int = LATEST) -> StructType:
    """The schema of a table in a version."""
    added = [f"{m.column} {m.type}" for m in MIGRATIONS if m.table == table and m.number <= version]
    return _parse_datatype_string(", ".join([FIRST[table], *added]))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Rows of a table of any version in the latest one: its columns in order, missing ones at their default, types cast."""
    default = {m.column: m.default for m in MIGRATIONS if m.table == table}
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(default.get(f.name))).cast(f.dataType).alias(f.name) for f in columns(table)])


def create(spark: SparkSession, folder: str, version: int = LATEST) -> None:
    """Empty tables of a version where there are none, and the version; a store that exists is left alone."""
    if stored_version(spark, folder) is not None:
        return
    for t in FIRST:
        spark.createDataFrame([], columns(t, version)).write.mode("overwrite").parquet(f"{folder}/{t}/v{version}")
    set_version(spark, folder, version)


def set_version(spark: SparkSession, folder: str, version: int) -> None:
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{folder}/_meta")


def stored_version(spark: SparkSession, folder: str) -> int | None:
    """The largest version written; None without a store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_meta")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    # a folder that begins with _ is hidden from scans of its parent, not from its own
    return spark.read.schema("version int").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/_meta").agg(F.max("version")).first()[0]


def migrate(spark: SparkSession, folder: str) -> list[int]:
    """Brings a store to the latest version and returns the numbers applied, in order; none the second time.

    Each table that changes is written anew beside its old rows, then the version is
    raised: a run that fails on the way leaves the old version in force.
    """
    now = stored_version(spark, folder)
    if now is None:
        raise ValueError(f"no store in {folder}")
    due = [m for m in MIGRATIONS if m.number > now]
    for t in FIRST if due else []:
        conform(spark.read.schema(columns(t, now)).parquet(f"{folder}/{t}/v{now}"), t).write.mode("overwrite").parquet(f"{folder}/{t}/v{LATEST}")
    if due:
        set_version(spark, folder, LATEST)
    return [m.number for m in sorted(due, key=lambda m: m.number)]


def load(spark: SparkSession, folder: str) -> Graph:
    """The graph of a store, in the latest version whatever is stored."""
    v = stored_version(spark, folder)
    if v is None:
        raise ValueError(f"no store in {folder}")
    return Graph(**{t: conform(spark.read.schema(columns(t, v)).parquet(f"{folder}/{t}/v{v}"), t) for t in FIRST})


def save(graph: Graph, folder: str) -> None:
    """Appends the tables of a graph to a store of the latest version; derived edges are not stored."""
    from quern.operators.sourcing import DERIVED

    spark = graph.tasks.sparkSession
    if stored_version(spark, folder) != LATEST:
        raise ValueError("migrate the store first")
    for t in FIRST:
        d = getattr(graph, t)
        if t == "edges":
            d = d.where(F.coalesce(F.col("relation") != DERIVED, F.lit(True)))
        conform(d, t).write.mode("append").parquet(f"{folder}/{t}/v{LATEST}")
