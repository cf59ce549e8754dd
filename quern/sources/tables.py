"""Ingest operators: merges, claims on resources, caches and codecs. Tables are immutable; an update is a new table."""

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

col = F.col


def scan(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table, also registered under its name."""
    d = spark.read.parquet(f"{path}/{name}.parquet")
    d.createOrReplaceTempView(name)
    return d


def insert(old: DataFrame, new: DataFrame, keys: list[str], order: str, replace: bool = False) -> DataFrame:
    """old with new's rows: of rows with equal keys the existing one stays, or the newest with `replace`. Within new the first, or last, by order."""
    pick = F.max_by if replace else F.min_by
    fresh = new.groupBy(*keys).agg(pick(F.struct(*new.columns), F.struct(order)).alias("r")).select("r.*")
    a, b = (old.join(fresh.select(*keys), keys, "left_anti"), fresh) if replace else (old, fresh.join(old.select(*keys), keys, "left_anti"))
    return a.select(*old.columns).unionByName(b.select(*old.columns))


def update(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """old with the non-key columns of changes where there is a change."""
    cols = [c for c in changes.columns if c not in keys]
    c = changes.select(*keys, *[col(x).alias(f"__{x}") for x in cols], F.lit(True).alias("__hit"))
    d = old.join(c, keys, "left")
    return d.select(*[F.when(col("__hit"), col(f"__{x}")).otherwise(col(x)).alias(x) if x in cols else col(x) for x in old.columns])


def upsert_works(works: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Merged works(canonical_id, ...): counts take the largest, access columns the latest known value, the rest stays as first written."""
    most, latest = ["citation_count", "reference_count"], ["is_open_access", "oa_url", "pdf_url"]
    both = works.withColumn("__o", F.struct(F.lit(0).alias("k"), F.lit(None).cast(batch.schema[order].dataType).alias("at"))).unionByName(batch.select(*works.columns, F.struct(F.lit(1).alias("k"), col(order).alias("at")).alias("__o")))
    how = lambda c: F.max(c) if c in most else F.max_by(c, F.when(col(c).isNotNull(), col("__o"))) if c in latest else F.min_by(c, "__o")
    return both.groupBy("canonical_id").agg(*[how(c).alias(c) for c in works.columns if c != "canonical_id"]).select(*works.columns)


def first_authors(authors: DataFrame, batch: DataFrame) -> DataFrame:
    """Author rows of works that had none are added; others keep theirs."""
    return authors.unionByName(batch.join(authors.select("canonical_id").distinct(), "canonical_id", "left_anti").select(*authors.columns))


def upsert_identifiers(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Merged identifiers(provider, provider_paper_id, canonical_id, doi, arxiv_id): new values win where known, the work stays."""
    k = ["provider", "provider_paper_id"]
    n = batch.select(*k, *[col(c).alias(f"n_{c}") for c in ("canonical_id", "doi", "arxiv_id")])
    d = old.join(n, k, "full_outer")
    return d.select(*k, F.coalesce("canonical_id", "n_canonical_id").alias("canonical_id"), F.coalesce("n_doi", "doi").alias("doi"), F.coalesce("n_arxiv_id", "arxiv_id").alias("arxiv_id"))


def claim_resources(requests: DataFrame) -> DataFrame:
    """requests(type, value, claimed_at, worker) with is_new: the first request of each resource wins it."""
    w = requests.groupBy("type", "value").agg(F.min(F.struct("claimed_at", "worker")).alias("__w"))
    d = requests.join(w, ["type", "value"])
    return d.withColumn("is_new", F.struct("claimed_at", "worker") == col("__w")).drop("__w")


def latest_state(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("r")).select("r.*")


def live(cache: DataFrame, as_of: Column) -> DataFrame:
    """Cache rows that have not expired."""
    return cache.where(col("expires_at") > as_of)


def cache_stats(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.count_if(col("expires_at") > as_of).alias("live"), F.count_if(~(col("expires_at") > as_of)).alias("expired"))


def pack_vector(v: list[float]) -> bytes:
    """Little-endian 32-bit floats."""
    return struct.pack(f"<{len(v)}f", *v)


def unpack_vector(b: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(b) // 4}f", b))


def vectors_from_blobs(df: DataFrame, blob: str = "embedding_blob") -> DataFrame:
    """Adds embedding, the floats of a packed column, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: None if b is None else np.frombuffer(bytes(b), "<f4").tolist())

    return df.withColumn("embedding", decode(col(blob)))


def abstract_text(index: Column) -> Column:
    """Text of an inverted index map<word, array<position>>; null when empty."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(index) > 0, F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "))


def cdx_snapshots(lines: DataFrame) -> DataFrame:
    """(url, at, mime, status) of archive index lines(value); malformed lines are dropped."""
    p = F.split(F.trim("value"), r"\s+")
    d = lines.select(p.alias("p")).where(F.size("p") >= 6)
    at = F.try_to_timestamp(col("p")[1], F.lit("yyyyMMddHHmmss"))
    status = F.when(col("p")[4] == "-", 200).otherwise(F.expr("try_cast(p[4] as int)"))
    return d.select(col("p")[2].alias("url"), at.alias("at"), col("p")[3].alias("mime"), status.alias("status")).where("at is not null and status is not null")


def sitemap_entries(xml: Column) -> Column:
    """array<struct<loc, lastmod, changefreq, priority>> of a sitemap document."""
    # the five entities of XML; & comes last, so that nothing is decoded twice
    entities = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
    decoded = lambda c: reduce(lambda d, e: F.replace(d, F.lit(e), F.lit(entities[e])), entities, c)
    part = lambda x, tag: F.regexp_extract(x, f"(?s)<{tag}>\\s*(.*?)\\s*</{tag}>", 1)
    one = lambda x, tag: F.when(part(x, tag) != "", decoded(part(x, tag)))
    entry = lambda x: F.struct(one(x, "loc").alias("loc"), one(x, "lastmod").alias("lastmod"), one(x, "changefreq").alias("changefreq"), F.coalesce(F.when(one(x, "priority").rlike(r"^\d*\.?\d+$"), one(x, "priority").cast("double")), F.lit(0.5)).alias("priority"))
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<url>.*?</url>"), F.lit(0)), entry)


def robots_rules(lines: DataFrame, agent: str) -> DataFrame:
    """(domain, directive, value, pos) of robots lines(domain, pos, value) that apply to an agent or to all; sitemaps always do."""
    from pyspark.sql import Window

    d = lines.withColumn("v", F.trim(F.regexp_replace("value", r"#.*$", ""))).where(col("v").contains(":"))
    d = d.select("domain", "pos", F.lower(F.trim(F.regexp_extract("v", r"^([^:]*):", 1))).alias("directive"), F.trim(F.regexp_extract("v", r"^[^:]*:(.*)$", 1)).alias("value"))
    mine = F.when(col("directive") == "user-agent", F.lower("value").isin("*", agent.lower()))
    w = Window.partitionBy("domain").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("ours", F.last(mine, ignorenulls=True).over(w))
    return d.where("directive = 'sitemap' or (ours and directive in ('disallow', 'allow', 'crawl-delay'))").where("value != ''").select("domain", "directive", "value", "pos")


def path_matches(path: Column, pattern: Column) -> Column:
    """Whether a robots pattern (* and a final $) matches a path from its start; an empty one matches nothing."""
    quoted = F.regexp_replace(pattern, r"([.+?()\[\]{}|^\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\\$"))
    return (pattern != "") & F.expr("true") & F.regexp_like(path, regex)
