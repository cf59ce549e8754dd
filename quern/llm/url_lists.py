"""URL filters by a temporal list join. SQL expresses it, and so it is DataFrame operations throughout.

Dated list entries (an addition or a removal of a host on a list) become intervals of
validity. Every capture meets the entries of its host and of the domains above it that
were valid when it was fetched: an as-of join on host and time. The most specific
entry decides, and at equal depth allowing wins over blocking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Intervals that may be broadcast; beyond, the join shuffles on host and skewed hosts are split.
BROADCAST_ROWS = 500_000


def intervals(entries: DataFrame) -> DataFrame:
    """(list, host, verdict, valid_from, valid_to) from entries(list, host, verdict, at, action 'add' or 'remove').

    An entry holds from its addition, inclusive, to its next change, exclusive, or for
    ever. Of changes at one instant the removal wins. Repeated additions split the
    interval without effect; removals of what is not listed do nothing. Entries with a
    null in list, host or time are dropped.
    """
    e = entries.select("list", F.lower(F.trim("host")).alias("host"), "verdict", "at", "action").where("list is not null and host is not null and at is not null")
    e = e.groupBy("list", "host", "at").agg(F.max("action").alias("action"), F.max("verdict").alias("verdict"))
    w = Window.partitionBy("list", "host").orderBy("at")
    return e.withColumn("valid_to", F.lead("at").over(w)).where("action = 'add'").select("list", "host", "verdict", F.col("at").alias("valid_from"), "valid_to")


def host_of(url):
    """Lower-cased host of a URL; null without one."""
    h = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def filter_captures(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """(page_id, url, host, fetched_at, verdict, list, entry, since) per capture.

    verdict is 'block' or 'allow' of the deciding entry, 'none' where no entry was valid
    or url or time is null. Ties of entries go to 'allow', then the first list name.
    Rows that repeat are judged alike.
    """
    c = captures.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(at).alias("fetched_at")).withColumn("host", host_of(F.col("url")))
    iv = intervals(entries).withColumnRenamed("host", "entry")
    if iv.count() <= BROADCAST_ROWS:
        iv = F.broadcast(iv)
    # judge each host and instant once, however many captures share them
    asked = c.where("host is not null and fetched_at is not null").select("host", "fetched_at").distinct()
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tried = asked.select("host", "fetched_at", F.posexplode(above).alias("up", "entry"))
    valid = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hits = tried.join(iv, "entry").where(valid)
    first = F.min(F.struct("up", "verdict", "list", "entry", "valid_from")).alias("m")
    best = hits.groupBy(F.col("host").alias("h"), F.col("fetched_at").alias("t")).agg(first)
    out = c.join(best, (F.col("host") == F.col("h")) & (F.col("fetched_at") == F.col("t")), "left")
    return out.select("page_id", "url", "host", "fetched_at", F.coalesce("m.verdict", F.lit("none")).alias("verdict"), F.col("m.list").alias("list"), F.col("m.entry").alias("entry"), F.col("m.valid_from").alias("since"))


# The tables hold neither fetch times nor lists: both follow from page ids and hosts by a fixed rule.
BASE = "2024-01-01 00:00:00"


def fetched(pages: DataFrame) -> DataFrame:
    minutes = F.pmod(F.col("page_id") * 7919, F.lit(43200))
    return pages.withColumn("fetched_at", F.expr(f"timestamp '{BASE}'") + F.make_dt_interval(mins=minutes.cast("int")))


def list_entries(pages: DataFrame) -> DataFrame:
    """Four changes for each host and each domain above it: listed, removed, listed again by another list, allowed."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    parts = F.split("host", r"\.")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    d = hosts.select(up.alias("host")).distinct().withColumn("n", F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long"))
    change = lambda name, verdict, action, day, cond: F.when(cond, F.struct(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), day.cast("int").alias("day")))
    n = F.col("n")
    changes = F.array_compact(
        F.array(
            change("spam", "block", "add", n % 11, n % 3 != 0),
            change("spam", "block", "remove", n % 11 + n % 7 + 1, n % 3 == 1),
            change("malware", "block", "add", n % 23 + 4, n % 5 == 0),
            change("trusted", "allow", "add", n % 17, n % 4 == 0),
        )
    )
    d = d.select("host", F.explode(changes).alias("c"))
    return d.select("c.list", "host", "c.verdict", (F.expr(f"timestamp '{BASE}'") + F.make_dt_interval(days=F.col("c.day"))).alias("at"), "c.action")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_captures(fetched(pages), list_entries(pages))


OP3_SQL = r"""
WITH c AS (SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_minutes((((page_id * 7919) % 43200 + 43200) % 43200)::INT) AS fetched_at,
                  nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host FROM pages),
h AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM c WHERE host IS NOT NULL),
u AS (SELECT DISTINCT array_to_string(p[i:], '.') AS host FROM (SELECT p, unnest(range(1, greatest(len(p) - 2, 1) + 1)) AS i FROM h)),
n AS (SELECT host, ('0x' || substr(md5(host), 1, 7))::BIGINT AS n FROM u),
e AS (SELECT 'spam' AS list, host, 'block' AS verdict, n % 11 AS day, 'add' AS action FROM n WHERE n % 3 <> 0
      UNION ALL SELECT 'spam', host, 'block', n % 11 + n % 7 + 1, 'remove' FROM n WHERE n % 3 = 1
      UNION ALL SELECT 'malware', host, 'block', n % 23 + 4, 'add' FROM n WHERE n % 5 = 0
      UNION ALL SELECT 'trusted', host, 'allow', n % 17, 'add' FROM n WHERE n % 4 = 0),
t AS (SELECT list, host, verdict, action, TIMESTAMP '2024-01-01 00:00:00' + to_days(day::INT) AS at_ts FROM e),
iv AS (SELECT * FROM (SELECT *, lead(at_ts) OVER (PARTITION BY list, host ORDER BY at_ts) AS valid_to FROM t) WHERE action = 'add'),
j AS (SELECT c.page_id, c.url, c.host, c.fetched_at, iv.verdict, iv.list, iv.host AS entry, iv.at_ts AS since,
             row_number() OVER (PARTITION BY c.host, c.fetched_at, c.page_id, c.url ORDER BY length(iv.host) DESC, iv.verdict, iv.list) AS k
      FROM c JOIN iv ON (c.host = iv.host OR ends_with(c.host, '.' || iv.host)) AND c.fetched_at >= iv.at_ts AND (iv.valid_to IS NULL OR c.fetched_at < iv.valid_to))
SELECT c.page_id, c.url, c.host, c.fetched_at, coalesce(j.verdict, 'none') AS verdict, j.list, j.entry, j.since
FROM c LEFT JOIN j ON j.k = 1 AND c.page_id = j.page_id AND c.url = j.url
"""
