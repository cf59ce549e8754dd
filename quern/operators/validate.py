"""Report validation: what a report cites or claims against what the evidence holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx

col = F.col
URL = r"https?://[^\s<>)\]\"']+"
NUMBER = r"\d+(?:\.\d+)?%?"


def urls_in(reports: DataFrame) -> DataFrame:
    """(id, url) of each URL in reports(id, text), once per report."""
    return reports.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(URL), F.lit(0)))).alias("url"))


def unknown_urls(reports: DataFrame, index: DataFrame) -> DataFrame:
    """URLs that the citation index(url) does not hold."""
    return urls_in(reports).join(index.select("url"), "url", "left_anti")


def numbers_in(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.length(x) > 2))


def unsupported_numbers(reports: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, number) that occur in no evidence(text): an anti-join on the numbers that the evidence holds."""
    said = reports.select("id", F.explode(numbers_in(col("text"))).alias("number"))
    known = evidence.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)))).alias("number")).distinct()
    return said.join(known, "number", "left_anti")


def unknown_claims(reports: DataFrame, claims: DataFrame, share: float = 0.6, shortest: int = 30) -> DataFrame:
    """Sentences of over `shortest` characters, none of whose matches in claims(text) shares more than that of their words.

    A claim that shares so many words holds one of a sentence's rarest, so sentences meet
    claims on those alone; a word that stands in most claims seldom counts.
    """
    s = reports.select("id", F.posexplode(tx.sentences(col("text"))).alias("pos", "sentence")).where(F.length("sentence") > shortest)
    s = s.withColumn("w", F.array_distinct(tx.tokens(col("sentence")))).where(F.size("w") > 3)
    c = claims.select(F.array_sort(F.array_distinct(tx.tokens(col("text")))).alias("cw")).distinct().withColumn("c", F.xxhash64("cw"))
    df = c.select(F.explode("cw").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    words = s.select("id", "pos", F.size("w").alias("n"), F.explode("w").alias("word")).join(df, "word")
    # words that no claim holds come first in the order of frequency, and meet nothing
    own = Window.partitionBy("id", "pos")
    words = words.withColumn("k", F.row_number().over(own.orderBy("df", "word")) + col("n") - F.count("*").over(own))
    words = words.where(col("k") <= col("n") - F.floor(share * col("n")))
    near = words.join(c.select("c", F.explode("cw").alias("word")), "word").select("id", "pos", "c").distinct()
    near = near.join(s.select("id", "pos", "w"), ["id", "pos"]).join(c, "c")
    hit = near.where(F.size(F.array_intersect("w", "cw")) > share * F.size("w")).select("id", "pos").distinct()
    return s.join(hit, ["id", "pos"], "left_anti").select("id", "sentence")


def closest_url(unknown: DataFrame, index: DataFrame) -> DataFrame:
    """(url, suggestion): for each unknown URL the first known one of its host."""
    host = lambda c: F.lower(F.regexp_extract(c, r"://([^/?#]+)", 1))
    known = index.select(host(col("url")).alias("h"), col("url").alias("k")).groupBy("h").agg(F.min("k").alias("suggestion"))
    return unknown.select("url", host(col("url")).alias("h")).distinct().join(known, "h", "left").select("url", "suggestion")


def citation_numbers(reports: DataFrame, token: str = r"\[\[([^\]]+)\]\]") -> DataFrame:
    """(id, token, number): cite tokens numbered by first use in each report."""
    d = reports.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(token), F.lit(1))).alias("pos", "token"))
    first = d.groupBy("id", "token").agg(F.min("pos").alias("pos"))
    order = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("o"))
    return order.select("id", F.posexplode("o").alias("k", "x")).select("id", "x.token", (col("k") + 1).alias("number"))


def unused_sources(index: DataFrame, reports: DataFrame) -> DataFrame:
    """Known URLs that no report mentions."""
    return index.select("url").distinct().join(urls_in(reports).select("url"), "url", "left_anti")
