"""Mixing sources to target weights by capped water-filling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut_running, discard, stash

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 2
SHARE = (3, 2)
SEED = 17


def water_level(sources: DataFrame, budget: float) -> float | None:
    """The level at which least(level * weight, cap) over sources(weight, cap) adds up to budget.

    Sources above their cap are clamped and the excess goes to the others by weight,
    again until none is above; a round is one small aggregate of one row per source.
    None: every source is at its cap.
    """
    level = 0.0
    while True:
        over = F.lit(level) * F.col("weight") > F.col("cap")
        row = sources.agg(F.sum(F.when(over, F.col("cap"))).alias("clamped"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            return None
        nxt = (budget - (row["clamped"] or 0)) / row["weight"]
        if nxt <= level:
            return level
        level = nxt


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: tuple[int, int] = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, extra, taken) for every row of docs.

    size: words of the text (null: 0). Sources in code point order, null last, take
    the weights in turn. target: the source's words in the mix. Every document is
    taken `epochs` whole times; one more repetition goes to documents in a seeded
    order until the source's target is met, of the last one only its first words
    (extra). taken = epochs * size + extra, at most max_epochs * size. Rows that
    repeat, null ids and empty texts are rows like others; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows, _ = stash(rows, "sizes")
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1).cast("long")
    # the window sees one narrow row per source
    sources, p1 = stash(rows.groupBy("source").agg(F.sum("size").alias("total")).withColumn("weight", weight).withColumn("cap", F.col("total") * max_epochs), "sources")
    budget = (sources.agg(F.sum("total")).first()[0] or 0) * share[0] / share[1]
    level = water_level(sources, budget)
    cap = F.col("cap").cast("double")
    target = cap if level is None else F.least(F.lit(level) * F.col("weight"), cap)
    plan = sources.withColumn("target", target).withColumn("whole", F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("left", F.floor(F.col("target") - F.col("whole") * F.col("total")).cast("long"))
    plan, p2 = stash(plan.select(F.col("source").alias("of"), F.col("total").alias("source_size"), "target", F.col("whole").alias("epochs"), "left"), "plan")
    discard(spark, p1)

    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    order = F.shiftleft(F.conv(F.substring(key, 1, 15), 16, 10).cast("long"), 2)
    d = cut_running(rows, F.col("source"), [order, F.col("doc_id"), F.col("size")], F.col("size"))
    d = d.join(plan, d["source"].eqNullSafe(plan["of"]))
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("left") - F.col("before")))
    d = d.withColumn("extra", extra).withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))
    return d.select("doc_id", "source", "size", "source_size", "target", "epochs", "extra", "taken")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT source, total, 2 * total AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS k FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest,
             (sum(total) OVER ())::DOUBLE * 3 / 2 AS budget FROM o),
l AS (SELECT (budget - below) / rest AS level FROM c WHERE ((budget - below) / rest) * weight <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, total, least((SELECT level FROM l) * weight, cap::DOUBLE) AS target FROM c),
p AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END::BIGINT AS epochs FROM t),
q AS (SELECT *, floor(target - epochs * total)::BIGINT AS rem FROM p),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':17'), 1, 15))::BIGINT, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
x AS (SELECT r.doc_id, r.source, size, total AS source_size, target, epochs, greatest(0, least(size, rem - before))::BIGINT AS extra FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, source, size, source_size, target, epochs, extra, epochs * size + extra AS taken FROM x
"""
