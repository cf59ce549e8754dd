"""Calibration, health and budget scores as columns and small aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iteration import drop, settle
from .views import exact_sum

col, lit = F.col, F.lit


def brier(samples: DataFrame, *by: str) -> DataFrame:
    """Mean squared error of samples(p, y); null without samples."""
    d = samples.select(*by, ((col("p") - col("y")) * (col("p") - col("y"))).alias("e"))
    return d.groupBy(*by).agg(F.when(F.count("*") > 0, F.round(exact_sum("e") / F.count("*"), 9)).alias("brier"))


def reliability(samples: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, accuracy, confidence) with bins (lo, hi]; empty bins are zeros, a prediction of exactly 0 falls in none."""
    d = samples.where("p > 0").select(F.least(lit(bins), F.ceil(F.round(col("p") * bins, 9))).cast("int").alias("bin"), "p", "y")
    got = d.groupBy("bin").agg(F.count("*").alias("n"), exact_sum("y").alias("hits"), exact_sum("p").alias("mass"))
    all_bins = samples.sparkSession.range(1, bins + 1).select(col("id").cast("int").alias("bin"))
    z = lambda c: F.coalesce(F.round(c, 9), lit(0.0))
    return all_bins.join(F.broadcast(got), "bin", "left").select("bin", F.coalesce("n", lit(0)).alias("n"), z(col("hits") / col("n")).alias("accuracy"), z(col("mass") / col("n")).alias("confidence"))


def ece(samples: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error: gaps of the bins, weighted by all samples."""
    r = reliability(samples, bins)
    n = samples.agg(F.count("*").alias("total"))
    gap = F.abs(col("accuracy") - col("confidence")) * col("n")
    return r.agg(exact_sum(gap).alias("g")).crossJoin(n).select(F.when(col("total") > 0, F.round(col("g") / col("total"), 6)).alias("ece"))


def platt(samples: DataFrame, steps: int = 100, rate: float = 0.01) -> tuple[float, float]:
    """(A, B) of p = sigmoid(A * logit + B) by gradient descent; each step is one aggregate over the distinct samples(logit, y)."""
    a = b = 0.0
    s, n = distinct_samples(samples)
    for _ in range(steps if n else 0):
        e = (1 / (1 + F.exp(-(a * col("logit") + b))) - col("y")) * col("n")
        g = s.agg(F.sum(e * col("logit")).alias("a"), F.sum(e).alias("b")).first()
        a, b = a - rate * g["a"] / n, b - rate * g["b"] / n
    drop(s)
    return a, b


def distinct_samples(samples: DataFrame) -> tuple[DataFrame, int]:
    """samples(logit, y) counted, settled, so that no step reads the source again; and how many there are."""
    s = settle(samples.groupBy("logit", "y").agg(F.count("*").alias("n")), "samples")
    return s, s.agg(F.sum("n")).first()[0] or 0


def temperature(samples: DataFrame, steps: int = 50, rate: float = 0.1) -> float:
    """T of p = sigmoid(logit / T), kept within 0.1 and 10."""
    t = 1.0
    s, n = distinct_samples(samples)
    for _ in range(steps if n else 0):
        e = (1 / (1 + F.exp(-col("logit") / t)) - col("y")) * col("n")
        g = s.agg(F.sum(e * -col("logit") / (t * t)).alias("g")).first()["g"] / n
        t = min(10.0, max(0.1, t - rate * g))
    drop(s)
    return t


def logit(p: Column) -> Column:
    c = F.least(F.greatest(p, lit(1e-10)), lit(1 - 1e-10))
    return F.ln(c / (1 - c))


def calibrate(p: Column, a: Column, b: Column) -> Column:
    """The calibrated probability; p itself where a parameter is missing."""
    return F.when(a.isNull() | b.isNull(), p).otherwise(1 / (1 + F.exp(-(a * logit(p) + b))))


def engine_weight(base: Column, s1h: Column, s24h: Column, captcha: Column, latency_ms: Column, hours_since_use: Column) -> Column:
    """Health-adjusted weight within 0.1 and 1; old metrics fade towards the base over 48 hours."""
    trust = F.coalesce(F.greatest(lit(0.1), 1.0 - hours_since_use / 48), lit(0.1))
    raw = base * (0.6 * s1h + 0.4 * s24h) * (1.0 - captcha * 0.5) * (1.0 / (1.0 + latency_ms / 1000.0))
    return F.greatest(lit(0.1), F.least(lit(1.0), trust * raw + (1 - trust) * base))


def satisfaction(sources: Column, primary: Column) -> Column:
    return F.least(lit(1.0), F.least(lit(1.0), sources / 3) * 0.7 + F.when(primary, lit(0.3)).otherwise(lit(0.0)))


def search_status(score: Column, novelty: Column, pages: Column, sources: Column, before: Column) -> Column:
    """Status of a search: skipped stays; what meets no condition keeps its status."""
    return (
        F.when(before == "skipped", before).when(score >= 0.8, "satisfied").when(sources > 0, "partial")
        .when((novelty < 0.1) & (pages > 10), "exhausted").otherwise(before)
    )


def freshness_penalty(age_days: Column) -> Column:
    """Piecewise linear from 0 at a week to 1 at three years."""
    d = age_days
    return (
        F.when(d < 7, lit(0.0))
        .when(d < 30, 0.2 * (d - 7) / 23)
        .when(d < 180, 0.2 + 0.3 * (d - 30) / 150)
        .when(d < 365, 0.5 + 0.2 * (d - 180) / 185)
        .otherwise(F.least(lit(1.0), 0.7 + 0.3 * F.least((d - 365) / 730, lit(1.0))))
    )


def with_freshness(confidence: Column, penalty: Column, weight: float = 0.5) -> Column:
    return F.when(penalty <= 0, confidence).otherwise(F.greatest(lit(0.0), F.least(lit(1.0), confidence * (1.0 - weight * penalty))))


# Boosts of sitemap entries by change frequency.
CHANGE_BOOST = {"always": 0.3, "hourly": 0.25, "daily": 0.2, "weekly": 0.1, "monthly": 0.05}


def sitemap_score(priority: Column, age_days: Column, changefreq: Column) -> Column:
    boost = F.create_map(*[x for k, v in CHANGE_BOOST.items() for x in (lit(k), lit(v))])
    recent = F.when(age_days < 7, 0.2).when(age_days < 30, 0.1).otherwise(0.0)
    return F.least(lit(1.0), priority + recent + F.coalesce(boost[F.lower(changefreq)], lit(0.0)))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(lit(most), base * F.pow(lit(2.0), attempt))


def total_backoff(attempts: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Sum of the delays of the first `attempts` retries."""
    return F.when(attempts > 0, F.aggregate(F.sequence(lit(0), attempts - 1), lit(0.0), lambda s, k: s + backoff(k, base, most))).otherwise(lit(0.0))


def cooldown_minutes(failures: Column, base: int = 30, most: int = 120) -> Column:
    return F.least(lit(most), base * F.pow(lit(2), F.least(F.floor(failures / 3), lit(10)))).cast("int")


def ucb(arms: DataFrame, constant: float = math.sqrt(2)) -> DataFrame:
    """Adds score to arms(reward, pulls, boost): mean reward plus exploration, times the boost; infinite unplayed.

    The total is one aggregate of all arms, joined back as a single row.
    """
    total = arms.agg(F.sum("pulls").alias("__total"))
    mean = col("reward") / col("pulls")
    extra = F.when(col("__total") > 0, constant * F.sqrt(F.ln(col("__total")) / col("pulls"))).otherwise(lit(0.0))
    d = arms.crossJoin(F.broadcast(total))
    return d.withColumn("score", F.when(col("pulls") == 0, lit(float("inf"))).otherwise((mean + extra) * col("boost"))).drop("__total")


def allocate(scored: DataFrame, budget: int, least: int = 5, share_cap: float = 0.4) -> DataFrame:
    """Adds budget: proportional to the score, capped, never under the minimum, which may exceed the total; the excess is exposed."""
    finite = F.when(col("score") < float("inf"), col("score"))
    top = scored.agg(F.max(finite).alias("__m"))
    d = scored.crossJoin(F.broadcast(top)).withColumn("__s", F.coalesce(finite, 2 * F.coalesce(col("__m"), lit(1.0))))
    sums = d.agg(F.sum("__s").alias("__t"))
    got = F.greatest(lit(least), F.least(F.floor(lit(budget) * col("__s") / col("__t")), lit(int(budget * share_cap)))).cast("long")
    return d.crossJoin(F.broadcast(sums)).withColumn("budget", got).drop("__m", "__s", "__t")


def verification_outcome(refutes: Column, sources: Column) -> Column:
    return F.when(refutes > 0, "pending").when(sources >= 2, "verified").otherwise("pending")


def auto_block(category: Column, rejected: Column, total: Column) -> Column:
    return category.isin("unverified", "low") & (rejected >= 3) & (rejected / F.greatest(total, lit(1)) > 0.3)


def llm_budget(llm_s: Column, elapsed_s: Column, estimate_s: Column, share: float = 0.30) -> Column:
    """Whether an LLM call fits: while the run is short, or while LLM time stays within its share."""
    after = elapsed_s + estimate_s
    return (after < 30) | ((llm_s + estimate_s) / after <= share)


def last_valid(versions: DataFrame, worst: float = 0.05) -> DataFrame:
    """Adds rolled_back to versions(source, version, brier): its error rose by more than that share over the version before."""
    was = F.lag("brier").over(Window.partitionBy("source").orderBy("version"))
    return versions.withColumn("rolled_back", F.coalesce(col("brier") > was * (1 + worst), lit(False)))
