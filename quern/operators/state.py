"""State that folds over ordered events: averages, failures, breakers, novelty, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

col, lit = F.col, F.lit


def ema(events: DataFrame, key: str, order: list[str], value: Column, alpha: float, start: float) -> DataFrame:
    """(key, ema, n) after folding e = alpha * x + (1 - alpha) * e over each key's events in order; order begins with a time.

    The fold of a run of events is a pair, its decay and its sum, and runs join: each
    key's hours are folded apart, so that a hot key is dealt over its hours, and then the hours.
    """
    d = events.select(key, F.date_trunc("hour", col(order[0])).alias("__h"), value.cast("double").alias("x"), *order)
    d = d.withColumn("back", F.row_number().over(Window.partitionBy(key, "__h").orderBy(*[F.col(o).desc() for o in order])) - 1)
    weigh = lambda s, back: F.when(back * float(-np.log1p(-alpha)) < 42, s * F.pow(lit(1 - alpha), back)).otherwise(lit(0.0))  # noqa: E731  below 1e-18
    hours = d.groupBy(key, "__h").agg(F.count("*").alias("n"), F.sum(weigh(alpha * col("x"), col("back"))).alias("s"))
    after = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(F.desc("__h")).rowsBetween(Window.unboundedPreceding, -1)), lit(0))
    hours = hours.withColumn("after", after)
    return hours.groupBy(key).agg(F.round(F.sum(weigh(col("s"), col("after"))) + start * F.pow(lit(1 - alpha), F.sum("n")), 9).alias("ema"), F.sum("n").alias("n"))


def consecutive_failures(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """(key, failures): failures since the last success. Two aggregates, no window over a hot key."""
    at = F.struct(*order)
    d = events.select(key, at.alias("at"), failed.alias("failed"))
    last = d.where(~col("failed")).groupBy(key).agg(F.max("at").alias("ok"))
    return d.join(last, key, "left").groupBy(key).agg(F.count_if(col("failed") & (col("ok").isNull() | (col("at") > col("ok")))).alias("failures"))


def streaks(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Adds streak to each event: consecutive failures up to it, 0 at a success (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(*order)
    d = events.withColumn("__f", failed.cast("int")).withColumn("__g", F.sum(1 - col("__f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("streak", F.sum("__f").over(Window.partitionBy(key, "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("__f", "__g")


def breaker(events: DataFrame, key: str, order: list[str], failed: Column, threshold: int = 2) -> DataFrame:
    """(key, state, failures): open after `threshold` consecutive failures, closed by the next success; no time passes."""
    n = consecutive_failures(events, key, order, failed)
    return n.select(key, F.when(col("failures") >= threshold, "open").otherwise("closed").alias("state"), "failures")


def half_open_breaker(events: DataFrame, key: str, at: str, order: list[str], failed: Column, threshold: int = 2, base: int = 30, most: int = 120) -> DataFrame:
    """Adds state, failures, total, until to each event: a breaker that time half-opens.

    Closed until `threshold` consecutive failures; open until its cooldown is over, which
    doubles with every three failures so far, up to `most` minutes; then half-open, when a
    success closes it and a failure opens it anew. Keys are sorted, and each is folded
    row by row with a state of four values, so a hot key takes time but no memory.
    """
    out = StructType([*events.schema.fields, StructField("state", StringType()), StructField("failures", LongType()), StructField("total", LongType()), StructField("until", TimestampType())])
    d = events.withColumn("__f", F.coalesce(failed, lit(False))).repartition(col(key)).sortWithinPartitions(key, *order)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state, failures, total, until = object(), "closed", 0, 0, None
        for p in it:
            rows = []
            for k, t, f in zip(p[key], p[at], p["__f"], strict=True):
                if k != own:
                    own, state, failures, total, until = k, "closed", 0, 0, None
                if state == "open" and until is not None and t >= until:
                    state = "half_open"
                if f:
                    failures, total = failures + 1, total + 1
                    if state == "half_open" or state == "closed" and failures >= threshold:
                        state, until = "open", t + pd.Timedelta(minutes=min(most, base * 2 ** min(total // 3, 10)))
                else:
                    failures = 0
                    if state == "half_open":
                        state, until, total = "closed", None, max(0, total - 1)
                rows.append((state, failures, total, until))
            q = p.drop(columns="__f")
            for i, name in enumerate(("state", "failures", "total")):
                q[name] = [r[i] for r in rows]
            q["until"] = pd.to_datetime(pd.Series([r[3] for r in rows], index=p.index))
            yield q

    return d.mapInPandas(run, out)


def state_at(folded: DataFrame, key: str, order: list[str], now: Column) -> DataFrame:
    """(key, state, failures, until) of half_open_breaker() at a time: what is open is half-open once its cooldown is over."""
    last = folded.groupBy(key).agg(F.max_by(F.struct("state", "failures", "until"), F.struct(*order)).alias("x"))
    state = F.when((col("x.state") == "open") & (col("x.until") <= now), "half_open").otherwise(col("x.state"))
    return last.select(key, state.alias("state"), col("x.failures").alias("failures"), col("x.until").alias("until"))


def novelty(events: DataFrame, key: str, order: list[str], novel: Column, last: int = 20) -> DataFrame:
    """Adds novelty to each event: the share of novel ones among the last `last`."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - last, 0)
    return events.withColumn("novelty", F.sum(novel.cast("int")).over(w) / F.count("*").over(w))


def should_stop(cycles: DataFrame, key: str, order: str, least: float = 0.1) -> DataFrame:
    """Adds stop to cycles(novelty): this and the one before are below the least novelty."""
    w = Window.partitionBy(key).orderBy(order)
    return cycles.withColumn("stop", (col("novelty") < least) & F.coalesce(F.lag("novelty").over(w) < least, lit(False)))


def pagination_stop(page: Column, novelty_: Column, harvest: Column, most: int = 10) -> Column:
    return F.when(page >= most, "max_pages").when(novelty_ < 0.1, "novelty").when(harvest < 0.05, "harvest")


def daily_budget(events: DataFrame, key: str, at: str, limit: int) -> DataFrame:
    """(key, day, used, allowed): uses per day against a limit, 0 for none."""
    d = events.groupBy(key, F.to_date(at).alias("day")).agg(F.count("*").alias("used"))
    return d.withColumn("allowed", lit(limit == 0) | (col("used") < limit))


def timeline(events: DataFrame, key: str, at: str, kind: str) -> DataFrame:
    """A row per key: first and last event, events by kind of interest, and whether it was retracted."""
    return events.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("events"), F.count_if(col(kind) == "purchase").alias("confirmations"), F.max((col(kind) == "error").cast("int")).alias("retracted"))


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, start, end, events) of sessions with no pause of `gap` or more."""
    s = events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select(key, col("w.start").alias("start"), col("w.end").alias("end"), "events")


def tumbling(events: DataFrame, at: str, width: str, *by: str, slide: str | None = None) -> DataFrame:
    """(start, by..., n): counts by window of event time."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(col("w.start").alias("start"), *by, "n")
