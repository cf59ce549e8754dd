"""The stateful operators on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, at: str, width: str, late: str, *by: str, slide: str | None = None) -> DataFrame:
    """Counts by window of event time; rows later than `late` behind the newest are dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w.alias("window"), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def session_counts(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    s = stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def health(stream: DataFrame, key: str, at: str, success: str, alpha: float = 0.1, threshold: int = 2, cooldown_s: int = 1800, late: str = "10 minutes") -> DataFrame:
    """(key, ema, failures, state, updated): an average of successes and a breaker per key.

    The breaker opens after `threshold` failures in a row; once the watermark has passed
    its cooldown it is half-open, and the next event closes or opens it again.
    """
    kind = stream.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, ema double, failures long, state string, updated timestamp"

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, failures, breaker, updated = state.get if state.exists else (1.0, 0, "closed", pd.Timestamp(0))
        if state.hasTimedOut:
            breaker = "half_open" if breaker == "open" else breaker
        rows = pd.concat(list(batches)) if not state.hasTimedOut else pd.DataFrame(columns=[at, success])
        for t, ok in rows.sort_values(at)[[at, success]].itertuples(index=False):
            ema, updated = alpha * float(ok) + (1 - alpha) * ema, t
            failures = 0 if ok else failures + 1
            if ok and breaker in ("half_open", "closed"):
                breaker = "closed"
            elif not ok and (breaker == "half_open" or failures >= threshold):
                breaker = "open"
        updated = pd.Timestamp(updated)
        state.update((ema, failures, breaker, updated.to_pydatetime()))
        if breaker == "open":
            due = int(updated.timestamp() * 1000) + cooldown_s * 1000
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
        yield pd.DataFrame({key: [k[0]], "ema": [ema], "failures": [failures], "state": [breaker], "updated": [updated]})

    return stream.withWatermark(at, late).groupBy(key).applyInPandasWithState(fold, schema, "ema double, failures long, state string, updated timestamp", "update", GroupStateTimeout.EventTimeTimeout)
