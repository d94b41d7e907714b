"""Structured Streaming forms: idempotent ingest, bursts, rate limits. Extras, not reference behaviour."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once_each(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are remembered for as long as late rows are let in."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def bursts(stream: DataFrame, key: str, at: str, quiet: str = "8 seconds", late: str = "1 minute") -> DataFrame:
    """(key, start, end, n): one row for each burst of requests, ended by a quiet gap."""
    made = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.session_window(at, quiet).alias("w"), key).agg(F.count("*").alias("n"))
    return made.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def hourly(stream: DataFrame, at: str, value: str, late: str = "10 minutes") -> DataFrame:
    """(start, n, total) of each hour."""
    made = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return made.select(F.col("w.start").alias("start"), "n", "total")


def throttled(stream: DataFrame, key: str, at: str, gap_seconds: float) -> DataFrame:
    """(key, at): rows at least gap_seconds after the last one let through; the state is one time for each key."""
    def let(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        kept = []
        rows = pd.concat(list(batches))
        for t in sorted(rows["at"].tolist()):
            if t - last >= gap_seconds:
                kept.append(t)
                last = t
        state.update((last,))
        yield pd.DataFrame({"key": [group[0]] * len(kept), "at": kept})

    rows = stream.select(F.col(key).cast("string").alias("key"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(let, "key string, at double", "last double", "append", GroupStateTimeout.NoTimeout)
