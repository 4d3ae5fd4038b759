"""Reviews, change batches and version diffs over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States that hide a finding.
SUPPRESSING = ("false-positive", "dismissed")


def latest_decisions(events: DataFrame, key: str = "identity", time: str = "at", state: str = "state") -> DataFrame:
    """One row per finding: the newest decision; at one time, one that doesn't suppress wins."""
    w = Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(state).isin(*SUPPRESSING).asc(), F.col(state).asc())
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").withColumn("suppressed", F.col(state).isin(*SUPPRESSING))


def debounced(events: DataFrame, key: str, time: str, quiet_seconds: int) -> DataFrame:
    """(key, began, ended, n): batches of events with no gap of quiet_seconds or more inside."""
    events = events.select(key, F.col(time).cast("timestamp").alias(time))
    w = Window.partitionBy(key).orderBy(time)
    gap = F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))
    first = F.when(gap.isNull() | (gap >= quiet_seconds * 1_000_000), 1).otherwise(0)
    numbered = events.select(key, time, first.alias("__f")).withColumn("__b", F.sum("__f").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__b").agg(F.min(time).alias("began"), F.max(time).alias("ended"), F.count("*").alias("n")).drop("__b")


def net_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key and net: insertions minus deletions, where they don't cancel out."""
    both = after.select(*key, F.lit(1).alias("v")).unionByName(before.select(*key, F.lit(-1).alias("v")))
    return both.groupBy(*key).agg(F.sum("v").alias("net")).where("net <> 0")
