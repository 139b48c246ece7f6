"""Coverage and events as streams: Structured Streaming forms of the batch aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_hits(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Hits of each file and hour from a stream of (ts, file, hit); late rows up to ``lateness`` count."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("hour"), "file").agg(F.sum(F.col("hit").cast("long")).alias("hits"))


def statuses(results: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Mutant outcomes by hour and status from a stream of (ts, status)."""
    return results.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("hour"), "status").agg(F.count("*").alias("n"))
