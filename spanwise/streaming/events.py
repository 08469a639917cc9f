"""Streaming forms of batch operators, for event streams with a time column; they run on batches too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, keys: list[str], time: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by key and tumbling or sliding window; a window is final once the watermark has passed it."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    counted = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of events with no longer silence than `gap`: the streaming form of runs with bridged gaps."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *keys)
    return s.agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *keys, "n")


def first_of_each(events: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark, with a state that does not grow without bound."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def histogram(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running counts by key and value rounded half to even."""
    return events.groupBy(*keys, F.bround(value).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
