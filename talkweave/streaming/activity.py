"""Live activity over event time: tumbling, sliding and session windows.

Rows later than the watermark are dropped; within it the counts equal the batch counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(messages: DataFrame, lateness: str) -> DataFrame:
    return messages.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness)


def _counts(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("message_count"))


def _flat(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.select(
        *keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "message_count"
    )


def hourly_counts(messages: DataFrame, lateness: str = "1 day") -> DataFrame:
    window = F.window("event_time", "1 hour")
    return _flat(_counts(_timed(messages, lateness).groupBy("workspace_id", window)), "workspace_id")


def weekly_counts(messages: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Weeks from Monday; the epoch was a Thursday, hence the offset of four days."""
    window = F.window("event_time", "7 days", "7 days", "4 days")
    return _flat(_counts(_timed(messages, lateness).groupBy("workspace_id", window)), "workspace_id")


def sliding_counts(messages: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Last hour of activity, refreshed every quarter of an hour."""
    window = F.window("event_time", "1 hour", "15 minutes")
    return _flat(_counts(_timed(messages, lateness).groupBy("workspace_id", window)), "workspace_id")


def session_counts(messages: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Sessions closed by more than 30 quiet minutes.

    Unlike the batch rule the gap counts from the last message, not from the first of the
    turn.
    """
    window = F.session_window("event_time", gap).alias("window")
    return _flat(_counts(_timed(messages, lateness).groupBy("workspace_id", window)), "workspace_id")
