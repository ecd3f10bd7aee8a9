"""Streams beside the batch operators: error rates over event time, profiles that grow with mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_rate(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """window start, kind, n, mean of value; events: ts, event_type, value.  Later events than `late` are dropped."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    windowed = events.withWatermark("ts", late) if events.isStreaming else events
    out = windowed.groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, session start and end, events in it."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    windowed = events.withWatermark("ts", late) if events.isStreaming else events
    out = windowed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def growing_profiles(mentions: DataFrame) -> DataFrame:
    """doc_id, docid, first_seen_id, n_mentions, as far as mentions have come (update mode)."""
    return mentions.groupBy("doc_id", "docid").agg(F.min("mention_id").alias("first_seen_id"), F.count(F.lit(1)).alias("n_mentions"))
