"""Streaming forms: each takes an event stream (event_id, ts, user_id, event_type, ...) or a table
of events, and bounds its state by a watermark. The plans are the same but for unique clicks: a stream
forgets a click once the watermark has passed it by ``late`` and then counts another one, a table never does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.display import tracked_event


def event_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """New event files of a folder, in the schema of a stored table."""
    return spark.readStream.schema(like.schema).parquet(folder)


def _marked(events: DataFrame, late: str) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late)


def unique_clicks(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One click for each user and target within the watermark."""
    clicks = _marked(events, late).filter("event_type = 'click'")
    keys = ["user_id", "props"]
    return clicks.dropDuplicatesWithinWatermark(keys) if events.isStreaming else clicks.dropDuplicates(keys)


def tracking_events(hits: DataFrame) -> DataFrame:
    """Hits on tracking paths (ts, path) as ts, short_id, request_id, rank, kind; other paths go."""
    return hits.select("ts", *(c.alias(n) for n, c in tracked_event(F.col("path")).items())).filter("kind IS NOT NULL")


def unique_outbound_clicks(hits: DataFrame, late: str = "1 hour") -> DataFrame:
    """One outbound click for each short id, request and rank."""
    clicks = _marked(tracking_events(hits), late).filter("kind = 'outbound_click'")
    keys = ["short_id", "request_id", "rank"]
    return clicks.dropDuplicatesWithinWatermark(keys) if hits.isStreaming else clicks.dropDuplicates(keys)


def requests_per_second(events: DataFrame, limit: int = 1, late: str = "10 seconds") -> DataFrame:
    """Requests of each user and second, and whether they exceed the limit."""
    n = _marked(events, late).groupBy(F.window("ts", "1 second"), "user_id").agg(F.count("*").alias("requests"))
    return n.select(F.col("window.start").alias("second"), "user_id", "requests", (F.col("requests") > limit).alias("limited"))


def daily_trend(events: DataFrame, late: str = "1 hour") -> DataFrame:
    n = _marked(events, late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    n = _marked(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return n.select(F.col("session_window.start").alias("started_at"), "user_id", "n")
