"""Streaming forms of the counters, states and filters that keep up with events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.joins import shared_folder
from tallyloom.operators import engagement

C = F.col


def stream_affinity(events: DataFrame, by: str) -> DataFrame:
    """Running counts and score of each user and brand (or category); state grows with their number."""
    return engagement.affinity(events, by)


def stream_impression_dedup(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """One impression of each user, session, feed, source and offer within the watermark."""
    shown = events.where((C("event_type") == "feed_impression") & C("context").isNotNull())
    return shown.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["user_id", "session_id", "context", "source_group", "promotion_id"])


def stream_capture_dedup(captures: DataFrame, delay: str = "90 days", known: DataFrame | None = None) -> DataFrame:
    """Captures whose text is new for their brand. A hash is kept as state until the watermark (the latest time seen, less the
    delay) has passed its first capture by the delay too, so state holds the hashes of a bounded time; older ones are told
    apart by known, the stored (brand, content_hash) of captures before. Null texts of a brand count as one text."""
    d = captures.withColumn("content_hash", F.sha2("text", 256))
    if known is not None:
        old = known.select(C("brand").alias("_brand"), C("content_hash").alias("_hash")).distinct()
        d = d.join(old, C("brand").eqNullSafe(C("_brand")) & C("content_hash").eqNullSafe(C("_hash")), "left_anti")
    return d.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(["brand", "content_hash"])


def stream_preference_state(events: DataFrame) -> DataFrame:
    """Saved and dismissed per user and offer, by the greatest sequence of each channel, in whatever order events come."""
    latest = lambda *kinds: F.max(F.when(C("event_type").isin(*kinds), F.struct("event_sequence", "event_type")))["event_type"]
    return events.where(C("event_type").isin("deal_saved", "deal_unsaved", "not_interested", "not_interested_undone")).groupBy("user_id", "promotion_id").agg(F.coalesce(latest("deal_saved", "deal_unsaved") == "deal_saved", F.lit(False)).alias("saved"), F.coalesce(latest("not_interested", "not_interested_undone") == "not_interested", F.lit(False)).alias("dismissed"))


def stream_sessions_per_day(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Events and distinct sessions of each day, exact, once the watermark has passed the day (append mode).

    The first step counts the events of each session and day, the second the sessions and events of each day, both under
    one watermark, so a busy day is many keys of the first step and a few partial rows of the second. Null sessions are one."""
    seen = events.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day"), "session_id").agg(F.count("*").alias("n"))
    days = seen.groupBy(F.window(F.window_time("window"), "1 day")).agg(F.sum("n").alias("events"), F.count("*").alias("sessions"))
    return days.select(C("window.start").alias("day"), "events", "sessions")


def stream_last_active(events: DataFrame) -> DataFrame:
    return engagement.last_active(events)


def run_now(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there (availableNow) and return what it has written; mode: complete or append."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/out"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").outputMode(mode)
    if mode == "complete":
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    else:
        writer = writer.format("parquet").option("path", out)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
