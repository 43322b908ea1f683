"""Streams over the test tables, run to their end, with the SQL of the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.domain import DOMAIN, ctes
from tallyloom.plans.engagement import ORACLE_SQL as ENGAGEMENT
from tallyloom.streaming import jobs

C = F.col

# The streams read a pattern, not a path: a table may be one file, which a stream takes only by a pattern.


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", C("ts").cast("timestamp"))
    return spark.sql(DOMAIN["interactions"].replace("from events", "from {events}"), events=rows)


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/document[s].parquet").select("doc_id", C("source").alias("brand"), "text", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 30 as int))").alias("scraped_at"))


QUERIES = {
    "stream_brand_affinity": lambda s, d: jobs.run_now(jobs.stream_affinity(_events(s, d), "brand"), "complete"),
    "stream_category_affinity": lambda s, d: jobs.run_now(jobs.stream_affinity(_events(s, d), "category"), "complete"),
    "stream_impression_dedup": lambda s, d: jobs.run_now(jobs.stream_impression_dedup(_events(s, d), "60 days"), "append").select("user_id", "session_id", "context", "source_group", "promotion_id"),
    "stream_capture_dedup": lambda s, d: jobs.run_now(jobs.stream_capture_dedup(_captures(s, d)), "append").select("brand", "content_hash"),
    "stream_preference_state": lambda s, d: jobs.run_now(jobs.stream_preference_state(_events(s, d)), "complete"),
    "stream_sessions_per_day": lambda s, d: jobs.run_now(jobs.stream_sessions_per_day(_events(s, d)), "append").select(C("day").cast("date").alias("day"), "events", "sessions"),
    "stream_last_active": lambda s, d: jobs.run_now(jobs.stream_last_active(_events(s, d)), "complete").select("user_id", C("last_active_at").cast("timestamp_ntz").alias("last_active_at")),
}

ORACLE_SQL = {
    "stream_brand_affinity": ENGAGEMENT["brand_affinity"],
    "stream_category_affinity": ENGAGEMENT["category_affinity"],
    "stream_impression_dedup": f"{ctes('interactions')} select distinct user_id, session_id, context, source_group, promotion_id from interactions where event_type = 'feed_impression' and context is not null",
    "stream_capture_dedup": "select distinct source as brand, sha256(text) as content_hash from documents",
    "stream_preference_state": f"""{ctes('interactions')} select user_id, promotion_id, coalesce(arg_max(event_type, event_sequence) filter (where event_type in ('deal_saved', 'deal_unsaved')) = 'deal_saved', false) as saved,
  coalesce(arg_max(event_type, event_sequence) filter (where event_type in ('not_interested', 'not_interested_undone')) = 'not_interested', false) as dismissed
from interactions where event_type in ('deal_saved', 'deal_unsaved', 'not_interested', 'not_interested_undone') group by 1, 2""",
    "stream_sessions_per_day": f"{ctes('interactions')} select cast(created_at as date) as day, count(*) as events, count(distinct session_id) as sessions from interactions group by 1 having cast(created_at as date) + interval 3 day <= (select max(created_at) from interactions)",
    "stream_last_active": ENGAGEMENT["last_active"],
}
