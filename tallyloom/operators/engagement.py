"""Exposure attribution, engagement metrics and affinity counters from interaction events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXPOSURE_KEY = ["user_id", "session_id", "promotion_id", "feed", "source_group", "deal_source", "ranking_version"]
OPENED = ("deal_card_opened", "deal_card_clicked")
REDEEMED = ("fast_redeem_clicked", "redeem_clicked")
#: What each kind of event adds to an affinity score.
AFFINITY_WEIGHTS = {"views": 1, "clicks": 8, "saves": 30, "fast_redeems": 20, "searches": 18, "ignored": -3}
KIND_OF_EVENT = {
    "feed_impression": "views",
    "deal_card_opened": "clicks",
    "deal_saved": "saves",
    "fast_redeem_clicked": "fast_redeems",
    "redeem_clicked": "fast_redeems",
    "search_submitted": "searches",
    "not_interested": "ignored",
}


def since(at: str, as_of: Column, days: int) -> Column:
    return F.col(at) >= as_of - F.expr(f"interval {days} days")


def tagged(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Recent events with a source group and a ranking version."""
    return events.where(since("created_at", as_of, days) & F.col("source_group").isin("email", "public") & F.col("ranking_version").isNotNull()).withColumn("feed", F.col("context"))


def exposures(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The earliest impression of each user, session, offer, feed, source and version; ties go to the smaller id."""
    shown = tagged(events, as_of, days).where((F.col("event_type") == "feed_impression") & F.col("feed").isin("for_you", "near_me"))
    row = F.struct("created_at", "id", "rank_position", "event_sequence")
    return shown.groupBy(*EXPOSURE_KEY).agg(F.min(row).alias("first")).select(*EXPOSURE_KEY, "first.id", "first.created_at", "first.rank_position", "first.event_sequence")


def attribute_actions(events: DataFrame, shown: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Each action with its latest matching exposure; one without a feed needs an exposure that came before it."""
    keys = ["user_id", "session_id", "promotion_id", "source_group", "deal_source", "ranking_version"]
    acts = tagged(events, as_of, days).where("event_type <> 'feed_impression'").select(*keys, "feed", "event_type", "created_at", "event_sequence", "id")
    seen = shown.select(*keys, F.col("feed").alias("shown_feed"), F.col("event_sequence").alias("shown_sequence"), F.col("id").alias("exposure_id"))
    fits = (F.col("feed") == F.col("shown_feed")) | (F.col("feed").isNull() & (F.col("shown_sequence") <= F.col("event_sequence")))
    pairs = acts.join(seen, keys).where(fits)
    return pairs.groupBy("id", "event_type", "created_at", "event_sequence").agg(F.max_by("exposure_id", F.struct("shown_sequence", "exposure_id")).alias("exposure_id"))


def deal_source_metrics(shown: DataFrame, actions: DataFrame) -> DataFrame:
    """Counts and rates of what happened to exposures, by version, feed, source and position band."""
    channel = F.col("event_type").isin("not_interested", "not_interested_undone")
    outcomes = actions.groupBy("exposure_id").agg(
        F.bool_or(F.col("event_type").isin(*OPENED)).alias("opened"),
        F.bool_or(F.col("event_type") == "deal_saved").alias("saved"),
        F.bool_or(F.col("event_type").isin(*REDEEMED)).alias("intent"),
        (F.max(F.when(channel, F.struct("event_sequence", "id", "event_type")))["event_type"] == "not_interested").alias("dismissed"),
    )
    band = F.when(F.col("rank_position") <= 3, "1-3").when(F.col("rank_position") <= 7, "4-7").otherwise("8-10")
    rows = shown.join(outcomes, shown["id"] == outcomes["exposure_id"], "left").withColumn("position_band", band)
    rate = lambda c: F.round(100.0 * F.count_if(F.col(c)) / F.count("*"), 1)
    return rows.groupBy("ranking_version", "feed", "source_group", "deal_source", "position_band").agg(
        F.count("*").alias("viewed_deals"),
        F.countDistinct("user_id").alias("users"),
        F.count_if("opened").alias("opened_deals"),
        F.count_if("saved").alias("saved_deals"),
        F.count_if("dismissed").alias("dismissed_deals"),
        F.count_if("intent").alias("redemption_intents"),
        rate("opened").alias("open_rate_pct"),
        rate("saved").alias("save_rate_pct"),
        rate("dismissed").alias("dismiss_rate_pct"),
        rate("intent").alias("redemption_intent_rate_pct"),
    )


def ingestion_yield(connections: DataFrame, jobs: DataFrame, deals: DataFrame, as_of: Column) -> DataFrame:
    """One row: connected users, what their latest completed syncs found, and who has eligible deals."""
    latest = jobs.where("status = 'completed'").groupBy("user_id").agg(F.max_by(F.struct("messages_seen", "deals_extracted"), "finished_at").alias("job"))
    latest = latest.select("user_id", F.lit(1).alias("synced"), "job.*")
    fine = (F.col("status") == "active") & (F.col("personal_rank_score") >= 70) & since("received_at", as_of, 14) & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    eligible = deals.where(fine).groupBy("user_id").agg(F.count("*").alias("deals"))
    rows = connections.where("status = 'connected'").select("user_id").join(latest, "user_id", "left").join(eligible, "user_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        F.count("*").alias("connected_users"),
        F.count("synced").alias("users_synced"),
        total("messages_seen").alias("messages_in_latest_syncs"),
        total("deals_extracted").alias("candidates_in_latest_syncs"),
        F.count("deals").alias("users_with_eligible_email_deals"),
        total("deals").alias("eligible_email_deals"),
    )


def dashboard_totals(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One row: users, and opens, saves, redeems and their rates in the look-back."""
    recent = since("created_at", as_of, days)
    n = lambda *kinds: F.count_if(recent & F.col("event_type").isin(*kinds))
    rate = lambda a, b: F.round(F.try_divide(a * F.lit(100.0), b), 1)
    opens, saves, redeems = n("deal_card_opened"), n("deal_saved"), n(*REDEEMED)
    return events.agg(
        F.count("*").alias("total_rows"),
        F.countDistinct("user_id").alias("total_users"),
        F.countDistinct(F.when(since("created_at", as_of, 7), F.col("user_id"))).alias("active_users"),
        opens.alias("opens"),
        saves.alias("saves"),
        redeems.alias("redeems"),
        rate(saves, opens).alias("save_rate_pct"),
        rate(redeems, opens).alias("redeem_rate_pct"),
    )


def sessions_per_day(events: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Distinct sessions of each of the last days, with zeros."""
    day = F.to_date("created_at")
    seen = events.where(since("created_at", as_of, days)).groupBy(day.alias("day")).agg(F.countDistinct("session_id").alias("n"))
    calendar = events.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(as_of) - F.expr(f"interval {days - 1} days"), F.to_date(as_of))).alias("day"))
    return calendar.join(seen, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("sessions"))


def top_opened(events: DataFrame, by: list[str], as_of: Column, limit: int, days: int = 30) -> DataFrame:
    """The values of `by` with most opened cards; ties in the order of the values."""
    opened = events.where(since("created_at", as_of, days) & (F.col("event_type") == "deal_card_opened"))
    for c in by:
        opened = opened.where(F.col(c).isNotNull())
    return opened.groupBy(*by).agg(F.count("*").alias("opens")).orderBy(F.desc("opens"), *by).limit(limit)


def affinity(events: DataFrame, by: str, strict_upsert: bool = False) -> DataFrame:
    """Counts of each kind of event and their weighted score, per user and brand or category.

    A category has no count of its own for fast redeems, which count as saves. strict_upsert: a key with one call has
    score 0, as an insert sets it and only an update computes it.
    """
    kinds = dict(KIND_OF_EVENT)
    names = list(AFFINITY_WEIGHTS)
    if by == "category":
        kinds = {e: "saves" if k == "fast_redeems" else k for e, k in kinds.items()}
        names.remove("fast_redeems")
    rows = events.where(F.col(by).isNotNull() & F.col("event_type").isin(*kinds))
    count = {n: F.count_if(F.col("event_type").isin(*[e for e, k in kinds.items() if k == n])) for n in names}
    score = sum((c * AFFINITY_WEIGHTS[n] for n, c in count.items()), F.lit(0))
    if strict_upsert:
        score = F.when(F.count("*") > 1, score).otherwise(0)
    return rows.groupBy("user_id", by).agg(*(c.alias(n) for n, c in count.items()), score.cast("long").alias("affinity_score"))


def query_counts(searches: DataFrame) -> DataFrame:
    """How often each query, trimmed and in lower case, was sent, and how often it found nothing."""
    return searches.groupBy(F.lower(F.trim("query")).alias("query")).agg(F.count("*").alias("searches"), F.count_if("no_result").alias("failed"))


def recent_queries(searches: DataFrame, most: int = 10) -> DataFrame:
    """Each user's latest different queries of two characters or more, newest first."""
    clean = searches.withColumn("query", F.trim("query")).where(F.length("query") >= 2)
    latest = clean.groupBy("user_id", "query").agg(F.max(F.struct("created_at", "id")).alias("last"))
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last"), "query"))
    return latest.withColumn("place", turn).where(F.col("place") <= most).select("user_id", "query", "place")


def failed_queries(searches: DataFrame, most: int = 50) -> DataFrame:
    """Each user's last different failed queries, in the order of their first failure."""
    bad = searches.where("no_result").withColumn("query", F.lower(F.trim("query")))
    first = bad.groupBy("user_id", "query").agg(F.min(F.struct("created_at", "id")).alias("first"))
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("first"), "query"))
    return first.withColumn("back", turn).where(F.col("back") <= most).select("user_id", "query", "back")


def interaction_state(events: DataFrame) -> DataFrame:
    """Per user and offer: what has been seen, clicked, redeemed, and the latest save and dismissal state."""
    latest = lambda *kinds: F.max(F.when(F.col("event_type").isin(*kinds), F.struct("event_sequence", "id", "event_type")))["event_type"]
    return events.groupBy("user_id", "promotion_id").agg(
        F.count_if(F.col("event_type") == "feed_impression").alias("impressions"),
        F.count_if(F.col("event_type").isin(*OPENED)).alias("clicks"),
        F.bool_or(F.col("event_type").isin(*REDEEMED)).alias("redeemed"),
        F.coalesce(latest("deal_saved", "deal_unsaved") == "deal_saved", F.lit(False)).alias("saved"),
        F.coalesce(latest("not_interested", "not_interested_undone") == "not_interested", F.lit(False)).alias("dismissed"),
    )


def last_active(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("created_at").alias("last_active_at"))


def feedback_export(events: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """The events that preferences are learned from, with their metadata as JSON."""
    kinds = ("deal_saved", "deal_unsaved", "not_interested", "not_interested_undone")
    meta = F.to_json(F.struct("event_sequence", "source_group"))
    return events.where(F.col("event_type").isin(*kinds) & since("created_at", as_of, days)).select("id", "user_id", "promotion_id", "event_type", "created_at", meta.alias("metadata")).orderBy("created_at", "id")
