"""Engagement queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import engagement as op
from tallyloom.plans.domain import AS_OF, ctes, domain


def now():
    """The time of every job, as a column."""
    return F.expr(AS_OF)


def _events(spark, sf_dir):
    return domain(spark, sf_dir, "interactions")


def _exposures(spark, sf_dir):
    return op.exposures(_events(spark, sf_dir), now())


def _actions(spark, sf_dir):
    events = _events(spark, sf_dir)
    return op.attribute_actions(events, op.exposures(events, now()), now())


def _metrics(spark, sf_dir):
    events = _events(spark, sf_dir)
    shown = op.exposures(events, now())
    return op.deal_source_metrics(shown, op.attribute_actions(events, shown, now()))


def _yield(spark, sf_dir):
    users = domain(spark, sf_dir, "users")
    connections = users.select("user_id", F.when(F.col("user_id") % 3 == 0, "revoked").otherwise("connected").alias("status"))
    jobs = domain(spark, sf_dir, "interactions").select("user_id", F.when(F.col("id") % 4 == 0, "failed").otherwise("completed").alias("status"), F.col("created_at").alias("finished_at"), (F.col("id") % 50).alias("messages_seen"), (F.col("id") % 7).alias("deals_extracted"))
    deals = domain(spark, sf_dir, "interactions").select("user_id", F.when(F.col("id") % 5 == 0, "suppressed").otherwise("active").alias("status"), (F.col("id") % 100).alias("personal_rank_score"), F.col("created_at").alias("received_at"), F.when(F.col("id") % 2 == 0, F.col("created_at") + F.expr("interval 9 days")).alias("expires_at"))
    return op.ingestion_yield(connections, jobs, deals, now())


QUERIES = {
    "exposures": _exposures,
    "attribute_actions": _actions,
    "deal_source_metrics": _metrics,
    "ingestion_yield": _yield,
    "dashboard_totals": lambda s, d: op.dashboard_totals(_events(s, d), now()),
    "sessions_per_day": lambda s, d: op.sessions_per_day(_events(s, d), now()),
    "top_opened_brands": lambda s, d: op.top_opened(_events(s, d), ["brand"], now(), 10),
    "top_opened_categories": lambda s, d: op.top_opened(_events(s, d), ["category"], now(), 8),
    "top_opened_offers": lambda s, d: op.top_opened(_events(s, d), ["promotion_id", "brand"], now(), 10),
    "brand_affinity": lambda s, d: op.affinity(_events(s, d), "brand"),
    "brand_affinity_strict": lambda s, d: op.affinity(_events(s, d), "brand", strict_upsert=True),
    "category_affinity": lambda s, d: op.affinity(_events(s, d), "category"),
    "query_counts": lambda s, d: op.query_counts(domain(s, d, "searches")),
    "recent_queries": lambda s, d: op.recent_queries(domain(s, d, "searches")),
    "failed_queries": lambda s, d: op.failed_queries(domain(s, d, "searches")),
    "interaction_state": lambda s, d: op.interaction_state(_events(s, d)),
    "last_active": lambda s, d: op.last_active(_events(s, d)),
    "feedback_export": lambda s, d: op.feedback_export(_events(s, d), now()).select("id", "user_id", "promotion_id", "event_type", "created_at", "metadata"),
}

_TAGGED = f"""
tagged as (
  select *, context as feed from interactions
  where created_at >= {AS_OF} - interval 30 day and source_group in ('email', 'public') and ranking_version is not null
), shown as (
  select distinct on (user_id, session_id, promotion_id, feed, source_group, deal_source, ranking_version)
    user_id, session_id, promotion_id, feed, source_group, deal_source, ranking_version, id, created_at, rank_position, event_sequence
  from tagged where event_type = 'feed_impression' and feed in ('for_you', 'near_me')
  order by user_id, session_id, promotion_id, feed, source_group, deal_source, ranking_version, created_at, id
), acts as (
  select id, event_type, created_at, event_sequence, exposure_id from (
    select e.id, e.event_type, e.created_at, e.event_sequence, x.id as exposure_id,
      row_number() over (partition by e.id order by x.event_sequence desc, x.id desc) as rn
    from tagged e join shown x using (user_id, session_id, promotion_id, source_group, deal_source, ranking_version)
    where e.event_type <> 'feed_impression' and (e.feed is null or e.feed = x.feed) and (e.feed is not null or x.event_sequence <= e.event_sequence)
  ) where rn = 1
)"""

_COUNTS = """
    count(*) filter (where event_type = 'feed_impression') as views,
    count(*) filter (where event_type = 'deal_card_opened') as clicks,
    {saves} as saves, {redeems}
    count(*) filter (where event_type = 'search_submitted') as searches,
    count(*) filter (where event_type = 'not_interested') as ignored"""
_KINDS = "('feed_impression', 'deal_card_opened', 'deal_saved', 'fast_redeem_clicked', 'redeem_clicked', 'search_submitted', 'not_interested')"
_BRAND = _COUNTS.format(saves="count(*) filter (where event_type = 'deal_saved')", redeems="count(*) filter (where event_type in ('fast_redeem_clicked', 'redeem_clicked')) as fast_redeems,")
_CATEGORY = _COUNTS.format(saves="count(*) filter (where event_type in ('deal_saved', 'fast_redeem_clicked', 'redeem_clicked'))", redeems="")


def _top(by: str, n: int) -> str:
    return f"{ctes('interactions')} select {by}, count(*) as opens from interactions where event_type = 'deal_card_opened' and created_at >= {AS_OF} - interval 30 day group by all order by opens desc, {by} limit {n}"


def _rate(c: str) -> str:
    return f"round(100.0e0 * count(*) filter (where {c}) / count(*), 1)"


ORACLE_SQL = {
    "exposures": f"{ctes('interactions')}, {_TAGGED} select * from shown",
    "attribute_actions": f"{ctes('interactions')}, {_TAGGED} select * from acts",
    "deal_source_metrics": f"""{ctes('interactions')}, {_TAGGED}, outcomes as (
  select exposure_id, bool_or(event_type in ('deal_card_opened', 'deal_card_clicked')) as opened, bool_or(event_type = 'deal_saved') as saved,
    bool_or(event_type in ('fast_redeem_clicked', 'redeem_clicked')) as intent,
    (list(event_type order by event_sequence desc, id desc) filter (where event_type in ('not_interested', 'not_interested_undone')))[1] = 'not_interested' as dismissed
  from acts group by exposure_id)
select ranking_version, feed, source_group, deal_source,
  case when rank_position <= 3 then '1-3' when rank_position <= 7 then '4-7' else '8-10' end as position_band,
  count(*) as viewed_deals, count(distinct user_id) as users, count(*) filter (where opened) as opened_deals, count(*) filter (where saved) as saved_deals,
  count(*) filter (where dismissed) as dismissed_deals, count(*) filter (where intent) as redemption_intents,
  {_rate('opened')} as open_rate_pct, {_rate('saved')} as save_rate_pct, {_rate('dismissed')} as dismiss_rate_pct, {_rate('intent')} as redemption_intent_rate_pct
from shown left join outcomes on exposure_id = id group by all""",
    "ingestion_yield": f"""{ctes('interactions', 'users')}, conn as (select user_id from users where user_id % 3 <> 0),
latest as (select user_id, 1 as synced, arg_max(id % 50, created_at) as messages_seen, arg_max(id % 7, created_at) as deals_extracted from interactions where id % 4 <> 0 group by user_id),
fine as (select user_id, count(*) as deals from interactions where id % 5 <> 0 and id % 100 >= 70 and created_at >= {AS_OF} - interval 14 day
  and (id % 2 <> 0 or created_at + interval 9 day > {AS_OF}) group by user_id)
select count(*) as connected_users, count(synced) as users_synced, coalesce(sum(messages_seen), 0) as messages_in_latest_syncs,
  coalesce(sum(deals_extracted), 0) as candidates_in_latest_syncs, count(deals) as users_with_eligible_email_deals, coalesce(sum(deals), 0) as eligible_email_deals
from conn left join latest using (user_id) left join fine using (user_id)""",
    "dashboard_totals": f"""{ctes('interactions')}, x as (select *, created_at >= {AS_OF} - interval 30 day as recent from interactions),
c as (select count(*) as total_rows, count(distinct user_id) as total_users, count(distinct case when created_at >= {AS_OF} - interval 7 day then user_id end) as active_users,
  count(*) filter (where recent and event_type = 'deal_card_opened') as opens, count(*) filter (where recent and event_type = 'deal_saved') as saves,
  count(*) filter (where recent and event_type in ('redeem_clicked', 'fast_redeem_clicked')) as redeems from x)
select *, round(saves * 100.0e0 / opens, 1) as save_rate_pct, round(redeems * 100.0e0 / opens, 1) as redeem_rate_pct from c""",
    "sessions_per_day": f"""{ctes('interactions')} select cast(d as date) as day, count(distinct session_id) as sessions
from generate_series({AS_OF} - interval 13 day, {AS_OF}, interval 1 day) t(d)
left join (select * from interactions where created_at >= {AS_OF} - interval 14 day) i on cast(i.created_at as date) = cast(d as date) group by 1""",
    "top_opened_brands": _top("brand", 10),
    "top_opened_categories": _top("category", 8),
    "top_opened_offers": _top("promotion_id, brand", 10),
    "brand_affinity": f"{ctes('interactions')}, c as (select user_id, brand, {_BRAND} from interactions where event_type in {_KINDS} group by all) select *, views + clicks * 8 + saves * 30 + fast_redeems * 20 + searches * 18 - ignored * 3 as affinity_score from c",
    "brand_affinity_strict": f"{ctes('interactions')}, c as (select user_id, brand, {_BRAND}, count(*) as calls from interactions where event_type in {_KINDS} group by all) select * exclude (calls), case when calls > 1 then views + clicks * 8 + saves * 30 + fast_redeems * 20 + searches * 18 - ignored * 3 else 0 end as affinity_score from c",
    "category_affinity": f"{ctes('interactions')}, c as (select user_id, category, {_CATEGORY} from interactions where event_type in {_KINDS} group by all) select *, views + clicks * 8 + saves * 30 + searches * 18 - ignored * 3 as affinity_score from c",
    "query_counts": f"{ctes('searches')} select lower(trim(query)) as query, count(*) as searches, count(*) filter (where no_result) as failed from searches group by 1",
    "recent_queries": f"""{ctes('searches')}, l as (select user_id, trim(query) as query, max((created_at, id)) as last from searches where length(trim(query)) >= 2 group by 1, 2)
select user_id, query, place from (select *, row_number() over (partition by user_id order by last desc, query) as place from l) where place <= 10""",
    "failed_queries": f"""{ctes('searches')}, l as (select user_id, lower(trim(query)) as query, min((created_at, id)) as first from searches where no_result group by 1, 2)
select user_id, query, back from (select *, row_number() over (partition by user_id order by first desc, query) as back from l) where back <= 50""",
    "interaction_state": f"""{ctes('interactions')} select user_id, promotion_id, count(*) filter (where event_type = 'feed_impression') as impressions,
  count(*) filter (where event_type in ('deal_card_opened', 'deal_card_clicked')) as clicks, bool_or(event_type in ('fast_redeem_clicked', 'redeem_clicked')) as redeemed,
  coalesce(arg_max(event_type, event_sequence) filter (where event_type in ('deal_saved', 'deal_unsaved')) = 'deal_saved', false) as saved,
  coalesce(arg_max(event_type, event_sequence) filter (where event_type in ('not_interested', 'not_interested_undone')) = 'not_interested', false) as dismissed
from interactions group by 1, 2""",
    "last_active": f"{ctes('interactions')} select user_id, max(created_at) as last_active_at from interactions group by 1",
    "feedback_export": f"""{ctes('interactions')} select id, user_id, promotion_id, event_type, created_at, concat('{{"event_sequence":', event_sequence, ',"source_group":"', source_group, '"}}') as metadata
from interactions where event_type in ('deal_saved', 'deal_unsaved', 'not_interested', 'not_interested_undone') and created_at >= {AS_OF} - interval 90 day""",
}
