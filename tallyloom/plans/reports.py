"""Quality reports over the test tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.functions.joins import shared_folder
from tallyloom.operators import reports as op
from tallyloom.plans.domain import AS_OF, ctes
from tallyloom.plans.ranking import _CAT, catalog

C = F.col


def _offers(spark, sf_dir):
    """The scored catalog; a seventh of the offers have no URL."""
    return catalog(spark, sf_dir).withColumn("source_url", F.when(C("pos") % 7 > 0, C("deal_url")))


def _report(spark, sf_dir):
    """The report of a day, after that of the day before, when the same offers were surer and none of them was online only."""
    now, path = F.expr(AS_OF), f"{shared_folder(spark)}/quality-{uuid.uuid4().hex}"
    offers = _offers(spark, sf_dir)
    surer = offers.withColumns({"confidence_score": F.least(C("confidence_score") + 0.25, F.lit(1.0)), "deal_scope": F.lit("brand_level")})
    op.quality_report(surer, now - F.expr("interval 1 day"), path)
    return op.quality_report(offers, now, path)


QUERIES = {
    "quality_report": _report,
    "quality_top_offers": lambda s, d: op.top_offers(_offers(s, d)),
    "redemption_distribution": lambda s, d: op.redemption_distribution(_offers(s, d)),
}

_SEEN = f"""{ctes("offers")}, {_CAT}, o as (select *, case when pos % 7 > 0 then deal_url end as source_url, promotion_type not in ('reward', 'membership_benefit') as no_program from cat),
both_runs as (select 1 as run, o.* from o union all select 0, o.* replace (least(confidence_score + 0.25e0, 1) as confidence_score, 'brand_level' as deal_scope) from o),
flagged as (select *, status in ('active', 'probably_active', 'online_only') and confidence_score >= 0.65 as seen, no_program and (redemption_method = 'online' or deal_scope = 'online_only' and redemption_method in ('show_code', 'in_app')) as online,
  action is not null and promotion_title <> '' and coalesce(end_date >= date '2024-01-31', true) as fits from both_runs)"""
_COUNTS = {
    "visible": "seen", "near_me": "seen and not online and category <> 'travel'", "online": "seen and online", "fast_redeem_eligible": "seen and fits", "no_fast_redeem": "seen and not fits", "scored": "seen and q is not null",
    "missing_title": "seen and promotion_title is null", "missing_source_url": "seen and source_url is null", "missing_brand": "seen and brand is null", "expired_visible": "seen and end_date < date '2024-01-31'",
    "confidence_90": "seen and confidence_score >= 0.9", "confidence_80": "seen and confidence_score >= 0.8 and confidence_score < 0.9", "confidence_65": "seen and confidence_score < 0.8", "confidence_dropped": "confidence_score < 0.65",
    "active": "seen and status = 'active'", "probably_active": "seen and status = 'probably_active'", "online_only": "seen and status = 'online_only'", "expires_today": "seen and end_date = date '2024-01-31'",
    "expires_in_3_days": "seen and end_date between date '2024-02-01' and date '2024-02-03'", "no_expiry": "seen and end_date is null", "expired_hidden": "status = 'expired'", "needs_review_hidden": "status = 'needs_review'",
}
_LABEL = "case action when 'open_app' then 'Open ' || brand || ' App' when 'copy_code_and_open_url' then if(category = 'food', 'Order & Apply Code', 'Copy Code & Shop') when 'copy_code' then 'Copy Code' when 'open_url' then if(category = 'food', 'Order Now', 'Shop Now') when 'open_maps' then 'Find Nearest Store' when 'open_rewards' then 'View Rewards' when 'show_steps' then 'How to Redeem' end"

ORACLE_SQL = {
    "quality_report": f"""{_SEEN}, m as (select run, {", ".join(f"cast(count(*) filter (where {w}) as double) as {n}" for n, w in _COUNTS.items())}, round(coalesce(avg(confidence_score) filter (where seen), 0), 3) as avg_confidence from flagged group by 1),
t as (select run, cast(count(*) filter (where confidence_score < 0.75) as double) as unsure_at_top from (select * from flagged where seen qualify row_number() over (partition by run order by q desc, pos) <= 20) group by 1),
l as (unpivot (select m.*, coalesce(unsure_at_top, 0) as unsure_at_top from m left join t using (run)) on columns(* exclude (run)) into name name value value),
c as (select a.name, a.value, b.value as previous, round(a.value - b.value, 3) as delta from l a left join l b on b.run = 0 and b.name = a.name and a.name in ('visible', 'near_me', 'online', 'fast_redeem_eligible', 'avg_confidence') where a.run = 1)
select 'counts' as section, * from c union all select 'warnings', if(name = 'visible', 'visible_dropped', name), value, previous, delta from c
where name in ('expired_visible', 'missing_source_url', 'no_fast_redeem', 'unsure_at_top') and value > 0 or name = 'visible' and value < 0.7e0 * previous""",
    "quality_top_offers": f"""{_SEEN}, s as (select unnest(['near_me', 'online']) as surface), r as (select surface, row_number() over (partition by surface order by q desc, pos) as place, pos, brand, substr(promotion_title, 1, 48) as title, q as score, confidence_score as confidence, if(fits, {_LABEL}, 'not_supported') as action
  from flagged, s where run = 1 and seen and if(surface = 'online', online, not online and category <> 'travel')) select * from r where place <= 10""",
    "redemption_distribution": f"{_SEEN} select if(fits, action, 'not_supported') as action_type, count(*) as n from flagged where run = 1 and seen group by 1",
}
