"""Scoring queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.text import rounded
from tallyloom.operators import scoring as op
from tallyloom.operators.catalog import fast_redemption
from tallyloom.plans.catalog import _STATUS, _with_status
from tallyloom.plans.domain import AS_OF, ctes, domain

C = F.col


def now():
    """The time of every job, as a column."""
    return F.expr(AS_OF)


def brand_values(spark):
    return spark.createDataFrame([("brand13", 8.0, 0), ("brand1x", 105.0, 1), ("brand12x", 40.0, 2), ("brand2", 12.5, 3)], "slug string, value double, ord int")


def cautious_values(spark):
    return spark.createDataFrame([("brand21", 50.0, 0), ("brand13zz", 22.0, 1)], "slug string, value double, ord int")


def offers(spark, sf_dir):
    d = _with_status(domain(spark, sf_dir, "offers", dealt=True))
    return fast_redemption(d, now()).withColumn("checked_at", F.when(C("pos") % 5 > 0, C("last_confirmed").cast("timestamp") + F.expr("interval 7 hours")))


def scored(spark, sf_dir):
    return op.score_offers(offers(spark, sf_dir), brand_values(spark), cautious_values(spark), now())


QUERIES = {
    "estimate_savings": lambda s, d: op.estimate_savings(offers(s, d), brand_values(s), cautious_values(s)).select("pos", "estimated_item_value", "estimated_savings"),
    "effective_discount": lambda s, d: op.effective_discount(op.estimate_savings(offers(s, d), brand_values(s), cautious_values(s))).select("pos", rounded("effective_discount_pct", 4).alias("effective_discount_pct")),
    "economic_value": lambda s, d: scored(s, d).select("pos", "relative_score", "absolute_score", "spend_penalty", "quantity_penalty", rounded("economic_value_score", 2).alias("economic_value_score")),
    "quality_subscores": lambda s, d: scored(s, d).select("pos", "presentation_score", "clarity_score", "reliability", "fast_redeem_score", "source_freshness_score", "expiration_urgency_score", "friction_penalty", rounded("urgency_effect", 1).alias("urgency_effect")),
    "global_quality_score": lambda s, d: scored(s, d).select("pos", rounded("global_quality_score", 1).alias("global_quality_score"), F.array_join("value_explanation_codes", ",").alias("codes")),
    "score_summary": lambda s, d: op.score_summary(scored(s, d)).select("offers", rounded("min_score", 1).alias("min_score"), rounded("max_score", 1).alias("max_score"), rounded("avg_score", 1).alias("avg_score")),
}


def _case(table: dict, key: str, default: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then {v}e0" for k, v in table.items()) + f" else {default} end"


_HINT = "case " + " ".join(f"when regexp_matches(title, '(?i){p}') then {v}e0" for p, v in op.TITLE_HINTS) + " end"


def _m(pattern: str) -> str:
    return f"regexp_matches(title, '{pattern}')"


#: The brands brand1x and brand12x are reached by their first seven characters, as brand13 is for the cautious values.
SCORED = f"""s0 as (select *, {_STATUS} as status, pos % 7 > 0 as has_url, promotion_title as title, lower(replace(brand, '#', '')) as slug,
  try_cast(nullif(regexp_extract(coalesce(discount_value, ''), '(\\d+(?:\\.\\d+)?)\\s*%', 1), '') as double) as share,
  try_cast(nullif(regexp_extract(coalesce(discount_value, ''), '\\$\\s*(\\d+(?:\\.\\d+)?)', 1), '') as double) as amount,
  try_cast(nullif(regexp_extract(promotion_title, '{op.BUY_GET}', 1), '') as double) as buy, try_cast(nullif(regexp_extract(promotion_title, '{op.BUY_GET}', 2), '') as double) as get from offers),
s1 as (select *, {_HINT} as hint, {_m(op.BOGO)} as bogo, {_m(op.TRIAL)} as trial, {_m(op.VAGUE)} as vague,
  case when status in ('active', 'probably_active', 'online_only') and confidence_score >= 0.65 then case when requires_app and (promo_code is not null or has_url or requires_app) then 'open_app' when promo_code is not null and has_url then 'copy_code_and_open_url'
    when promo_code is not null then 'copy_code' when redemption_method = 'online' and has_url then 'open_url' when redemption_method = 'in_store' and has_url then 'open_maps' when promotion_type in ('reward', 'membership_benefit') and has_url then 'open_rewards' when has_url then 'show_steps' end end as action,
  case when slug = 'brand13' then 8e0 when slug = 'brand2' then 12.5e0 when slug like 'brand1_' and substr('brand1x', 1, 7) = substr(slug, 1, 7) then 105e0 when substr(slug, 1, 7) = 'brand12' then 40e0 else {_case(op.ITEM_VALUE, 'category', '30e0')} end as item from s0),
s2 as (select *, case when slug = 'brand21' then 50e0 when substr(slug, 1, 7) = 'brand13' then 22e0 else {_case(op.CAUTIOUS_VALUE, 'category', 'item * 0.5e0')} end as cautious from s1),
s3 as (select *, round(case when bogo or buy is not null then item when discount_type = 'free_item' then case when trial then 5e0 else coalesce(hint, least(item, 15e0)) end
  when discount_type = 'percentage_off' and share > 0 then round(coalesce(hint, case when vague then cautious else item end) * share / 100, 2) when discount_type = 'percentage_off' and vague then round(cautious * 0.2e0, 2)
  when discount_type = 'percentage_off' then round(item * 0.15e0, 2) when discount_type = 'amount_off' then case when amount > 0 then amount else 8e0 end when discount_type = 'sale_price' then round(case when vague then cautious else item end * 0.2e0, 2)
  when discount_type = 'free_shipping' then case when category = 'tech' then 10e0 when category = 'fashion' then 8e0 else 5e0 end when discount_type = 'points' then 2e0 else 5e0 end, 2) as saved from s2),
s4 as (select *, case when discount_type = 'free_item' and not trial then 100e0 when bogo then 50e0 when buy is not null then round(get / (buy + get) * 100, 1) when discount_type = 'percentage_off' then case when share > 0 then share else 15e0 end
  when discount_type = 'amount_off' and item > 0 then least(saved / item * 100, 100e0) when discount_type = 'sale_price' then 20e0 when discount_type = 'free_shipping' then 8e0 when discount_type = 'points' then 1.5e0 else 10e0 end as pct,
  case when category in ('food', 'beauty', 'grocery') then 0.1e0 when category in ('tech', 'travel') then 0.85e0 else 0.4e0 end as weight, case when bogo then item when buy is not null then item * buy end as spend from s3),
s5 as (select *, round(least(27 * ln(1 + least(pct, 100) / 100 * 3.5e0) / ln(4.5e0), 27), 2) as rel, round(least(50 * ln(1 + saved) / ln(1 + {_case(op.SAVINGS_CAP, 'category', '50e0')}), 50), 2) as abs_score,
  case when spend > 0 then round((1 - least(saved / spend, 1)) ** 2 * 12, 2) else 0e0 end as spend_penalty, case when bogo then round(10 * weight, 2) when buy is not null then round(10 * weight * least(buy / 2, 1), 2) else 0e0 end as quantity_penalty from s4),
s6 as (select *, greatest(rel + abs_score - spend_penalty - quantity_penalty, 0e0) as econ, coalesce(share > 0, false) or coalesce(amount > 0, false) as exact, end_date - date '2024-01-31' as left_days,
  case when pos % 5 > 0 then floor(epoch({AS_OF} - (cast(last_confirmed as timestamp) + interval 7 hour)) / 86400) end as age from s5),
s7 as (select *, least(case when discount_type = 'free_item' and not trial then 4e0 when bogo then 3e0 else 0e0 end + case when promo_code is not null then 2e0 else 0e0 end + case when exact then 2e0 else 0e0 end, 8e0) as presentation_score,
  case when bogo or buy is not null then 5e0 when discount_type = 'free_shipping' then 4e0 when discount_type = 'free_item' and not trial then case when hint is not null then 4e0 else 2e0 end when exact then case when vague then 1e0 else 5e0 end when vague then 0e0 else 2e0 end as clarity_score,
  case when confidence_score <= 0 then 0.75e0 when confidence_score < 0.6e0 then 0.65e0 when confidence_score < 0.7e0 then 0.8e0 when confidence_score < 0.75e0 then 0.87e0 when confidence_score < 0.8e0 then 0.92e0 when confidence_score < 0.9e0 then 0.96e0 else 1e0 end as reliability,
  {_case(op.REDEEM_POINTS, 'action', '0e0')} as fast_redeem_score, case when age is null then 0e0 when age = 0 then 8e0 when age <= 1 then 6e0 when age <= 3 then 4e0 when age <= 7 then 1e0 when age <= 14 then -3e0 else -8e0 end as source_freshness_score,
  case when left_days = 0 then 5e0 when left_days = 1 then 4e0 when left_days in (2, 3) then 2e0 else 0e0 end as expiration_urgency_score,
  case when requires_membership then case membership_cost when 'paid' then 15e0 when 'free' then 2e0 else 8e0 end else 0e0 end + case when requires_app then 5e0 else 0e0 end
    + case when action is null or action = 'show_steps' then 6e0 when action in ('open_app', 'open_maps', 'open_rewards') then 3e0 else 0e0 end as friction_penalty from s6),
s8 as (select *, round(expiration_urgency_score * least(econ / 35, 1), 2) as urgency_effect from s7),
s9 as (select *, round((econ + presentation_score) * reliability + clarity_score + fast_redeem_score + source_freshness_score + urgency_effect - friction_penalty, 2) as gqs from s8)"""
_WITH = f"{ctes('offers')}, {SCORED}"

ORACLE_SQL = {
    "estimate_savings": f"{_WITH} select pos, round(item, 2) as estimated_item_value, saved as estimated_savings from s9",
    "effective_discount": f"{_WITH} select pos, round(pct, 4) as effective_discount_pct from s9",
    "economic_value": f"{_WITH} select pos, rel as relative_score, abs_score as absolute_score, spend_penalty, quantity_penalty, round(econ, 2) as economic_value_score from s9",
    "quality_subscores": f"{_WITH} select pos, presentation_score, clarity_score, reliability, fast_redeem_score, source_freshness_score, expiration_urgency_score, friction_penalty, round(urgency_effect, 1) as urgency_effect from s9",
    "global_quality_score": f"""{_WITH} select pos, round(gqs, 1) as global_quality_score, concat_ws(',', case when pct >= 50 then 'HIGH_EFFECTIVE_DISCOUNT' when pct >= 30 then 'STRONG_DISCOUNT' when pct >= 15 then 'MODERATE_DISCOUNT' end,
  case when saved >= 50 then 'HIGH_VALUE_SAVINGS' when saved >= 20 then 'GOOD_VALUE_SAVINGS' end, case when expiration_urgency_score >= 4 then 'EXPIRES_TODAY' when expiration_urgency_score >= 2 then 'EXPIRES_SOON' end,
  case when not requires_membership and not requires_app then 'NO_MEMBERSHIP_REQUIRED' when requires_membership and membership_cost = 'paid' then 'PAID_MEMBERSHIP_REQUIRED' when requires_membership and membership_cost = 'free' then 'FREE_MEMBERSHIP_REQUIRED' when requires_membership then 'MEMBERSHIP_REQUIRED' end,
  case when fast_redeem_score >= 10 then 'LOW_REDEMPTION_FRICTION' end, case when spend_penalty <= 0.5 and quantity_penalty <= 0.5 then 'NO_PURCHASE_MINIMUM' when spend_penalty >= 8 then 'HIGH_SPEND_REQUIRED' end,
  case when econ >= 40 then 'STRONG_ECONOMIC_VALUE' end, case when confidence_score < 0.6 then 'LOW_CONFIDENCE_WARNING' end) as codes from s9""",
    "score_summary": f"{_WITH} select count(*) as offers, round(min(gqs), 1) as min_score, round(max(gqs), 1) as max_score, round(avg(gqs), 1) as avg_score from s9",
}
