"""Offers read by rules from whole texts and e-mails of the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import extraction as op
from tallyloom.operators import messages
from tallyloom.plans.domain import ctes, domain

C = F.col

_LISTS = ("redemption_steps", "friction_reasons", "evidence")
_RULES = [c for c in op.OFFER_COLUMNS if c not in ("deal_scope", "source_type")]


def _joined(df, *keys):
    return df.select(*keys, *(F.array_join(c, "|").alias(c) if c in _LISTS else c for c in _RULES if c not in keys))


def _offers(spark, sf_dir):
    return _joined(op.rule_based_offers(domain(spark, sf_dir, "rule_texts")), "doc_id")


def _mails(spark, sf_dir):
    d = op.extract_email_offers(domain(spark, sf_dir, "rule_mails"))
    keys = ["message_id", "visibility", "promo_code", "end_date", "deal_url", "source_type"]
    return _joined(d, *keys)


QUERIES = {"rule_based_offers": _offers, "extract_email_offers": _mails}

_WORDS = "reward rewards offer deal promo promotion coupon discount sale valid expires birthday member membership app".split()
_HITS = " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}" for w in _WORDS)
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_WHITE = " || ".join(f"chr({ord(c)})" for c in op.WHITE)
_ANY = "|".join(op.EVIDENCE)


def _has(*words: str) -> str:
    return "(" + " or ".join(f"contains(low, '{w}')" for w in words) + ")"


def _list(*rules: tuple[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"case when {cond} then {text} end" for cond, text in rules) + ")"


def _clock(h: int, m: int, half: int) -> str:
    part = lambda k: f"regexp_extract(hours, '{op.HOURS}', {k})"
    hour = f"cast({part(h)} as int)"
    return f"""case when hours <> '' then concat(lpad(cast(case when lower({part(half)}) = 'pm' and {hour} <> 12 then {hour} + 12 when lower({part(half)}) = 'am' and {hour} = 12 then 0 else {hour} end as varchar), 2, '0'), ':', case when {part(m)} = '' then '00' else {part(m)} end) end"""


def _rules(source: str, least: int, need: bool) -> str:
    """The CTEs of rule_based_offers over source (brand, text, ...); the last is named ruled."""
    program = " ".join(f"when contains(lower(brand), '{k}') then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in op.PROGRAMS.items())
    return f"""r0 as (select *, lower(coalesce(text, '')) as low, length(trim(text, {_WHITE})) as trimmed from {source}),
r1 as (select *, {_HITS} as keyword_hits, regexp_extract_all(low, '{_ANY}') as ev, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{_BREAK}'), lambda x: trim(x, {_WHITE})), lambda x: x <> '') as lines,
  coalesce(regexp_extract(text, '{op.HOURS}'), '') as hours, {_has(*op.MEMBERS.split('|'))} as requires_membership, {_has(' app')} as requires_app, {_has('birthday')} as birthday_related, {_has(*op.NEW_USERS.split('|'))} as new_user_only, {_has(*op.PURCHASE.split('|'))} as purchase_required,
  case when {_has('app')} then 'in_app' when {_has('code')} then 'show_code' when {_has('barcode', 'scan')} then 'scan_barcode' when {_has('online')} then 'online' when {_has('in store', 'in-store')} then 'in_store' else 'unknown' end as redemption_method from r0),
r2 as (select *, len(ev) > 0 as clear, coalesce(trimmed >= {least} and (keyword_hits > 0 {'' if need else 'or len(ev) > 0'}), false) as ok,
  list_filter(lines, lambda x: regexp_matches(lower(x), '{op.TERMS}'))[1:8] as told from r1),
r3 as (select *, case when not clear then 'unknown' when regexp_matches(low, '{op.PERCENT_OFF}') then 'percentage_off' when regexp_matches(low, '{op.DOLLARS_OFF}') or regexp_matches(low, '{op.WORDED_DOLLARS_OFF}') then 'amount_off'
    when regexp_matches(low, '{op.FREE}') then 'free_item' when regexp_matches(low, '{op.EARN}') or regexp_matches(low, '{op.TOWARD}') then 'points' when regexp_matches(low, '{op.SALE}') then 'sale_price' else 'unknown' end as dtype,
  case when clear then case when {_has('birthday')} then 'birthday_reward' when {_has('coupon')} then 'coupon' when {_has('sale', 'clearance')} then 'sale' when {_has('app')} and {_has('offer', 'deal')} then 'app_offer' when {_has('reward')} then 'reward' when {_has('member')} then 'membership_benefit' else 'unknown' end
    when {_has('reward', 'loyalty')} then 'reward' else 'unknown' end as ptype,
  substr(array_to_string(case when len(told) > 0 then told else lines[1:5] end, ' '), 1, 1500) as terms, redemption_method in ('show_code', 'scan_barcode') as coded, requires_app or redemption_method = 'in_app' as through_app from r2),
r4 as (select *, case dtype when 'percentage_off' then concat(regexp_extract(low, '{op.PERCENT_OFF}', 1), '%') when 'amount_off' then concat('$', case when regexp_matches(low, '{op.DOLLARS_OFF}') then regexp_extract(low, '{op.DOLLARS_OFF}', 1) else regexp_extract(low, '{op.WORDED_DOLLARS_OFF}', 1) end) when 'free_item' then 'free' end as dvalue,
  requires_membership::int + requires_app::int + 2 * new_user_only::int + coded::int as effort from r3),
ruled as (select * exclude (requires_membership, requires_app, new_user_only, birthday_related, purchase_required, redemption_method),
  case when ok then brand || case when dvalue is not null then concat(' ', dvalue, ' offer') when birthday_related and ptype = 'birthday_reward' then ' birthday reward' else case ptype when 'sale' then ' sale' when 'reward' then ' rewards program' when 'membership_benefit' then ' membership benefit' when 'coupon' then ' coupon' else ' promotion' end end end as promotion_title,
  case when ok then brand || ' has' || case when birthday_related then ' a birthday-related reward' when dvalue is not null then concat(' a ', dvalue, ' offer') when ptype = 'sale' then ' a sale or discount offer' when ptype = 'reward' then ' a rewards-related offer' else ' a promotion' end
    || case when requires_membership then ' that may require membership' else '' end || case when requires_app then ' and may require the app' else '' end || '.' else 'No clear offer or reward text found for ' || brand || '.' end as short_summary,
  if(ok, ptype, 'unknown') as promotion_type, if(ok, dtype, 'unknown') as discount_type, if(ok, dvalue, null) as discount_value, ok and requires_membership as requires_membership,
  case when ok and requires_membership then case {program} else brand || ' Rewards' end end as membership_name, case when ok and requires_membership then 'free' end as membership_cost, ok and requires_app as requires_app,
  if(ok, requires_membership or requires_app, null) as requires_account_login, if(ok, new_user_only, null) as new_user_only, if(ok, birthday_related, null) as birthday_related,
  case when ok then {_clock(1, 2, 3)} end as time_start, case when ok then {_clock(4, 5, 6)} end as time_end, if(ok, redemption_method, null) as redemption_method,
  case when ok then {_list(("requires_membership", "'Sign in to or join the ' || brand || ' rewards/membership program.'"), ("through_app", "'Open the ' || brand || ' app or rewards account.'"), ("through_app", "'Find and activate the offer if required.|Use the app or account at checkout.'"),
    ("not through_app", "case redemption_method when 'show_code' then 'Copy or show the promo code at checkout.' when 'online' then 'Apply the offer during online checkout.' when 'in_store' then 'Ask the cashier or show the offer in store.' else 'Review the offer terms before checkout.' end"))} end as redemption_steps,
  if(ok, terms, null) as terms_text, if(ok, purchase_required, null) as purchase_required, if(ok, case when effort <= 1 then 'low' when effort <= 3 then 'medium' else 'high' end, null) as friction_level,
  case when ok then case when effort = 0 then 'Simple redemption' else {_list(("requires_membership", "'Membership or rewards account required'"), ("requires_app", "'App may be required'"), ("new_user_only", "'May be limited to new users'"), ("coded", "'Code or barcode may be required'"))} end end as friction_reasons,
  case when ok then least(65, 25 + if(length(text) > 1000, 15, 0) + if(length(text) > 3000, 10, 0) + if(keyword_hits > 5, 15, 0) + if(keyword_hits > 20, 10, 0) + if(dvalue is not null, 10, 0) + if(requires_membership, 5, 0) + if(length(terms) > 100, 10, 0)) / 100.0e0 else 0.15e0 end as confidence_score,
  if(ok, 'success', 'no_offer_found') as extraction_status, array_to_string(list_filter(ev, lambda v, i: list_position(ev, v) = i), '|') as evidence from r4)"""


_NAMED = r"(?i)^([a-z]{3})[a-z]*\.?\s+(\d{1,2})(?:,\s*(\d{4}))?$"
# Phrases here are "January 3" or "January 3, 2024"; a month's first three letters name it.
_DATE = f"""coalesce(try_strptime(concat_ws(' ', regexp_extract(p, '{_NAMED}', 1), regexp_extract(p, '{_NAMED}', 2), coalesce(nullif(regexp_extract(p, '{_NAMED}', 3), ''), cast(year(sent_at) as varchar))), '%b %d %Y'))"""

ORACLE_SQL = {
    "rule_based_offers": f"{ctes('rule_texts')}, {_rules('rule_texts', 200, True)} select doc_id, {', '.join(_RULES)} from ruled",
    "extract_email_offers": f"""{ctes('rule_mails')}, m0 as (select *, concat(subject, chr(10), body) as text, list_distinct(list_transform(regexp_extract_all(concat(subject, chr(10), body), '{messages.CODE}', 1), lambda v: upper(v))) as codes,
  regexp_extract_all(concat(subject, chr(10), body), '{messages.EXPIRY}', 1) as phrases from rule_mails), {_rules('m0', 1, False)},
pp as (select message_id, sent_at, unnest(phrases) as p, unnest(range(len(phrases))) as k from m0), pd as (select message_id, k, sent_at, regexp_matches(p, '[0-9]{{4}}') as full_, cast({_DATE} as date) as d from pp),
pe as (select message_id, arg_min(case when not full_ and d < cast(sent_at as date) and month(sent_at) = 12 and month(d) = 1 then d + interval 1 year else d end, k) as end_date from pd where d is not null group by 1),
f as (select r.* exclude (promotion_title, confidence_score), subject as promotion_title, case when len(codes) = 1 then codes[1] end as promo_code, cast(pe.end_date as date) as end_date,
  list_filter(links, lambda x: starts_with(lower(x), 'http') and not regexp_matches(lower(x), 'unsubscribe|preferences|privacy|view.?in.?browser'))[1] as deal_url, confidence_score as c0 from ruled r left join pe using (message_id) where ok)
select message_id, visibility, promo_code, end_date, deal_url, 'email' as source_type, {', '.join(c if c != 'confidence_score' else "case when discount_type in ('percentage_off', 'amount_off', 'free_item') then (60 + 5 * ((promo_code is not null)::int + (deal_url is not null)::int + (end_date is not null)::int)) / 100.0e0 else c0 end as confidence_score" for c in _RULES)} from f""",
}
