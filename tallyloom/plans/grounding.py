"""Evidence queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import grounding as op
from tallyloom.plans.domain import ctes, domain

C = F.col

#: Four offers (k = 0 to 3) of each text, in SQL that Spark and DuckDB read alike.
_OFFER = {
    "promotion_title": "case k when 0 then '20% off running shoes' when 1 then 'Take $15 off any order' when 2 then 'Tote bag gift' else 'Summer dresses up to 30% off' end",
    "discount_type": "case k when 0 then 'percentage_off' when 1 then 'amount_off' when 2 then 'free_item' else case when doc_id % 13 = 0 then 'unknown' else 'percentage_off' end end",
    "discount_value": "case k when 0 then '20%' when 1 then '$15' when 2 then null else 'up to 30%' end",
    "promo_code": "case when k = 0 and doc_id % 2 = 0 then 'RUN20' else null end",
    "promotion_type": "case when k = 0 and doc_id % 10 = 1 then 'coupon' else 'sale' end",
    "minimum_spend": "case when k = 1 and doc_id % 3 < 2 then concat('$', 60 + doc_id % 3) else null end",
    "purchase_required": "k = 2 and doc_id % 4 < 3",
    "requires_membership": "k = 3 and doc_id % 6 = 0",
    "membership_name": "case when doc_id % 12 = 0 then 'Club' else null end",
    "end_date": "case when k = 3 and doc_id % 2 = 0 then '2024-03-05' else null end",
    "terms_text": "case when k = 3 and doc_id % 3 = 0 then 'Selected styles' else null end",
    "synthesized": "k = 3 and doc_id % 11 = 0",
    "has_steps": "doc_id % 7 > 0",
}


def _texts(spark, sf_dir):
    return domain(spark, sf_dir, "promo_texts")


def _offers(spark, sf_dir, *more):
    rows = _texts(spark, sf_dir).select("doc_id", "source", *more, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    rows = rows.select("source", *rows.columns[2:-1], (C("doc_id") * 4 + C("k")).alias("pos"), *(F.expr(e).alias(c) for c, e in _OFFER.items()))
    return rows.withColumn("redemption_steps", F.when(C("has_steps"), F.array(F.lit("Show it."))).otherwise(F.array(F.lit(" ")))).drop("has_steps")


def _grounded(spark, sf_dir):
    return op.build_source_evidence(_offers(spark, sf_dir), _texts(spark, sf_dir).drop("doc_id"))


def _evidence(spark, sf_dir):
    e = C("source_evidence")
    return _grounded(spark, sf_dir).select("pos", e["status"].alias("status"), e["source_url"].alias("source_url"), e["excerpt"].alias("excerpt"), e["content_hash"].alias("content_hash"), F.array_join(e["reasons"], ",").alias("reasons"), e["offer"]["promo_code"].alias("promo_code"), e["offer"]["timezone"].alias("timezone"))


_EVIDENCE_SQL = rf"""{ctes("promo_texts")},
offers as (select *, doc_id * 4 + k as pos, {", ".join(f"{e} as {c}" for c, e in _OFFER.items())} from (select doc_id, source, source_url, checked_at, trusted_domain, unnest([0, 1, 2, 3]) as k from promo_texts)),
split as (select source, trusted_domain, source_url, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from promo_texts),
paged as (select *, nullif(regexp_extract(trim(line), '^=== (https?://\S+) ===$', 1), '') as head from split),
numbered as (select *, count(head) over w as page, coalesce(last_value(head ignore nulls) over w, source_url) as page_url from paged window w as (partition by source order by i)),
following as (select *, lead(line, 1) over w as l1, lead(line, 2) over w as l2, lead(line, 3) over w as l3 from numbered where head is null window w as (partition by source, page order by i)),
passages as (
  select source, i, page_url, lower(trim(regexp_replace(excerpt, '\s+', ' ', 'g'))) as said, excerpt from (
    select source, i, page_url, substr(regexp_replace(concat(line, case when l1 is not null and not l1 ^@ '=== ' then concat(chr(10), l1, case when l2 is not null and not l2 ^@ '=== ' then concat(chr(10), l2, case when l3 is not null and not l3 ^@ '=== ' then concat(chr(10), l3) else '' end) else '' end) else '' end), '^\s+|\s+$', '', 'g'), 1, 700) as excerpt
    from following where trim(line) <> '' and regexp_matches(page_url, concat('^https://([a-z0-9-]+\.)*', replace(trusted_domain, '.', '\.'), '/')))
),
found as (
  select pos, arg_min(excerpt, i) as excerpt, arg_min(page_url, i) as page_url from offers o join passages p on o.source = p.source and case k
    when 0 then regexp_matches(said, '(^|[^\d.])20(\.00)?\s*%') and not contains(said, 'up to') and regexp_matches(said, '\b(save|savings|rebate|discount)\b(\s+\w+){{0,3}}\s*([^\d.]|\b)20(\.00)?\s*%|([^\d.]|^)20(\.00)?\s*%\s+(off|discount|rebate|savings)\b')
      and (promo_code is null or regexp_matches(said, '\brun20\b')) and cast(regexp_matches(said, '(^|[^a-z])running([^a-z]|$)') as int) + cast(regexp_matches(said, '(^|[^a-z])shoes([^a-z]|$)') as int) = 2
    when 1 then regexp_matches(said, '\$\s*15(\.00)?($|[^\d.]|\.($|\D))') and regexp_matches(said, '\b(save|savings|rebate|discount)\b(\s+\w+){{0,3}}\s*\$\s*15(\.00)?($|[^\d.]|\.($|\D))|\$\s*15(\.00)?\s+(off|discount|rebate|savings)\b')
      and cast(regexp_matches(said, '(^|[^a-z])take([^a-z]|$)') as int) + cast(regexp_matches(said, '(^|[^a-z])any([^a-z]|$)') as int) = 2
      and case when minimum_spend is null then not regexp_matches(said, '\b(orders?|purchases?|spend) (of |over |above |at least )?\$\s*\d|\$\d+(\.\d+)?\+') else regexp_matches(said, concat('\$\s*', substr(minimum_spend, 2), '(\.00)?($|[^\d.]|\.($|\D))')) end
    when 2 then regexp_matches(said, '\b(free|complimentary)\b') and cast(regexp_matches(said, '(^|[^a-z])tote([^a-z]|$)') as int) + cast(regexp_matches(said, '(^|[^a-z])bag([^a-z]|$)') as int) + cast(regexp_matches(said, '(^|[^a-z])gift([^a-z]|$)') as int) >= 2
    else regexp_matches(said, '(^|[^\d.])30(\.00)?\s*%') and regexp_matches(said, '\b(save|savings|rebate|discount)\b(\s+\w+){{0,3}}\s*([^\d.]|\b)30(\.00)?\s*%|([^\d.]|^)30(\.00)?\s*%\s+(off|discount|rebate|savings)\b')
      and cast(regexp_matches(said, '(^|[^a-z])summer([^a-z]|$)') as int) + cast(regexp_matches(said, '(^|[^a-z])dresses([^a-z]|$)') as int) = 2
      and (end_date is null or regexp_matches(said, '\b(mar\.?|march)\s+0?5(st|nd|rd|th)?[,\s]+2024\b|\b2024-0?3-0?5\b|\b0?3/0?5/2024\b')) end
    and not regexp_matches(said, '\bfirst (order|purchase)\b|\bnew (customers?|users?|members?) only\b') and (purchase_required or not regexp_matches(said, '\bwith (any |a |qualifying )?purchase\b'))
    and not regexp_matches(said, '\b(app.only|in.app only)\b') and (requires_membership or not regexp_matches(said, '\bmembers? only\b|\b(rewards|loyalty) members\b'))
    and (k = 1 or not regexp_matches(said, '\b(orders?|purchases?|spend) (of |over |above |at least )?\$\s*\d|\$\d+(\.\d+)?\+')) and (terms_text is not null or not regexp_matches(said, '\bselect(ed)?\b'))
  where has_steps and not synthesized and discount_type <> 'unknown' and (promotion_type <> 'coupon' or promo_code is not null) and (not requires_membership or membership_name is not null) and o.checked_at is not null and length(o.checked_at) > 19
  group by pos
), texts as (select source, sha256(text) as content_hash from promo_texts)
select pos, case when f.excerpt is not null then 'supported' else 'unverified' end as status, coalesce(f.page_url, source_url) as source_url, f.excerpt, content_hash, promo_code, 'America/New_York' as timezone,
  case when f.excerpt is not null then '' else coalesce(nullif(concat_ws(',', case when length(checked_at) <= 19 then 'capture_timezone_missing' end, case when checked_at is null then 'capture_date_missing' end,
    case when synthesized then 'synthesized_offer_needs_review' end, case when discount_type = 'unknown' then 'unknown_discount' end, case when not has_steps then 'missing_redemption_steps' end,
    case when requires_membership and membership_name is null then 'missing_membership_name' end, case when promotion_type = 'coupon' and promo_code is null then 'missing_promo_code' end), ''), 'offer_not_grounded_in_captured_text') end as reasons
from offers o join texts using (source) left join found f using (pos)"""


def _outcomes(spark, sf_dir):
    """Evidence of the texts, and fetches that found them again, found others, or failed."""
    texts = _texts(spark, sf_dir)
    offers = _offers(spark, sf_dir, C("trusted_domain").alias("website_domain"))
    told = facts, _ = op.grounds(offers, texts)
    catalog = op.build_source_evidence(offers, texts, told=told)
    catalog = catalog.select("pos", C("source").alias("brand"), "website_domain", F.lit("active").alias("status"), C("source_evidence.checked_at").alias("last_confirmed"), "source_evidence")
    k = C("doc_id") % 4
    outcome = F.when(k == 0, "skipped_duplicate_hash").when(k == 1, "failed").when(k == 2, "success").otherwise("skipped_duplicate_hash")
    outcomes = facts.select(C("source").alias("brand"), outcome.alias("outcome"), F.when(k == 3, "other").otherwise(C("content_hash")).alias("content_hash"), F.array("source_url").alias("captured_urls"), F.lit("2024-02-01T00:00:00+00:00").alias("at"))
    e = C("source_evidence")
    return op.apply_capture_outcome(catalog, outcomes).select("pos", "status", "last_confirmed", e["status"].alias("evidence"), e["checked_at"].alias("checked_at"), e["check_failed_at"].alias("check_failed_at"), F.array_join(e["reasons"], ",").alias("reasons"))


_LATER = "'2024-02-01T00:00:00+00:00'"

QUERIES = {"build_source_evidence": _evidence, "apply_capture_outcome": _outcomes}

ORACLE_SQL = {
    "build_source_evidence": _EVIDENCE_SQL,
    "apply_capture_outcome": f"""select pos, case when doc_id % 4 = 1 and e.status = 'supported' then 'needs_review' else 'active' end as status,
  case when doc_id % 4 = 0 and e.status = 'supported' and e.source_url = t.source_url then {_LATER} else t.checked_at end as last_confirmed,
  case when doc_id % 4 = 1 then 'unverified' else e.status end as evidence, case when doc_id % 4 = 0 and e.status = 'supported' and e.source_url = t.source_url then {_LATER} else t.checked_at end as checked_at,
  case when doc_id % 4 = 1 and e.status = 'supported' then {_LATER} end as check_failed_at, case when doc_id % 4 = 1 and e.status = 'supported' then 'source_fetch_failed' else e.reasons end as reasons
from ({_EVIDENCE_SQL}) e join ({ctes("promo_texts")} select * from promo_texts) t on e.pos // 4 = t.doc_id""",
}
