"""Catalog queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import catalog as op
from tallyloom.plans.domain import AS_OF, ctes, domain

C = F.col


def now():
    """The time of every job, as a column."""
    return F.expr(AS_OF)


def _offers(spark, sf_dir):
    return domain(spark, sf_dir, "offers")


def _titled(spark, sf_dir):
    """Offers with awkward titles: placeholders, contests, curly quotes, missing ones."""
    k = C("pos") % 11
    title = F.when(k == 0, "No promotions found").when(k == 1, F.concat(F.lit("Win the giveaway of "), C("brand"))).when(k == 2, F.concat(C("category"), F.lit(" movie tickets"))).when(k == 3, "Truck rental for a day").when(k == 4, F.lit(None)).when(k == 5, F.concat(F.lit("Today’s “best” price – "), C("promotion_title"))).otherwise(C("promotion_title"))
    return _offers(spark, sf_dir).withColumn("promotion_title", title)


_TITLED = """titled as (select * replace (case pos % 11 when 0 then 'No promotions found' when 1 then concat('Win the giveaway of ', brand) when 2 then concat(category, ' movie tickets')
  when 3 then 'Truck rental for a day' when 4 then null when 5 then concat('Today’s “best” price – ', promotion_title) else promotion_title end as promotion_title) from offers)"""
_TEXT = "concat_ws(' ', nullif(promotion_title, ''), nullif(short_summary, ''))"


def _sources(spark):
    rows = [(f"Brand#{k}", f"https://www.brand{k}.example.com/deals", "food" if k % 2 else "tech", k % 3 == 0) for k in range(1, 21)]
    return spark.createDataFrame(rows, "brand string, url string, category string, online_only boolean")


_SOURCES = "sources as (select concat('Brand#', k) as known, concat('brand', k, '.example.com') as website_domain, case when k % 2 = 1 then 'food' else 'tech' end as known_category, k % 3 = 0 as online_only from range(1, 21) t(k))"


def _attach(spark, sf_dir):
    offers = _offers(spark, sf_dir).select("pos", F.when(C("pos") % 2 == 0, F.lower("brand")).otherwise(C("brand")).alias("brand"), F.when(C("pos") % 5 == 0, "").otherwise(C("category")).alias("category"), F.when(C("pos") % 3 == 0, F.concat(F.lit("/x/"), C("pos"))).when(C("pos") % 3 == 1, "broken").otherwise(C("deal_url")).alias("deal_url"))
    return op.resolve_deal_url(op.attach_brand(offers, _sources(spark)))


_DISCOUNT_COLUMNS = ["pos", "discount_type", "discount_value", "promotion_type"]


def _discounts(spark, sf_dir):
    k = C("pos") % 9
    offers = _offers(spark, sf_dir)
    d = offers.withColumns({"discount_type": F.when(k < 3, "unknown").when(k == 3, "percentage_off").otherwise(C("discount_type")), "discount_value": F.when(k == 3, "0%").when(k == 4, "$0").otherwise(C("discount_value")), "promotion_type": F.when(k == 2, "unknown").otherwise(C("promotion_type"))})
    return op.fix_discounts(d).select(*_DISCOUNT_COLUMNS)


_NORMAL = ["pos", "brand", "promotion_title", "discount_type", "discount_value", "promotion_type", "redemption_method", "deal_scope", "category", "confidence_score", "requires_membership", "membership_cost", "status"]


def normalized(offers):
    """All passes in the order of a nightly run."""
    d = op.drop_placeholder_and_junk(offers)
    d = op.fix_membership(op.fix_discounts(d))
    d = op.fix_redemption_and_scope(op.fix_titles(d))
    return op.compute_status(op.fix_confidence(d), now())


def _dates(spark, sf_dir):
    k = C("pos") % 6
    d = C("end_date")
    text = F.when(k == 0, F.date_format(d, "MM/dd/yyyy")).when(k == 1, F.date_format(d, "MMMM d, yyyy")).when(k == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T23:59:00"))).when(k == 3, F.date_format(d, "d MMMM yyyy")).when(k == 4, F.lit("soon")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return op.normalize_dates(_offers(spark, sf_dir).select("pos", text.alias("end_date")), "end_date")


def _dedup(spark, sf_dir):
    offers = _offers(spark, sf_dir).withColumn("promotion_title", F.when(C("pos") % 13 == 0, "").when(C("pos") % 4 == 0, F.concat(F.coalesce("discount_value", F.lit("")), F.lit(" Off Today"))).otherwise(F.concat(C("promotion_title"), F.when(C("pos") % 2 == 0, " with the Fancy Bank Credit card").otherwise(""))))
    return op.dedup_offers(offers).select("pos", "place", "brand", "promotion_title", "confidence_score")


def _merge_active(spark, sf_dir):
    """Two catalogs with a status each, of which the second lacks the brand."""
    status = F.element_at(F.array(*(F.lit(x) for x in ("active", "expired", "needs_review", "probably_active", "online_only"))), (C("pos") % 5 + 1).cast("int"))
    offers = _offers(spark, sf_dir).withColumn("status", status)
    return op.merge_active(offers.where("pos % 2 = 0").select("pos", "brand", "status"), offers.where("pos % 2 = 1").select("pos", "status"))


def _merge_sources(spark, sf_dir):
    offers = _offers(spark, sf_dir).select("pos", "brand", "promotion_title", "discount_type", "confidence_score")
    web = offers.where("pos % 3 <> 0")
    email = offers.where("pos % 2 = 0").withColumn("confidence_score", F.round(1.2 - C("confidence_score"), 2))
    return op.merge_sources(web, email)


def _scored(spark, sf_dir):
    return _offers(spark, sf_dir).withColumn("global_quality_score", F.round((C("pos") * 37 % 1000) / 10.0, 1))


_SCORED = "scored as (select *, round((pos * 37 % 1000) / 10.0e0, 1) as global_quality_score from offers)"


def _keywords(spark, sf_dir):
    words = F.array(F.lit("a"), F.lit("b"))
    none = F.array().cast("array<string>")
    offers = _offers(spark, sf_dir).select("pos", "brand", F.when(C("pos") % 3 == 0, words).otherwise(none).alias("product_keywords_explicit"), F.when(C("pos") % 5 == 0, words).otherwise(none).alias("product_keywords_contextual"), none.alias("product_categories"))
    return offers


def _apply_keywords(spark, sf_dir):
    offers = _keywords(spark, sf_dir)
    store = offers.select("brand").distinct().where("brand < 'Brand#2'").select("brand", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("k"), i)).alias("keywords"), F.array(F.lit("c")).alias("categories"))
    return op.apply_keyword_store(offers, store).select("pos", "brand", F.array_join("product_keywords_contextual", ",").alias("contextual"), F.array_join("product_categories", ",").alias("categories"))


def _links(spark):
    return spark.createDataFrame([("brand1", "one://", "https://one.example.com", 0), ("brand12", "twelve://", None, 1), ("brand2", "two://", "https://two.example.com", 2)], "word string, deep_link string, web_link string, ord int")


def _with_status(offers):
    return op.compute_status(offers, now()).withColumn("website_domain", F.when(C("pos") % 7 > 0, F.concat(F.lower(F.replace("brand", F.lit("#"), F.lit(""))), F.lit(".example.com"))))


def _redemption(spark, sf_dir):
    d = op.fast_redemption(_with_status(_offers(spark, sf_dir)), now(), _links(spark))
    return d.select("pos", "fast_redemption.*", "app_deep_link")


def _url_cases(spark, sf_dir):
    k = C("pos") % 9
    url = F.when(k == 0, "ftp://a.example.com").when(k == 1, "https://user@a.example.com/").when(k == 2, "https://localhost/x").when(k == 3, "http://10.0.0.1/").when(k == 4, "https://a.example.com:8443/").when(k == 5, "https://a.example.com:443/y").when(k == 6, "https://a b.example.com").otherwise(C("deal_url"))
    d = _offers(spark, sf_dir).select("pos", url.alias("url"), F.when(C("pos") % 2 == 0, "example.com").otherwise("www.brand13.example.com").alias("domain"))
    return d.select("pos", "url", "domain", tx.public_url(C("url")).alias("is_public"), tx.matches_domain(C("url"), C("domain")).alias("matches"))


QUERIES = {
    "drop_placeholder_and_junk": lambda s, d: op.drop_placeholder_and_junk(_titled(s, d)).select("pos", "promotion_title"),
    "attach_brand_and_url": _attach,
    "fix_discounts": _discounts,
    "fix_membership": lambda s, d: op.fix_membership(_offers(s, d)).select("pos", "requires_membership", "membership_name", "membership_cost", "promotion_type"),
    "fix_titles": lambda s, d: op.fix_titles(_titled(s, d)).select("pos", "promotion_title"),
    "fix_redemption_and_scope": lambda s, d: op.fix_redemption_and_scope(_offers(s, d), C("brand") == "Brand#13").select("pos", "redemption_method", "deal_scope"),
    "fix_confidence": lambda s, d: op.fix_confidence(_titled(s, d)).select("pos", "confidence_score", "category"),
    "normalize_dates": _dates,
    "compute_status": lambda s, d: op.compute_status(_offers(s, d), now()).select("pos", "status"),
    "dedup_offers": _dedup,
    "public_and_matching_urls": _url_cases,
    "merge_sources": _merge_sources,
    "merge_active": _merge_active,
    "publish_filter": lambda s, d: op.publish_filter(_offers(s, d).withColumn("promotion_title", F.when(C("pos") % 12 == 0, F.concat(F.lit("Año "), C("promotion_title"))).otherwise(C("promotion_title"))), now()).select("pos", "drop_reason"),
    "publish_drop_counts": lambda s, d: op.drop_counts(op.publish_filter(_offers(s, d), now())),
    "review_table": lambda s, d: op.review_table(op.compute_status(_offers(s, d), now())),
    "status_counts": lambda s, d: op.status_counts(op.compute_status(_offers(s, d), now())),
    "load_catalog": lambda s, d: op.load_catalog(_scored(s, d).withColumn("promotion_title", F.substring("promotion_title", 1, 12))).select("pos", "brand", "promotion_title", "global_quality_score"),
    "missing_keyword_queue": lambda s, d: op.missing_keyword_queue(_keywords(s, d)),
    "apply_keyword_store": _apply_keywords,
    "category_percentile": lambda s, d: op.category_percentile(_scored(s, d)).select("pos", "top_pct"),
    "group_grocery": lambda s, d: op.group_grocery(_offers(s, d)).select("pos", "group_size"),
    "fast_redemption": _redemption,
}

_STATUS = f"""case when end_date < date '2024-01-31' then 'expired' when confidence_score < 0.4 then 'low_confidence'
  when epoch({AS_OF} - cast(last_confirmed as timestamp)) / 86400 > 14 or confidence_score < 0.6 then 'needs_review'
  when deal_scope = 'online_only' then 'online_only' when end_date is null then 'probably_active' else 'active' end"""
_SLUG = "case when regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' then 'unknown' else regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') end"


def _m(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern}')"


_TYPOGRAPHY = "{}"
for _a, _b in op.TYPOGRAPHY.items():
    _TYPOGRAPHY = f"replace({_TYPOGRAPHY}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"

ORACLE_SQL = {
    "drop_placeholder_and_junk": f"""{ctes('offers')}, {_TITLED}, t as (select *, trim(coalesce(promotion_title, '')) as title, {_TEXT} as txt from titled)
select pos, promotion_title from t where not (
  {_m('title', op.PLACEHOLDER)} or {_m('title', op.SWEEPSTAKES)} or ({_m('title', op.TICKETS)} and not {_m('txt', op.REAL_DISCOUNT)})
  or ({_m('title', op.SERVICE)} and not {_m('txt', op.REAL_DISCOUNT)} and not {_m('txt', op.FREE)})
  or coalesce(promotion_type = 'membership_benefit' and membership_cost = 'unknown' and end_date is null and not {_m('txt', op.REAL_DISCOUNT)} and not {_m('txt', op.FREE)}, false))""",
    "attach_brand_and_url": f"""{ctes('offers')}, {_SOURCES}, o as (select pos, case when pos % 2 = 0 then lower(brand) else brand end as brand, case when pos % 5 = 0 then '' else category end as category,
  case pos % 3 when 0 then concat('/x/', pos) when 1 then 'broken' else deal_url end as deal_url from offers)
select pos, coalesce(known, brand) as brand, case when category <> '' then category else known_category end as category, website_domain, online_only,
  case when deal_url like '/%' and website_domain is not null then concat('https://www.', website_domain, deal_url) when deal_url like 'http%' then deal_url end as deal_url
from o left join sources on lower(brand) = lower(known)""",
    "fix_discounts": f"""{ctes('offers')}, a as (select pos, promotion_title as title, {_TEXT} as txt, case when pos % 9 < 3 then 'unknown' when pos % 9 = 3 then 'percentage_off' else discount_type end as dt,
  case pos % 9 when 3 then '0%' when 4 then '$0' else discount_value end as dv, case when pos % 9 = 2 then 'unknown' else promotion_type end as pt from offers),
b as (select pos, title, txt, pt, case when dt = 'percentage_off' and coalesce(trim(dv), '') in ('0%', '0') then case when {_m('title', '(?i)free')} then 'free_item' else 'unknown' end
  when coalesce(trim(dv), '') in ('$0', '0', '$0.00') and {_m('title', '(?i)free')} then 'free_item' else dt end as dt,
  case when (dt = 'percentage_off' and trim(dv) in ('0%', '0')) or (trim(dv) in ('$0', '0', '$0.00') and {_m('title', '(?i)free')}) or (dt = 'free_shipping' and trim(dv) in ('0%', '0', '0.0')) then '' else dv end as dv from a),
c as (select *, dt = 'free_shipping' and {_m('title', op.BOGO)} as bogo, (dt = 'free_item' and {_m('txt', op.SHIPPING)}) or (dt = 'unknown' and {_m('title', op.SHIPPING_TITLE)}) as ships from b),
d as (select pos, txt, case when bogo then 'free_item' when ships then 'free_shipping' else dt end as dt, case when bogo then '' else dv end as dv, case when ships and not bogo and pt = 'unknown' then 'sale' else pt end as pt from c),
e as (select *, nullif(regexp_extract(txt, '{op.SUBSCRIPTION}', 1), '') as price from d),
f as (select pos, txt, case when dt = 'unknown' and price is not null then 'sale_price' else dt end as dt, case when dt = 'unknown' and price is not null and coalesce(dv, '') = '' then trim(price) else dv end as dv,
  case when dt = 'unknown' and price is not null and pt = 'unknown' then 'membership_benefit' else pt end as pt from e),
g as (select *, nullif(regexp_extract(txt, '{op.PERCENT_OFF}', 1), '') as share, coalesce(nullif(regexp_extract(txt, '{op.AMOUNT_OFF}', 1), ''), nullif(regexp_extract(txt, '{op.AMOUNT_SAVE}', 1), '')) as amount from f)
select pos, case when dt = 'unknown' and share is not null then 'percentage_off' when dt = 'unknown' and amount is not null then 'amount_off' else dt end as discount_type,
  case when dt = 'unknown' and coalesce(share, amount) is not null and coalesce(dv, '') = '' then trim(coalesce(share, amount)) else dv end as discount_value, pt as promotion_type from g""",
    "fix_membership": f"""{ctes('offers')}, a as (select *, lower({_TEXT}) as txt from offers),
b as (select *, case when contains(txt, 'aarp') then 'AARP' when contains(txt, 'aaa') then 'AAA' when contains(txt, 'costco') then 'Costco' when contains(txt, 'sam''s club') then 'Sam''s Club' when contains(txt, 'bj''s') then 'BJ''s' end as program from a),
c as (select *, not requires_membership and regexp_matches(txt, '\\bmembers?\\b') and program is not null as named from b)
select pos, requires_membership or named as requires_membership, case when named then program end as membership_name,
  case when named then 'paid' when requires_membership and membership_cost = 'unknown' and promotion_type = 'reward' then 'free' else membership_cost end as membership_cost,
  case when (requires_membership or named) and promotion_type not in ('reward', 'membership_benefit') then 'membership_benefit' else promotion_type end as promotion_type from c""",
    "fix_titles": f"""{ctes('offers')}, {_TITLED}, a as (select *, trim(coalesce(short_summary, '')) as s, case when discount_type = 'points' and coalesce(discount_value, '') = '' and not coalesce(starts_with(lower(promotion_title), 'rewards program:'), false)
  then concat('Rewards Program: ', brand) else promotion_title end as title from titled),
b as (select pos, case when coalesce(title, '') <> '' then title when discount_type = 'free_shipping' then 'Free Shipping'
  when coalesce(discount_value, '') <> '' and discount_type in ('percentage_off', 'amount_off') then concat(discount_value, ' Off')
  when coalesce(discount_value, '') <> '' and discount_type = 'free_item' then concat('Free ', discount_value)
  when s <> '' and instr(s, '. ') between 2 and 81 then trim(substr(s, 1, instr(s, '. ') - 1)) when s <> '' then trim(substr(s, 1, 80)) else brand end as title from a)
select pos, {_TYPOGRAPHY.format('title')} as promotion_title from b""",
    "fix_redemption_and_scope": f"""{ctes('offers')}, a as (select pos, brand, deal_scope, case when redemption_method <> 'unknown' then redemption_method when requires_app then 'in_app' when {_m(_TEXT, op.CODE)} then 'show_code'
  when deal_scope = 'online_only' or {_m(_TEXT, op.ONLINE)} then 'online' else redemption_method end as m from offers),
b as (select *, case when (m in ('in_app', 'in_store') and deal_scope = 'online_only') or (m = 'in_app' and deal_scope = 'unknown') then 'brand_level' else deal_scope end as s from a)
select pos, case when brand = 'Brand#13' and m not in ('online', 'show_code') then 'online' else m end as redemption_method, case when brand = 'Brand#13' then 'online_only' else s end as deal_scope from b""",
    "fix_confidence": f"""{ctes('offers')}, {_TITLED}, a as (select *, category in ('grocery', 'food') and promotion_type = 'sale' as weekly, contains(lower({_TEXT}), 'gift card') as gift,
  case when extraction_status <> 'success' then least(confidence_score, 0.4e0) else confidence_score end as s0 from titled),
b as (select *, case when discount_type = 'unknown' and not weekly then least(s0, 0.6e0) else s0 end as s1 from a), c as (select *, case when gift then least(s1, 0.55e0) else s1 end as s2 from b)
select pos, round(greatest(0, least(1, s2 - case when coalesce(promotion_title, '') <> '' then 0 else 0.15e0 end - case when coalesce(short_summary, '') <> '' then 0 else 0.1e0 end
  - case when coalesce(discount_value, '') <> '' or discount_type in ('free_item', 'free_shipping', 'points') or weekly then 0 else 0.05e0 end)), 3) as confidence_score,
  case when gift then 'gift_card' else category end as category from c""",
    "normalize_dates": f"""{ctes('offers')} select pos, case when pos % 6 = 4 then 'soon' when end_date is null then null when pos % 6 = 2 then strftime(end_date, '%Y-%m-%dT23:59:00') else strftime(end_date, '%Y-%m-%d') end as end_date from offers""",
    "compute_status": f"{ctes('offers')} select pos, {_STATUS} as status from offers",
    "dedup_offers": f"""{ctes('offers')}, o as (select * replace (case when pos % 13 = 0 then '' when pos % 4 = 0 then concat(discount_value, ' Off Today') else concat(promotion_title, case when pos % 2 = 0 then ' with the Fancy Bank Credit card' else '' end) end as promotion_title) from offers),
k as (select *, regexp_replace(regexp_replace(lower(promotion_title), '{op.CARD_PARTNER}', '', 'g'), '[^a-z0-9]', '', 'g') as tk from o),
a as (select *, case when tk = '' then concat('x', pos) else tk end as gk from k),
b as (select *, row_number() over (partition by brand, gk, case when tk <> '' then discount_type end, case when tk <> '' then discount_value end order by confidence_score desc, pos) as rn,
  min(pos) over (partition by brand, gk, case when tk <> '' then discount_type end, case when tk <> '' then discount_value end) as first_pos from a),
c as (select *, nullif(regexp_extract(lower(trim(coalesce(discount_value, ''))), '([0-9]+([.][0-9]+)?)', 1), '') as num from b where rn = 1),
d as (select *, case when num is null then concat('x', pos) else concat(num, '|', deal_url) end as uk from c),
e as (select *, row_number() over (partition by brand, discount_type, uk order by confidence_score desc, first_pos) as rn2, min(first_pos) over (partition by brand, discount_type, uk) as place from d)
select pos, place, brand, promotion_title, confidence_score from e where rn2 = 1""",
    "public_and_matching_urls": f"""{ctes('offers')}, u as (select pos, case pos % 9 when 0 then 'ftp://a.example.com' when 1 then 'https://user@a.example.com/' when 2 then 'https://localhost/x' when 3 then 'http://10.0.0.1/' when 4 then 'https://a.example.com:8443/'
  when 5 then 'https://a.example.com:443/y' when 6 then 'https://a b.example.com' else deal_url end as url, case when pos % 2 = 0 then 'example.com' else 'www.brand13.example.com' end as domain from offers),
v as (select *, pos % 9 in (5, 7, 8) as is_public, regexp_replace(regexp_extract(url, '^https?://([^/:]+)', 1), '^www[.]', '') as host, regexp_replace(domain, '^www[.]', '') as dom from u)
select pos, url, domain, is_public, is_public and (host = dom or ends_with(host, '.' || dom)) as matches from v""",
    "merge_active": f"""{ctes('offers')} select pos, case when pos % 2 = 0 then brand end as brand, case pos % 5 when 0 then 'active' when 1 then 'expired' when 2 then 'needs_review' when 3 then 'probably_active' else 'online_only' end as status from offers where pos % 5 not in (1, 2)""",
    "merge_sources": f"""{ctes('offers')}, k as (select pos, brand, promotion_title, discount_type, confidence_score, concat({_SLUG.format('brand')}, '|', substr({_SLUG.format('promotion_title')}, 1, 40), '|', discount_type) as key from offers),
w as (select * from k where pos % 3 <> 0 qualify row_number() over (partition by key order by pos desc) = 1),
e0 as (select * replace (round(1.2e0 - confidence_score, 2) as confidence_score) from k where pos % 2 = 0),
e as (select *, count(*) over (partition by key) as n from e0 qualify row_number() over (partition by key order by confidence_score desc, pos desc) = 1)
select case when e.key is not null and (w.key is null or e.confidence_score >= w.confidence_score) then e.pos else w.pos end as pos,
  coalesce(w.brand, e.brand) as brand, case when e.key is not null and (w.key is null or e.confidence_score >= w.confidence_score) then e.promotion_title else w.promotion_title end as promotion_title,
  coalesce(w.discount_type, e.discount_type) as discount_type, case when e.key is not null and (w.key is null or e.confidence_score >= w.confidence_score) then e.confidence_score else w.confidence_score end as confidence_score,
  case when e.key is null then 'web' when w.key is null and n = 1 then 'email' else 'both' end as source from w full join e on w.key = e.key""",
    "publish_filter": f"{ctes('offers')} select pos, case when pos % 12 = 0 then 'not_english' when confidence_score < 0.65 then 'low_confidence' when cast(end_date as timestamp) < {AS_OF} then 'expired' end as drop_reason from offers",
    "publish_drop_counts": f"{ctes('offers')} select case when confidence_score < 0.65 then 'low_confidence' else 'expired' end as drop_reason, count(*) as n from offers where confidence_score < 0.65 or cast(end_date as timestamp) < {AS_OF} group by 1",
    "review_table": f"""{ctes('offers')}, s as (select *, {_STATUS} as status from offers) select pos, brand, category, promotion_title, coalesce(discount_value, '') as discount_value, status, status in ('needs_review', 'low_confidence') as needs_review,
  case status when 'needs_review' then 0 when 'low_confidence' then 1 when 'expired' then 2 else 3 end as status_order from s""",
    "status_counts": f"{ctes('offers')}, s as (select *, {_STATUS} as status from offers) select status, count(*) as n, round(avg(confidence_score), 4) as avg_confidence from s group by 1",
    "load_catalog": f"""{ctes('offers')}, {_SCORED}, t as (select pos, brand, substr(promotion_title, 1, 12) as promotion_title, global_quality_score from scored where global_quality_score >= 35)
select * from t where trim(promotion_title) <> '' qualify row_number() over (partition by lower(brand), lower(promotion_title) order by global_quality_score desc, pos) = 1""",
    "missing_keyword_queue": f"{ctes('offers')} select brand, count(*) as offers, min(pos) as first from offers where pos % 3 <> 0 and pos % 5 <> 0 group by 1",
    "apply_keyword_store": f"""{ctes('offers')} select pos, brand, case when pos % 5 = 0 then 'a,b' when pos % 3 = 0 or brand >= 'Brand#2' then '' else array_to_string([concat('k', i) for i in range(1, 26)], ',') end as contextual,
  case when pos % 3 = 0 or pos % 5 = 0 or brand >= 'Brand#2' then '' else 'c' end as categories from offers""",
    "category_percentile": f"""{ctes('offers')}, {_SCORED}, r as (select pos, global_quality_score as s, count(*) over (partition by category) as n, rank() over (partition by category order by global_quality_score) - 1 as beaten from scored),
x as (select *, round((1 - beaten / n) * 100) as raw from r)
select pos, case when n < 5 then case when s >= 80 then 10 when s >= 65 then 25 when s >= 50 then 40 else 50 end when raw <= 5 then 5 when raw <= 10 then 10 when raw <= 15 then 15 when raw <= 20 then 20 when raw <= 25 then 25 when raw <= 30 then 30 when raw <= 40 then 40 else 50 end as top_pct from x""",
    "group_grocery": f"""{ctes('offers')}, g as (select *, promotion_type = 'sale' and category in ('grocery', 'food', 'fashion') as sale from offers),
w as (select *, count(*) over (partition by brand, sale) as n, first_value(case when category = 'fashion' then 4 else 2 end) over (partition by brand, sale order by pos) as least_n from g)
select pos, case when sale and n >= least_n then n else 1 end as group_size from w""",
    "fast_redemption": f"""{ctes('offers')}, s as (select *, {_STATUS} as status, case when pos % 7 > 0 then concat('https://www.', lower(replace(brand, '#', '')), '.example.com') end as url, lower(replace(brand, '#', '')) as slug, category = 'food' as food from offers),
e as (select *, status in ('active', 'probably_active', 'online_only') and confidence_score >= 0.65 and (promo_code is not null or requires_app or url is not null) as fine from s),
a as (select *, case when not fine then 'not_supported' when requires_app then 'open_app' when promo_code is not null and url is not null then 'copy_code_and_open_url' when promo_code is not null then 'copy_code'
  when redemption_method = 'online' and url is not null then 'open_url' when redemption_method = 'in_store' and url is not null then 'open_maps' when promotion_type in ('reward', 'membership_benefit') and url is not null then 'open_rewards'
  when url is not null then 'show_steps' else 'not_supported' end as action_type from e)
select pos, action_type <> 'not_supported' as eligible, action_type, case action_type when 'not_supported' then '' when 'open_app' then concat('Open ', brand, ' App') when 'copy_code_and_open_url' then case when food then 'Order & Apply Code' else 'Copy Code & Shop' end
  when 'copy_code' then 'Copy Code' when 'open_url' then case when food then 'Order Now' else 'Shop Now' end when 'open_maps' then 'Find Nearest Store' when 'open_rewards' then 'View Rewards' else 'How to Redeem' end as button_label,
  case when action_type in ('copy_code', 'copy_code_and_open_url') then promo_code when action_type = 'open_maps' then brand end as primary_value,
  case when action_type = 'not_supported' then null when action_type = 'open_app' and contains(slug, 'brand1') then 'https://one.example.com' when action_type = 'open_app' and contains(slug, 'brand2') then 'https://two.example.com' else url end as primary_url,
  case action_type when 'not_supported' then 'high' when 'show_steps' then 'high' when 'open_app' then 'medium' when 'open_maps' then 'medium' when 'open_rewards' then 'medium' else 'low' end as effort_level,
  case action_type when 'not_supported' then 0.0 when 'open_app' then 0.80 when 'copy_code_and_open_url' then 0.95 when 'copy_code' then 0.90 when 'open_url' then 0.85 when 'open_maps' then 0.70 when 'open_rewards' then 0.75 else 0.50 end::double as confidence,
  case when action_type = 'open_app' and contains(slug, 'brand1') then 'one://' when action_type = 'open_app' and contains(slug, 'brand2') then 'two://' end as app_deep_link from a""",
}
