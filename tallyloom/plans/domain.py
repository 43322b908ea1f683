"""Domain tables derived from the test tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallyloom.functions.joins import spread

#: Time of every job over the test tables, whose events span January 2024.
AS_OF = "timestamp '2024-01-31 00:00:00'"

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"

DOMAIN = {
    "interactions": f"""
select event_id as id, user_id, concat('s', user_id, '-', cast(floor((day(ts) - 1) / 7.0) as int)) as session_id,
  concat('p', {_K} % 5) as promotion_id,
  case event_type when 'view' then 'feed_impression' when 'click' then 'deal_card_opened' when 'purchase' then 'deal_saved'
    when 'error' then 'not_interested'
    else case event_id % 3 when 0 then 'not_interested_undone' when 1 then 'deal_unsaved' else 'redeem_clicked' end end as event_type,
  concat('Brand#', 1 + {_K} % 25) as brand,
  case {_K} % 4 when 0 then 'food' when 1 then 'tech' when 2 then 'travel' else 'fashion' end as category,
  case when event_type <> 'view' and event_id % 2 = 0 then null when user_id % 2 = 0 then 'for_you' else 'near_me' end as context,
  cast(1 + event_id % 10 as int) as rank_position, ts as created_at,
  case when {_K} % 5 < 2 then 'email' else 'public' end as source_group,
  case when {_K} % 5 < 2 then 'inbox' else 'web' end as deal_source,
  case when event_id % 17 = 0 then null else 'v5' end as ranking_version, event_id as event_sequence
from events""",
    "offers": """
select p_partkey as pos, p_brand as brand,
  case p_type when 'ECONOMY' then 'food' when 'STANDARD' then 'fashion' when 'PROMO' then 'tech' when 'SMALL' then 'beauty'
    when 'LARGE' then 'travel' else 'grocery' end as category,
  case p_partkey % 8 when 0 then concat(5 + p_partkey % 70, '% off ', p_name) when 1 then concat('$', 1 + p_partkey % 40, ' off ', p_name)
    when 2 then concat('Free ', p_name) when 3 then 'Free Shipping' when 4 then 'Earn points'
    when 5 then concat('Save on select styles ', p_name) when 6 then concat('Buy 2 get 1 free ', p_name) else concat('BOGO ', p_name) end as promotion_title,
  case p_partkey % 8 when 0 then 'percentage_off' when 1 then 'amount_off' when 2 then 'free_item' when 3 then 'free_shipping'
    when 4 then 'points' when 5 then 'sale_price' when 6 then 'unknown' else 'free_item' end as discount_type,
  case p_partkey % 8 when 0 then concat(5 + p_partkey % 70, '%') when 1 then concat('$', 1 + p_partkey % 40) else null end as discount_value,
  case p_partkey % 6 when 0 then 'reward' when 1 then 'membership_benefit' when 2 then 'coupon' else 'sale' end as promotion_type,
  case p_partkey % 5 when 0 then 'online' when 1 then 'in_store' when 2 then 'in_app' when 3 then 'show_code' else 'unknown' end as redemption_method,
  p_partkey % 6 in (0, 1) as requires_membership, p_partkey % 9 = 0 as requires_app,
  case when p_partkey % 5 in (0, 3) then concat('CODE', p_partkey % 97) else null end as promo_code,
  round(0.35e0 + (p_partkey % 66) / 100.0e0, 2) as confidence_score,
  case when p_partkey % 4 = 0 then null else cast(date '2024-01-31' + cast(p_partkey % 40 - 10 as int) as date) end as end_date,
  concat('Get ', p_name, ' from ', p_brand, case p_partkey % 7 when 0 then ' for $9.99/month' when 1 then ', 20% off today' when 2 then ' gift card' when 3 then ' for members of AAA' else '' end) as short_summary,
  concat('https://www.', lower(replace(p_brand, '#', '')), '.example.com/', p_partkey % 50) as deal_url,
  case p_partkey % 4 when 0 then 'unknown' when 1 then 'brand_level' when 2 then 'online_only' else 'location_specific' end as deal_scope,
  case when p_partkey % 10 = 0 then 'failed' else 'success' end as extraction_status,
  case when p_partkey % 3 = 0 then 'unknown' when p_partkey % 3 = 1 then 'free' else 'paid' end as membership_cost,
  cast(date '2024-01-31' - cast(p_partkey % 45 as int) as date) as last_confirmed
from part""",
    "stores": """
select s_suppkey as store_id, concat('Brand#', 1 + s_suppkey % 25) as brand, round(37.0e0 + (s_suppkey % 50) / 100.0e0, 4) as lat,
  round(-122.5e0 + (s_suppkey % 37) / 100.0e0, 4) as lng
from supplier""",
    "users": """
select c_custkey as user_id, round(37.0e0 + (c_custkey % 53) / 100.0e0, 4) as lat, round(-122.5e0 + (c_custkey % 41) / 100.0e0, 4) as lng,
  concat('Brand#', 1 + c_custkey % 25) as favorite_brand,
  case c_custkey % 4 when 0 then 'food' when 1 then 'tech' when 2 then 'travel' else 'fashion' end as favorite_category,
  cast(1 + c_custkey % 12 as int) as birthday_month
from customer""",
    "captures": """
select doc_id, source as brand, text, n_chars, lang,
  cast(timestamp '2024-01-01 00:00:00' as timestamp) + make_interval_days(doc_id % 30) as scraped_at
from documents""",
    "emails": """
select concat('m', conv_id, '-', turn) as message_id, 1 + conv_id % 50 as user_id, concat('Brand#', 1 + conv_id % 25) as brand,
  concat('Save ', 10 + conv_id % 60, '% off today') as subject,
  concat('Use code SAVE', 10 + conv_id % 60, '. Offer expires January ', 1 + turn % 28, case when conv_id % 3 = 0 then '. Members earn rewards. ' else '. ' end, text) as body,
  conv_id, turn
from conversations""",
    "searches": """
select event_id as id, user_id, case event_id % 5 when 0 then 'brand#1' when 1 then 'food' when 2 then ' Tech ' when 3 then 'zzz' else 'Brand#12' end as query,
  event_id % 5 = 3 as no_result, ts as created_at
from events where event_type = 'signup'""",
    # A page for each document, with offers between its sentences, and a second page, of the same site or another.
    "promo_texts": """
select doc_id, concat('s', doc_id) as source, concat('https://www.', coalesce(source, 'none'), '.example.com/', doc_id) as source_url, concat(coalesce(source, 'none'), '.example.com') as trusted_domain,
  case when doc_id % 29 = 0 then null when doc_id % 31 = 0 then '2024-01-30T10:00:00' else concat('2024-01-', 10 + doc_id % 20, 'T10:00:00+00:00') end as checked_at,
  concat(case when doc_id % 3 = 0 then concat('=== https://', coalesce(source, 'none'), '.example.com/first ===', chr(10)) else '' end,
    replace(replace(replace(coalesce(text, ''), concat('.', chr(10), 'A'), concat('.', chr(10), case doc_id % 5 when 0 then 'Save 20% off running shoes.' when 1 then 'Take  $15.00 off any order' when 2 then 'Free tote bag with any purchase!' when 3 then 'Running shoes: 20% discount for rewards members' else 'Summer dresses up to 30% off' end, chr(10), 'A')),
      '. Las ', concat(case when doc_id % 2 = 0 then '. Use RUN20 for it,' else ' on an order of $60.' end, chr(10), 'Las ')), '. The ', concat(case when doc_id % 4 < 2 then ' on selected styles' else ' ends March 5, 2024' end, chr(10), 'The ')),
    chr(10), '=== https://', case when doc_id % 5 = 0 then 'evil.test' else concat('shop.', coalesce(source, 'none'), '.example.com') end, '/q ===', chr(10), 'Save 20% off blue running shoes', chr(10), 'Save $15 off any order, take it with RUN20', chr(10), 'A complimentary gift: one tote bag', chr(10), 'Summer dresses: save up to 30% until 3/5/2024') as text
from documents""",
    # A shop's page for each document: products and prices between its sentences, links at its end.
    "shop_texts": """
select doc_id, coalesce(source, 'none') as brand, lang as category, concat(coalesce(source, 'none'), '.example.com') as website_domain,
  concat(replace(replace(replace(replace(coalesce(text, ''),
    concat('.', chr(10), 'A'), concat('.', chr(10), 'Slim Fit Denim Jacket M', chr(10), '$', 80 + doc_id % 40, '.00 $', 39 + doc_id % 7, '.99', chr(10), 'A')),
    '. Las ', concat('.', chr(10), 'Black Leather Boots XL', chr(10), case when doc_id % 2 = 0 then 'now ' else '' end, '$45.50 was $', 60 + doc_id % 60, chr(10), 'Las ')),
    '. The ', concat('.', chr(10), 'Floral Midi Dress / women', chr(10), '120.00', chr(10), 10 + doc_id % 99, '.95', chr(10), 'View cart', chr(10), 'The ')),
    '. Les ', concat('.', chr(10), 'Save $10 - $25', chr(10), 'Canvas tote bag, one size', chr(10), '$1,', 200 + doc_id % 300, '.00 $999.00', chr(10), 'Les ')),
    chr(10), 'Denim jacket offers [deal_url:/jackets/', doc_id % 9, '] and leather boots [deal_url:', case when doc_id % 4 = 0 then '//evil.test' else '' end, '/boots] for you', case when doc_id % 3 = 0 then ' [deal_url:/home]' else '' end) as text
from documents""",
    # A shop's text for each document, with what offers say at its head and between its sentences; some are empty or short.
    "rule_texts": """
select doc_id, case doc_id % 9 when 0 then 'Target' when 1 then 'AMC Theatres' when 2 then 'Mcdonalds' else source end as brand,
  case when doc_id % 37 = 0 then null when doc_id % 37 = 1 then '  Coupon: 30% off  ' else concat(
    case doc_id % 14 when 0 then 'Take 20% off today. ' when 1 then 'Get $ 5.50 off your order! ' when 2 then 'Just 7 dollars off' when 3 then 'A free drink for you' when 4 then 'Earn 50 points toward a reward'
      when 5 then 'Clearance for a limited time' when 6 then 'Our loyalty program has 50 points' when 7 then 'Happy birthday, coupon inside' when 8 then 'Offer valid in the app' when 9 then 'Members deal: 15 percent off'
      when 10 then 'Free with purchase, promo code RUN' when 11 then 'Rewardsale of the year' else '' end, chr(10),
    case doc_id % 5 when 0 then 'Happy hour 3:30pm - 12 AM for new customers' when 1 then 'Scan in store, 9 am to 5:15 pm. Sign up now' when 2 then 'Online only, valid until noon' else '' end, chr(13), chr(10), chr(9),
    replace(coalesce(text, ''), '. ', case doc_id % 3 when 0 then concat('.', chr(10)) when 1 then concat('. Members save. ', chr(10)) else '. ' end)) end as text
from documents""",
    "rule_mails": """
select concat('m', conv_id, '-', turn) as message_id, concat('Brand#', 1 + conv_id % 25) as brand, concat('Save ', 10 + conv_id % 60, '% off today') as subject,
  cast(case when conv_id % 2 = 0 then timestamp '2023-12-20 10:00:00' else timestamp '2024-01-10 00:00:00' end as timestamp) as sent_at,
  split(concat('https://brand.example.com/unsubscribe ', case when conv_id % 3 = 0 then 'mailto:a@example.com' else concat('https://brand.example.com/', turn) end, ' https://brand.example.com/privacy'), ' ') as links,
  case when conv_id % 5 = 0 then 'private_user_offer' else 'public_general_offer' end as visibility,
  concat('Use code SAVE', 10 + conv_id % 60, case when conv_id % 7 = 0 then ' or use code EXTRA5' else '' end, '. Offer expires ', case conv_id % 4 when 0 then 'Feb 31' when 1 then 'January 32' else '' end, case when conv_id % 4 < 2 then ' and ends ' else '' end,
    'January ', 1 + turn % 28, case when conv_id % 6 = 1 then ', 2024' else '' end, '. ', coalesce(text, '')) as body
from conversations""",
}

_DAYS = re.compile(r"make_interval_days\(([^)]*)\)")


def domain(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """A domain table; dealt: its source is dealt to all cores before anything is worked out on it."""
    sql = _DAYS.sub(r"make_interval(0, 0, 0, cast(\1 as int))", DOMAIN[name])
    source = re.search(r"from (\w+)(?: where|$)", sql.strip().split("\n")[-1])[1]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(re.sub(rf"from {source}\b", f"from {{{source}}}", sql), **{source: spread(rows) if dealt else rows})


def ctes(*names: str) -> str:
    """The domain tables as a WITH clause for DuckDB."""
    return "with " + ",\n".join(f"{n} as ({_DAYS.sub(r'to_days(cast(\1 as int))', DOMAIN[n])})" for n in names)
