"""Notification, membership, page-signal, store and evidence queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.text import rounded
from tallyloom.operators import captures as cap
from tallyloom.operators import catalog as cat
from tallyloom.operators import messages as msg
from tallyloom.operators import ranking as rank
from tallyloom.plans.domain import AS_OF, ctes, domain
from tallyloom.plans.ranking import _CAT, catalog

C = F.col
_NOON = "timestamp '2024-01-31 12:00:00'"
_ALIASES = """select * from (values ('Acme', 'Acme', cast(null as string), false, cast(null as map<string, string>)), ('Acme Any', null, 'Acme( [A-Za-z0-9]+)?', true, null), ('Acme Out', null, '^Acme O', false, null),
  ('Other Shop', 'Other', null, false, map('shop', 'yes'))) as a(brand, name, pattern, ignore_case, extra)"""


def _ago(k):
    return F.expr(AS_OF) - F.expr("interval 1 day") * k


def _gender(spark, sf_dir):
    k = C("doc_id") % 7
    line = F.when(k == 0, "Women's dresses").when(k == 1, "Shoes for MEN").when(k == 2, "kids/baby").when(k == 3, "For her-him").when(k == 4, "Boys")
    return domain(spark, sf_dir, "captures").select("doc_id", cap.detect_gender(F.array_compact(F.array(line)), C("text")).alias("target_gender"))


def _signals(spark, sf_dir):
    text = F.when(C("doc_id") % 3 == 0, F.concat(F.lit("Happy HOUR bogo "), "text")).otherwise(C("text"))
    return domain(spark, sf_dir, "captures").select("doc_id", cap.has_deal_signals(text).alias("has_signals"))


def _due(spark, sf_dir):
    shops = domain(spark, sf_dir, "stores").select("store_id", F.concat(F.lit(" Shop "), "store_id").alias("name"))
    checks = domain(spark, sf_dir, "interactions").where("id % 5 = 0").select(F.concat(F.lit("SHOP "), "user_id").alias("name"), C("created_at").alias("checked_at"))
    return cap.due_businesses(shops, checks, F.expr(AS_OF)).select("store_id")


def _local(spark, sf_dir):
    return cap.best_local_offer(domain(spark, sf_dir, "offers").withColumn("name", F.concat(F.lit("Shop "), C("pos") % 997)))


def _evidence(spark, sf_dir):
    k = C("pos")
    page = domain(spark, sf_dir, "offers").select("pos", C("promotion_title").alias("offer"), C("deal_url").alias("source_url"))
    new = page.select("pos", "offer", "source_url", F.concat(F.lit("h"), k % 3).alias("content_hash"), F.when(k % 4 == 0, "unverified").otherwise("supported").alias("status"), _ago(k % 10).alias("checked_at"))
    old = page.select("offer", "source_url", F.concat(F.lit("h"), k % 2).alias("content_hash"), F.lit("supported").alias("status"), _ago(k % 5).alias("checked_at"), F.when(k % 11 == 0, _ago(k % 7)).alias("check_failed_at"))
    return cat.carry_forward_evidence(new, old, F.expr(AS_OF)).select("pos", "status", "checked_at", "check_failed_at", "needs_review")


def _stores(spark, sf_dir):
    k = C("store_id")
    name = F.when(k % 5 == 0, "Acme").when(k % 5 == 1, "Acme Outlet").when(k % 5 == 2, "ACME 12").when(k % 5 == 4, "Other")
    shop = F.when(k % 7 == 0, "vacant").when(k % 3 == 0, "yes")
    tag = lambda key, value: F.when(value.isNotNull(), F.struct(F.lit(key).alias("k"), value.alias("v")))
    tags = F.map_from_entries(F.array_compact(F.array(tag("name", name), tag("shop", shop), tag("disused:shop", F.when(k % 11 == 0, "yes")))))
    lat = F.when(k % 13 == 0, 60.0).otherwise(C("lat"))
    features = domain(spark, sf_dir, "stores").select(k.alias("id"), F.when(k % 2 == 0, "node").otherwise("way").alias("kind"), F.when(k % 2 == 0, lat).alias("lat"), F.when(k % 2 == 0, C("lng")).alias("lng"), F.when(k % 3 != 1, lat).alias("center_lat"), F.when(k % 3 != 1, C("lng")).alias("center_lng"), tags.alias("tags"))
    return rank.open_stores(features, spark.sql(_ALIASES))


def _memberships(spark, sf_dir):
    k = C("conv_id") % 5
    said = F.when(k == 0, "Join Blue Sky Circle now. ").when(k == 1, F.concat(F.lit("Your Sky"), C("conv_id") % 7, F.lit(" and Harbor Rewards are here. "))).otherwise("")
    mails = domain(spark, sf_dir, "emails").select("brand", "subject", F.concat(said, "body").alias("body"), _ago(C("conv_id") % 20).alias("sent_at"))
    n = C("pos") % 6
    name = F.when(n == 0, "Gold Tier").when(n == 1, "Unknown").when(n == 2, F.concat("brand", F.lit(" Rewards"))).when(n == 3, F.concat(F.lit("Tier "), C("pos") % 40)).when(n == 4, "VIP")
    offers = domain(spark, sf_dir, "offers").select("brand", (C("pos") % 2 == 0).alias("requires_membership"), name.alias("membership_name"), _ago(C("pos") % 9).alias("email_date"))
    known = domain(spark, sf_dir, "stores").select("brand", F.concat(F.lit("Tier "), C("store_id") % 60).alias("program"), _ago(C("store_id") % 12).alias("last_seen"))
    return msg.detect_memberships(mails, offers, known)


def _policy(spark, sf_dir):
    candidates = catalog(spark, sf_dir, "brand", "category", "global_quality_score").select(C("promotion_id").alias("promo_id"), "brand", "category", C("global_quality_score").alias("notify_score"))
    events = domain(spark, sf_dir, "interactions")
    history = events.where("event_type = 'deal_unsaved'").select("user_id", "brand", C("created_at").alias("sent_at"))
    feedback = events.where("event_type = 'not_interested'").select("user_id", "brand", "category", "created_at", (C("id") % 2 == 0).alias("interested"))
    return msg.notification_policy(domain(spark, sf_dir, "users"), candidates, history, events, feedback, F.expr(_NOON))


#: What both surfaces read of an offer.
_SHOWN = ["category", "status", "promotion_type", "redemption_method", "deal_scope", "discount_type", "discount_value", "confidence_score"]


def _surfaces(spark, sf_dir, *more):
    """The catalog with week days and memberships."""
    k = C("pos")
    days = F.when(k % 4 == 0, F.array(F.lit("Wed"))).when(k % 4 == 1, F.array(F.lit("monday"), F.lit("Tue"))).when(k % 4 == 2, F.array().cast("array<string>"))
    return catalog(spark, sf_dir, *_SHOWN, *more).withColumns({"valid_days": days, "member": k % 7 == 0})


QUERIES = {
    "online_feed": lambda s, d: rank.online_feed(_surfaces(s, d), F.expr(AS_OF)).select("pos", rounded("score", 4).alias("score")),
    "rewards_feed": lambda s, d: rank.rewards_feed(_surfaces(s, d, "requires_membership", "membership_cost", "global_quality_score"), F.expr(AS_OF)).select("pos", rounded("score", 4).alias("score"), "quality"),
    "detect_gender": _gender,
    "has_deal_signals": _signals,
    "due_businesses": _due,
    "best_local_offer": _local,
    "carry_forward_evidence": _evidence,
    "open_stores": _stores,
    "detect_memberships": _memberships,
    "notification_policy": _policy,
}


def _back(k):
    return f"{AS_OF} - to_days(cast({k} as int))"


_HAS = {g: f"list_has_any(words, {[*w]})" for g, w in cap.GENDER_WORDS.items()}
_SUM = " + ".join(f"cast(contains(t, '{w}') as int)" for w in cap.DEAL_SIGNALS)
_SENT = "interactions where event_type = 'deal_unsaved'"

_DAY = "case pos % 4 when 0 then 5 when 1 then -20 else 0 end"
_FEE = "case when not requires_membership then 8 when membership_cost = 'free' then -2 when membership_cost = 'paid' then -15 else -5 end"

ORACLE_SQL = {
    "online_feed": f"""{ctes('offers')}, {_CAT} select pos, round(least(100, confidence_score * case discount_type when 'free_item' then 85 when 'percentage_off' then 40 + 0.6e0 * (5 + pos % 70) when 'amount_off' then 40 + least(40, cast(replace(discount_value, '$', '') as double) / 5) when 'sale_price' then 50 when 'free_shipping' then 35 when 'points' then 20 else 15 end), 4) as score
from cat where status in ('active', 'probably_active', 'online_only') and pos % 4 <> 1 and promotion_type not in ('reward', 'membership_benefit') and (redemption_method = 'online' or redemption_method = 'show_code' and deal_scope = 'online_only')""",
    "rewards_feed": f"""{ctes('offers')}, {_CAT} select pos, round(q + {_DAY} + case when pos % 7 = 0 then 25 else {_FEE} end, 4) as score,
  pos % 7 = 0 or (confidence_score >= 0.75 and (membership_cost = 'free' or discount_type = 'free_item' or q + {_DAY} + {_FEE} >= 60)) as quality from cat where promotion_type in ('reward', 'membership_benefit')""",
    "detect_gender": f"""{ctes('captures')}, w as (select doc_id, regexp_split_to_array(lower(concat_ws(' ', case doc_id % 7 when 0 then 'Women''s dresses' when 1 then 'Shoes for MEN' when 2 then 'kids/baby' when 3 then 'For her-him' when 4 then 'Boys' else '' end, text)), '[\\s\\-/'']+') as words from captures)
select doc_id, case when {_HAS['women']} and {_HAS['men']} then 'unisex' when {_HAS['women']} then 'women' when {_HAS['men']} then 'men' when {_HAS['kids']} then 'kids' end as target_gender from w""",
    "has_deal_signals": f"{ctes('captures')}, t as (select doc_id, lower(coalesce(case when doc_id % 3 = 0 then 'Happy HOUR bogo ' || text else text end, '')) as t from captures) select doc_id, {_SUM} >= 2 as has_signals from t",
    "due_businesses": f"{ctes('stores', 'interactions')} select store_id from stores where store_id not in (select user_id from interactions where id % 5 = 0 and floor((epoch({AS_OF}) - epoch(created_at)) / 86400) < 7)",
    "best_local_offer": f"{ctes('offers')}, r as (select concat('shop ', pos % 997) as business, pos, promotion_title, confidence_score, row_number() over (partition by pos % 997 order by confidence_score desc, pos) as n from offers where confidence_score >= 0.85 and promotion_title <> '') select business, pos, promotion_title, confidence_score from r where n = 1",
    "carry_forward_evidence": f"""{ctes('offers')}, n as (select pos, promotion_title as offer, deal_url as url, pos % 3 as h, case when pos % 4 = 0 then 'unverified' else 'supported' end as status, {_back('pos % 10')} as seen from offers),
f as (select deal_url as url, pos % 2 as h, max({_back('pos % 7')}) as failed from offers where pos % 11 = 0 group by 1, 2), p as (select promotion_title as offer, deal_url as url, pos % 2 as h, max({_back('pos % 5')}) as proved from offers group by 1, 2, 3),
j as (select n.*, failed, proved, coalesce(failed >= seen, false) as lost from n left join f using (url, h) left join p using (offer, url, h))
select pos, case when lost then 'unverified' else status end as status, case when not lost and status = 'supported' and proved > seen then proved else seen end as checked_at, case when lost then failed end as check_failed_at, lost or status <> 'supported' as needs_review from j""",
    "open_stores": f"""{ctes('stores')}, s as (select store_id as id, case when store_id % 13 = 0 then 60 else lat end as lat, lng, case store_id % 5 when 0 then 'Acme' when 1 then 'Acme Outlet' when 2 then 'ACME 12' when 4 then 'Other' end as store from stores
  where store_id % 7 <> 0 and store_id % 11 <> 0 and (store_id % 2 = 0 or store_id % 3 <> 1)),
a as (select * from (values ('Acme', ['Acme']), ('Acme Any', ['Acme', 'Acme Outlet', 'ACME 12']), ('Acme Out', ['Acme Outlet']), ('Other Shop', ['Other'])) as a(brand, names))
select brand, id, store, lat, lng from s join a on list_contains(names, store) where lat < 49.384358 and (brand <> 'Other Shop' or id % 3 = 0)""",
    "detect_memberships": f"""{ctes('emails', 'offers', 'stores')}, m as (select brand, conv_id, subject || chr(10) || case conv_id % 5 when 0 then 'Join Blue Sky Circle now. ' when 1 then concat('Your Sky', conv_id % 7, ' and Harbor Rewards are here. ') else '' end || body as t from emails),
o as (select brand, pos, case pos % 6 when 0 then 'Gold Tier' when 1 then 'Unknown' when 2 then brand || ' Rewards' when 3 then concat('Tier ', pos % 40) when 4 then 'VIP' end as program from offers where pos % 2 = 0),
u as (select brand, unnest(list_distinct(regexp_extract_all(t, '{msg.PROGRAM.replace("'", "''")}', 1))) as program, {_back('conv_id % 20')} as last_seen, 1 as turn from m
  union all select brand, program, {_back('pos % 9')}, 2 from o where program = 'Gold Tier' or program like 'Tier %' union all select brand, concat('Tier ', store_id % 60), {_back('store_id % 12')}, 0 from stores),
r as (select *, row_number() over (partition by program order by last_seen desc, turn, brand) as n from u) select program, brand, last_seen from r where n = 1""",
    "notification_policy": f"""{ctes('offers', 'users', 'interactions')}, {_CAT}, p0 as (select lower(brand) as b, lower(category) as c, promotion_id as promo_id, q, row_number() over (partition by lower(brand), lower(category) order by q desc, promotion_id) as n from cat where q >= 60),
p as (select b, c, promo_id, q from p0 where n = 1), f as (select user_id, lower(brand) as b, lower(category) as c, {{'at': created_at, 'yes': id % 2 = 0}} as said from interactions where event_type = 'not_interested'),
fp as (select user_id, b, c, min(said).yes as yes from (select user_id, p.b, p.c, said from f join p on f.b = p.b union all select user_id, p.b, p.c, said from f join p on f.c = p.c) group by 1, 2, 3),
acts as (select distinct user_id, lower(brand) as b from interactions where event_type in ('deal_card_opened', 'deal_card_clicked', 'fast_redeem_clicked')),
ids as (select user_id from users union select user_id from acts union select user_id from f),
d as (select i.user_id, p.*, q + case when lower(u.favorite_brand) = p.b then 40 else 0 end + case when lower(u.favorite_category) = p.c then 25 else 0 end + case when acts.b is not null then 15 else 0 end + case when yes then 35 else 0 end as score
  from ids i cross join p left join users u using (user_id) left join acts on acts.user_id = i.user_id and acts.b = p.b left join fp on fp.user_id = i.user_id and fp.b = p.b and fp.c = p.c where coalesce(yes, true)),
busy as (select user_id from {_SENT} and created_at <= {_NOON} group by 1 having count(*) filter (where cast(created_at as date) = date '2024-01-31') >= 2 or max(created_at) > {_NOON} - interval 4 hour),
cool as (select distinct user_id, lower(brand) as b from {_SENT} and created_at <= {_NOON} and cast(created_at as date) > date '2024-01-31' - 7),
r as (select *, row_number() over (partition by user_id order by round(score, 2) desc, promo_id) as n from d where round(score, 2) >= 95 and user_id not in (select user_id from busy) and not exists (select 1 from cool where cool.user_id = d.user_id and cool.b = d.b))
select user_id, promo_id, round(score, 2) as score from r where n = 1""",
}
