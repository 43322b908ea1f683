"""Search queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.joins import stored
from tallyloom.functions.text import rounded
from tallyloom.operators import search as op
from tallyloom.plans.domain import AS_OF, ctes, domain
from tallyloom.plans.ranking import _CAT, catalog

C = F.col

_ASKED = """select event_id as id, user_id, ts as created_at, case event_id % 11 when 0 then 'brand#1' when 1 then 'Food' when 2 then ' Tech ' when 3 then 'zzz'
  when 4 then 'Brand#12' when 5 then 'cold widget' when 6 then 'Free' when 7 then 'CODE17' when 8 then 'flights' when 9 then 'bn one' else 'food deals today' end as query
from {events} where event_type = 'signup'"""
_WORDS = """select * from (values ('Brand#1', 'alias', 0, 'bn one'), ('Brand#1', 'alias', 1, 'free B1'), ('Brand#12', 'alias', 0, 'twelve'), ('Brand#3', 'alias', 0, 'brand#12 three'),
  ('Brand#2', 'taxonomy', 0, 'flights'), ('Brand#2', 'taxonomy', 1, 'airfare'), ('Brand#5', 'tag', 0, 'zz'), ('Brand#7', 'tag', 0, 'flight'), ('Brand#7', 'tag', 1, 'zzzz'),
  ('Brand#4', 'blocked', 0, 'food'), ('Brand#9', 'blocked', 0, 'Tech')) as w(brand, kind, place, term)"""
_SUGGESTED = """select * from (values (0, 'Food', 'food', true), (0, 'Food', 'meal', true), (1, 'Deals', 'deals today', true), (2, 'Travel', 'travel', true), (2, 'Travel', 'flight', true),
  (3, 'Widgets', 'cold widget set', true), (4, 'Brand#1', 'Brand#1', false), (5, 'Brand#12', 'Brand#12', false), (6, 'Brand#13', 'Brand#13', false), (7, 'Brand#14', 'Brand#14', false), (8, 'Brand#15', 'Brand#15', false)) as g(place, name, term, two_way)"""
_KEYWORDS = """select * from (values (0, 'today', 'Daily'), (1, 'food', 'Food'), (2, 'tech', 'Tech'), (3, 'flight', 'Travel'), (4, 'deals', 'Retail')) as k(place, term, label)"""

#: What searches read of an offer.
_READ = [
    "brand", "category", "promotion_title", "short_summary", "promo_code", "global_quality_score", "confidence_score", "status", "requires_membership", "membership_cost",
    "redemption_method", "deal_scope", "promotion_type", "discount_type",
]


def _asked(spark, sf_dir):
    return spark.sql(_ASKED, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _offers(spark, sf_dir):
    """The catalog with keywords of both sorts, product categories, distances and memberships."""
    k = C("pos")
    return catalog(spark, sf_dir, *_READ).withColumns({
        "keywords_explicit": F.when(k % 7 == 0, F.array("category", F.lit("food deals"))), "keywords_contextual": F.when(k % 5 == 0, F.array(F.lit("tech week"), C("category"))),
        "product_categories": F.when(k % 3 == 0, F.array("category")), "distance_km": F.when(k % 4 == 0, (k % 100) / 10.0), "member": k % 2 == 0,
    })


def _matches(spark, sf_dir, offers):
    return op.search_match(_asked(spark, sf_dir), offers, spark.sql(_WORDS))


def _search(spark, sf_dir):
    offers = _offers(spark, sf_dir)
    bonus = domain(spark, sf_dir, "users").groupBy(C("favorite_brand").alias("brand")).agg((F.count("*") % 30).cast("double").alias("points"))
    return op.run_search(_matches(spark, sf_dir, offers), offers, "for_you", bonus).withColumn("best_score", rounded("best_score", 4))


def _context(spark, sf_dir):
    offers = _offers(spark, sf_dir)
    out = [op.context_deals(offers, c, radius_mi=5.0).withColumn("context", F.lit(c)) for c in ("near_me", "online")]
    return out[0].unionByName(out[1]).select("context", "brand", "best_pos", rounded("best_score", 4).alias("best_score"), "n_deals", "n_rewards", "contexts")


def _categories(spark, sf_dir):
    offers = _offers(spark, sf_dir)
    results = _matches(spark, sf_dir, offers).join(offers.select("pos", "category"), "pos").withColumn("score", rounded("score", 4))
    return op.query_category(_asked(spark, sf_dir), spark.sql(_KEYWORDS), results)


def _interest(spark, sf_dir):
    asked = _asked(spark, sf_dir).withColumn("query", F.trim(F.lower("query")))
    labels = stored(_categories(spark, sf_dir))
    return op.category_interest(asked.join(F.broadcast(labels), "query").withColumn("weight", 1 + C("id") % 3), F.expr(AS_OF))


QUERIES = {
    "search_match": lambda s, d: _matches(s, d, _offers(s, d)).withColumn("score", rounded("score", 4)),
    "run_search": _search,
    "context_deals": _context,
    "related_searches": lambda s, d: op.related_searches(_asked(s, d), s.sql(_SUGGESTED)),
    "query_category": _categories,
    "category_interest": _interest,
}


def _n(c):
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'))"


_LISTS = "".join(f", list_transform(coalesce((select list(term order by place) from w where w.brand = cat.brand and kind = '{k}'), []), lambda x: {_n('x')}) as w_{k}" for k in ("alias", "taxonomy", "tag", "blocked"))
_FITS = lambda c: f"list_filter({c}, lambda x: contains(x, query) or contains(query, x))"
_SEARCH = f"""{ctes('offers', 'users')}, {_CAT}, asked as ({_ASKED.format(events='events')}), qs as (select distinct {_n('query')} as query from asked), w as ({_WORDS}),
o as (select *, case when pos % 4 = 0 then (pos % 100) / 10.0e0 end as km, pos % 2 = 0 as member, {_n('brand')} as nb, case when pos % 7 = 0 then [category, 'food deals'] else [] end as ex,
  case when pos % 5 = 0 then ['tech week', category] else [] end as cx, case when pos % 3 = 0 then [category] else [] end as pc{_LISTS} from cat),
m1 as (select o.*, query, list_filter(w_alias, lambda x: starts_with(x, query)) as al, {_FITS('ex')} as fe, {_FITS('cx')} as fc, len({_FITS('pc')}) > 0 as fp, len({_FITS('w_tag')}) > 0 as ft,
  contains({_n('promotion_title')}, query) as tt, contains({_n('short_summary')}, query) as ts, coalesce({_n('promo_code')} = query, false) as tc, contains(category, query) as tg from o, qs where query <> ''),
m2 as (select *, case when nb = query then 1 when starts_with(nb, query) then 2 when len(al) > 0 then 3 when contains(nb, query) then 4 when len(fe) > 0 then 5 when len(fc) > 0 then 6 when fp then 7 when list_contains(w_taxonomy, query) then 8 end as t1 from m1),
m3 as (select *, coalesce(t1, case when tt then 8 when ts then 9 when tc then 3 when ft or tg then 9 end) as tier,
  coalesce(case t1 when 1 then 100 when 2 then 80 when 3 then (case when al[1] = query then 90 else 70 end) when 4 then 60 when 5 then (case when fe[1] = query then 80 else 70 end) when 6 then (case when fc[1] = query then 35 else 25 end) when 7 then 25 when 8 then 60 end, 0)
  + case when tt then 50 else 0 end + case when ts then 35 else 0 end + case when tc then 70 else 0 end + case when t1 is null and not tt and not ts and not tc and ft then 35 else 0 end + case when tg then 20 else 0 end
  + greatest(0, least(100, q)) / 4 + case when km is null then 0 when km * 0.621371e0 <= 0.5 then 15 when km * 0.621371e0 <= 1 then 12 when km * 0.621371e0 <= 2 then 8 when km * 0.621371e0 <= 5 then 4 else 1 end as score from m2),
m as (select * from m3 where tier is not null and not (tier >= 5 and list_contains(w_blocked, query)))"""
_REWARD = "promotion_type in ('reward', 'membership_benefit')"
_VISIT = "redemption_method in ('in_store', 'in_app', 'app_reward', 'show_code', 'open_maps') and deal_scope <> 'online_only'"
_ONLINE = "(redemption_method = 'online' or (redemption_method = 'show_code' and deal_scope = 'online_only'))"
_ALLOWED = "status in ('active', 'probably_active', 'online_only') and not (requires_membership and membership_cost = 'paid' and not member)"
_CHIPS = f"concat_ws(',', case when bool_or(not {_REWARD} and {_VISIT}) then 'Near Me' end, case when bool_or(not {_REWARD} and ({_ONLINE} or not ({_VISIT}))) then 'Online' end, case when bool_or({_REWARD}) then 'Rewards' end) as contexts"
_COUNTS = f"count(*) as n_deals, count(*) filter (where {_REWARD}) as n_rewards, {_CHIPS}"


def _browse(context, score, where):
    return f"(select '{context}' as context, brand, arg_max(pos, {{'s': {score}, 'p': -pos}}) as best_pos, round(max({score}), 4) as best_score, {_COUNTS} from o where {_ALLOWED} and confidence_score >= 0.65 and {where} group by brand order by max({score}) desc, brand limit 15)"


_LABEL = f"""{_SEARCH}, k as ({_KEYWORDS}), top as (select query, category, row_number() over (partition by query order by round(score, 4) desc, pos) as turn from m),
common as (select query, arg_min(category, {{'n': -n, 't': t}}) as common from (select query, category, count(*) as n, min(turn) as t from top where turn <= 10 group by 1, 2) where n >= 5 group by 1),
labels as (select a.query, coalesce((select arg_min(label, place) from k where contains(a.query, k.term)), common) as category from (select distinct trim(lower(query)) as query from asked) a left join common c on c.query = {_n('a.query')})"""

ORACLE_SQL = {
    "search_match": f"{_SEARCH} select query, pos, tier, round(score, 4) as score from m",
    "run_search": f"""{_SEARCH}, g as (select query, brand, arg_max({{'p': pos, 't': tier, 'c': category}}, {{'s': score, 'p': -pos}}) as b, max(score) as s, {_COUNTS} from m
  where {_ALLOWED} and confidence_score >= case when tier <= 3 then 0.5 else 0.65 end and (tier <= 4 or q >= 40) group by 1, 2)
select query, brand, b.p as best_pos, b.t as best_tier, b.c as category, round(s + 0.4e0 * coalesce((select count(*) % 30 from users where favorite_brand = brand), 0), 4) as best_score, n_deals, n_rewards, contexts from g""",
    "context_deals": f"{_SEARCH} {_browse('near_me', 'q + case when km * 0.621371e0 <= 0.5 then 30 when km * 0.621371e0 <= 1 then 25 when km * 0.621371e0 <= 2 then 18 else 8 end', f'{_VISIT} and km * 0.621371e0 <= 5')} union all {_browse('online', 'q', '''(redemption_method in ('online', 'show_code') or deal_scope = 'online_only')''')}",
    "related_searches": f"""with qs as (select distinct {_n('query')} as query from ({_ASKED.format(events='events')})), g as ({_SUGGESTED}),
n as (select query, name, min(place) as place from qs, g where contains({_n('term')}, query) or (two_way and contains(query, {_n('term')})) group by 1, 2), r as (select *, row_number() over (partition by query order by place, name) as turn from n)
select query, turn, name from r where turn <= 4""",
    "query_category": f"{_LABEL} select query, category from labels",
    "category_interest": f"""{_LABEL}, i as (select user_id, l.category, round(sum((1 + id % 3) * case when floor((epoch({AS_OF}) - epoch(created_at)) / 86400) <= 7 then 1.0e0 else 0.6e0 end), 6) as interest
  from asked a join labels l on l.query = trim(lower(a.query)) where l.category is not null and floor((epoch({AS_OF}) - epoch(created_at)) / 86400) <= 30 group by 1, 2)
select *, interest >= 2 as promoted, case when interest >= 2 then least(interest * 5, 25) else 0 end as boost, row_number() over (partition by user_id order by interest desc, category) as place from i""",
}
