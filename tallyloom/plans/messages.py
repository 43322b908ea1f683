"""Capture and message queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.text import rounded
from tallyloom.operators import captures as cap
from tallyloom.operators import messages as op
from tallyloom.plans.domain import AS_OF, ctes, domain
from tallyloom.plans.ranking import _CAT, catalog

C = F.col


def now():
    """The time of every job, as a column."""
    return F.expr(AS_OF)


def _captures(spark, sf_dir):
    return domain(spark, sf_dir, "captures")


def _emails(spark, sf_dir):
    return domain(spark, sf_dir, "emails")


def _pages(spark, sf_dir):
    k = C("doc_id") % 7
    d = _captures(spark, sf_dir)
    title = F.when(k == 0, "Access Denied").when(k == 1, "Oops Page Not Found").when(k == 5, "Something went wrong.").otherwise(C("brand"))
    return d.select("doc_id", title.alias("title"), F.when(k == 2, F.concat(F.lit("Please verify you are HUMAN. "), C("text"))).otherwise(C("text")).alias("text"), F.when(k == 3, "https://x.example.com/Verify?a=1").when(k == 4, "https://x.example.com/page-not-found").otherwise("https://x.example.com/").alias("final_url"))


def _errors(spark, sf_dir):
    said = F.element_at(F.array(*(F.lit(x) for x in ("Request TIMED out", "Invalid JSON at 3", "no concrete offer", "ValidationError: validation", "HTTP 404", "connection refused", "not valid json", "could not extract", "odd\nerror"))), (C("doc_id") % 9 + 1).cast("int"))
    return _captures(spark, sf_dir).select("doc_id", F.concat_ws(" ", said, F.when(C("doc_id") % 9 == 8, C("text"))).alias("error"))


def _log(spark, sf_dir):
    k = C("doc_id") % 4
    line = F.when(k == 0, F.concat(F.lit("[FAILED] "), "brand", F.lit(": C:/failed/x.json"))).when(k == 1, F.concat(F.lit("[OK] "), "brand", F.lit(": 3 offers"))).when(k == 2, F.concat("brand", F.lit(": https://x.example.com -> skipped"))).otherwise(F.lit("nothing to tell"))
    return _captures(spark, sf_dir).select(line.alias("value"))


def _kept(spark, sf_dir):
    """New offers of some brands, and the old ones of the rest."""
    offers = domain(spark, sf_dir, "offers").select("pos", "brand", "promotion_title")
    return cap.keep_previous_if_empty(offers.where("brand < 'Brand#2'"), offers.where("pos % 2 = 0"))


def _sources(spark, sf_dir):
    """The brands that have captures, and four that have none, of which two name a home page only."""
    new = spark.range(4).select(F.concat(F.lit("new"), "id").alias("brand"), F.array(F.concat(F.lit("https://n.example.com"), F.when(C("id") % 2 == 0, "/").otherwise("/deals"))).alias("urls"))
    return _captures(spark, sf_dir).select("brand").distinct().withColumn("urls", F.array(F.lit("https://x.example.com/"))).unionByName(new)


def _combined(spark, sf_dir):
    pages = _captures(spark, sf_dir).select("brand", C("doc_id").alias("pos"), F.concat(F.lit("u"), C("doc_id")).alias("url"), "text", F.when(C("doc_id") % 3 == 0, C("lang")).alias("title"))
    hashes = cap.section_hashes(cap.combine_sections(pages)).select(C("brand").alias("of"), "text_sha")
    return cap.first_titles(pages).join(hashes, C("brand").eqNullSafe(C("of")), "left").select("brand", F.coalesce("text_sha", F.sha2(F.lit(""), 256)).alias("text_sha"), "title")


def _signals(spark, sf_dir):
    return op.classify_visibility(op.email_signals(_emails(spark, sf_dir)))


def _candidates(spark, sf_dir):
    k = C("pos")
    c = catalog(spark, sf_dir).withColumns({
        "valid_days": F.when(k % 5 == 0, F.array(F.lit("Mon"))).when(k % 5 == 1, F.array(F.lit("wednesday"))).when(k % 5 == 2, F.array(F.lit("Tue"), F.lit("Wed"))),
        "new_user_only": k % 7 == 0, "birthday_related": k % 6 == 0, "purchase_required": k % 4 == 0,
        "minimum_spend": F.when(k % 11 == 0, 20.0), "visibility": F.when(k % 9 == 0, "private_user_offer").otherwise("public_general_offer"),
    })
    users = domain(spark, sf_dir, "users")
    brands = lambda where: users.where(where).select(F.upper("favorite_brand").alias("brand"))
    affinity = users.groupBy(C("favorite_brand").alias("brand")).agg(F.count_if(C("user_id") % 9 == 0).alias("email_count"))
    return op.notification_candidates(c, brands("user_id % 150 = 7"), brands("user_id % 150 = 11"), affinity, now(), F.lit("1990-02-10").cast("date"))


def _push(spark, sf_dir):
    c = catalog(spark, sf_dir).select(C("promotion_id").alias("promo_id"), "brand", "category", C("global_quality_score").alias("notify_score"))
    events = domain(spark, sf_dir, "interactions")
    sent = events.where("id % 3 = 0").select("user_id", F.concat(F.lit("p"), C("id") % 2000).alias("promo_id"), C("created_at").alias("sent_at"))
    return op.push_selection(domain(spark, sf_dir, "users"), c, sent, events, domain(spark, sf_dir, "searches"), now(), least=50.0)


def _deals(spark, sf_dir):
    """E-mail offers of users, with the columns that ranking reads."""
    e = op.classify_visibility(_emails(spark, sf_dir))
    k = C("conv_id") % 6
    return e.select("user_id", "message_id", "brand", F.when(k < 2, "food").when(k < 4, "tech").otherwise("travel").alias("category"), F.when(k == 5, "BOGO lunch").otherwise(C("subject")).alias("promotion_title"), F.when(k == 0, "free_item").when(k == 1, "points").otherwise("percentage_off").alias("discount_type"), F.lit("20%").alias("discount_value"), F.lit(None).cast("string").alias("promo_code"), "visibility", (C("conv_id") % 80).cast("double").alias("global_quality_score"), F.lit(0.8).alias("confidence_score"), (k == 3).alias("requires_membership"))


def _ranked(spark, sf_dir):
    users = _emails(spark, sf_dir).select("user_id").distinct()
    profiles = users.select("user_id", F.array(F.concat(F.lit("brand#"), 1 + C("user_id") % 25)).alias("favorite_brands"), F.array(F.lit("food")).alias("favorite_categories"), F.array(F.lit("free"), F.lit("bogo")).alias("deal_priorities"), F.array(F.concat(F.lit("brand#"), 1 + C("user_id") % 9)).alias("hidden_brands"))
    brands = users.select("user_id", F.concat(F.lit("Brand#"), 1 + C("user_id") % 13).alias("brand"), (C("user_id") * 3 % 200).alias("affinity_score"))
    categories = users.where("user_id % 2 = 0").select("user_id", F.lit("tech").alias("category"), (C("user_id") % 150).alias("affinity_score"))
    return op.personal_email_rank(_deals(spark, sf_dir), profiles, brands, categories)


QUERIES = {
    "detect_bad_page": lambda s, d: cap.detect_bad_page(_pages(s, d)).select("doc_id", "bad_reason"),
    "classify_failures": lambda s, d: cap.classify_failures(_errors(s, d)).select("doc_id", "reason"),
    "pipeline_log_summary": lambda s, d: cap.pipeline_log_summary(_log(s, d)),
    "keep_previous_if_empty": _kept,
    "capture_status": lambda s, d: cap.capture_status(_captures(s, d), _captures(s, d).where("doc_id % 4 = 0").select("brand", F.sha2("text", 256).alias("content_hash"))).select("doc_id", "content_hash", "status"),
    "keep_latest_captures": lambda s, d: cap.keep_latest_captures(_captures(s, d), 3).select("doc_id", "brand", "place"),
    "combine_sections": _combined,
    "raw_text_summary": lambda s, d: cap.raw_text_summary(_captures(s, d)),
    "text_candidates": lambda s, d: cap.text_candidates(_captures(s, d)),
    "select_parse_candidates": lambda s, d: cap.select_parse_candidates(cap.text_candidates(_captures(s, d)), _captures(s, d).where("doc_id % 2 = 0").select("brand", "doc_id"), _captures(s, d).where("doc_id % 100 = 0").select("brand").distinct(), 10).select("doc_id", "brand", "hits", "length"),
    "brand_health": lambda s, d: cap.brand_health(_captures(s, d).select("brand").distinct(), _captures(s, d), domain(s, d, "offers").select(F.concat(F.lit("src"), C("pos") % 15).alias("brand"), "confidence_score")),
    "brand_status": lambda s, d: cap.brand_status(_sources(s, d), _captures(s, d), domain(s, d, "offers").select(F.concat(F.lit("src"), C("pos") % 15).alias("brand"), (C("pos") % 2 == 0).alias("synthesized")), _sources(s, d).where("brand in ('src3', 'new3')")),
    "email_signals": lambda s, d: op.email_signals(_emails(s, d)).select("message_id", C("keyword_hits")["save"].alias("n_save"), C("keyword_hits")["offer"].alias("n_offer"), F.array_join("promo_codes", ",").alias("codes"), F.array_join("discount_phrases", ",").alias("discounts"), F.array_join("expiry_phrases", ",").alias("expiries"), "has_signal"),
    "classify_visibility": lambda s, d: op.classify_visibility(_emails(s, d).withColumn("body", F.when(C("conv_id") % 5 == 0, F.concat(F.lit("Your reward is here. "), C("body"))).when(C("conv_id") % 5 == 1, F.concat(F.lit("A plus member price. "), C("body"))).otherwise(C("body")))).select("message_id", "visibility"),
    "email_ingest_status": lambda s, d: op.email_ingest_status(_emails(s, d).withColumn("sender", C("brand")), _emails(s, d).where("conv_id % 3 = 0").select(F.sha2(F.concat_ws("\n", "brand", "subject", "body"), 256).alias("content_hash"))).select("message_id", "status"),
    "email_candidates": lambda s, d: op.email_candidates(_signals(s, d)),
    "inbox_brand_affinity": lambda s, d: op.inbox_brand_affinity(_emails(s, d).select("brand", C("conv_id").alias("seen_at")), _emails(s, d).where("turn = 0").select("brand", F.lit(2).cast("long").alias("email_count"), C("conv_id").alias("last_seen"))),
    "personal_email_rank": lambda s, d: _ranked(s, d).select("message_id", rounded("personal_rank_score", 3).alias("score"), F.array_join("rank_reasons", ",").alias("reasons")),
    "deal_fingerprint": lambda s, d: op.deal_fingerprint(_deals(s, d)).select("message_id", "fingerprint"),
    "upsert_user_deals": lambda s, d: op.upsert_user_deals(*(op.deal_fingerprint(_ranked(s, d)).where(w).select("user_id", "fingerprint", (C("personal_rank_score") + x).alias("personal_rank_score"), F.lit("2024-02-01").cast("date").alias("end_date"), (now() - F.expr("interval 1 day") * (F.length("message_id") * 2)).alias("received_at")) for w, x in (("length(message_id) > 0", 0), ("category = 'food'", 5))), now()).select("user_id", "fingerprint", rounded("personal_rank_score", 3).alias("score"), "status", "expires_at"),
    "notification_candidates": lambda s, d: _candidates(s, d).select("pos", "promo_id", F.array_join("signal_groups", ",").alias("groups"), "skip_reason"),
    "notification_skip_counts": lambda s, d: op.skip_counts(_candidates(s, d)),
    "push_selection": _push,
}

_COUNT = "cast((length(lower({c})) - length(replace(lower({c}), '{w}', ''))) / {n} as bigint)"
_HITS = " + ".join(f"length(regexp_extract_all(lower(text), '\\b{w}\\b'))" for w in cap.CANDIDATE_WORDS)
_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LATEST = "latest as (select *, row_number() over (partition by brand order by scraped_at desc, doc_id desc) as place from captures)"
_TC = f"{_LATEST}, tc as (select doc_id, brand, length(text) as length, {_HITS} as hits, case when length(text) >= 300 then 'usable' else 'too_short' end as status from latest where place = 1)"
_SIG = f"""sig as (select *, concat(subject, chr(10), body) as txt from emails), x as (select *, list_distinct_in_order(regexp_extract_all(txt, '{op.CODE}', 1)) as codes from sig)"""


def _ordered(expr: str) -> str:
    return f"list_filter({expr}, lambda v, i: list_position({expr}, v) = i)[1:10]"


_VIS = f"case when regexp_matches(subject, '{op.PRIVATE_SUBJECT}') or regexp_matches(concat(subject, chr(10), body), '{op.PRIVATE_BODY}') then 'private_user_offer' when regexp_matches(concat(subject, chr(10), body), '{op.MEMBER}') then 'member_offer' else 'public_general_offer' end"
_DEALS = f"""deals as (select user_id, message_id, brand, case when conv_id % 6 < 2 then 'food' when conv_id % 6 < 4 then 'tech' else 'travel' end as category, case when conv_id % 6 = 5 then 'BOGO lunch' else subject end as title,
  case conv_id % 6 when 0 then 'free_item' when 1 then 'points' else 'percentage_off' end as kind, {_VIS} as visibility, cast(conv_id % 80 as double) as q, conv_id % 6 = 3 as needs from emails),
flags as (select *, lower(brand) = concat('brand#', 1 + user_id % 25) as f0, category = 'food' as f1, brand = concat('Brand#', 1 + user_id % 13) as f2, category = 'tech' and user_id % 2 = 0 as f3, lower(brand) = concat('brand#', 1 + user_id % 9) as hid from deals),
rk as (select *, case when hid then 0 else greatest(0, least(100, case when q <> 0 then q else 65 end + case when f0 then 20 else 0 end + case when f1 then 12 else 0 end + case when f2 then least((user_id * 3 % 200) / 8.0e0, 14) else 0 end + case when f3 then least((user_id % 150) / 10.0e0, 10) else 0 end
  + case visibility when 'private_user_offer' then 9 when 'member_offer' then 6 else 0 end + case when kind = 'free_item' then 16 else 0 end + case when title like 'BOGO%' then 7 else 0 end - case when kind = 'points' and not f0 then 10 else 0 end - case when needs and visibility <> 'member_offer' then 5 else 0 end)) end as score,
  case when hid then 'hidden_brand' else concat_ws(',', case when f0 then 'favorite_brand' end, case when f1 then 'favorite_category' end, case when f2 then 'brand_affinity' end, case when f3 then 'category_affinity' end, case visibility when 'private_user_offer' then 'private_email_offer' when 'member_offer' then 'member_email_offer' end,
  case when kind = 'free_item' then 'free_item,matches_free_priority' end, case when title like 'BOGO%' then 'matches_bogo_priority' end, case when kind = 'points' and not f0 then 'points_without_affinity' end, case when needs and visibility <> 'member_offer' then 'membership_required' end) end as reasons,
  sha256(concat_ws(chr(10), cast(user_id as varchar), message_id, brand, title, kind, '20%', '')) as fingerprint from flags)"""
_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_NOTE = f"""ub as (select {_KEY.format('favorite_brand')} as k, bool_or(user_id % 150 = 7) as fav, bool_or(user_id % 150 = 11) as mem, count(*) filter (where user_id % 9 = 0) as emails from users group by 1),
note as (select c.*, coalesce(u.fav, false) as fav, coalesce(u.mem, false) as mem, coalesce(u.emails, 0) as emails, end_date - date '2024-01-31' as days from cat c left join ub u on u.k = {_KEY.format('c.brand')}),
n2 as (select *, fav or mem or emails >= 10 or pos % 9 = 0 or pos % 6 = 0 as g1,
  coalesce(discount_type = 'free_item', false) and not regexp_matches(promotion_title, '{op.TRIAL}') or regexp_matches(promotion_title, '{op.BOGO}')
  or discount_type = 'percentage_off' and coalesce(try_cast(regexp_extract(discount_value, '([0-9]+) *%', 1) as double) >= 50, false) or coalesce(days between 0 and 1, false) as g2,
  pos % 5 = 1 or coalesce(days = 0, false) or (not requires_membership and not requires_app and pos % 11 <> 0 and pos % 4 <> 0) as g3 from note),
n3 as (select *, case when q < 65 then 'below_threshold' when confidence_score < 0.75 then 'low_confidence' when discount_type = 'points' then 'points' when pos % 5 = 0 then 'wrong_day'
  when regexp_matches(concat_ws(' ', promotion_title, short_summary), '{op.DEMOGRAPHIC}') then 'demographic_restricted' when contains(membership_cost, 'paid') and requires_membership and not mem then 'paid_membership_not_member'
  when pos % 7 = 0 and (mem or emails >= 3) then 'new_user_only_existing_customer' when cast(g1 as int) + cast(g2 as int) + cast(g3 as int) < 2 then 'insufficient_signal_diversity' end as skip_reason from n2)"""
_CAT_VALUE = _CAT.replace("select * exclude (saved), concat", "select * exclude (saved), saved as saved_value, concat")

ORACLE_SQL = {
    "detect_bad_page": f"""{ctes('captures')}, p as (select *, lower(substr(case when doc_id % 7 = 2 then concat('Please verify you are HUMAN. ', text) else text end, 1, 1200)) as t from captures)
select doc_id, case when doc_id % 7 = 0 then 'access_denied' when doc_id % 7 = 1 then 'page_not_found' when doc_id % 7 = 5 then 'generic_error' when contains(t, 'access denied') or contains(t, 'access to this page has been denied') then 'access_denied'
  when contains(t, 'enable javascript and cookies') or contains(t, 'verify you are human') or contains(t, 'request unsuccessful') then 'bot_or_queue_page' when contains(t, 'something went wrong') then 'generic_error'
  when doc_id % 7 = 3 then 'bot_or_queue_page' when doc_id % 7 = 4 then 'page_not_found' end as bad_reason from p""",
    "classify_failures": f"""{ctes('captures')} select doc_id, case doc_id % 9 when 0 then 'LLM timeout' when 1 then 'invalid JSON from LLM' when 2 then 'no concrete promotion extracted' when 3 then 'LLM output failed validation' when 4 then 'Ollama model not found (404)'
  when 5 then 'connection error' when 6 then 'invalid JSON from LLM' when 7 then 'LLM returned no promotions list' else
  case {' '.join(f"when contains(lower(text), '{w}') then '{r}'" for w, r in cap.FAILURES)} else substr(concat('odd error ', replace(text, chr(10), ' ')), 1, 120) end end as reason from captures""",
    "pipeline_log_summary": f"""{ctes('captures')}, l as (select case doc_id % 4 when 0 then 'failed' when 1 then 'ok' when 2 then 'skipped' end as outcome, brand from captures)
select outcome, count(*) as n, array_to_string(list_sort(list_distinct(list(brand))), ',') as brands from l where outcome is not null group by 1""",
    "keep_previous_if_empty": f"{ctes('offers')} select pos, brand, promotion_title from offers where brand < 'Brand#2' union all select pos, brand, promotion_title from offers where pos % 2 = 0 and brand >= 'Brand#2'",
    "capture_status": f"{ctes('captures')} select doc_id, sha256(text) as content_hash, case when length(text) < 100 then 'failed' when exists (select 1 from captures h where h.doc_id % 4 = 0 and h.brand = c.brand and h.text = c.text) then 'skipped_duplicate_hash' else 'success' end as status from captures c",
    "keep_latest_captures": f"{ctes('captures')}, {_LATEST} select doc_id, brand, place from latest where place <= 3",
    "combine_sections": f"{ctes('captures')} select brand, sha256(string_agg(concat('=== u', doc_id, ' ===', chr(10), text), chr(10) || chr(10) order by doc_id)) as text_sha, arg_min(case when doc_id % 3 = 0 then lang end, doc_id) filter (where doc_id % 3 = 0 and lang is not null) as title from captures group by brand",
    "raw_text_summary": f"""{ctes('captures')} select doc_id, brand, length(text) as length, len(regexp_extract_all(text, '\\r\\n|{_BREAK}')) + case when text = '' or regexp_matches(text, '{_BREAK}\\z') then 0 else 1 end as lines,
  replace(substr(text, 1, 500), chr(10), ' ') as start, {', '.join(_COUNT.format(c='text', w=w, n=len(w)) + f' as n_{w}' for w in cap.COUNTED)} from captures""",
    "text_candidates": f"{ctes('captures')}, {_TC} select * from tc",
    "select_parse_candidates": f"{ctes('captures')}, {_TC} select doc_id, brand, hits, length from tc where status = 'usable' and doc_id % 2 <> 0 order by hits desc, length desc, brand limit 10",
    "brand_health": f"""{ctes('captures', 'offers')}, t as (select brand, arg_max(length(text), (scraped_at, doc_id)) as length from captures group by 1), n as (select concat('src', pos % 15) as brand, count(*) as offers, count(*) filter (where confidence_score >= 0.65) as confident from offers group by 1)
select brand, length, coalesce(offers, 0) as offers, coalesce(confident, 0) as confident, case when length is null then 'never_captured' when length < 400 then 'too_short' when coalesce(offers, 0) = 0 then 'no_offers' when confident = 0 then 'weak' else 'healthy' end as health
from (select distinct brand from captures) left join t using (brand) left join n using (brand)""",
    "brand_status": f"""{ctes('captures', 'offers')}, t as (select brand, arg_max({{'n': length(text), 'blocked': {" or ".join(f"contains(lower(text), '{w}')" for w in cap.BLOCK_SIGNALS)}}}, (scraped_at, doc_id)) as c from captures group by 1),
n as (select concat('src', pos % 15) as brand, count(*) filter (where pos % 2 <> 0) as llm, count(*) filter (where pos % 2 = 0) as synthetic from offers group by 1), f as (select unnest(['src3', 'new3']) as brand),
src as (select distinct brand, false as home from captures union all select concat('new', range), range % 2 = 0 from range(4)),
a as (select *, exists (select 1 from f where f.brand = src.brand) as failed from src left join t using (brand) left join n using (brand))
select brand, case when failed then 'parse_failed' when c is null then if(home, 'homepage_only', 'never_scraped') when c.n < 400 then 'too_short' when c.blocked then 'blocked_or_challenge' when llm > 0 then 'success_llm' when synthetic > 0 then 'success_synthetic' else 'zero_deals_real' end as status,
  coalesce(c.n, 0) as raw_chars, case when failed or c is null then 0 else coalesce(llm, 0) end as llm_deals, case when failed or c is null then 0 else coalesce(synthetic, 0) end as synth_deals from a""",
    "email_signals": f"""{ctes('emails')}, s as (select *, concat(subject, chr(10), body) as txt from emails),
x as (select message_id, txt, list_transform(regexp_extract_all(txt, '{op.CODE}', 1), lambda v: upper(v)) as c, list_concat(regexp_extract_all(txt, '{op.PERCENT}'), regexp_extract_all(txt, '{op.MONEY}')) as d, regexp_extract_all(txt, '{op.EXPIRY}', 1) as e from s)
select message_id, {_COUNT.format(c='txt', w='save', n=4)} as n_save, {_COUNT.format(c='txt', w='offer', n=5)} as n_offer, array_to_string({_ordered('c')}, ',') as codes, array_to_string({_ordered('d')}, ',') as discounts, array_to_string({_ordered('e')}, ',') as expiries,
  {" or ".join(f"contains(lower(txt), '{w}')" for w in op.KEYWORDS)} or len(c) > 0 or len(d) > 0 or len(e) > 0 as has_signal from x""",
    "classify_visibility": f"{ctes('emails')}, e as (select * replace (case conv_id % 5 when 0 then concat('Your reward is here. ', body) when 1 then concat('A plus member price. ', body) else body end as body) from emails) select message_id, {_VIS} as visibility from e",
    "email_ingest_status": f"{ctes('emails')} select message_id, case when length(body) < 40 then 'failed' when exists (select 1 from emails h where h.conv_id % 3 = 0 and h.brand = e.brand and h.subject = e.subject and h.body = e.body) then 'skipped_duplicate_hash' else 'success' end as status from emails e",
    "email_candidates": f"""{ctes('emails')}, s as (select *, concat(subject, chr(10), body) as txt, {_VIS} as visibility from emails), h as (select *, {" + ".join(_COUNT.format(c='txt', w=w, n=len(w)) for w in op.KEYWORDS)} as hits from s)
select message_id, visibility, hits from h where hits > 0 qualify row_number() over (partition by subject, body order by message_id) = 1""",
    "inbox_brand_affinity": f"{ctes('emails')} select brand, count(*) + 2 * count(*) filter (where turn = 0) as email_count, max(conv_id) as last_seen from emails group by 1",
    "personal_email_rank": f"{ctes('emails')}, {_DEALS} select message_id, round(score, 3) as score, case when reasons = '' then 'deal_quality' else reasons end as reasons from rk",
    "deal_fingerprint": f"{ctes('emails')}, {_DEALS} select message_id, fingerprint from rk",
    "upsert_user_deals": f"{ctes('emails')}, {_DEALS}, m as (select user_id, fingerprint, max(case when category = 'food' then score + 5 else score end) as s, max(length(message_id)) as n from rk group by 1, 2) select user_id, fingerprint, round(s, 3) as score, case when s >= 70 and n * 2 <= 14 then 'active' else 'suppressed' end as status, date '2024-02-02' as expires_at from m",
    "notification_candidates": f"{ctes('offers', 'users')}, {_CAT_VALUE}, {_NOTE} select pos, substr(regexp_replace(regexp_replace(lower(concat(brand, '_', promotion_title)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 100) as promo_id, concat_ws(',', case when g1 then 'personal' end, case when g2 then 'value' end, case when g3 then 'context' end) as groups, skip_reason from n3",
    "notification_skip_counts": f"{ctes('offers', 'users')}, {_CAT_VALUE}, {_NOTE} select coalesce(skip_reason, 'candidate') as reason, count(*) as n from n3 group by 1",
    "push_selection": f"""{ctes('offers', 'users', 'interactions', 'searches')}, {_CAT}, cd as (select promotion_id as promo_id, lower(brand) as b, category as c, q from cat where q >= 50),
sent as (select user_id, concat('p', id % 2000) as promo_id from interactions where id % 3 = 0 and created_at >= {AS_OF} - interval 7 day),
ac as (select user_id, lower(brand) as b, category as c from interactions where created_at >= {AS_OF} - interval 7 day and event_type in ('deal_card_opened', 'redeem_clicked')),
sq as (select distinct user_id, lower(trim(query)) as w from searches where created_at >= {AS_OF} - interval 7 day),
sb as (select distinct user_id, b from sq, (select distinct b from cd) where contains(b, w) or contains(w, b)), sc as (select distinct user_id, c from sq, (select distinct c from cd) where contains(c, w) or contains(w, c)),
cb as (select distinct user_id, b from ac), cc as (select distinct user_id, c from ac),
p as (select u.user_id, cd.*, sb.b is not null as s1, cb.b is not null as s2, cd.b = lower(favorite_brand) as s3, sc.c is not null as s4, cc.c is not null as s5, cd.c = favorite_category as s6 from users u cross join cd
  left join sb on sb.user_id = u.user_id and sb.b = cd.b left join cb on cb.user_id = u.user_id and cb.b = cd.b left join sc on sc.user_id = u.user_id and sc.c = cd.c left join cc on cc.user_id = u.user_id and cc.c = cd.c
  where not exists (select 1 from sent where sent.user_id = u.user_id and sent.promo_id = cd.promo_id)),
r as (select user_id, promo_id, round(q + 55 * s1::int + 45 * s2::int + 35 * s3::int + 30 * s4::int + 20 * s5::int + 20 * s6::int, 2) as score, case when s1 then 'searched_brand' when s2 then 'clicked_brand' when s3 then 'fav_brand' when s4 then 'searched_cat' when s5 then 'clicked_cat' when s6 then 'fav_cat' else 'none' end as reason from p)
select user_id, promo_id, score, reason from r where score >= case when reason = 'none' then 110 else 90 end qualify row_number() over (partition by user_id order by score desc, promo_id desc) = 1""",
}
