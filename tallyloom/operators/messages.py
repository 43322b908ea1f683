"""Offers from e-mail, and choosing what to notify users of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.joins import small, stored
from tallyloom.functions.text import offer_id, rounded

C = F.col
# Signals in promotional e-mails.
KEYWORDS = ["sale", "deal", "offer", "discount", "promo", "coupon", "reward", "rewards", "free", "save", "clearance", "expires", "valid"]
CODE = r"(?i)\b(?:promo\s+code|coupon\s+code|offer\s+code|code|use\s+code|enter\s+code)\s*[:\-]?\s*([A-Z0-9][A-Z0-9-]{3,24})\b"
PERCENT = r"(?i)\b(?:up\s+to\s+)?\d{1,3}%\s+off\b|\bsave\s+\d{1,3}%"
MONEY = r"(?i)\$\d+(?:\.\d{2})?\s+off\b|\bsave\s+\$\d+(?:\.\d{2})?\b"
EXPIRY = r"(?i)\b(?:expires?|ends?|valid\s+(?:through|until))\s+(?:on\s+)?([A-Za-z]{3,9}\.?\s+\d{1,2}(?:,\s*\d{4})?|\d{1,2}/\d{1,2}(?:/\d{2,4})?)"
PRIVATE_SUBJECT = r"(?i)\bjust\s+for\s+you\b|\bpersonali[sz]ed\b|\byour\s+(?:reward|offer|gift|exclusive)\b"
PRIVATE_BODY = r"(?i)\bjust\s+for\s+you\b|\byour\s+(?:reward|offer|gift|code|coupon|account|exclusive)\b|\bunique\s+(?:code|offer)\b|\bone[-\s]time\s+(?:code|offer|use)\b|\bpersonali[sz]ed\b|\bexclusive(?:ly)?\s+for\s+you\b"
MEMBER = r"(?i)\b(?:rewards?|loyalty|insider|circle|plus|elite|member)\s+(?:member|exclusive|only|offer|get|price|benefit)\b|\bfor\s+(?:our\s+)?(?:rewards?|loyalty|insider|circle|elite)\s+members?\b"
# Bonuses and thresholds of push messages.
BONUS = {"fav_brand": 35.0, "fav_cat": 20.0, "searched_brand": 55.0, "searched_cat": 30.0, "clicked_brand": 45.0, "clicked_cat": 20.0}
PERSONAL, UNKNOWN, PUSH_FLOOR = 90.0, 110.0, 65.0
NOTIFY_FLOOR, MIN_GROUPS, LEAST_CONFIDENCE = 65.0, 2, 0.75
BOGO = r"(?i)\bbogo\b|buy.one.get.one"
TRIAL = r"(?i)\bfree\s+trial\b|\btrial\b|\d+\s+(?:months?|weeks?|days?)\s+free"
DEMOGRAPHIC = r"(?i)\b(veteran|veterans|military|active[- ]duty|student|students|teacher|teachers|senior|seniors|first[- ]responder|first[- ]responders|healthcare|nurse|nurses|employee\s+discount|staff\s+discount)\b"


def email_signals(emails: DataFrame) -> DataFrame:
    """Word counts, and at most ten different codes, discounts and expiry phrases in the order they come."""
    text = F.concat_ws("\n", "subject", "body")
    low = F.lower(text)
    count = lambda w: ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int")
    hits = F.create_map(*(x for w in KEYWORDS for x in (F.lit(w), count(w))))
    d = emails.withColumns({
        "keyword_hits": hits,
        "promo_codes": F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CODE), 1), F.upper)), 1, 10),
        "discount_phrases": F.slice(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(PERCENT), 0), F.regexp_extract_all(text, F.lit(MONEY), 0))), 1, 10),
        "expiry_phrases": F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(EXPIRY), 1)), 1, 10),
    })
    some = F.exists(F.map_values("keyword_hits"), lambda n: n > 0)
    return d.withColumn("has_signal", some | (F.size("promo_codes") > 0) | (F.size("discount_phrases") > 0) | (F.size("expiry_phrases") > 0))


def classify_visibility(emails: DataFrame) -> DataFrame:
    text = F.concat_ws("\n", "subject", "body")
    kind = F.when(C("subject").rlike(PRIVATE_SUBJECT) | text.rlike(PRIVATE_BODY), "private_user_offer").when(text.rlike(MEMBER), "member_offer").otherwise("public_general_offer")
    return emails.withColumn("visibility", kind)


def email_ingest_status(emails: DataFrame, history: DataFrame) -> DataFrame:
    """content_hash of sender, subject and text; failed for short texts, skipped for known hashes, else success."""
    d = emails.withColumn("content_hash", F.sha2(F.concat_ws("\n", "sender", "subject", "body"), 256))
    known = history.select("content_hash", F.lit(True).alias("known")).distinct()
    return d.join(known, "content_hash", "left").withColumn("status", F.when(F.length("body") < 40, "failed").when(C("known"), "skipped_duplicate_hash").otherwise("success")).drop("known")


def email_candidates(signals: DataFrame) -> DataFrame:
    """E-mails with a signal and something concrete, or meant for members or one user; the first of equal contents."""
    concrete = (F.size("promo_codes") > 0) | (F.size("discount_phrases") > 0) | (F.size("expiry_phrases") > 0) | (C("visibility") != "public_general_offer")
    hits = F.aggregate(F.map_values("keyword_hits"), F.lit(0), lambda a, x: a + x)
    d = signals.where(C("has_signal") & concrete).withColumn("hits", hits).withColumn("content", F.sha2(F.concat_ws("\n", "subject", "body"), 256))
    return d.groupBy("content").agg(F.min_by(F.struct("message_id", "visibility", "hits"), "message_id").alias("o")).select("o.*")


def inbox_brand_affinity(emails: DataFrame, previous: DataFrame) -> DataFrame:
    """How many e-mails of a brand there have been, and the last; added to what was counted before."""
    now = emails.groupBy("brand").agg(F.count("*").alias("email_count"), F.max("seen_at").alias("last_seen"))
    return now.unionByName(previous).groupBy("brand").agg(F.sum("email_count").alias("email_count"), F.max("last_seen").alias("last_seen"))


def in_scope_messages(messages: DataFrame, as_of: Column) -> DataFrame:
    return messages.where(F.array_contains("labels", "CATEGORY_PROMOTIONS") & C("received_at").between(as_of - F.expr("interval 14 days"), as_of))


def personal_email_rank(deals: DataFrame, profiles: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    """personal_rank_score (0 to 100) and at most eight reasons. profiles: user_id with arrays of favourites, priorities and
    hidden brands in lower case; brands and categories: affinity scores of users."""
    top = lambda df, by: df.withColumn("_t", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("affinity_score"), by))).where("_t <= 25").select("user_id", C(by), C("affinity_score").alias(f"_{by}_affinity"))
    d = deals.join(profiles, "user_id", "left").join(top(brands, "brand"), ["user_id", "brand"], "left").join(top(categories, "category"), ["user_id", "category"], "left")
    brand, category, title, kind = F.lower("brand"), F.lower("category"), F.lower("promotion_title"), F.lower("discount_type")
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    base = F.when(F.coalesce("global_quality_score", F.lit(0.0)) != 0, C("global_quality_score")).otherwise(45 + F.coalesce("confidence_score", F.lit(0.0)) * 25)
    favourite = has("favorite_brands", brand)
    rules = [
        (favourite, F.lit(20.0), "favorite_brand"),
        (has("favorite_categories", category), F.lit(12.0), "favorite_category"),
        (C("_brand_affinity").isNotNull(), F.least(C("_brand_affinity") / 8.0, F.lit(14.0)), "brand_affinity"),
        (C("_category_affinity").isNotNull(), F.least(C("_category_affinity") / 10.0, F.lit(10.0)), "category_affinity"),
        (C("visibility") == "private_user_offer", F.lit(9.0), "private_email_offer"),
        (C("visibility") == "member_offer", F.lit(6.0), "member_email_offer"),
        (kind == "free_item", F.lit(8.0), "free_item"),
        (has("deal_priorities", F.lit("free")) & (kind == "free_item"), F.lit(8.0), "matches_free_priority"),
        (has("deal_priorities", F.lit("discount")) & kind.isin("percentage_off", "amount_off", "sale_price"), F.lit(6.0), "matches_discount_priority"),
        (has("deal_priorities", F.lit("bogo")) & title.rlike(r"\bbogo\b|buy one get one"), F.lit(7.0), "matches_bogo_priority"),
        ((kind == "points") & ~favourite, F.lit(-10.0), "points_without_affinity"),
        (C("requires_membership") & (C("visibility") != "member_offer"), F.lit(-5.0), "membership_required"),
        (title.contains("newsletter") | title.contains("sign up"), F.lit(-12.0), "newsletter_like"),
    ]
    d = d.withColumns({f"_r{k}": F.coalesce(cond, F.lit(False)) for k, (cond, _, _) in enumerate(rules)})
    score = sum((F.when(C(f"_r{k}"), points).otherwise(0.0) for k, (_, points, _) in enumerate(rules)), base)
    reasons = F.array_compact(F.array(*(F.when(C(f"_r{k}"), name) for k, (_, _, name) in enumerate(rules))))
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("deal_quality"))).otherwise(F.slice(reasons, 1, 8))
    hidden = has("hidden_brands", brand)
    return d.select(*deals.columns, F.when(hidden, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).alias("personal_rank_score"), F.when(hidden, F.array(F.lit("hidden_brand"))).otherwise(reasons).alias("rank_reasons"))


def deal_fingerprint(deals: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(C(c).cast("string"), F.lit(""))
    return deals.withColumn("fingerprint", F.sha2(F.concat_ws("\n", *(text(c) for c in ("user_id", "message_id", "brand", "promotion_title", "discount_type", "discount_value", "promo_code"))), 256))


def upsert_user_deals(existing: DataFrame, ranked: DataFrame, as_of: Column) -> DataFrame:
    """One row per user and fingerprint, the last one given; its status, and when it expires (the day after its end)."""
    columns = ["user_id", "fingerprint", "personal_rank_score", "end_date", "received_at"]
    both = existing.select(*columns, F.lit(0).alias("turn")).unionByName(ranked.select(*columns, F.lit(1).alias("turn")))
    last = both.groupBy("user_id", "fingerprint").agg(F.max_by(F.struct("personal_rank_score", "end_date", "received_at"), F.struct("turn", "received_at", "personal_rank_score")).alias("o")).select("user_id", "fingerprint", "o.*")
    fine = (C("personal_rank_score") >= 70) & (C("received_at") >= as_of - F.expr("interval 14 days"))
    return last.withColumn("status", F.when(fine, "active").otherwise("suppressed")).withColumn("expires_at", F.date_add("end_date", 1))


def merge_user_email_deals(catalog: DataFrame, deals: DataFrame, as_of: Column, most: int = 50) -> DataFrame:
    """Each user's catalog: shared offers and the user's own best, by brand and title; the greater score wins, the shared
    offer of equals."""
    fine = (C("status") == "active") & (C("personal_rank_score") >= 70) & (C("received_at") >= as_of - F.expr("interval 14 days")) & (C("expires_at").isNull() | (C("expires_at") > as_of))
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("personal_rank_score"), "fingerprint"))
    own = deals.where(fine).withColumn("_t", turn).where(C("_t") <= most)
    key = lambda: [F.lower("brand").alias("b"), F.lower("promotion_title").alias("t")]
    mine = own.select("user_id", *key(), C("personal_rank_score").alias("score"), "fingerprint").groupBy("user_id", "b", "t").agg(F.max_by(F.struct("score", "fingerprint"), F.struct("score", "fingerprint")).alias("o")).select("user_id", "b", "t", "o.*")
    shared = catalog.select(*key(), C("global_quality_score").alias("shared_score"))
    both = mine.join(shared, ["b", "t"], "left")
    return both.select("user_id", C("b").alias("brand_key"), C("t").alias("title_key"), "score", "shared_score", F.when(C("shared_score").isNull() | (C("score") > C("shared_score")), "email").otherwise("catalog").alias("winner"))


def notification_candidates(offers: DataFrame, favourites: DataFrame, members: DataFrame, affinity: DataFrame, as_of: Column, birthday: Column | None = None) -> DataFrame:
    """Every offer with its first disqualifier, or null, and the groups of signals it has; candidates need two groups.

    favourites, members and affinity (with email_count) tell of brands; birthday is the user's. Columns that offers lack
    (valid_days, new_user_only, ...) count as null."""
    given = lambda name, kind: C(name) if name in offers.columns else F.lit(None).cast(kind)
    yes = lambda c: F.coalesce(c, F.lit(False))
    key = F.regexp_replace(F.lower(F.coalesce("brand", F.lit(""))), "[^a-z0-9]", "").alias("_key")
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    known = affinity.groupBy(key).agg(F.max("email_count").alias("_emails"))
    d = offers.withColumn("_key", key).join(flag(favourites, "_fav"), "_key", "left").join(flag(members, "_mem"), "_key", "left").join(known, "_key", "left")
    today = F.to_date(as_of)
    days, title, kind = F.datediff("end_date", today), F.coalesce("promotion_title", F.lit("")), F.coalesce("discount_type", F.lit(""))
    valid = F.transform(F.coalesce(given("valid_days", "array<string>"), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    names = [F.lower(F.date_format(today, f)) for f in ("EEEE", "EEE")]
    member = yes(C("_mem"))
    birth = F.to_date(birthday) if birthday is not None else F.lit(None).cast("date")
    this_year = F.add_months(birth, (F.year(today) - F.year(birth)) * 12)
    next_birth = F.when(this_year < today, F.add_months(birth, (F.year(today) + 1 - F.year(birth)) * 12)).otherwise(this_year)
    private = given("email_date", "date").isNotNull() | yes(given("source_type", "string") == "email") | yes(given("visibility", "string") == "private_user_offer")
    personal = yes(C("_fav")) | yes(C("_emails") >= 10) | private | member | (yes(given("birthday_related", "boolean")) & yes(F.datediff(next_birth, today).between(0, 30)))
    percent = F.nullif(F.regexp_extract(F.coalesce("discount_value", F.lit("")), r"(\d+(?:\.\d+)?)\s*%", 1), F.lit("")).cast("double")
    value = ((kind == "free_item") & ~title.rlike(TRIAL)) | title.rlike(BOGO) | ((kind == "percentage_off") & yes(percent >= 50)) | yes(days.between(0, 1))
    only_today = ((F.size(valid) == 1) & F.element_at(F.concat(valid, F.array(F.lit(""))), 1).isin(*names)) | yes(days == 0)
    easy = ~yes(C("requires_membership")) & ~yes(C("requires_app")) & (F.coalesce(given("minimum_spend", "double"), F.lit(0.0)) == 0) & ~yes(given("purchase_required", "boolean"))
    groups = F.array_compact(F.array(F.when(personal, "personal"), F.when(value, "value"), F.when(only_today | easy, "context")))
    text = F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(given("short_summary", "string"), F.lit("")), F.nullif(given("terms_text", "string"), F.lit("")))
    other_day = (F.size(valid) > 0) & ~F.exists(valid, lambda x: x.isin(*names))
    skip = (
        F.when(F.coalesce("global_quality_score", F.lit(0.0)) < NOTIFY_FLOOR, "below_threshold")
        .when(F.coalesce("confidence_score", F.lit(0.0)) < LEAST_CONFIDENCE, "low_confidence")
        .when(kind == "points", "points")
        .when(other_day, "wrong_day")
        .when(text.rlike(DEMOGRAPHIC), "demographic_restricted")
        .when(yes(C("requires_membership")) & yes(F.lower("membership_cost").contains("paid")) & ~member, "paid_membership_not_member")
        .when(yes(given("new_user_only", "boolean")) & (member | yes(C("_emails") >= 3)), "new_user_only_existing_customer")
        .when(F.size(groups) < MIN_GROUPS, "insufficient_signal_diversity")
    )
    return d.select(*offers.columns, groups.alias("signal_groups"), skip.alias("skip_reason"), offer_id(C("brand"), C("promotion_title")).alias("promo_id"))


def skip_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy(F.coalesce("skip_reason", F.lit("candidate")).alias("reason")).agg(F.count("*").alias("n"))


def push_selection(users: DataFrame, candidates: DataFrame, sent: DataFrame, events: DataFrame, searches: DataFrame, as_of: Column, least: float = PUSH_FLOOR) -> DataFrame:
    """The one candidate for each user: of a score of least or more, not sent for a week, best score with bonuses for what the user likes, clicked and
    searched lately, over the threshold. Queries match brands and categories as substrings, either way."""
    week = lambda c: C(c) >= as_of - F.expr("interval 7 days")
    acts = events.where(week("created_at") & C("event_type").isin("deal_card_opened", "deal_card_clicked", "redeem_clicked", "fast_redeem_clicked"))
    ranked = candidates.where(C("notify_score") >= least).select("promo_id", F.lower("brand").alias("brand"), F.lower("category").alias("category"), "notify_score")
    asked = searches.where(week("created_at") & (F.trim("query") != "")).select("user_id", F.lower(F.trim("query")).alias("q")).distinct()
    queries = asked.select("q").distinct()
    either = lambda c: C(c).contains(C("q")) | C("q").contains(C(c))
    liked = {}
    for c, favourite in (("brand", "favorite_brand"), ("category", "favorite_category")):
        words = queries.join(small(ranked.select(c).distinct()), either(c)).select("q", c)
        signal = lambda df, key, kind: df.select("user_id", F.lower(key).alias(c), F.lit(kind).alias("kind"))  # noqa: B023, E731
        signals = signal(users, favourite, "fav").union(signal(asked.join(words, "q"), c, "searched")).union(signal(acts, c, "clicked"))
        flags = [F.bool_or(C("kind") == k).alias(f"{k}_{c}") for k in ("searched", "clicked", "fav")]
        liked[c] = signals.where(C(c).isNotNull()).join(users.select("user_id"), "user_id", "left_semi").groupBy("user_id", c).agg(*flags)
    # Who likes neither brand nor category of a candidate needs its best alone, and so on: each user meets the lists of all
    # candidates, of liked brands, of liked categories and of both, and of each the first candidate not sent lately. A list
    # leaves out what else the user likes of a candidate, but another one then holds it with its full score.
    lately = sent.where(week("sent_at")).select("user_id", "promo_id").distinct()
    had = stored(lately.join(ranked, "promo_id").join(users.select("user_id"), "user_id", "left_semi").select("user_id", "brand", "category"))
    met = {(): users.select("user_id").distinct(), ("brand",): liked["brand"], ("category",): liked["category"], ("brand", "category"): liked["brand"].join(liked["category"], "user_id")}
    most = (had.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0) + 1
    order = [rounded("notify_score", 2).desc(), F.desc("promo_id")]
    names = [f"{k}_{c}" for c in liked for k in ("searched", "clicked", "fav")]
    d = None
    for keys, who in met.items():
        if keys:
            first = ranked.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(C("_place") <= most)
        else:
            first = ranked.where(C("notify_score") >= UNKNOWN).orderBy(*order).limit(most).withColumn("_place", F.row_number().over(Window.orderBy(*order)))
        times = had.groupBy("user_id", *keys).agg(F.count("*").alias("_had"))
        places = F.explode(F.sequence(F.lit(1), (F.coalesce("_had", F.lit(0)) + 1).cast("int")))
        m = who.join(times, ["user_id", *keys], "left").withColumn("_place", places).join(small(first.select(*keys, "_place", "promo_id", "notify_score")), [*keys, "_place"])
        m = m.select("user_id", "promo_id", "notify_score", *((C(n) if n in who.columns else F.lit(False)).alias(n) for n in names))
        d = m if d is None else d.unionByName(m)
    d = d.join(lately, ["user_id", "promo_id"], "left_anti")
    flag = {"searched_brand": "searched_brand", "clicked_brand": "clicked_brand", "fav_brand": "fav_brand", "searched_cat": "searched_category", "clicked_cat": "clicked_category", "fav_cat": "fav_category"}
    score = sum((F.when(C(flag[k]), BONUS[k]).otherwise(0.0) for k in flag), C("notify_score"))
    reason = F.lit("none")
    for k in reversed(flag):
        reason = F.when(C(flag[k]), k).otherwise(reason)
    d = d.withColumns({"score": rounded(score, 2), "reason": reason})
    d = d.where(C("score") >= F.when(C("reason") == "none", UNKNOWN).otherwise(PERSONAL))
    best = d.groupBy("user_id").agg(F.max_by(F.struct("promo_id", "score", "reason"), F.struct("score", "promo_id")).alias("o"))
    return best.select("user_id", "o.*")


#: Suffixes of programs in mails, endings and words of names that say nothing.
PROGRAM = r"\b([A-Z][A-Za-z&']{1,20}(?:\s[A-Za-z&']{1,20}){0,3}\s(?:Rewards?|Insider|Circle|One|Club|Plus\s*(?:Card)?|Perks|Stubs|ExtraCare|myWalgreens|SkyMiles|AAdvantage|MileagePlus|TrueBlue|Rapid\sRewards|Ultamate\sRewards))\b"
GENERIC_ENDING = r"(?i)\s+(rewards?|program|membership|points?|club|perks?|card|pass|plus|insider)\s*$"
SAYS_NOTHING = "unknown|n/a|yes|membership|rewards program"
#: Signals and their points, most a day, hours between two, days before a brand comes again, least quality and score, quiet hours.
POLICY_POINTS = {"favorite_brand": 40.0, "favorite_category": 25.0, "brand_interaction": 15.0, "user_interested": 35.0}
MOST_A_DAY, GAP_HOURS, COOLDOWN_DAYS, LEAST_NOTIFY, LEAST_SCORE, QUIET = 2, 4, 7, 60.0, 95.0, (22, 8)


def detect_memberships(emails: DataFrame, offers: DataFrame, previous: DataFrame) -> DataFrame:
    """Programs with the brand that named them last: from mail texts, from membership_name of offers, and known before.

    Names of offers that are fillers or the brand with a usual ending are left out. Of equal times the known one stays,
    then the mail's; then the smaller brand. As the fixed pattern has it, a name may begin in the subject and end in the text.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    text = F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    mailed = emails.select("brand", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(PROGRAM), 1))).alias("program"), C("sent_at").alias("last_seen"), F.lit(1).alias("turn"))
    name = F.trim("membership_name")
    generic = plain(F.regexp_replace(name, GENERIC_ENDING, "")) == plain(F.coalesce("brand", F.lit("")))
    stated = offers.where(C("requires_membership") & (F.length(name) > 3) & ~F.lower(name).rlike(SAYS_NOTHING) & ~generic).select("brand", name.alias("program"), C("email_date").alias("last_seen"), F.lit(2).alias("turn"))
    known = previous.select("brand", "program", "last_seen", F.lit(0).alias("turn"))
    best = F.min_by(F.struct("brand", "last_seen"), F.struct(-F.coalesce(F.unix_timestamp("last_seen"), F.lit(0)), "turn", "brand"))
    return known.unionByName(mailed).unionByName(stated).groupBy("program").agg(best.alias("b")).select("program", "b.*")


def notification_policy(users: DataFrame, candidates: DataFrame, history: DataFrame, events: DataFrame, feedback: DataFrame, as_of: Column) -> DataFrame:
    """The one candidate a user may get now: none in quiet hours, after two on a day or within four hours of the last.

    All signals hang on brand and category, and a sent offer cools its whole brand, so only the best candidate of each pair
    counts (ties: the smaller promo_id). Scores go to 100, so a pair without a signal never reaches the 105 it would need;
    users thus meet pairs by their signals. The first feedback on brand or category counts; a refusal drops the pair.
    """
    low = lambda c: F.lower(c).alias(c)
    pairs = candidates.where(C("notify_score") >= LEAST_NOTIFY).groupBy(low("brand"), low("category")).agg(F.min_by(F.struct("promo_id", "notify_score"), F.struct(-C("notify_score"), "promo_id")).alias("o")).select("brand", "category", "o.*")
    none = F.lit(None).cast("struct<at:timestamp,interested:boolean>")
    said = F.struct(C("created_at").alias("at"), "interested")
    acts = events.where(C("event_type").isin("deal_card_opened", "deal_card_clicked", "fast_redeem_clicked"))
    signal = lambda df, key, kind, fb=none: df.select("user_id", F.lower(key).alias("key"), F.lit(kind).alias("kind"), fb.alias("said"))
    by_brand = signal(users, "favorite_brand", "favorite_brand").union(signal(acts, "brand", "brand_interaction").distinct()).union(signal(feedback, "brand", "feedback", said))
    by_category = signal(users, "favorite_category", "favorite_category").union(signal(feedback, "category", "feedback", said))
    small_pairs = small(stored(pairs))
    reduced = lambda d: d.groupBy("user_id", "key", "kind").agg(F.min("said").alias("said"))
    met = reduced(by_brand).join(small_pairs, C("key") == C("brand")).unionByName(reduced(by_category).join(small_pairs, C("key") == C("category")))
    d = met.groupBy("user_id", "brand", "category", "promo_id", "notify_score").agg(*(F.bool_or(C("kind") == k).alias(k) for k in POLICY_POINTS if k != "user_interested"), F.min("said")["interested"].alias("user_interested"))
    score = sum((F.when(F.coalesce(C(k), F.lit(False)), p).otherwise(0.0) for k, p in POLICY_POINTS.items()), C("notify_score"))
    hour = F.hour(as_of)
    fine = d.withColumn("score", rounded(score, 2)).where((hour < QUIET[0]) & (hour >= QUIET[1]) & F.coalesce(C("user_interested"), F.lit(True)) & (C("score") >= LEAST_SCORE))
    past = history.where(C("sent_at") <= as_of)
    today = F.count_if(F.to_date("sent_at") == F.to_date(as_of)) >= MOST_A_DAY
    soon = F.max("sent_at") > as_of - F.expr(f"interval {GAP_HOURS} hours")
    full = past.groupBy("user_id").agg((today | soon).alias("full")).where("full").select("user_id")
    cool = past.where(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(F.date_trunc("day", "sent_at"))) / 86400) < COOLDOWN_DAYS).select("user_id", low("brand")).distinct()
    free = fine.join(full, "user_id", "left_anti").join(cool, ["user_id", "brand"], "left_anti")
    return free.groupBy("user_id").agg(F.min_by(F.struct("promo_id", "score"), F.struct(-C("score"), "promo_id")).alias("o")).select("user_id", "o.*")
