"""Offers read from texts by fixed rules, and the offers of promotional e-mails."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.messages import email_signals

C = F.col
# Words that speak of offers; those of the second list hold one of the first and count for both.
WORDS = "reward|offer|deal|promo|coupon|discount|sale|valid|expires|birthday|member|app"
LONGER_WORDS = "rewards|promotion|membership"
# What an offer that can be redeemed says, in the order of precedence.
FREE_THING = r"\bfree\s+(?:drink|beverage|coffee|item|entrée|entree|meal|dessert|appetizer|sandwich|reward|gift)\b"
EARN, TOWARD = r"\bearn\s+\d+\s+points?\b", r"\bpoints?\s+toward\s+(?:a\s+)?reward\b"
EVIDENCE = [
    r"\b\d{1,3}\s?(?:%|percent)\s?off\b",
    r"\$\s?\d+(?:\.\d{2})?\s?off\b",
    r"\b\d+(?:\.\d{2})?\s?dollars?\s?off\b",
    FREE_THING,
    r"\bvalid\s+(?:through|until|from)\b",
    r"\bexpires?\b",
    r"\blimited\s+time\b",
    r"\boffer\s+valid\b",
    r"\bpromo\s+code\b",
    r"\bcoupon\b",
    EARN,
    TOWARD,
]
# Kinds of discounts, and words of members, new users, purchases and terms.
PERCENT_OFF = r"\b(\d{1,3})\s?(?:%|percent)\s?off\b"
DOLLARS_OFF = r"\$\s?(\d+(?:\.\d{2})?)\s?off\b"
WORDED_DOLLARS_OFF = r"\b(\d+(?:\.\d{2})?)\s?dollars?\s?off\b"
FREE = FREE_THING + r"|\bfree\s+with\s+purchase\b"
SALE = r"\b(?:sale|clearance|markdown|limited-time sale)\b"
MEMBERS = "member|rewards|loyalty|insider|circle|extra care|extracare|stubs"
NEW_USERS = "new user|new customer|first order|first purchase|sign up|join now|when you join"
PURCHASE = "purchase required|with purchase|when you buy|first purchase|minimum purchase"
TERMS = "valid|expires|terms|offer|reward|member|app|purchase|participating|coupon|discount|birthday"
HOURS = r"(?i)(\d{1,2})(?::(\d{2}))?\s?(am|pm)\s?(?:-|to|–)\s?(\d{1,2})(?::(\d{2}))?\s?(am|pm)"
# Names of programs by a part of the brand's name; the first that fits.
PROGRAMS = {
    "starbucks": "Starbucks Rewards",
    "chipotle": "Chipotle Rewards",
    "mcdonald": "MyMcDonald's Rewards",
    "chick-fil-a": "Chick-fil-A One",
    "target": "Target Circle",
    "sephora": "Beauty Insider",
    "ulta": "Ultamate Rewards",
    "cvs": "ExtraCare",
    "walgreens": "myWalgreens",
    "amc": "AMC Stubs",
    "cinemark": "Cinemark Movie Rewards",
    "best buy": "My Best Buy",
}
# Links of e-mails that lead to no offer.
NO_OFFER_LINK = r"(?i)unsubscribe|preferences|privacy|view.?in.?browser"
MOST_TERMS, MOST_CONFIDENCE, NO_OFFER_CONFIDENCE = 1500, 65, 0.15
#: White space, as texts are trimmed of it.
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = "\\R|[\x1c-\x1e]"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_NAME = r"(?i)^(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?\s+(\d{1,2})(?:,\s*(\d{4}))?$"
SLASHED = r"^(\d{1,2})/(\d{1,2})(?:/(\d{4}|\d{2}))?$"


def _clock(hour: Column, minute: Column, half: Column) -> Column:
    h, pm = hour.cast("int"), F.lower(half) == "pm"
    h24 = F.when(pm & (h != 12), h + 12).when(~pm & (h == 12), 0).otherwise(h)
    return F.format_string("%02d:%02d", h24, F.coalesce(F.nullif(minute, F.lit("")).cast("int"), F.lit(0)))


def _says(words: str, c: Column | None = None) -> Column:
    """Whether the lower text has one of the words, which are parted by |; a search of bytes, unlike rlike()."""
    text = C("_low") if c is None else c
    return functools.reduce(lambda a, b: a | b, (text.contains(w) for w in words.split("|")))


def _starting(first: str, pattern: str) -> str:
    """The pattern, tried only where one of the first characters of its alternatives stands."""
    return f"(?=[{first}])(?:{pattern})"


def rule_based_offers(texts: DataFrame, min_length: int = 200, require_keywords: bool = True) -> DataFrame:
    """One offer for each text, of whole texts (brand, text and any other columns, which stay unless the offer has them).

    A text that is null, shorter than min_length without outer white space, or that has no word of offers gives
    no_offer_found; without require_keywords, clear evidence stands for a word. A null brand gives a null title and summary.
    evidence has the different phrases that tell of an offer, which do not overlap: the earliest, of equals the first rule's.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    d = texts.withColumn("_low", low)
    starts = lambda first, words: F.regexp_count("_low", F.lit(_starting(first, f"(?={words})")))
    hits = starts("rodpcsvebma", WORDS) + starts("rpm", LONGER_WORDS)
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), LINE_END), lambda x: F.btrim(x, F.lit(WHITE))), lambda x: x != "")
    d = d.withColumns({
        "keyword_hits": hits,
        "evidence": F.array_distinct(F.regexp_extract_all("_low", F.lit(_starting(r"\d$fvelopc", "|".join(EVIDENCE))), F.lit(0))),
        "_lines": lines,
        "_hours": F.regexp_extract("text", HOURS, 0),
        "_length": F.length("text"),
        "_trimmed": F.length(F.btrim("text", F.lit(WHITE))),
        "requires_membership": _says(MEMBERS), "requires_app": _says(" app"), "birthday_related": _says("birthday"),
        "new_user_only": _says(NEW_USERS), "purchase_required": _says(PURCHASE), "_reward": _says("reward"),
        "redemption_method": F.when(_says("app"), "in_app").when(_says("code"), "show_code").when(_says("scan"), "scan_barcode").when(_says("online"), "online").when(_says("in store|in-store"), "in_store").otherwise("unknown"),
        "_kind": F.when(_says("birthday"), "birthday_reward").when(_says("coupon"), "coupon").when(_says("sale|clearance"), "sale").when(_says("app") & _says("offer|deal"), "app_offer").when(_says("reward"), "reward").when(_says("member"), "membership_benefit").otherwise("unknown"),
    })
    d = d.withColumn("_told", F.slice(F.filter("_lines", lambda x: _says(TERMS, F.lower(x))), 1, 8))
    clear = F.size("evidence") > 0
    found = lambda pattern: F.regexp_extract("_low", pattern, 1)
    of_kind = lambda kind, value=None: F.struct(F.lit(kind).alias("type"), (F.lit(value) if value is None or isinstance(value, str) else value).cast("string").alias("value"))
    discount = (
        F.when(~clear, of_kind("unknown"))
        .when(C("_low").rlike(PERCENT_OFF), of_kind("percentage_off", F.concat(found(PERCENT_OFF), F.lit("%"))))
        .when(C("_low").rlike(DOLLARS_OFF), of_kind("amount_off", F.concat(F.lit("$"), found(DOLLARS_OFF))))
        .when(C("_low").rlike(WORDED_DOLLARS_OFF), of_kind("amount_off", F.concat(F.lit("$"), found(WORDED_DOLLARS_OFF))))
        .when(C("_low").rlike(FREE), of_kind("free_item", "free"))
        .when(C("_low").rlike(f"{EARN}|{TOWARD}"), of_kind("points"))
        .when(C("_low").rlike(SALE), of_kind("sale_price"))
        .otherwise(of_kind("unknown"))
    )
    told = C("_told")
    enough = (C("_trimmed") >= min_length) & ((C("keyword_hits") > 0) | (F.lit(not require_keywords) & clear))
    d = d.withColumns({
        "_ok": F.coalesce(enough, F.lit(False)),
        "_discount": discount,
        "promotion_type": F.when(clear, C("_kind")).when(C("_reward") | _says("loyalty"), "reward").otherwise("unknown"),
        "terms_text": F.substring(F.array_join(F.when(F.size(told) > 0, told).otherwise(F.slice("_lines", 1, 5)), " "), 1, MOST_TERMS),
    })
    return _described(d, [c for c in texts.columns if c not in OFFER_COLUMNS])


#: The columns of an offer that the rules give.
OFFER_COLUMNS = [
    "promotion_title", "short_summary", "promotion_type", "discount_type", "discount_value", "requires_membership", "membership_name", "membership_cost",
    "requires_app", "requires_account_login", "new_user_only", "birthday_related", "time_start", "time_end", "redemption_method", "redemption_steps",
    "terms_text", "purchase_required", "deal_scope", "friction_level", "friction_reasons", "confidence_score", "source_type", "extraction_status",
    "keyword_hits", "evidence",
]


def _described(d: DataFrame, kept: list[str]) -> DataFrame:
    """The offer's title, summary, steps, friction and confidence, from what the rules have found."""
    brand, value, kind, how = C("brand"), C("_discount.value"), C("promotion_type"), C("redemption_method")
    member, app, new, birthday = C("requires_membership"), C("requires_app"), C("new_user_only"), C("birthday_related")
    some = lambda *rules: F.array_compact(F.array(*(F.when(cond, text) for cond, text in rules)))
    of = lambda before, after: F.concat(F.lit(before), brand, F.lit(after))
    title = (
        F.when(value.isNotNull(), F.concat(brand, F.lit(" "), value, F.lit(" offer")))
        .when(birthday & (kind == "birthday_reward"), of("", " birthday reward")).when(kind == "sale", of("", " sale"))
        .when(kind == "reward", of("", " rewards program")).when(kind == "membership_benefit", of("", " membership benefit"))
        .when(kind == "coupon", of("", " coupon")).otherwise(of("", " promotion"))
    )
    what = (
        F.when(birthday, " has a birthday-related reward").when(value.isNotNull(), F.concat(F.lit(" has a "), value, F.lit(" offer")))
        .when(kind == "sale", " has a sale or discount offer").when(kind == "reward", " has a rewards-related offer").otherwise(" has a promotion")
    )
    ends = F.concat(F.when(member, " that may require membership").otherwise(""), F.when(app, " and may require the app").otherwise(""), F.lit("."))
    in_app = app | (how == "in_app")
    steps = some(
        (member, of("Sign in to or join the ", " rewards/membership program.")),
        (in_app, of("Open the ", " app or rewards account.")),
        (in_app, F.lit("Find and activate the offer if required.")),
        (in_app, F.lit("Use the app or account at checkout.")),
        (~in_app & (how == "show_code"), F.lit("Copy or show the promo code at checkout.")),
        (~in_app & (how == "online"), F.lit("Apply the offer during online checkout.")),
        (~in_app & (how == "in_store"), F.lit("Ask the cashier or show the offer in store.")),
        (~in_app & ~how.isin("show_code", "online", "in_store"), F.lit("Review the offer terms before checkout.")),
    )
    coded = how.isin("show_code", "scan_barcode")
    effort = member.cast("int") + app.cast("int") + 2 * new.cast("int") + coded.cast("int")
    reasons = some((member, F.lit("Membership or rewards account required")), (app, F.lit("App may be required")), (new, F.lit("May be limited to new users")), (coded, F.lit("Code or barcode may be required")))
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("Simple redemption"))).otherwise(reasons)
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    hits, length = C("keyword_hits"), C("_length")
    score = 25 + points(length > 1000, 15) + points(length > 3000, 10) + points(hits > 5, 15) + points(hits > 20, 10) + points(value.isNotNull(), 10) + points(member, 5) + points(F.length("terms_text") > 100, 10)
    program = F.lower(brand)
    name = F.coalesce(*(F.when(program.contains(part), text) for part, text in PROGRAMS.items()), of("", " Rewards"))
    part = lambda k: F.regexp_extract("_hours", HOURS, k)
    timed, ok = C("_hours") != "", C("_ok")
    given = {
        "promotion_title": title,
        "short_summary": F.concat(brand, what, ends),
        "promotion_type": kind,
        "discount_type": C("_discount.type"),
        "discount_value": value,
        "requires_membership": member,
        "membership_name": F.when(member, name),
        "membership_cost": F.when(member, "free"),
        "requires_app": app,
        "requires_account_login": member | app,
        "new_user_only": new,
        "birthday_related": birthday,
        "time_start": F.when(timed, _clock(part(1), part(2), part(3))),
        "time_end": F.when(timed, _clock(part(4), part(5), part(6))),
        "redemption_method": how,
        "redemption_steps": steps,
        "terms_text": C("terms_text"),
        "purchase_required": C("purchase_required"),
        "deal_scope": F.lit("brand_level"),
        "friction_level": F.when(effort <= 1, "low").when(effort <= 3, "medium").otherwise("high"),
        "friction_reasons": reasons,
        "confidence_score": F.least(score, F.lit(MOST_CONFIDENCE)) / 100,
        "extraction_status": F.lit("success"),
    }
    none = {
        "short_summary": of("No clear offer or reward text found for ", "."), "promotion_type": F.lit("unknown"), "discount_type": F.lit("unknown"),
        "requires_membership": F.lit(False), "requires_app": F.lit(False), "confidence_score": F.lit(NO_OFFER_CONFIDENCE), "extraction_status": F.lit("no_offer_found"),
    }
    out = {c: F.when(ok, e).otherwise(none[c]) if c in none else F.when(ok, e) for c, e in given.items()}
    out |= {"source_type": F.lit("web_page"), "keyword_hits": hits, "evidence": C("evidence")}
    return d.select(*kept, *(out[c].alias(c) for c in OFFER_COLUMNS))


def phrase_date(phrase: Column, reference: Column) -> Column:
    """The date that a phrase such as "March 5", "Mar. 5, 2024" or "3/5/24" names, null if none. Without a year it is that of
    the reference; a day in January that would lie before a reference in December is in the next year."""
    name = lambda k: F.regexp_extract(phrase, MONTH_NAME, k)
    num = lambda k: F.regexp_extract(phrase, SLASHED, k)
    worded = phrase.rlike(MONTH_NAME)
    a, b, year = num(1).try_cast("int"), num(2).try_cast("int"), F.when(worded, name(3)).otherwise(num(3))
    swapped = (a > 12) & (year != "")
    month = F.when(worded, (F.instr(F.lit(MONTHS), F.substring(F.lower(name(1)), 1, 3)) + 2) / 3).when(swapped, b).otherwise(a).cast("int")
    day = F.when(worded, name(2).try_cast("int")).when(swapped, a).otherwise(b)
    given = F.when(year == "", None).when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year).try_cast("int")
    date = lambda y: F.to_date(F.try_to_timestamp(F.concat_ws("-", y.cast("string"), month.cast("string"), day.cast("string")), F.lit("yyyy-M-d")))
    own = date(F.coalesce(given, F.year(reference)))
    rolls = given.isNull() & (own < F.to_date(reference)) & (F.month(reference) == 12) & (month == 1)
    return F.when(month.isNull() | day.isNull(), None).when(rolls, date(F.year(reference) + 1)).otherwise(own)


def extract_email_offers(emails: DataFrame, min_length: int = 1, require_keywords: bool = False) -> DataFrame:
    """The offers of e-mails (message_id, brand, subject, body, sent_at, links, visibility and any others; those stay).

    Subject and body are read by rule_based_offers(); e-mails without an offer give no row. The title is the subject, the code
    the only one there is, the end the first phrase of expiry that is a date, the link the first that may lead to an offer.
    With a percentage, amount or free item the confidence is 0.6, and 0.05 more for each of code, end and link. A null
    sent_at gives no end to a date without a year."""
    kept = [c for c in emails.columns if c not in {*OFFER_COLUMNS, "promo_code", "end_date", "deal_url"}]
    texts = email_signals(emails.select(*kept)).drop("keyword_hits").withColumn("text", F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))))
    d = rule_based_offers(texts, min_length, require_keywords).where("extraction_status = 'success'")
    ends = F.get(F.filter(F.transform("expiry_phrases", lambda x: phrase_date(x, C("sent_at"))), lambda x: x.isNotNull()), F.lit(0))
    link = F.get(F.filter("links", lambda x: x.rlike("(?i)^https?:") & ~x.rlike(NO_OFFER_LINK)), F.lit(0))
    d = d.withColumns({"promo_code": F.when(F.size("promo_codes") == 1, F.get("promo_codes", F.lit(0))), "end_date": ends, "deal_url": link})
    shown = sum((F.when(C(c) != "", 1).otherwise(0) for c in ("promo_code", "deal_url")), F.col("end_date").isNotNull().cast("int"))
    sure = C("discount_value").isNotNull() & C("discount_type").isin("percentage_off", "amount_off", "free_item")
    subject = F.btrim("subject", F.lit(WHITE))
    d = d.withColumns({
        "promotion_title": F.coalesce(F.nullif(subject, F.lit("")), C("promotion_title")),
        "confidence_score": F.when(sure, (60 + 5 * shown) / 100).otherwise(C("confidence_score")),
        "source_type": F.lit("email"),
    })
    return d.select(*kept, *OFFER_COLUMNS, "promo_code", "end_date", "deal_url")
