"""Savings, economic value and quality of offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.joins import small
from tallyloom.functions.text import any_date, compact, dollars, percent, rounded

C = F.col

# Dollars per item, conservative dollars, and the greatest savings of each category.
ITEM_VALUE = {"food": 10.0, "fast_food": 9.0, "coffee": 6.0, "restaurant": 18.0, "grocery": 5.0, "supermarket": 5.0, "beauty": 22.0, "personal_care": 15.0, "fashion": 65.0, "clothing": 55.0, "apparel": 55.0, "retail": 45.0, "shoes": 95.0, "footwear": 95.0, "tech": 250.0, "electronics": 250.0, "home": 90.0, "home_goods": 90.0, "furniture": 200.0, "travel": 200.0, "hotels": 180.0, "airlines": 280.0, "automotive": 75.0, "gas": 55.0, "entertainment": 14.0, "movies": 14.0}
CAUTIOUS_VALUE = {"fashion": 28.0, "clothing": 25.0, "apparel": 25.0, "retail": 20.0, "shoes": 50.0, "footwear": 50.0, "beauty": 14.0, "personal_care": 12.0, "tech": 60.0, "electronics": 60.0, "home": 35.0, "home_goods": 30.0, "furniture": 80.0, "travel": 80.0, "hotels": 80.0, "airlines": 100.0}
SAVINGS_CAP = {"food": 15.0, "fast_food": 12.0, "coffee": 8.0, "restaurant": 25.0, "grocery": 25.0, "supermarket": 25.0, "beauty": 50.0, "personal_care": 30.0, "fashion": 60.0, "clothing": 50.0, "apparel": 50.0, "retail": 40.0, "shoes": 80.0, "footwear": 80.0, "tech": 150.0, "electronics": 150.0, "home": 100.0, "home_goods": 80.0, "furniture": 200.0, "travel": 200.0, "hotels": 150.0, "airlines": 250.0, "automotive": 100.0, "gas": 25.0, "entertainment": 20.0, "movies": 15.0}
REPEATED = ["food", "fast_food", "coffee", "grocery", "supermarket", "restaurant", "beauty", "personal_care"]
SINGLE = ["tech", "electronics", "furniture", "travel", "hotels", "airlines", "automotive"]
# What an item named in a title is worth; the first that fits counts.
TITLE_HINTS = [
    (r"\bfries?\b|\bchips?\b|\bside\b", 3.5),
    (r"\bcoffee\b|\bteas?\b|\bespresso\b|\bamericano\b", 5.5),
    (r"\blattes?\b|\bcappuccino\b|\bmacchiato\b|\bfrapp", 6.5),
    (r"\bsmoothies?\b|\bshakes?\b|\bmilkshake\b", 7.0),
    (r"\bdrinks?\b|\bbeverages?\b|\bsodas?\b|\bfountain\b", 4.0),
    (r"\bdonuts?\b|\bdoughnuts?\b|\bmuffins?\b|\bbagels?\b|\bpastries?\b", 3.5),
    (r"\bcookies?\b|\bbrownies?\b", 2.5),
    (r"\bburgers?\b|\bwhopper\b|\bbig mac\b", 9.0),
    (r"\bsandwiches?\b|\bsubs?\b|\bwraps?\b|\bhoagies?\b", 10.0),
    (r"\btacos?\b|\bburritos?\b|\bquesadillas?\b|\bbowls?\b", 10.0),
    (r"\bentr[eé]es?\b|\bmeals?\b|\bcombos?\b", 11.0),
    (r"\bpizzas?\b", 13.0),
    (r"\bscoops?\b|\bice\s+cream\b|\bgelato\b", 5.0),
    (r"\blipsticks?\b|\blip\s+colors?\b|\blip\s+gloss\b", 18.0),
    (r"\bmascaras?\b|\beyeliners?\b|\bconcealers?\b|\beyeshadows?\b", 16.0),
    (r"\bfoundations?\b", 28.0),
    (r"\bserums?\b|\bmoisturizers?\b|\bface\s+cream\b", 25.0),
    (r"\bhoodies?\b|\bsweaters?\b|\bsweatshirts?\b", 55.0),
    (r"\bjackets?\b|\bcoats?\b|\bvests?\b|\bparkas?\b", 75.0),
    (r"\bjeans?\b|\bdenim\b|\bpants?\b|\btrousers?\b|\bleggings?\b", 55.0),
    (r"\bdresses?\b|\bblouses?\b|\bskirts?\b|\bgowns?\b", 60.0),
    (r"\bshirts?\b|\btees?\b|\btops?\b|\btanks?\b", 30.0),
    (r"\bsneakers?\b|\bshoes?\b|\bboots?\b|\bsandals?\b|\bheels?\b", 90.0),
    (r"\bhandbags?\b|\bpurses?\b|\btotes?\b", 120.0),
    (r"\bwallets?\b|\bcard\s+holders?\b|\bwristlets?\b", 55.0),
    (r"\bbags?\b", 100.0),
]
# Patterns of titles, and points of quick actions.
BOGO = r"(?i)\bbogo\b|buy.one.get.one"
BUY_GET = r"(?i)buy\s+(\d+)\s+get\s+(\d+)"
TRIAL = r"(?i)\bfree\s+trial\b|\btrial\b|\d+\s+(?:months?|weeks?|days?)\s+free"
VAGUE = r"(?i)\bselect\s+(?:styles?|items?|products?)\b|\bsitewide\b|\byour\s+(?:order|purchase)\b|\beverything\b|\ball\s+(?:items?|styles?|orders?|purchases?)\b|\bfull[\s-]price\b|\bregular[\s-]price\b"
REDEEM_POINTS = {"copy_code_and_open_url": 12.0, "copy_code": 10.0, "open_app": 8.0, "open_rewards": 8.0, "show_barcode_or_code": 7.0, "open_url": 6.0, "open_maps": 6.0, "show_steps": 2.0}


def _of(table: dict[str, float], key: Column, default: Column | float | None) -> Column:
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def _title() -> Column:
    return F.coalesce("promotion_title", F.lit(""))


def _hint() -> Column:
    """The value of the first hint that fits. Most titles name no item at all, which one search from word to word tells."""
    words = "|".join(p.removeprefix(r"\b") for pattern, _ in TITLE_HINTS for p in pattern.split("|"))
    out = F.lit(None).cast("double")
    for pattern, value in reversed(TITLE_HINTS):
        out = F.when(_title().rlike(f"(?i){pattern}"), value).otherwise(out)
    return F.when(_title().rlike(rf"(?i)\b(?=[a-z])(?:{words})"), out)


FACTS = ["_hint", "_bogo", "_trial", "_vague", "_buy", "_get", "_share", "_amount"]


def with_facts(offers: DataFrame) -> DataFrame:
    """offers with what the scores read from titles and values, so that each text is searched once."""
    if "_hint" in offers.columns:
        return offers
    title = _title()
    group = lambda k: F.nullif(F.regexp_extract(title, BUY_GET, k), F.lit("")).cast("double")
    facts = [_hint(), title.rlike(BOGO), title.rlike(TRIAL), title.rlike(VAGUE), group(1), group(2), percent(C("discount_value")), dollars(C("discount_value"))]
    return offers.withColumns(dict(zip(FACTS, facts, strict=True)))


def _as_given(result: DataFrame, offers: DataFrame) -> DataFrame:
    return result if "_hint" in offers.columns else result.drop(*FACTS)


def brand_lookup(offers: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """offers with the value of their brand (slug, value, ord): of an equal slug, else of the first with the same first
    seven characters when both have five or more."""
    brands = offers.select("brand").distinct().withColumn("_slug", compact(C("brand")))
    v = values.select(C("slug").alias("_s"), C("value").alias("_v"), "ord")
    exact = brands.join(v, C("_slug") == C("_s")).select("brand", F.lit(0).alias("_r"), "ord", "_v")
    seven = F.substring("_slug", 1, 7) == F.substring("_s", 1, 7)
    prefix = brands.join(v, seven & (F.length("_slug") >= 5) & (F.length("_s") >= 5)).select("brand", F.lit(1).alias("_r"), "ord", "_v")
    best = exact.union(prefix).groupBy("brand").agg(F.min_by("_v", F.struct("_r", "ord")).alias(name))
    return offers.join(small(best), "brand", "left")


def estimate_savings(offers: DataFrame, brand_values: DataFrame, cautious_values: DataFrame) -> DataFrame:
    """estimated_item_value and estimated_savings from brand, category, title and discount; brand tables as in brand_lookup."""
    d = brand_lookup(brand_lookup(with_facts(offers), brand_values, "_brand_value"), cautious_values, "_brand_cautious")
    category = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    d = d.withColumn("_item", F.coalesce("_brand_value", _of(ITEM_VALUE, category, 30.0)))
    d = d.withColumn("_cautious", F.coalesce("_brand_cautious", _of(CAUTIOUS_VALUE, category, C("_item") * 0.5)))
    item, cautious, hint, vague, share, amount = (C(c) for c in ("_item", "_cautious", "_hint", "_vague", "_share", "_amount"))
    kind = F.trim(F.coalesce("discount_type", F.lit("")))
    free = F.coalesce(hint, F.least(item, F.lit(15.0)))
    birthday = (C("promotion_type") == "birthday_reward") | (F.coalesce(C("birthday_related"), F.lit(False)) if "birthday_related" in offers.columns else F.lit(False))
    shipping = F.when(category.isin("tech", "electronics", "furniture", "home", "home_goods"), 10.0).when(category.isin("fashion", "clothing", "shoes", "footwear", "apparel", "retail"), 8.0).otherwise(5.0)
    savings = (
        F.when(birthday, free)
        .when(C("_bogo") | C("_buy").isNotNull(), item)
        .when(kind == "free_item", F.when(C("_trial"), 5.0).otherwise(free))
        .when((kind == "percentage_off") & (share > 0), rounded(F.coalesce(hint, F.when(vague, cautious).otherwise(item)) * share / 100.0, 2))
        .when((kind == "percentage_off") & vague, rounded(cautious * 0.20, 2))
        .when(kind == "percentage_off", rounded(item * 0.15, 2))
        .when(kind == "amount_off", F.when(amount > 0, amount).otherwise(8.0))
        .when(kind == "sale_price", rounded(F.when(vague, cautious).otherwise(item) * 0.20, 2))
        .when(kind == "free_shipping", shipping)
        .when(kind == "points", 2.0)
        .otherwise(5.0)
    )
    d = d.withColumns({"estimated_item_value": rounded(item, 2), "estimated_savings": rounded(savings, 2)})
    return _as_given(d.drop("_brand_value", "_brand_cautious", "_item", "_cautious"), offers)


def effective_discount(offers: DataFrame) -> DataFrame:
    """effective_discount_pct: what share of the received value is saved."""
    kind = F.trim(F.coalesce("discount_type", F.lit("")))
    buy, get, share = C("_buy"), C("_get"), C("_share")
    pct = (
        F.when((kind == "free_item") & ~C("_trial"), 100.0)
        .when(C("_bogo"), 50.0)
        .when(buy.isNotNull(), rounded(F.try_divide(get, buy + get) * 100.0, 1))
        .when(kind == "percentage_off", F.when(share > 0, share).otherwise(15.0))
        .when((kind == "amount_off") & (C("estimated_item_value") > 0), F.least(C("estimated_savings") / C("estimated_item_value") * 100.0, F.lit(100.0)))
        .when(kind == "sale_price", 20.0)
        .when(kind == "free_shipping", 8.0)
        .when(kind == "points", 1.5)
        .otherwise(10.0)
    )
    return _as_given(with_facts(offers).withColumn("effective_discount_pct", pct), offers)


def economic_value(offers: DataFrame) -> DataFrame:
    """economic_value_score: relative and absolute savings on log curves, less required spending and quantity; 0 at least."""
    category = F.lower(F.coalesce("category", F.lit("")))
    pct, saved, item = C("effective_discount_pct"), C("estimated_savings"), C("estimated_item_value")
    relative = F.when(pct <= 0, 0.0).otherwise(rounded(F.least(27.0 * F.log(1 + F.least(pct, F.lit(100.0)) / 100.0 * 3.5) / F.log(F.lit(4.5)), F.lit(27.0)), 2))
    absolute = F.when(saved <= 0, 0.0).otherwise(rounded(F.least(50.0 * F.log(1 + saved) / F.log(1 + _of(SAVINGS_CAP, category, 50.0)), F.lit(50.0)), 2))
    bogo, buy = C("_bogo"), C("_buy")
    stated = dollars(C("minimum_spend").cast("string")) if "minimum_spend" in offers.columns else F.lit(None).cast("double")
    spend = F.when(bogo, item).when(buy.isNotNull(), item * buy).otherwise(stated)
    spend_penalty = F.when(spend > 0, rounded(F.pow(1.0 - F.least(saved / spend, F.lit(1.0)), 2) * 12.0, 2)).otherwise(0.0)
    weight = F.when(category.isin(REPEATED), 0.1).when(category.isin(SINGLE), 0.85).otherwise(0.4)
    quantity = F.when(bogo, rounded(10.0 * weight, 2)).when(buy.isNotNull(), rounded(10.0 * weight * F.least(buy / 2.0, F.lit(1.0)), 2)).otherwise(0.0)
    d = with_facts(offers).withColumns({"relative_score": relative, "absolute_score": absolute, "spend_penalty": spend_penalty, "quantity_penalty": quantity})
    score = F.greatest(C("relative_score") + C("absolute_score") - C("spend_penalty") - C("quantity_penalty"), F.lit(0.0))
    return _as_given(d.withColumn("economic_value_score", score), offers)


def quality_subscores(offers: DataFrame, as_of: Column) -> DataFrame:
    """Presentation, clarity, reliability, redemption, freshness, urgency and friction."""
    kind = F.coalesce("discount_type", F.lit(""))
    exact = F.coalesce((C("_share") > 0) | (C("_amount") > 0), F.lit(False))
    trial, bogo, vague = C("_trial"), C("_bogo"), C("_vague")
    presentation = F.least(F.when((kind == "free_item") & ~trial, 4.0).when(bogo, 3.0).otherwise(0.0) + F.when(F.coalesce("promo_code", F.lit("")) != "", 2.0).otherwise(0.0) + F.when(exact, 2.0).otherwise(0.0), F.lit(8.0))
    clarity = F.when(bogo | C("_buy").isNotNull(), 5.0).when(kind == "free_shipping", 4.0).when((kind == "free_item") & ~trial, F.when(C("_hint").isNotNull(), 4.0).otherwise(2.0)).when(exact, F.when(vague, 1.0).otherwise(5.0)).otherwise(F.when(vague, 0.0).otherwise(2.0))
    c = F.coalesce("confidence_score", F.lit(0.0))
    reliability = F.when(c <= 0, 0.75).when(c < 0.60, 0.65).when(c < 0.70, 0.80).when(c < 0.75, 0.87).when(c < 0.80, 0.92).when(c < 0.90, 0.96).otherwise(1.0)
    has = "fast_redemption" in offers.columns
    redeem = F.when(C("fast_redemption.eligible"), _of(REDEEM_POINTS, C("fast_redemption.action_type"), 0.0)).otherwise(0.0) if has else F.lit(0.0)
    effort = F.when(C("fast_redemption.effort_level") == "high", 6.0).when(C("fast_redemption.effort_level") == "medium", 3.0).otherwise(0.0) if has else F.lit(0.0)
    age = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(C("checked_at").cast("timestamp"))) / 86400e6) if "checked_at" in offers.columns else F.lit(None).cast("long")
    fresh = F.when(age.isNull(), 0.0).when(age == 0, 8.0).when(age <= 1, 6.0).when(age <= 3, 4.0).when(age <= 7, 1.0).when(age <= 14, -3.0).otherwise(-8.0)
    left = F.datediff(any_date(C("end_date").cast("string")), F.to_date(as_of))
    urgency = F.when(left == 0, 5.0).when(left == 1, 4.0).when(left.isin(2, 3), 2.0).otherwise(0.0)
    cost = F.lower(F.coalesce("membership_cost", F.lit("")))
    friction = F.when(F.coalesce("requires_membership", F.lit(False)), F.when(cost.contains("paid"), 15.0).when(cost.contains("free"), 2.0).otherwise(8.0)).otherwise(0.0) + F.when(F.coalesce("requires_app", F.lit(False)), 5.0).otherwise(0.0) + effort
    if "terms_text" in offers.columns:
        friction = friction + F.when(F.lower(F.coalesce("terms_text", F.lit(""))).contains("participating"), 4.0).otherwise(0.0)
    d = with_facts(offers).withColumns({"presentation_score": presentation, "clarity_score": clarity, "reliability": reliability, "fast_redeem_score": redeem, "source_freshness_score": fresh, "expiration_urgency_score": urgency, "friction_penalty": friction})
    d = d.withColumn("urgency_effect", rounded(C("expiration_urgency_score") * F.least(C("economic_value_score") / 35.0, F.lit(1.0)), 2))
    return _as_given(d, offers)


def global_quality_score(offers: DataFrame) -> DataFrame:
    """global_quality_score and the codes that explain it."""
    score = (C("economic_value_score") + C("presentation_score")) * C("reliability") + C("clarity_score") + C("fast_redeem_score") + C("source_freshness_score") + C("urgency_effect") - C("friction_penalty")
    pct, saved, urgent = C("effective_discount_pct"), C("estimated_savings"), C("expiration_urgency_score")
    member, cost = F.coalesce("requires_membership", F.lit(False)), F.lower(F.coalesce("membership_cost", F.lit("")))
    codes = F.array_compact(F.array(
        F.when(pct >= 50, "HIGH_EFFECTIVE_DISCOUNT").when(pct >= 30, "STRONG_DISCOUNT").when(pct >= 15, "MODERATE_DISCOUNT"),
        F.when(saved >= 50, "HIGH_VALUE_SAVINGS").when(saved >= 20, "GOOD_VALUE_SAVINGS"),
        F.when(urgent >= 4, "EXPIRES_TODAY").when(urgent >= 2, "EXPIRES_SOON"),
        F.when(~member & ~F.coalesce("requires_app", F.lit(False)), "NO_MEMBERSHIP_REQUIRED").when(member & cost.contains("paid"), "PAID_MEMBERSHIP_REQUIRED").when(member & cost.contains("free"), "FREE_MEMBERSHIP_REQUIRED").when(member, "MEMBERSHIP_REQUIRED"),
        F.when(C("fast_redeem_score") >= 10, "LOW_REDEMPTION_FRICTION"),
        F.when((C("spend_penalty") <= 0.5) & (C("quantity_penalty") <= 0.5), "NO_PURCHASE_MINIMUM").when(C("spend_penalty") >= 8, "HIGH_SPEND_REQUIRED"),
        F.when(C("economic_value_score") >= 40, "STRONG_ECONOMIC_VALUE"),
        F.when(F.coalesce("confidence_score", F.lit(0.0)) < 0.60, "LOW_CONFIDENCE_WARNING"),
    ))
    return offers.withColumn("global_quality_score", rounded(score, 2)).withColumn("value_explanation_codes", codes)


def score_offers(offers: DataFrame, brand_values: DataFrame, cautious_values: DataFrame, as_of: Column) -> DataFrame:
    d = effective_discount(estimate_savings(with_facts(offers), brand_values, cautious_values))
    return global_quality_score(quality_subscores(economic_value(d), as_of)).drop(*FACTS)


def score_summary(scored: DataFrame) -> DataFrame:
    s = C("global_quality_score")
    return scored.agg(F.count("*").alias("offers"), rounded(F.min(s), 2).alias("min_score"), rounded(F.max(s), 2).alias("max_score"), rounded(F.avg(s), 2).alias("avg_score"))
