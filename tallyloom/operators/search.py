"""Search of offers by text: matches with tiers, groups by brand, browsing, suggestions and searched categories.

Texts meet by short substrings instead of a cross join. Dictionaries (aliases, tags, taxonomy, blocked queries, category
keywords) are tables that the caller gives. Null and empty texts match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.joins import small, stored
from tallyloom.functions.text import rounded

C = F.col
#: Redemption methods that need a visit, offers that are rewards, and words of a paid membership.
VISITS = ("in_store", "in_app", "app_reward", "show_code", "open_maps")
REWARDS = ("reward", "membership_benefit")
PAID = "paid|annual|subscription"
#: Points for a distance of up to so many miles in a search, and in browsing near offers.
NEAR_POINTS = ((0.5, 15.0), (1.0, 12.0), (2.0, 8.0), (5.0, 4.0), (None, 1.0))
BROWSE_POINTS = ((0.5, 30.0), (1.0, 25.0), (2.0, 18.0), (5.0, 8.0), (None, 2.0))
#: Least confidence (brand matches, others), least quality of other matches, weight of a personal bonus.
BRAND_CONFIDENCE, LEAST_CONFIDENCE, LEAST_QUALITY, BONUS_WEIGHT = 0.5, 0.65, 40.0, 0.4
#: A category is promoted from this weight on; days of full weight and of 60 %.
PROMOTED, FULL_DAYS, LAST_DAYS, LATE_WEIGHT = 2.0, 7, 30, 0.6


def norm(c: Column) -> Column:
    """Lower-case letters, digits and spaces only, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Every pair of distinct texts (column text) of which outer holds inner, met by the first three characters of inner."""
    pieces = F.expr("array_distinct(flatten(transform(array(1, 2, 3), n -> transform(sequence(1, length(outer)), i -> substring(outer, i, n)))))")
    keys = inner.where("text <> ''").select(C("text").alias("inner")).distinct().withColumn("piece", F.substring("inner", 1, 3))
    holders = outer.where("text <> ''").select(C("text").alias("outer")).distinct().withColumn("piece", F.explode(pieces))
    return holders.join(small(keys), "piece").where(C("outer").contains(C("inner"))).select("inner", "outer")


def _terms(offers: DataFrame, words: DataFrame) -> DataFrame:
    """The texts of each offer that a query can meet, with their kind and place."""
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("place"), norm(C(c)).alias("term"))
    many = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), norm(x).alias("term")))
    own = F.concat(
        F.array(one("brand", "brand"), one("title", "promotion_title"), one("summary", "short_summary"), one("code", "promo_code"), one("category", "category")),
        many("explicit", "keywords_explicit"), many("contextual", "keywords_contextual"), many("product", "product_categories"),
    )
    keys = ["pos", "global_quality_score", "distance_km"]
    of_brand = words.select(norm(C("brand")).alias("b"), "kind", "place", norm(C("term")).alias("term"))
    by_word = offers.select(*keys, norm(C("brand")).alias("b")).join(small(of_brand), "b").select(*keys, "kind", "place", "term")
    return offers.select(*keys, F.inline(own)).unionByName(by_word).where("term <> ''")


def _near(points, km: Column) -> Column:
    miles, out = km * 0.621371, None
    for limit, p in points[:-1]:
        out = (F.when if out is None else out.when)(miles <= limit, p)
    return F.when(km.isNotNull(), out.otherwise(points[-1][1])).otherwise(0.0)


def search_match(queries: DataFrame, offers: DataFrame, words: DataFrame) -> DataFrame:
    """Every offer that a distinct query matches, with tier (1 to 9) and score.

    words has brand, kind (alias, taxonomy, tag or blocked), place and term; the first fitting alias or keyword counts.
    """
    asked = queries.select(norm(C("query")).alias("text")).distinct()
    terms = _terms(offers, words)
    either = C("kind").isin("explicit", "contextual", "product", "tag")
    down = contained(asked, terms.select(C("term").alias("text"))).select(C("inner").alias("query"), C("outer").alias("term"))
    up = contained(terms.where(either).select(C("term").alias("text")), asked).select(C("outer").alias("query"), C("inner").alias("term"))
    same, prefix, held = C("term") == C("query"), C("term").startswith(C("query")), C("term").contains(C("query"))
    has = lambda kind, how: F.bool_or((C("kind") == kind) & how).alias(kind)
    first = lambda kind, how, exact, other: F.min(F.when((C("kind") == kind) & how, F.struct("place", F.when(same, exact).otherwise(other).alias("points"))))["points"].alias(kind)
    found = terms.join(small(stored(down.union(up).distinct())), "term").groupBy("query", "pos", "global_quality_score", "distance_km").agg(
        has("brand", same), has("brand", prefix).alias("brand_start"), has("brand", held).alias("brand_part"), first("alias", prefix, 90.0, 70.0),
        first("explicit", F.lit(True), 80.0, 70.0), first("contextual", F.lit(True), 35.0, 25.0), has("product", F.lit(True)), has("taxonomy", same),
        has("title", held), has("summary", held), has("code", same), has("tag", F.lit(True)), has("category", held), has("blocked", same),
    )
    level = lambda when, points, tier: F.when(when, F.struct(F.lit(points).cast("double").alias("points") if isinstance(points, float) else points.alias("points"), F.lit(tier).alias("tier")))
    main = F.coalesce(
        level(C("brand"), 100.0, 1), level(C("brand_start"), 80.0, 2), level(C("alias").isNotNull(), C("alias"), 3), level(C("brand_part"), 60.0, 4),
        level(C("explicit").isNotNull(), C("explicit"), 5), level(C("contextual").isNotNull(), C("contextual"), 6), level(C("product"), 25.0, 7), level(C("taxonomy"), 60.0, 8),
    )
    add = lambda when, points: F.when(when, points).otherwise(0.0)
    by_tag = C("main").isNull() & ~C("title") & ~C("summary") & ~C("code") & C("tag")
    tier = F.coalesce("main.tier", F.when(C("title"), 8).when(C("summary"), 9).when(C("code"), 3).when(C("tag") | C("category"), 9))
    score = F.coalesce("main.points", F.lit(0.0)) + add(C("title"), 50.0) + add(C("summary"), 35.0) + add(C("code"), 70.0) + add(by_tag, 35.0) + add(C("category"), 20.0)
    score += F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("global_quality_score", F.lit(0.0)))) / 4 + _near(NEAR_POINTS, C("distance_km"))
    rated = found.withColumn("main", main).select("query", "pos", tier.alias("tier"), score.alias("score"), "blocked")
    return rated.where("tier is not null and not (tier >= 5 and blocked)").drop("blocked")


def in_context(context: str) -> Column:
    """Whether an offer belongs to a context chip; saved reads the column saved."""
    method, kind, online_only = C("redemption_method"), C("promotion_type"), F.coalesce(C("deal_scope") == "online_only", F.lit(False))
    rules = {
        "for_you": F.lit(True),
        "near_me": ~online_only & method.isin(*VISITS),
        "online": online_only | method.isin("online", "show_code"),
        "rewards": kind.isin(*REWARDS),
        "free_bogo": (C("discount_type") == "free_item") | (kind == "bogo"),
    }
    return F.coalesce(C("saved") if context == "saved" else rules[context], F.lit(False))


def context_labels() -> Column:
    """The chips of an offer: Rewards alone, else Online and Near Me as they fit, Online if none does."""
    online_only = F.coalesce(C("deal_scope") == "online_only", F.lit(False))
    online = (C("redemption_method") == "online") | ((C("redemption_method") == "show_code") & online_only)
    near = C("redemption_method").isin(*VISITS) & ~online_only
    labels = F.array_compact(F.array(F.when(online, "Online"), F.when(near, "Near Me")))
    return F.when(C("promotion_type").isin(*REWARDS), F.array(F.lit("Rewards"))).when(F.size(labels) == 0, F.array(F.lit("Online"))).otherwise(labels)


def allowed() -> Column:
    """Active offers; those of a paid membership only where the column member says that the user has it."""
    paid = F.coalesce(C("requires_membership"), F.lit(False)) & F.coalesce(F.lower("membership_cost").rlike(PAID), F.lit(False))
    return C("status").isin("active", "probably_active", "online_only") & (~paid | F.coalesce("member", F.lit(False)))


def _groups(deals: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and brand: the best offer (ties: the smaller pos), counts and chips; the offers stay rows of deals."""
    best = F.max_by(F.struct("pos", "tier", "category"), F.struct("score", -C("pos")))
    rewards = F.count_if(C("promotion_type").isin(*REWARDS))
    g = deals.withColumn("labels", context_labels()).groupBy(*keys, "brand").agg(
        best.alias("best"), F.max("score").alias("best_score"), F.count("*").alias("n_deals"), rewards.alias("n_rewards"),
        *(F.bool_or(F.array_contains("labels", x)).alias(x) for x in ("Near Me", "Online", "Rewards")),
    )
    contexts = F.concat_ws(",", *(F.when(C(x), x) for x in ("Near Me", "Online", "Rewards")))
    return g.select(*keys, "brand", C("best.pos").alias("best_pos"), C("best.tier").alias("best_tier"), C("best.category").alias("category"), "best_score", "n_deals", "n_rewards", contexts.alias("contexts"))


def run_search(matches: DataFrame, offers: DataFrame, context: str = "for_you", bonus: DataFrame | None = None) -> DataFrame:
    """Matches that pass the user's gates, by query and brand; bonus (brand, points) adds 0.4 times its points."""
    sure = C("confidence_score") >= F.when(C("tier") <= 3, BRAND_CONFIDENCE).otherwise(LEAST_CONFIDENCE)
    good = (C("tier") <= 4) | (C("global_quality_score") >= LEAST_QUALITY)
    groups = _groups(matches.join(offers.where(allowed() & in_context(context)), "pos").where(sure & good), ["query"])
    if bonus is None:
        return groups
    points = BONUS_WEIGHT * F.coalesce("points", F.lit(0.0))
    return groups.join(small(bonus), "brand", "left").withColumn("best_score", C("best_score") + points).drop("points")


def context_deals(offers: DataFrame, context: str, brands: int = 15, radius_mi: float | None = None) -> DataFrame:
    """Browsing without a query: the best brands of a context by their best offer; ties go by brand."""
    near = _near(BROWSE_POINTS, C("distance_km")) if context == "near_me" else F.lit(0.0)
    fine = allowed() & in_context(context) & (C("confidence_score") >= LEAST_CONFIDENCE)
    if context == "near_me" and radius_mi is not None:
        fine &= C("distance_km") * 0.621371 <= radius_mi
    d = offers.where(fine).withColumn("tier", F.lit(1)).withColumn("score", F.coalesce("global_quality_score", F.lit(0.0)) + near)
    return _groups(d, []).orderBy(F.desc("best_score"), "brand").limit(brands)


def related_searches(queries: DataFrame, suggestions: DataFrame, most: int = 4) -> DataFrame:
    """Up to four suggestions a query, in the order of place.

    suggestions has place, name, term and two_way: a term holds the query or, where two_way, is held by it.
    """
    asked = queries.select(norm(C("query")).alias("text")).distinct()
    terms = suggestions.withColumn("text", norm(C("term")))
    down = contained(asked, terms).select(C("inner").alias("query"), C("outer").alias("text"))
    up = contained(terms.where("two_way"), asked).select(C("outer").alias("query"), C("inner").alias("text"))
    met = down.join(terms, "text").unionByName(up.join(terms.where("two_way"), "text"))
    names = met.groupBy("query", "name").agg(F.min("place").alias("place"))
    w = Window.partitionBy("query").orderBy("place", "name")
    return names.withColumn("turn", F.row_number().over(w)).where(C("turn") <= most).select("query", "turn", "name")


def query_category(queries: DataFrame, keywords: DataFrame, results: DataFrame) -> DataFrame:
    """The category of each distinct query: the first keyword (place, term, label) it holds, else the category of at least
    half of ten among its ten best results (query, pos, category, score); null where neither says."""
    asked = queries.select(F.trim(F.lower("query")).alias("text")).where("text <> ''").distinct()
    held = contained(keywords.select(C("term").alias("text")), asked).join(keywords.withColumnRenamed("term", "inner"), "inner")
    named = held.groupBy(C("outer").alias("text")).agg(F.min_by("label", "place").alias("label"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "pos")
    top = results.withColumn("turn", F.row_number().over(w)).where("turn <= 10").groupBy("query", "category").agg(F.count("*").alias("n"), F.min("turn").alias("turn"))
    common = top.where("n >= 5").groupBy("query").agg(F.min_by("category", F.struct(-C("n"), "turn")).alias("common"))
    d = asked.withColumn("query", norm(C("text"))).join(named, "text", "left").join(common, "query", "left")
    return d.select(C("text").alias("query"), F.coalesce("label", "common").alias("category"))


def category_interest(searched: DataFrame, as_of: Column) -> DataFrame:
    """Decayed interest of users in categories (user_id, category, weight, created_at), its boost and the order of chips."""
    age = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(C("created_at").cast("timestamp"))) / 86400e6)
    decay = F.when(age <= FULL_DAYS, 1.0).otherwise(LATE_WEIGHT)
    d = searched.where((age <= LAST_DAYS) & C("category").isNotNull()).groupBy("user_id", "category").agg(rounded(F.sum(C("weight") * decay), 6).alias("interest"))
    promoted = C("interest") >= PROMOTED
    w = Window.partitionBy("user_id").orderBy(F.desc("interest"), "category")
    return d.select("user_id", "category", "interest", promoted.alias("promoted"), F.when(promoted, F.least(C("interest") * 5, F.lit(25.0))).otherwise(0.0).alias("boost"), F.row_number().over(w).alias("place"))
