"""Normalising, merging and publishing offers.

Jobs read the columns of an offer by name (brand, category, promotion_title, short_summary, discount_type, discount_value,
promotion_type, redemption_method, deal_scope, confidence_score, ...) and add or replace columns; pos gives the order of
offers where ties need one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.joins import small
from tallyloom.functions.text import any_date, compact, iso_date, offer_text, public_url, slug

C = F.col

# Fixed values, all of this block: what counts as a placeholder, junk, a discount, and so on, in offer texts; names of paid
# programs, titles, and typography.
PLACEHOLDER = r"(?i)^(?:no\s+promotions?\s+found|an\s+error\s+occurred|[a-z\s]+\s+promotion\s*$)"
SWEEPSTAKES = r"(?i)\bsweepstakes\b|\bcontest\b|\braffle\b|\bgiveaway\b|\benter\s+to\s+win\b"
TICKETS = r"(?i)^.{2,60}\s+tickets?\s*(?:\([^)]*\))?\s*$"
SERVICE = r"(?i)\brent(?:al)?\b|\bhire\b"
REAL_DISCOUNT = r"(?i)\d+(?:\.\d+)?%\s+off|\$\d+(?:\.\d+)?\s+off|\bsave\s+(?:up\s+to\s+)?\$\d+|\bbuy\s+one\s+get\s+one\b|\bbogo\b"
FREE = r"(?i)\bfree\b"
BOGO = r"(?i)\bbuy\s+one\s+get\s+one\b|\bbogo\b"
SHIPPING = r"(?i)\bfree\s+(?:standard\s+|ground\s+|express\s+|2-day\s+)?(?:ship(?:ping|s)?|delivery)\b|\bship(?:ping|s)?\s+(?:is\s+)?free\b"
SHIPPING_TITLE = r"(?i)\bfree\s+(?:standard\s+)?(?:shipping|delivery)\b"
SUBSCRIPTION = r"(?i)(\$\d+(?:\.\d+)?\s*(?:/\s*mo(?:nth)?|per\s+mo(?:nth)?|/\s*yr|/\s*year|per\s+year))\b"
PERCENT_OFF = r"(?i)((?:up\s+to\s+)?\d+(?:\.\d+)?%)\s+off\b"
AMOUNT_OFF = r"(?i)(\$\d+(?:\.\d+)?)\s+off\b"
AMOUNT_SAVE = r"(?i)\bsave\s+(?:up\s+to\s+)?(\$\d+(?:\.\d+)?)\b"
IN_APP, IN_STORE = r"(?i)\bapp\b|\bdownload\b|\bmobile\b", r"(?i)\bin[-\s]store\b|\bat\s+(the\s+)?store\b|\bin\s+person\b"
CODE, ONLINE = r"(?i)\bpromo\s+code\b|\bcoupon\s+code\b|\benter\s+(the\s+)?code\b", r"(?i)\bonline\s+only\b|\bweb\s+only\b|\bwebsite\s+only\b"
CARD_PARTNER = r"(?i)\b(with|using|via)\s+the\s+.{5,60}(card|credit|debit|rewards)\b"
PAID_PROGRAMS = [("aarp", "AARP"), ("aaa", "AAA"), ("costco", "Costco"), ("sam's club", "Sam's Club"), ("bj's", "BJ's")]
TITLE_FROM_VALUE = {"percentage_off": "{} Off", "amount_off": "{} Off", "free_item": "Free {}", "free_shipping": "Free Shipping", "points": "{} Points", "sale_price": "{} Sale"}
TYPOGRAPHY = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", "®": "", "™": ""}
VISIBLE = ("active", "probably_active", "online_only")
NOT_ENGLISH = "[¡¿ñÑ]"


def _text() -> Column:
    return offer_text(C("promotion_title"), C("short_summary"))


def _filled(c: str) -> Column:
    return F.coalesce(C(c), F.lit("")) != ""


def drop_placeholder_and_junk(offers: DataFrame) -> DataFrame:
    """Without placeholders, sweepstakes, plain tickets, services and descriptions of paid memberships."""
    title, text = F.trim(F.coalesce("promotion_title", F.lit(""))), _text()
    real, free = text.rlike(REAL_DISCOUNT), text.rlike(FREE)
    bare = (C("promotion_type") == "membership_benefit") & (C("membership_cost") == "unknown") & C("end_date").isNull() & ~real & ~free
    junk = title.rlike(PLACEHOLDER) | title.rlike(SWEEPSTAKES) | (title.rlike(TICKETS) & ~real) | (title.rlike(SERVICE) & ~real & ~free) | F.coalesce(bare, F.lit(False))
    return offers.where(~junk)


def attach_brand(offers: DataFrame, sources: DataFrame) -> DataFrame:
    """Canonical brand, domain and online_only from sources by the brand's slug or lower-case name; category where empty."""
    keyed = sources.select(F.explode(F.array_distinct(F.array(slug(C("brand")), F.lower("brand")))).alias("key"), C("brand").alias("known"), C("category").alias("known_category"), F.regexp_replace(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), r"^www\.", "").alias("website_domain"), F.coalesce("online_only", F.lit(False)).alias("online_only")).dropDuplicates(["key"])
    both = offers.join(keyed.withColumnRenamed("key", "by_slug"), slug(C("brand")) == C("by_slug"), "left")
    return both.withColumn("brand", F.coalesce("known", "brand")).withColumn("category", F.when(_filled("category"), C("category")).otherwise(C("known_category"))).drop("by_slug", "known", "known_category")


def resolve_deal_url(offers: DataFrame) -> DataFrame:
    """Paths become URLs on the brand's domain; other things that are no URL become null."""
    path = C("deal_url").startswith("/") & _filled("website_domain")
    return offers.withColumn("deal_url", F.when(path, F.concat(F.lit("https://www."), C("website_domain"), C("deal_url"))).when(C("deal_url").startswith("http"), C("deal_url")))


def fix_discounts(offers: DataFrame) -> DataFrame:
    """Zero discounts, free shipping, subscription prices, and types that the text tells: in this order."""
    title, value = F.coalesce("promotion_title", F.lit("")), F.trim(F.coalesce("discount_value", F.lit("")))
    kind = C("discount_type")
    zero = (kind == "percentage_off") & value.isin("0%", "0")
    nothing = value.isin("$0", "0", "$0.00") & title.rlike("(?i)free")
    shipped = (kind == "free_shipping") & value.isin("0%", "0", "0.0")
    d = offers.withColumns({
        "discount_type": F.when(zero, F.when(title.rlike("(?i)free"), "free_item").otherwise("unknown")).when(nothing, "free_item").otherwise(kind),
        "discount_value": F.when(zero | nothing | shipped, "").otherwise(C("discount_value")),
    })
    text = _text()
    bogo = (kind == "free_shipping") & title.rlike(BOGO)
    ships = ~bogo & (((kind == "free_item") & text.rlike(SHIPPING)) | ((kind == "unknown") & title.rlike(SHIPPING_TITLE)))
    open_type = F.coalesce(C("promotion_type") == "unknown", F.lit(True))
    d = d.withColumns({
        "discount_type": F.when(bogo, "free_item").when(ships, "free_shipping").otherwise(kind),
        "discount_value": F.when(bogo, "").otherwise(C("discount_value")),
        "promotion_type": F.when(ships & open_type, "sale").otherwise(C("promotion_type")),
    })
    price = F.nullif(F.regexp_extract(text, SUBSCRIPTION, 1), F.lit(""))
    subscribed = (kind == "unknown") & price.isNotNull()
    d = d.withColumns({
        "discount_type": F.when(subscribed, "sale_price").otherwise(kind),
        "discount_value": F.when(subscribed & ~_filled("discount_value"), F.trim(price)).otherwise(C("discount_value")),
        "promotion_type": F.when(subscribed & open_type, "membership_benefit").otherwise(C("promotion_type")),
    })
    share = F.nullif(F.regexp_extract(text, PERCENT_OFF, 1), F.lit(""))
    amount = F.coalesce(F.nullif(F.regexp_extract(text, AMOUNT_OFF, 1), F.lit("")), F.nullif(F.regexp_extract(text, AMOUNT_SAVE, 1), F.lit("")))
    told = F.coalesce(share, amount)
    return d.withColumns({
        "discount_type": F.when((kind == "unknown") & share.isNotNull(), "percentage_off").when((kind == "unknown") & amount.isNotNull(), "amount_off").otherwise(kind),
        "discount_value": F.when((kind == "unknown") & told.isNotNull() & ~_filled("discount_value"), F.trim(told)).otherwise(C("discount_value")),
    })


def fix_membership(offers: DataFrame) -> DataFrame:
    """Paid third-party programs named in the text, free loyalty programs, and the type of offers for members."""
    text = F.lower(_text())
    program = F.lit(None).cast("string")
    for word, name in reversed(PAID_PROGRAMS):
        program = F.when(text.contains(word), name).otherwise(program)
    needs = F.coalesce("requires_membership", F.lit(False))
    named = ~needs & text.rlike(r"\bmembers?\b") & program.isNotNull()
    d = offers.withColumns({
        "membership_name": F.when(named, program).otherwise(C("membership_name") if "membership_name" in offers.columns else F.lit(None)),
        "membership_cost": F.when(named, "paid").otherwise(C("membership_cost")),
        "requires_membership": needs | named,
    })
    d = d.withColumn("membership_cost", F.when(C("requires_membership") & (C("membership_cost") == "unknown") & (C("promotion_type") == "reward"), "free").otherwise(C("membership_cost")))
    keep = F.coalesce(C("promotion_type").isin("reward", "membership_benefit"), F.lit(False))
    return d.withColumn("promotion_type", F.when(C("requires_membership") & ~keep, "membership_benefit").otherwise(C("promotion_type")))


def plain_typography(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 put right, then curly quotes, dashes and marks made plain."""
    again = F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")
    broken = c.rlike("[Â-ô][\u0080-¿]") & ~c.rlike("[^\u0000-ÿ]") & ~F.coalesce(again.contains("�"), F.lit(False))
    out = F.when(broken, again).otherwise(c)
    for a, b in TYPOGRAPHY.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fix_titles(offers: DataFrame) -> DataFrame:
    """Titles of rewards programs, titles that are missing, and plain typography."""
    points = (C("discount_type") == "points") & ~_filled("discount_value") & ~F.coalesce(F.lower("promotion_title").startswith("rewards program:"), F.lit(False))
    d = offers.withColumn("promotion_title", F.when(points, F.concat(F.lit("Rewards Program: "), C("brand"))).otherwise(C("promotion_title")))
    summary = F.trim(F.coalesce("short_summary", F.lit("")))
    end = F.instr(summary, ". ")
    made = F.when((C("discount_type") == "free_shipping"), "Free Shipping")
    for kind, form in TITLE_FROM_VALUE.items():
        before, _, after = form.partition("{}")
        made = made.when(_filled("discount_value") & (C("discount_type") == kind), F.concat(F.lit(before), C("discount_value"), F.lit(after)) if "{}" in form else F.lit(form))
    made = made.when((summary != "") & (end > 1) & (end <= 81), F.trim(F.substring(summary, F.lit(1), end - 1))).when(summary != "", F.trim(F.substring(summary, 1, 80)))
    made = made.otherwise(F.concat(C("brand"), F.lit(" "), F.initcap(F.replace(F.coalesce("promotion_type", F.lit("unknown")), F.lit("_"), F.lit(" ")))))
    d = d.withColumn("promotion_title", F.when(_filled("promotion_title"), C("promotion_title")).otherwise(made))
    return d.withColumn("promotion_title", plain_typography(C("promotion_title"))).withColumn("short_summary", plain_typography(C("short_summary")))


def fix_redemption_and_scope(offers: DataFrame, online_only: Column | None = None) -> DataFrame:
    """A redemption method where none is known, a scope that agrees with it, and online routing for online-only brands."""
    steps = F.array_join("redemption_steps", " ") if "redemption_steps" in offers.columns else F.lit("")
    text = _text()
    method = F.when(F.coalesce("requires_app", F.lit(False)) | steps.rlike(IN_APP), "in_app").when(text.rlike(CODE), "show_code").when(steps.rlike(IN_STORE), "in_store").when((C("deal_scope") == "online_only") | text.rlike(ONLINE), "online")
    unknown = F.coalesce(C("redemption_method") == "unknown", F.lit(True))
    d = offers.withColumn("redemption_method", F.when(unknown, F.coalesce(method, "redemption_method")).otherwise(C("redemption_method")))
    narrow = (C("redemption_method").isin("in_app", "in_store") & (C("deal_scope") == "online_only")) | ((C("redemption_method") == "in_app") & (F.coalesce("deal_scope", F.lit("unknown")) == "unknown"))
    d = d.withColumn("deal_scope", F.when(narrow, "brand_level").otherwise(C("deal_scope")))
    if online_only is not None:
        d = d.withColumn("deal_scope", F.when(online_only, "online_only").otherwise(C("deal_scope")))
        d = d.withColumn("redemption_method", F.when(online_only & ~C("redemption_method").isin("online", "show_code"), "online").otherwise(C("redemption_method")))
    return d


def fix_confidence(offers: DataFrame) -> DataFrame:
    """Caps and penalties for failed, unknown, gift card and incomplete offers; gift cards get a category of their own."""
    weekly = F.coalesce(C("category").isin("grocery", "food") & (C("promotion_type") == "sale"), F.lit(False))
    unknown = C("discount_type") == "unknown"
    score = F.coalesce("confidence_score", F.lit(0.0))
    score = F.when(F.coalesce(C("extraction_status") != "success", F.lit(True)), F.least(score, F.lit(0.4))).otherwise(score)
    score = score - F.when(unknown & (C("promotion_type") == "unknown"), 0.2).otherwise(0.0)
    score = F.when(unknown & ~weekly, F.least(score, F.lit(0.6))).otherwise(score)
    gift = F.lower(_text()).contains("gift card")
    score = F.when(gift, F.least(score, F.lit(0.55))).otherwise(score)
    score = score - F.when(_filled("promotion_title"), 0.0).otherwise(0.15) - F.when(_filled("short_summary"), 0.0).otherwise(0.1)
    priced = _filled("discount_value") | F.coalesce(C("discount_type").isin("free_item", "free_shipping", "points"), F.lit(False)) | weekly
    score = score - F.when(priced, 0.0).otherwise(0.05)
    return offers.withColumn("confidence_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)).withColumn("category", F.when(gift, "gift_card").otherwise(C("category")))


def normalize_dates(offers: DataFrame, *columns: str) -> DataFrame:
    return offers.withColumns({c: iso_date(C(c).cast("string")) for c in columns})


def compute_status(offers: DataFrame, as_of: Column) -> DataFrame:
    """expired, low_confidence, needs_review, online_only, probably_active or active: the first that holds."""
    end = any_date(C("end_date").cast("string"))
    score = F.coalesce("confidence_score", F.lit(0.0))
    stamp = F.try_to_timestamp(F.nullif(F.regexp_extract("source_path", r"(\d{8}T\d{6}Z)", 1), F.lit("")), F.lit("yyyyMMdd'T'HHmmss'Z'")) if "source_path" in offers.columns else F.lit(None).cast("timestamp")
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.coalesce(C("last_confirmed").cast("timestamp"), stamp))) / 86400e6
    status = F.when(end < F.to_date(as_of), "expired").when(score < 0.4, "low_confidence").when((age > 14) | (score < 0.6), "needs_review").when(C("deal_scope") == "online_only", "online_only").when(C("end_date").isNull(), "probably_active").otherwise("active")
    return offers.withColumn("status", status)


def dedup_offers(offers: DataFrame) -> DataFrame:
    """One offer per brand of equal title, type and value; then of equal type, number and URL. The most confident wins,
    the first of equals, and takes the place (pos) of the first."""
    title = compact(F.regexp_replace(F.lower("promotion_title"), CARD_PARTNER, ""))
    best = lambda: F.max_by(F.struct(*offers.columns), F.struct(F.coalesce("confidence_score", F.lit(0.0)), -C("pos")))
    keyed = offers.withColumn("_title", title)
    bare = keyed.where("_title = ''").drop("_title")
    first = keyed.where("_title <> ''").groupBy("brand", "_title", "discount_type", "discount_value").agg(best().alias("o"), F.min("pos").alias("_pos")).select("o.*", "_pos")
    d = first.unionByName(bare.withColumn("_pos", C("pos")))
    value = F.lower(F.trim(F.coalesce("discount_value", F.lit(""))))
    number = F.when(~value.isin("", "free", "points", "unknown"), F.nullif(F.regexp_extract(value, r"(\d+(?:\.\d+)?)", 1), F.lit("")))
    url = F.coalesce(F.nullif(C("deal_url"), F.lit("")), F.nullif(C("source_url"), F.lit("")) if "source_url" in offers.columns else F.lit(None))
    d = d.withColumns({"_number": number, "_url": url})
    loose = d.where(C("_number").isNull() | C("_url").isNull() | C("discount_type").isNull()).select(*offers.columns, "_pos")
    again = F.max_by(F.struct(*offers.columns), F.struct(F.coalesce("confidence_score", F.lit(0.0)), -C("_pos")))
    second = d.where(C("_number").isNotNull() & C("_url").isNotNull() & C("discount_type").isNotNull()).groupBy("brand", "discount_type", "_number", "_url").agg(again.alias("o"), F.min("_pos").alias("_pos")).select("o.*", "_pos")
    return second.unionByName(loose).withColumn("place", C("_pos")).drop("_pos")


def merge_active(*catalogs: DataFrame) -> DataFrame:
    out = catalogs[0]
    for c in catalogs[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out.where(C("status").isin(*VISIBLE))


def merge_sources(web: DataFrame, email: DataFrame) -> DataFrame:
    """Web and e-mail offers by brand, first 40 characters of the title's slug, and type: the last web offer, unless an
    e-mail offer is as confident; source tells which sides (or several e-mails) had it."""
    key = [slug(C("brand")).alias("_brand"), F.substring(slug(C("promotion_title")), 1, 40).alias("_title"), F.coalesce("discount_type", F.lit("unknown")).alias("_type")]
    keys = ["_brand", "_title", "_type"]
    row = F.struct(*web.columns)
    w = web.select(row.alias("o"), C("pos"), *key).groupBy(*keys).agg(F.max_by("o", "pos").alias("web"))
    e = email.select(row.alias("o"), C("pos"), F.coalesce("confidence_score", F.lit(0.0)).alias("score"), *key).groupBy(*keys).agg(F.max_by("o", F.struct("score", "pos")).alias("email"), F.max("score").alias("score"), F.count("*").alias("n"))
    both = w.join(e, keys, "full_outer")
    wins = C("web").isNull() | (C("score") >= F.coalesce("web.confidence_score", F.lit(0.0)))
    source = F.when(C("email").isNull(), "web").when(C("web").isNull() & (C("n") == 1), "email").otherwise("both")
    return both.select(F.when(C("email").isNotNull() & wins, C("email")).otherwise(C("web")).alias("o"), source.alias("source")).select("o.*", "source")


def publish_filter(offers: DataFrame, as_of: Column, least: float = 0.65) -> DataFrame:
    """Every offer with why it is dropped, the first reason that holds: not_english, low_confidence, expired; null if not."""
    text = F.trim(offer_text(C("promotion_title"), C("short_summary")))
    reason = F.when(text.rlike(NOT_ENGLISH), "not_english").when(F.coalesce("confidence_score", F.lit(0.0)) < least, "low_confidence").when(F.to_timestamp(C("end_date")) < as_of, "expired")
    return offers.withColumn("drop_reason", reason)


def drop_counts(marked: DataFrame) -> DataFrame:
    return marked.where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n"))


def review_table(offers: DataFrame) -> DataFrame:
    """What reviewers see of each offer, with the order of its status."""
    order = F.when(C("status") == "needs_review", 0).when(C("status") == "low_confidence", 1).when(C("status") == "expired", 2).otherwise(3)
    return offers.select("pos", "brand", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("promotion_title", F.lit("")).alias("promotion_title"), F.coalesce("discount_value", F.lit("")).alias("discount_value"), "status", C("status").isin("needs_review", "low_confidence").alias("needs_review"), order.alias("status_order"))


def status_counts(offers: DataFrame) -> DataFrame:
    return offers.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("confidence_score"), 4).alias("avg_confidence"))


def load_catalog(offers: DataFrame, least: float = 35.0) -> DataFrame:
    """Titled offers of enough quality, the best of each brand and title (lower case); the first of equals."""
    fine = offers.where((F.trim(F.coalesce("promotion_title", F.lit(""))) != "") & (C("global_quality_score") >= least))
    best = F.max_by(F.struct(*offers.columns), F.struct("global_quality_score", -C("pos")))
    return fine.groupBy(F.lower("brand").alias("_b"), F.lower("promotion_title").alias("_t")).agg(best.alias("o")).select("o.*")


def missing_keyword_queue(offers: DataFrame) -> DataFrame:
    """Brands with offers that have no keywords, most offers first; equal ones in the order of their first offer."""
    bare = (F.coalesce(F.size("product_keywords_explicit"), F.lit(0)) <= 0) & (F.coalesce(F.size("product_keywords_contextual"), F.lit(0)) <= 0)
    return offers.where(_filled("brand") & bare).groupBy("brand").agg(F.count("*").alias("offers"), F.min("pos").alias("first")).orderBy(F.desc("offers"), "first")


def apply_keyword_store(offers: DataFrame, store: DataFrame) -> DataFrame:
    """Keywords (at most 25) and categories (at most 5) of the brand for offers without any of their own."""
    has = (F.coalesce(F.size("product_keywords_explicit"), F.lit(0)) > 0) | (F.coalesce(F.size("product_keywords_contextual"), F.lit(0)) > 0)
    both = offers.join(store.select("brand", C("keywords").alias("_k"), C("categories").alias("_c")), "brand", "left")
    return both.withColumns({
        "product_keywords_contextual": F.when(has, C("product_keywords_contextual")).otherwise(F.coalesce(F.slice("_k", 1, 25), "product_keywords_contextual")),
        "product_categories": F.when(has, C("product_categories")).otherwise(F.coalesce(F.slice("_c", 1, 5), "product_categories")),
    }).drop("_k", "_c")


def category_percentile(offers: DataFrame) -> DataFrame:
    """The band ("Top N %") of each offer among its category by quality; by score alone under five offers."""
    w = Window.partitionBy(F.lower("category"))
    n, beaten, score = F.count("*").over(w), F.rank().over(w.orderBy("global_quality_score")) - 1, C("global_quality_score")
    raw = F.round((1.0 - beaten / n) * 100)
    sparse = F.when(score >= 80, 10).when(score >= 65, 25).when(score >= 50, 40).otherwise(50)
    band = F.when(raw <= 5, 5)
    for step in (10, 15, 20, 25, 30, 40):
        band = band.when(raw <= step, step)
    return offers.withColumn("top_pct", F.when(n < 5, sparse).otherwise(band.otherwise(50)))


def group_grocery(offers: DataFrame) -> DataFrame:
    """Offers with the size of the group that their brand's sales are shown as (grocery and food from 2, fashion from 4)."""
    least = F.when(C("category").isin("grocery", "food"), 2).when(C("category") == "fashion", 4)
    sale = (C("promotion_type") == "sale") & least.isNotNull()
    w = Window.partitionBy("brand", sale)
    first = F.first(least).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n = F.count("*").over(w)
    return offers.withColumn("group_size", F.when(sale & (n >= first), n).otherwise(F.lit(1)))


def fast_redemption(offers: DataFrame, as_of: Column, links: DataFrame | None = None) -> DataFrame:
    """The first action that fits an eligible offer: its type, label, value, URL, effort and confidence.

    links: (word, deep_link, web_link, ord) of apps; the first word that is part of the brand's name counts.
    """
    url = F.coalesce(F.nullif(F.trim("source_url"), F.lit("")) if "source_url" in offers.columns else F.lit(None), F.concat(F.lit("https://www."), F.nullif(F.trim("website_domain"), F.lit(""))))
    d = offers.withColumn("_url", url)
    web, deep = F.lit(None).cast("string"), F.lit(None).cast("string")
    if links is not None:
        name = F.trim(F.regexp_replace(F.lower("brand"), "[^a-z0-9 ]", ""))
        hit = d.select("pos", name.alias("_n")).join(small(links), C("_n").contains(C("word"))).groupBy("pos").agg(F.min_by(F.struct("deep_link", "web_link"), "ord").alias("_app"))
        d = d.join(hit, "pos", "left")
        web, deep = C("_app.web_link"), C("_app.deep_link")
    code, food = F.nullif(F.trim("promo_code"), F.lit("")), F.coalesce(F.lower("category").isin("food", "fast_food", "restaurant", "coffee"), F.lit(False))
    app = F.coalesce("requires_app", F.lit(False))
    expired = any_date(C("end_date").cast("string")) < F.to_date(as_of)
    eligible = C("status").isin(*VISIBLE) & (F.coalesce("confidence_score", F.lit(0.0)) >= 0.65) & _filled("promotion_title") & ~F.coalesce(expired, F.lit(False)) & (code.isNotNull() | app | C("_url").isNotNull())
    there = C("_url").isNotNull()
    how = C("redemption_method")

    def act(kind, label, effort, confidence, value=None, to=None):
        text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
        return F.struct(F.lit(True).alias("eligible"), F.lit(kind).alias("action_type"), text(label).alias("button_label"), text(value).alias("primary_value"), (C("_url") if to is None else to).alias("primary_url"), F.lit(effort).alias("effort_level"), F.lit(confidence).alias("confidence"))

    none = F.struct(F.lit(False).alias("eligible"), F.lit("not_supported").alias("action_type"), F.lit("").alias("button_label"), F.lit(None).cast("string").alias("primary_value"), F.lit(None).cast("string").alias("primary_url"), F.lit("high").alias("effort_level"), F.lit(0.0).alias("confidence"))
    pick = lambda a, b: F.when(food, a).otherwise(b)
    action = (
        F.when(~F.coalesce(eligible, F.lit(False)), none)
        .when(app, act("open_app", F.concat(F.lit("Open "), C("brand"), F.lit(" App")), "medium", 0.80, to=F.coalesce(web, C("_url"))))
        .when(code.isNotNull() & there, act("copy_code_and_open_url", pick("Order & Apply Code", "Copy Code & Shop"), "low", 0.95, code))
        .when(code.isNotNull(), act("copy_code", "Copy Code", "low", 0.90, code))
        .when((how == "online") & there, act("open_url", pick("Order Now", "Shop Now"), "low", 0.85))
        .when((how == "in_store") & there, act("open_maps", "Find Nearest Store", "medium", 0.70, C("brand")))
        .when(C("promotion_type").isin("reward", "membership_benefit") & there, act("open_rewards", "View Rewards", "medium", 0.75))
        .when(there, act("show_steps", "How to Redeem", "high", 0.50))
        .otherwise(none)
    )
    return d.withColumn("fast_redemption", action).withColumn("app_deep_link", F.when(C("fast_redemption.action_type") == "open_app", deep)).drop("_url", "_app")


def trusted_urls(offers: DataFrame) -> DataFrame:
    return offers.withColumn("url_is_public", public_url(C("deal_url")))


def carry_forward_evidence(new: DataFrame, previous: DataFrame, as_of: Column) -> DataFrame:
    """New evidence (offer, source_url, content_hash, status, checked_at) after what earlier runs found on the same page.

    A fetch that failed at or after the capture makes it unverified; an equal supported offer that was checked later lends
    its time. Evidence that is not supported sends an offer to review. Null URLs or hashes match nothing.
    """
    page = ["source_url", "content_hash"]
    latest = lambda c, more=F.lit(True): F.max(F.when((F.col(c) <= as_of) & more, F.col(c)))
    failed = previous.groupBy(*page).agg(latest("check_failed_at").alias("_failed"))
    proved = previous.groupBy("offer", *page).agg(latest("checked_at", F.col("status") == "supported").alias("_proved"))
    d = new.join(failed, page, "left").join(proved, ["offer", *page], "left")
    lost = F.coalesce(F.col("_failed") >= F.col("checked_at"), F.lit(False))
    status = F.when(lost, "unverified").otherwise(F.col("status"))
    newer = ~lost & (F.col("status") == "supported") & (F.col("_proved") > F.col("checked_at"))
    return d.withColumns({"status": status, "checked_at": F.when(newer, F.col("_proved")).otherwise(F.col("checked_at")), "check_failed_at": F.when(lost, F.col("_failed")), "needs_review": F.coalesce(status != "supported", F.lit(True))}).drop("_failed", "_proved")
