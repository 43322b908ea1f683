"""Captured pages and texts: quality, status, selection of what to extract from."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.joins import small, stored

C = F.col
# What tells a page that is no content, and the words that are counted.
BAD_TITLES = [
    ("access denied", "access_denied"), ("access to this page has been denied", "access_denied"),
    ("404 not found", "page_not_found"), ("page not found", "page_not_found"), ("page not available", "page_not_found"), ("oops page not found", "page_not_found"),
    ("site offline", "site_offline"), ("something went wrong", "generic_error"), ("routing to checkout", "bot_or_queue_page"),
]
BAD_TEXTS = [
    ("access to this page has been denied", "access_denied"), ("access denied", "access_denied"),
    ("enable javascript and cookies", "bot_or_queue_page"), ("verify you are human", "bot_or_queue_page"), ("request unsuccessful", "bot_or_queue_page"),
    ("something went wrong", "generic_error"),
]
BAD_URLS = [("/pagenotfound", "page_not_found"), ("/page-not-found", "page_not_found"), ("/verify?", "bot_or_queue_page"), ("/dduser-challenge", "bot_or_queue_page"), ("queue.", "bot_or_queue_page")]
COUNTED = ["reward", "offer", "deal", "discount", "promo", "app", "member", "birthday", "expires", "valid", "coupon", "free"]
FAILURES = [
    ("timed out", "LLM timeout"), ("invalid json", "invalid JSON from LLM"), ("json decode", "invalid JSON from LLM"),
    ("no concrete", "no concrete promotion extracted"), ("no promotion", "no concrete promotion extracted"),
    ("pydantic", "LLM output failed validation"), ("validation", "LLM output failed validation"), ("404", "Ollama model not found (404)"),
    ("connection", "connection error"), ("valid json", "invalid JSON from LLM"),
    ("could not extract", "LLM returned no promotions list"), ("promotions list", "LLM returned no promotions list"),
]
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CANDIDATE_WORDS = ["reward", "offer", "deal", "promo", "discount", "valid", "expires", "birthday", "membership", "app", "sale", "off", "clearance", "savings", "coupon", "free", "redeem", "code"]
BLOCK_SIGNALS = ["access denied", "forbidden", "cloudflare", "captcha", "are you human", "just a moment", "checking your browser", "enable javascript", "pardon our interruption", "security check", "robot or human", "ddos-guard", "ray id"]


def detect_bad_page(pages: DataFrame) -> DataFrame:
    """bad_reason: the first reason that title, the start of the text or the final URL gives; null for good pages."""
    title, text, url = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 1200)), F.lower(F.coalesce("final_url", F.lit("")))
    out = F.lit(None).cast("string")
    for column, rules in reversed([(title, BAD_TITLES), (text, BAD_TEXTS), (url, BAD_URLS)]):
        for word, reason in reversed(rules):
            out = F.when(column.contains(word), reason).otherwise(out)
    return pages.withColumn("bad_reason", out)


def capture_status(captures: DataFrame, history: DataFrame) -> DataFrame:
    """content_hash, and success, skipped_duplicate_hash for texts stored before for the brand, or failed for short ones."""
    d = captures.withColumn("content_hash", F.sha2(C("text"), 256))
    known = history.select("brand", C("content_hash"), F.lit(True).alias("known")).distinct()
    return d.join(known, ["brand", "content_hash"], "left").withColumn("status", F.when(F.length("text") < 100, "failed").when(C("known"), "skipped_duplicate_hash").otherwise("success")).drop("known")


def keep_latest_captures(captures: DataFrame, keep: int) -> DataFrame:
    """The newest captures of each brand; ties by the greater id."""
    turn = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("scraped_at"), F.desc("doc_id")))
    return captures.withColumn("place", turn).where(C("place") <= keep)


def combine_sections(pages: DataFrame) -> DataFrame:
    """(brand, place, section): each page under its URL, numbered from 1 in the order of pos within its brand. Places are
    counted in ranges of (brand, pos), so that no task or value holds all texts of a brand."""
    section = F.concat(F.lit("=== "), C("url"), F.lit(" ===\n"), C("text")).alias("section")
    rows = pages.select("brand", "pos", section).where("section is not null")
    rows = rows.repartitionByRange("brand", "pos").sortWithinPartitions("brand", "pos", "section")
    rows = stored(rows.select("brand", "section", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = rows.groupBy("brand", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("brand").orderBy("part")) - C("n")
    counts = counts.select(C("brand").alias("of"), C("part").alias("in"), (before - C("first") + 1).alias("shift"))
    ranked = rows.join(small(counts), C("brand").eqNullSafe(C("of")) & (C("part") == C("in")))
    return ranked.select("brand", (C("at") + C("shift")).alias("place"), "section")


def first_titles(pages: DataFrame) -> DataFrame:
    """(brand, title): the first title of each brand that is not null."""
    return pages.groupBy("brand").agg(F.expr("min_by(title, struct(pos, url, text)) filter (where title is not null)").alias("title"))


def section_hashes(sections: DataFrame) -> DataFrame:
    """(brand, text_sha): SHA-256 of each brand's sections with blank lines between, read one after the other."""

    def run(batches):
        brand, digest = None, None
        for batch in batches:
            shas, brands = [], []
            for at, section in zip(batch.column("brand").to_pylist(), batch.column("section"), strict=True):
                if digest is None or at != brand:
                    if digest is not None:
                        brands.append(brand)
                        shas.append(digest.hexdigest())
                    brand, digest = at, hashlib.sha256()
                else:
                    digest.update(b"\n\n")
                digest.update(section.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(brands, pa.string()), pa.array(shas, pa.string())], ["brand", "text_sha"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([brand], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["brand", "text_sha"])

    return sections.repartition("brand").sortWithinPartitions("brand", "place").select("brand", "section").mapInArrow(run, "brand string, text_sha string")


def raw_text_summary(captures: DataFrame) -> DataFrame:
    """Length, lines, the start with spaces for line feeds, and how often each counted word is a part of the text."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    n = lambda w: ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("long")
    open_line = ((text != "") & ~text.rlike(f"(?:{LINE_END})\\z")).cast("long")
    lines = F.regexp_count(text, F.lit(LINE_END)) + open_line
    return captures.select("doc_id", "brand", F.length(text).cast("long").alias("length"), lines.alias("lines"), F.replace(F.substring(text, 1, 500), F.lit("\n"), F.lit(" ")).alias("start"), *(n(w).alias(f"n_{w}") for w in COUNTED))


def text_candidates(captures: DataFrame) -> DataFrame:
    """The latest text of each brand with its whole-word hits; usable from 300 characters."""
    latest = keep_latest_captures(captures, 1)
    hits = sum((F.regexp_count(F.lower("text"), F.lit(rf"\b{w}\b")) for w in CANDIDATE_WORDS), F.lit(0))
    return latest.select("doc_id", "brand", F.length("text").cast("long").alias("length"), hits.cast("long").alias("hits"), F.when(C("text").isNull(), "file_error").when(F.length("text") >= 300, "usable").otherwise("too_short").alias("status"))


def select_parse_candidates(candidates: DataFrame, done: DataFrame, failed: DataFrame, limit: int, mode: str = "new") -> DataFrame:
    """The next brands to extract from: most hits, longest, first by name. mode: new leaves out texts done before, failed
    takes only brands that failed, never takes brands without any extraction, steady leaves out brands that ever failed."""
    d = candidates.where("status = 'usable'")
    d = {"new": lambda: d.join(done, ["brand", "doc_id"], "left_anti"), "failed": lambda: d.join(failed, "brand", "left_semi"), "never": lambda: d.join(done, "brand", "left_anti"), "steady": lambda: d.join(failed, "brand", "left_anti")}[mode]()
    return d.orderBy(F.desc("hits"), F.desc("length"), "brand").limit(limit)


def keep_previous_if_empty(new: DataFrame, old: DataFrame) -> DataFrame:
    """New offers, and the old ones of brands whose new extraction is empty."""
    return new.unionByName(old.join(new.select("brand").distinct(), "brand", "left_anti"))


def classify_failures(failures: DataFrame) -> DataFrame:
    """Reasons for error texts, the first that fits; else the first 120 characters in one line."""
    e = F.lower("error")
    reason = F.substring(F.replace("error", F.lit("\n"), F.lit(" ")), 1, 120)
    for word, name in reversed(FAILURES):
        reason = F.when(e.contains(word), name).otherwise(reason)
    return failures.withColumn("reason", reason)


def pipeline_log_summary(lines: DataFrame) -> DataFrame:
    """How many lines report each outcome, and the brands named in them."""
    outcome = F.regexp_extract("value", r"(?:-> |\[)(success|skipped|failed|OK|SKIP|FAILED)\b", 1)
    brand = F.regexp_extract("value", r"^(?:\[\w+\] )?\s*([^:\[\]]+?):", 1)
    d = lines.select(F.lower(outcome).alias("outcome"), F.nullif(brand, F.lit("")).alias("brand")).where("outcome <> ''")
    return d.groupBy("outcome").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("brand")), ",").alias("brands"))


def brand_health(sources: DataFrame, captures: DataFrame, offers: DataFrame) -> DataFrame:
    """Each source's status: never captured, too short, no offers, weak or healthy; brand_status has the whole list."""
    text = captures.groupBy("brand").agg(F.max(F.struct("scraped_at", "doc_id", F.length("text").alias("length"))).alias("c"))
    n = offers.groupBy("brand").agg(F.count("*").alias("offers"), F.count_if(C("confidence_score") >= 0.65).alias("confident"))
    d = sources.join(text, "brand", "left").join(n, "brand", "left").select("brand", C("c.length").alias("length"), F.coalesce("offers", F.lit(0)).alias("offers"), F.coalesce("confident", F.lit(0)).alias("confident"))
    return d.withColumn("health", F.when(C("length").isNull(), "never_captured").when(C("length") < 400, "too_short").when(C("offers") == 0, "no_offers").when(C("confident") == 0, "weak").otherwise("healthy"))


def brand_status(sources: DataFrame, captures: DataFrame, offers: DataFrame, failures: DataFrame) -> DataFrame:
    """Each source's status of eight, by its latest text: parse_failed (brands in failures), homepage_only, never_scraped,
    too_short, blocked_or_challenge, success_synthetic, success_llm, zero_deals_real. sources: brand and its urls."""
    text = F.coalesce("text", F.lit(""))
    blocked = F.lower(text).rlike("|".join(BLOCK_SIGNALS))
    latest = captures.groupBy("brand").agg(F.max(F.struct("scraped_at", "doc_id", F.length(text).cast("long").alias("n"), blocked.alias("blocked"))).alias("c"))
    made = F.coalesce("synthesized", F.lit(False))
    n = offers.groupBy("brand").agg(F.count_if(~made).alias("llm"), F.count_if(made).alias("synthetic"))
    failed = failures.select("brand", F.lit(True).alias("failed")).distinct()
    d = sources.join(latest, "brand", "left").join(n, "brand", "left").join(failed, "brand", "left")
    home = F.forall("urls", lambda u: u.rlike(r"^[^?#]*://[^/?#]*/*(\?)?(#.*)?$"))
    status = F.when(C("failed"), "parse_failed").when(C("c").isNull() & home, "homepage_only").when(C("c").isNull(), "never_scraped").when(C("c.n") < 400, "too_short").when(C("c.blocked"), "blocked_or_challenge").when(C("llm") > 0, "success_llm").when(C("synthetic") > 0, "success_synthetic").otherwise("zero_deals_real")
    deals = lambda c: F.when(C("failed") | C("c").isNull(), 0).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    d = d.withColumn("failed", F.coalesce("failed", F.lit(False)))
    return d.select("brand", status.alias("status"), F.coalesce("c.n", F.lit(0)).alias("raw_chars"), deals("llm").alias("llm_deals"), deals("synthetic").alias("synth_deals"))


def health_shares(health: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return health.groupBy("health").agg(F.count("*").alias("n")).withColumn("share_pct", F.round(100.0 * C("n") / total, 1))


#: Words of a page for women, men and children.
GENDER_WORDS = {
    "women": ["women", "woman", "womens", "womenswear", "her", "ladies", "lady", "girls", "girl"],
    "men": ["mens", "menswear", "him", "guys", "guy", "boys", "boy", "men", "man"],
    "kids": ["kids", "kid", "children", "child", "baby", "babies", "toddler", "infant", "infants"],
}
#: Words that a page with a local deal has, how many it needs, and the least confidence of its offer.
DEAL_SIGNALS = [
    "sale", "special", "discount", "promo", "promotion", "offer", "happy hour", "deal", "coupon", "% off", "off today", "free",
    "first visit", "new guest", "first time", "student", "resident", "pop-up", "pop up", "event", "limited time", "this week", "today only",
    "weekday special", "prix fixe", "early bird", "complimentary", "bogo", "buy one", "get one",
]
LEAST_SIGNALS, LOCAL_CONFIDENCE = 2, 0.85


def detect_gender(lines: Column, text: Column) -> Column:
    """Whom product lines and text speak of: kids alone, women, men, unisex for both of these, else null."""
    said = F.concat_ws(" ", F.array_join(F.coalesce(lines, F.array().cast("array<string>")), " "), text)
    words = F.split(F.lower(said), r"[\s\-/']+")
    women, men, kids = (F.arrays_overlap(words, F.array(*map(F.lit, GENDER_WORDS[g]))) for g in ("women", "men", "kids"))
    return F.when(women & men, "unisex").when(women, "women").when(men, "men").when(kids, "kids")


def has_deal_signals(text: Column) -> Column:
    """Whether the text has two or more of the signals of a local deal; a null text has none."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(lower.contains(w), 1).otherwise(0) for w in DEAL_SIGNALS), F.lit(0)) >= LEAST_SIGNALS


def due_businesses(businesses: DataFrame, checks: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Businesses that were not checked in the last days; names differ by more than case and outer spaces."""
    recent = checks.where(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("checked_at")) / 86400) < days)
    return businesses.withColumn("_key", F.lower(F.trim("name"))).join(recent.select(F.lower(F.trim("name")).alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def best_local_offer(offers: DataFrame) -> DataFrame:
    """The surest titled offer of each business (name, pos, promotion_title, confidence_score); ties: the smaller pos."""
    sure = offers.where((F.col("confidence_score") >= LOCAL_CONFIDENCE) & (F.col("promotion_title") != ""))
    best = F.max_by(F.struct("pos", "promotion_title", "confidence_score"), F.struct("confidence_score", -F.col("pos")))
    return sure.groupBy(F.lower(F.trim("name")).alias("business")).agg(best.alias("o")).select("business", "o.*")
