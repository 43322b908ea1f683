"""Examples of captures that the test tables do not hold."""

import hashlib

from pyspark.sql import functions as F

from tallyloom.operators import captures as cap


def test_text_candidates_count_their_own_words(spark):
    words = ["reward", "offer", "deal", "promo", "discount", "valid", "expires", "birthday", "membership", "app", "sale", "off", "clearance", "savings", "coupon", "free", "redeem", "code"]
    rows = [(1, "A", " ".join(words)), (2, "B", "save member offers appcode")]
    captures = spark.createDataFrame(rows, "doc_id long, brand string, text string").withColumn("scraped_at", F.lit("2024-01-01").cast("timestamp"))
    assert {r["brand"]: r["hits"] for r in cap.text_candidates(captures).collect()} == {"A": 18, "B": 0}


def test_brand_status_has_eight(spark):
    long = "x" * 400
    texts = {"short": "y", "blocked": long + " Ray ID 1", "llm": long, "made": long, "none": long, "failed": long}
    captures = spark.createDataFrame([(k, b, t) for k, (b, t) in enumerate(texts.items())] + [(-1, "llm", "captcha")], "doc_id long, brand string, text string").withColumn("scraped_at", F.lit("2024-01-01").cast("timestamp"))
    urls = {"home": ["https://a.example.com/", "https://a.example.com"], "never": ["https://a.example.com", "https://a.example.com/deals"]}
    sources = spark.createDataFrame([(b, urls.get(b, [])) for b in [*texts, *urls]], "brand string, urls array<string>")
    offers = spark.createDataFrame([("llm", False), ("llm", True), ("made", True), ("failed", False), ("blocked", None)], "brand string, synthesized boolean")
    got = {r["brand"]: (r["status"], r["llm_deals"], r["synth_deals"]) for r in cap.brand_status(sources, captures, offers, sources.where("brand = 'failed'")).collect()}
    assert got == {
        "short": ("too_short", 0, 0), "blocked": ("blocked_or_challenge", 1, 0), "llm": ("success_llm", 1, 1), "made": ("success_synthetic", 0, 1), "none": ("zero_deals_real", 0, 0),
        "failed": ("parse_failed", 0, 0), "home": ("homepage_only", 0, 0), "never": ("never_scraped", 0, 0),
    }


def test_sections_stay_rows(spark):
    """A brand's sections are rows with running places and are hashed as one text, whatever range or batch holds them."""
    pages = spark.range(500).select(F.when(F.col("id") % 5 > 0, "A").alias("brand"), (1000 - F.col("id")).alias("pos"), F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") != 7, F.concat(F.lit("t\u00e9"), "id")).alias("text"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("T"), "id")).alias("title"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        sections = cap.combine_sections(pages)
        got = {r["brand"]: r["text_sha"] for r in cap.section_hashes(sections).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = sections.collect()
    for brand in ("A", None):
        ids = [i for i in reversed(range(500)) if (i % 5 > 0) == (brand == "A") and i != 7]
        want = [f"=== u{i} ===\nt\u00e9{i}" for i in ids]
        assert [(r["place"], r["section"]) for r in sorted((r for r in rows if r["brand"] == brand), key=lambda r: r["place"])] == list(enumerate(want, 1))
        assert got[brand] == hashlib.sha256("\n\n".join(want).encode()).hexdigest()
    assert {r["brand"]: r["title"] for r in cap.first_titles(pages).collect()} == {"A": "T498", None: "T490"}


def test_bad_pages_by_example(spark):
    rows = [("Access to this page has been denied.", "", None, "access_denied"), ("Something went wrong.", "", None, "generic_error"), ("Sale at L.L.Bean- Quality Apparel & Gear", "real sale copy", None, None), (None, "x" * 1200 + "access denied", "https://queue.example.com", "bot_or_queue_page"), (None, None, None, None)]
    pages = spark.createDataFrame([r[:3] for r in rows], "title string, text string, final_url string")
    assert [r["bad_reason"] for r in cap.detect_bad_page(pages).collect()] == [r[3] for r in rows]


def test_failed_brands_of_a_log(spark):
    lines = spark.createDataFrame([("[FAILED] Hilton: C:\\failed\\hilton.json",), ("[OK] A b: 3",), ("C: https://x -> skipped",), ("noise",)], "value string")
    assert {(r["outcome"], r["n"], r["brands"]) for r in cap.pipeline_log_summary(lines).collect()} == {("failed", 1, "Hilton"), ("ok", 1, "A b"), ("skipped", 1, "C")}


def test_visible_text_of_a_page():
    from tallyloom.operators.pages import visible_text

    html = f"<header>Deals</header><canvas>no</canvas><p>Read our privacy policy</p><p><a href='/deals/1'>Big sale</a> <a href='/cart'>My cart</a> <a href='/x#y'>Other one</a></p><p>{'pursuant to law ' * 30}</p><p>Warranty terms</p>"
    assert visible_text(html) == "Deals\nBig sale [deal_url:/deals/1] My cart Other one\nWarranty terms"


def test_notification_rules_by_example(spark):
    from tallyloom.operators import messages

    base = dict(brand="A b!", promotion_title="BOGO lunch", discount_type="free_item", discount_value=None, global_quality_score=80.0, confidence_score=0.9, requires_membership=False, requires_app=False, membership_cost=None, end_date=None, valid_days=None, new_user_only=False)
    cases = [({}, None), ({"global_quality_score": 64.9}, "below_threshold"), ({"confidence_score": 0.74}, "low_confidence"), ({"discount_type": "points"}, "points"), ({"valid_days": ["mon"]}, "wrong_day"), ({"valid_days": ["WED "]}, None), ({"promotion_title": "BOGO for students"}, "demographic_restricted"), ({"requires_membership": True, "membership_cost": "Paid"}, "paid_membership_not_member"), ({"brand": "ab", "new_user_only": True}, "new_user_only_existing_customer"), ({"promotion_title": "One month off", "discount_type": "unknown"}, "insufficient_signal_diversity"), ({"promotion_title": "3 months free", "discount_type": "free_item"}, "insufficient_signal_diversity"), ({"discount_type": "percentage_off", "discount_value": "50 %", "promotion_title": "Half"}, None)]
    rows = [{**base, "brand": "zz", **c} for c, _ in cases]
    offers = spark.createDataFrame([tuple(r.values()) for r in rows], "brand string, promotion_title string, discount_type string, discount_value string, global_quality_score double, confidence_score double, requires_membership boolean, requires_app boolean, membership_cost string, end_date date, valid_days array<string>, new_user_only boolean")
    none = spark.createDataFrame([], "brand string")
    affinity = spark.createDataFrame([("A B", 3)], "brand string, email_count int")
    got = messages.notification_candidates(offers, none, none, affinity, F.lit("2024-01-31").cast("timestamp")).collect()
    assert [r["skip_reason"] for r in got] == [w for _, w in cases]
