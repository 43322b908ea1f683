"""Offers read from texts and e-mails, by example."""

import datetime

from pyspark.sql import functions as F

from tallyloom.operators import extraction as ex


def one(spark, text, brand="Store", **kw):
    return ex.rule_based_offers(spark.createDataFrame([(brand, text)], "brand string, text string"), **kw).first()


def test_short_or_silent_texts_have_no_offer(spark):
    for text in ("Coupon: 30% off", None, "", "nothing to tell here " * 20, "reward " + " " * 500):
        r = one(spark, text)
        assert (r["extraction_status"], r["promotion_title"], r["confidence_score"], r["discount_type"]) == ("no_offer_found", None, 0.15, "unknown")
        assert r["short_summary"] == "No clear offer or reward text found for Store."
    assert one(spark, "30% off today\n30% off online.", min_length=1, require_keywords=False)["discount_value"] == "30%"
    assert one(spark, "30% off today\n30% off online.", min_length=1)["extraction_status"] == "no_offer_found"


def test_a_whole_offer(spark):
    text = "Happy hour 3:30pm - 12 am for members.\r\n  Get $ 5.50 off with promo code RUN, new customers only.  \u2028Other\x1dvalid until May 3, coupon needed"
    r = one(spark, text, "AMC Theatres", min_length=10)
    assert (r["discount_type"], r["discount_value"], r["promotion_type"]) == ("amount_off", "$5.50", "coupon")
    assert (r["time_start"], r["time_end"], r["membership_name"], r["membership_cost"]) == ("15:30", "00:00", "AMC Stubs", "free")
    assert r["evidence"] == ["$ 5.50 off", "promo code", "valid until", "coupon"]
    assert r["redemption_method"] == "in_app" and not r["requires_app"]  # "happy" has the word
    assert r["redemption_steps"][0] == "Sign in to or join the AMC Theatres rewards/membership program." and len(r["redemption_steps"]) == 4
    assert (r["friction_level"], len(r["friction_reasons"])) == ("medium", 2)
    assert r["terms_text"] == "Happy hour 3:30pm - 12 am for members. valid until May 3, coupon needed"
    assert r["promotion_title"] == "AMC Theatres $5.50 offer" and r["short_summary"] == "AMC Theatres has a $5.50 offer that may require membership."


def test_kinds_of_discounts_in_their_order(spark):
    cases = {
        "save 20 percent off or $3 off": ("percentage_off", "20%"), "take 7 dollars off": ("amount_off", "$7"), "a free entrée, coupon": ("free_item", "free"),
        "earn 50 points toward a reward": ("points", None), "sale, limited time": ("sale_price", None), "coupon": ("unknown", None),
        "50 points, 50 states, sale of rewards": ("unknown", None),
    }
    for text, want in cases.items():
        r = one(spark, text, min_length=1, require_keywords=False)
        assert (r["discount_type"], r["discount_value"]) == want, text
    assert one(spark, "our rewards for you", min_length=1)["promotion_type"] == "reward"
    assert one(spark, "valued members", min_length=1)["promotion_type"] == "unknown"


def test_words_count_wherever_they_stand(spark):
    """As often as each word occurs, words within words included."""
    words = "reward rewards offer deal promo promotion coupon discount sale valid expires birthday member membership app".split()
    for text in ("Rewardsale offereward happymembership promotion", "apps app" * 30, " ".join(words), ""):
        assert one(spark, text)["keyword_hits"] == sum(text.lower().count(w) for w in words)


def test_confidence_has_a_ceiling_and_counts(spark):
    long = "reward offer coupon 20% off for members and more\n" * 100
    assert one(spark, long)["confidence_score"] == 0.65
    assert one(spark, "valid " + "x" * 300)["confidence_score"] == 0.25 + 0.10
    assert len(one(spark, "valid " + "x" * 30_000)["terms_text"]) == 1500


def test_clashing_names_and_no_rows(spark):
    d = spark.createDataFrame([(None, "20% off coupon", "mine", 7)], "brand string, text string, evidence string, extra int")
    r = ex.rule_based_offers(d, min_length=1).first()
    assert r["evidence"] == ["20% off", "coupon"] and r["extra"] == 7 and r["promotion_title"] is None
    assert ex.rule_based_offers(d.limit(0)).count() == 0


EMAIL = "message_id string, brand string, subject string, body string, sent_at timestamp, links array<string>, visibility string"
SENT = datetime.datetime(2026, 10, 6, 12)


def offers(spark, *rows):
    return ex.extract_email_offers(spark.createDataFrame(list(rows), EMAIL)).collect()


def test_short_email_keeps_what_redeems_it(spark):
    body = "Use code SAVE30 for 30% off online. Offer expires October 10, 2026.\nhttps://example.com/unsubscribe\nhttps://example.com/deal"
    links = ["https://example.com/unsubscribe", "mailto:a@example.com", "https://example.com/deal"]
    (r,) = offers(spark, ("m", "Example Store", "Your offer: 30% off today", body, SENT, links, "private_user_offer"))
    assert (r["source_type"], r["discount_type"], r["discount_value"], r["promo_code"]) == ("email", "percentage_off", "30%", "SAVE30")
    assert (r["deal_url"], str(r["end_date"]), r["visibility"], r["promotion_title"]) == ("https://example.com/deal", "2026-10-10", "private_user_offer", "Your offer: 30% off today")
    assert r["confidence_score"] == 0.75


def test_mails_without_an_offer_give_none(spark):
    assert offers(spark, ("m", "Store", "Our story", "Welcome to our newsletter.", SENT, [], "x"), ("n", "Store", None, None, None, None, None)) == []
    (r,) = offers(spark, ("m", "Store", "30% off today", "30% off online.", None, None, "x"))
    assert (r["discount_value"], r["deal_url"], r["end_date"], r["confidence_score"]) == ("30%", None, None, 0.6)


def test_dates_of_phrases(spark):
    cases = [
        ("October 10, 2026", "2026-10-06", "2026-10-10"), ("Oct. 1", "2026-10-06", "2026-10-01"), ("January 3", "2026-12-30", "2027-01-03"),
        ("January 3, 2026", "2026-12-30", "2026-01-03"), ("1/3", "2026-12-30", "2027-01-03"), ("1/3/26", "2026-12-30", "2026-01-03"),
        ("13/5/2026", "2026-10-06", "2026-05-13"), ("13/5", "2026-10-06", None), ("February 30", "2026-01-01", None), ("members 12", "2026-01-01", None),
        ("Sept 5", "2026-01-01", "2026-09-05"), ("junk 5", "2026-01-01", None), ("3/5/024", "2026-01-01", None),
    ]
    d = spark.createDataFrame(cases, "phrase string, ref string, want string")
    for r in d.withColumn("got", ex.phrase_date(F.col("phrase"), F.to_timestamp("ref")).cast("string")).collect():
        assert r["got"] == r["want"], r["phrase"]
