"""Examples for what SQL does not show: page text, mail, sources, sinks, typography and tree scores."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import catalog, learning, messages, pages
from tallyloom.sources import files


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_visible_text():
    html = "<html><body><script>x()</script><nav>Menu</nav><h1>Rewards</h1><p>Get offers today.</p><p>Get offers today.</p><p>We use cookies</p><a href='/deals/shoes'>Shoes on sale</a><img alt='Summer sale banner'></body></html>"
    assert pages.visible_text(html) == "Rewards\nGet offers today.\nWe use cookies\nShoes on sale [deal_url:/deals/shoes] Summer sale banner"
    assert pages.visible_text(None) == "" and pages.visible_text(pages.visible_text(html)).startswith("Rewards")


def test_parse_eml(spark):
    raw = b"From: Shop <deals@shop.example.com>\r\nSubject: Save 30%\r\nDate: Mon, 05 Oct 2026 10:00:00 +0200\r\nMessage-ID: <1@x>\r\nContent-Type: text/plain\r\n\r\nUse code SAVE30. Expires 10/10/2026. https://shop.example.com/a https://shop.example.com/a\r\n"
    r = files.parse_eml(spark.createDataFrame([("p", bytearray(raw))], "path string, content binary")).first()
    assert (r["brand"], r["sender"], r["subject"], str(r["sent_at"]), r["links"]) == ("Shop", "deals@shop.example.com", "Save 30%", "2026-10-05 08:00:00", ["https://shop.example.com/a"])
    s = messages.email_signals(spark.createDataFrame([(r["subject"], r["text"])], "subject string, body string")).first()
    assert s["promo_codes"] == ["SAVE30"] and s["expiry_phrases"] == ["10/10/2026"] and s["has_signal"]


def test_mails_that_cannot_be_read_do_not_end_the_job(spark):
    odd = b"From: a@b.example.com\r\nContent-Type: text/plain; charset=no-such-set\r\n\r\nHello"
    rows = [("none", None), ("odd", bytearray(odd)), ("empty", bytearray(b"")), ("good", bytearray(b"Subject: Hi\r\n\r\nText"))]
    got = {r["path"]: r for r in files.parse_eml(spark.createDataFrame(rows, "path string, content binary").coalesce(1)).collect()}
    assert got["none"]["error"].startswith("TypeError") and got["none"]["text"] is None and got["odd"]["error"].startswith("LookupError")
    assert (got["good"]["subject"], got["good"]["text"], got["good"]["error"]) == ("Hi", "Text", None) and got["empty"]["text"] == ""


def test_sources_and_sinks(spark, tmp_path):
    docs = {"brand": "Acme", "category": "food", "promotions": [{"promotion_title": "10% off", "confidence_score": 0.8}, None, {"promotion_title": "Free tea", "brand": "Other"}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "acme.json").write_text(json.dumps(docs))
    (tmp_path / "in" / "none.json").write_text(json.dumps({"brand": "None"}))
    offers = files.read_brand_documents(spark, str(tmp_path / "in"))
    assert sorted((r["pos"], r["brand"], r["promotion_title"]) for r in offers.collect()) == [(0, "Acme", "10% off"), (2, "Other", "Free tea")]
    files.write_catalog(offers, str(tmp_path / "catalog"))
    assert spark.read.json(str(tmp_path / "catalog/stats")).first()["promotion_count"] == 2
    (tmp_path / "sources.json").write_text(json.dumps([{"brand": "A", "url": "https://a.example.com"}, {"brand": "B", "urls": ["https://b.example.com", "x"], "allowed_to_fetch": False}]))
    sources = files.load_sources(spark, str(tmp_path / "sources.json"))
    assert sorted((r["brand"], r["url"], len(r["urls"])) for r in sources.collect()) == [("A", "https://a.example.com", 1), ("B", "https://b.example.com", 2)]
    assert [r["brand"] for r in files.filter_sources(sources, allowed_only=False, first=1).collect()] == ["A"]
    assert [r["brand"] for r in files.filter_sources(sources, brand="a").collect()] == ["A"]
    (tmp_path / "caps").mkdir()
    (tmp_path / "caps" / "a_1.txt").write_text("one\ntwo")
    (tmp_path / "caps" / "b_1.txt").write_text("three")
    (tmp_path / "caps" / "a_1.meta.json").write_text(json.dumps({"brand": "A", "title": "T"}))
    assert sorted((r["stem"], r["text"], r["brand"]) for r in files.read_captures(spark, str(tmp_path / "caps")).collect()) == [("a_1", "one\ntwo", "A"), ("b_1", "three", None)]
    for _ in range(2):
        files.append_log(offers.select("brand"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    files.write_review_csv(offers.select("pos", "brand"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["pos", "brand"]


@pytest.mark.parametrize("given,plain", [("CafÃ© â€™s", "CafÃ© â€s"), ("CafÃ©", "Café"), ("Café", "Café"), ("it’s “so” — nice…™", "it's \"so\" - nice..."), ("plain", "plain")])
def test_plain_typography(spark, given, plain):
    assert spark.range(1).select(catalog.plain_typography(F.lit(given))).first()[0] == plain


@pytest.mark.parametrize("url", ["http://localhost/", "https://u:p@example.com", "https://example.com:99/", "ftp://example.com", "https://exa mple.com", "https://-a.example.com", "https://1.2.3.4/", "example.com", "https://example.com.evil.org/", "https://notexample.com/"])
def test_untrusted_urls(spark, url):
    assert spark.range(1).select(tx.matches_domain(F.lit(url), F.lit("example.com"))).first()[0] is False


def test_trees_fall_back_to_the_prior(spark):
    model = {"prior": 0.25, "trees": [{"splits": [{"feature": 0, "border": 0.5}], "leaves": [-1.0, 1.0]}]}
    rows = spark.createDataFrame([(0.5,), (0.6,), (None,), (float("inf"),)], "x double")
    got = [round(r["probability"], 4) for r in learning.score_trees(rows, model, ["x"]).collect()]
    assert got == [0.2689, 0.7311, 0.25, 0.25]


def test_one_dismissal_of_the_brand(spark):
    """One fresh dismissal: brand preference -1 / 5, total evidence 1 / 20."""
    labels = spark.createDataFrame([(1, "p1", 0, 5)], "user_id long, promotion_id string, label int, sequence long").withColumn("at", F.expr("timestamp '2024-01-31 00:00:00'"))
    offers = spark.createDataFrame([("p1", "A", "food", "sale", "points", False), ("p2", "a ", "tech", "sale", "free_item", True)], "promotion_id string, brand string, category string, promotion_type string, discount_type string, requires_membership boolean")
    pairs = spark.createDataFrame([(1, "p2"), (1, "p1")], "user_id long, promotion_id string")
    got = {r["promotion_id"]: r for r in learning.preference_features(pairs, labels, offers, F.expr("timestamp '2024-01-31 00:00:00'")).collect()}
    assert (got["p2"]["brand_preference"], got["p2"]["total_evidence"], got["p2"]["category_preference"]) == (-0.2, 0.05, 0.0)
    assert (got["p1"]["brand_preference"], got["p1"]["total_evidence"]) == (0.0, 0.0)


def test_features_of_offers_and_stated_preferences(spark):
    """Scores clamp to 0..1, names meet in any case, unknown memberships are told apart, each priority has its own sort of offer."""
    labels = spark.createDataFrame([], "user_id long, promotion_id string, label int, sequence long, at timestamp")
    offers = spark.createDataFrame(
        [("p1", " Brand A", "Food", "reward", "free_item", True, 130.0, -4.0, 0.5, 25.0, True, True, " $5 ", "online_only", True, "BOGO socks"),
         ("p2", "b", "tech", "sale", "points", False, float("nan"), None, None, 300.0, None, False, " ", "brand_level", False, "Buy one, get one"),
         ("p3", "c", None, None, "amount_off", None, 50.0, 10.0, 1.5, 0.0, False, None, None, None, None, None)],
        "promotion_id string, brand string, category string, promotion_type string, discount_type string, requires_membership boolean, global_quality_score double, economic_value_score double, confidence_score double, effective_discount_pct double, requires_app boolean, purchase_required boolean, minimum_spend string, deal_scope string, is_email boolean, promotion_title string")
    users = spark.createDataFrame([(1, ["brand a ", None], ["FOOD"], [" Free"]), (2, ["B"], None, ["bogo", "nearby"]), (3, [], [], ["discount"]), (4, None, None, ["nearby"])], "user_id long, favorite_brands array<string>, favorite_categories array<string>, deal_priorities array<string>")
    members = spark.createDataFrame([(1, "BRAND A", False), (1, "brand a", True), (2, "b", False)], "user_id long, brand string, is_member boolean")
    pairs = spark.createDataFrame([(1, "p1", None), (2, "p1", None), (2, "p2", None), (3, "p3", None), (4, "p3", 2.5), (9, "p2", 1.0)], "user_id long, promotion_id string, distance_km double")
    rows = learning.preference_features(pairs, labels, offers, F.expr("timestamp '2024-01-31 00:00:00'"), users, members)
    assert rows.columns == ["user_id", "promotion_id", *learning.PREFERENCE_FEATURES] and len(learning.PREFERENCE_FEATURES) == 30
    got = {(r["user_id"], r["promotion_id"]): r.asDict() for r in rows.collect()}
    ones = lambda *k: {name for name, v in got[k].items() if v == 1 and name not in ("user_id", "promotion_id")}
    assert ones(1, "p1") == {"quality", "requires_membership", "has_membership", "membership_known", "requires_app", "purchase_required", "minimum_spend_required", "online_only", "email", "favorite_brand", "favorite_category", "priority_match", "discount_free", "discount_bogo", "promotion_reward"}
    assert (got[1, "p1"]["economic_value"], got[1, "p1"]["confidence"], got[1, "p1"]["discount"]) == (0.0, 0.5, 0.25)
    assert ones(2, "p1") == ones(1, "p1") - {"has_membership", "membership_known", "favorite_brand", "favorite_category"}
    assert ones(2, "p2") == {"discount", "membership_known", "favorite_brand", "discount_points"}  # a comma is no single character before a space
    assert ones(3, "p3") == {"confidence", "priority_match", "discount_amount"} and ones(4, "p3") == ones(3, "p3")
    assert ones(9, "p2") == {"discount", "discount_points"}
    assert all(v is not None for row in got.values() for v in row.values())
