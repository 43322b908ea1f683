"""Examples of price grids, product lines, collapsed offers and links that the test tables do not hold."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import price_grids as op

GRID = "Blue Jacket\n$100.00 $60.00\nRed Dress\n$80 $40\nTote\n$50.00 $30.00\n"


def cards(spark, *texts):
    rows = [(k, f"B{k}", "fashion", t) for k, t in enumerate(texts)]
    return {r["doc_id"]: r for r in op.price_grid_sale(spark.createDataFrame(rows, "doc_id long, brand string, category string, text string")).collect()}


def test_cards(spark):
    far = "Jacket $100.00 $50.00\n" + "x " * 300 + "\nDress $80.00 $40.00"
    near = "Jacket $100.00 $50.00\nDress $80.00 $40.00"
    turned = "now $60.00 was $100.00\n" + "y " * 30 + "now $40.00 was $80.00\n" + "z " * 30 + "$30.00 (reg. $50.00)"
    unsure = "$60.00 / $100.00\n" + "y " * 30 + "$40.00 / $80.00\n" + "z " * 30 + "$30.00 / $50.00"
    outlier = "$100.00 $20.00\n" + "\n".join("word " * 9 + f"${100 + k}.00 $70.00" for k in range(11))
    thousands = "$2,999.00 $1,999.00\n" + "a " * 30 + "$1,500.00 $999.50\n" + "b " * 30 + "$100 $50"
    got = cards(spark, GRID, far, near, turned, unsure, outlier, thousands, None, "", "$100 - $50\n" * 5, "$100 save $50\n" * 5, "4.50 4.20 no price 3.2.10 12.345")
    assert set(got) == {0, 2, 3, 5, 6}
    assert (got[0]["discount_value"], got[0]["n_pairs"], got[0]["least_cut"], got[0]["confidence_score"]) == ("up to 40% off", 3, 40, 0.60)
    assert got[0]["product_categories"] == ["outerwear", "dresses", "bags"] and got[0]["matched_product_examples"] == ["BLUE JACKET", "RED DRESS", "TOTE"]
    assert got[0]["short_summary"] == "B0 has items on sale with discounts from 40% to 40% off. On sale: outerwear, dresses, bags."
    assert (got[2]["n_pairs"], got[2]["confidence_score"], got[2]["short_summary"][:60]) == (2, 0.52, "B2 has items on sale up to 50% off, saving up to $50. On sal")
    assert (got[3]["n_pairs"], got[3]["least_cut"], got[3]["most_cut"]) == (3, 40, 50)
    assert (got[5]["most_cut"], got[5]["headline_cut"], got[5]["confidence_score"]) == (80, 36, 0.67)
    assert got[6]["most_saved"] == 1000.0 and "saving up to $1,000." in got[6]["short_summary"]


def test_markdowns_are_rounded_to_even_and_bounded():
    assert [c for c, _, _ in op.markdowns("$200.00 $175.00 abcdefghijklmnopqrstuvwxyz $200.00 $171.00")] == [12, 14]
    assert list(op.markdowns("$5000 $2000 abcdefghijklmnopqrstuvwxyz $100 $10 abcdefghijklmnopqrstuvwxyz $100 $95 abcdefghijklmnopqrstuvwxyz $1 $0.50")) == []


def test_product_lines():
    text = "Far away line\n" + "\n".join(f"filler {k}" for k in range(6)) + "\nSlim  Shirt XL,\n$20\nslim shirt M\nView cart\nXL\n-20%\n25 %\n$9 each\nabc\nCap"
    assert op.lines_of(text) == ["filler 2", "filler 3", "filler 4", "filler 5", "slim shirt"]
    assert op.lines_of("$1\n" + "\n".join(f"name {chr(97 + k % 26)}{k}" if k % 5 else "$5" for k in range(200))) == [f"name {chr(97 + k % 26)}{k}" for k in range(200) if k % 5][:30]
    assert op.lines_of("") == op.lines_of("no price") == []


def brute_kinds(lines):
    import re

    text = " ".join(lines).lower()
    return [label for label, triggers, _ in op.TAXONOMY if any(re.search(rf"\b{re.escape(t)}\b", text) for t in triggers)]


@pytest.mark.parametrize("lines", [[], ["laptop address"], ["Blazer Set"], ["eau de parfum", "t-shirt_x", "T-Shirt"], ["suitcase", "one-piece swim"], ["tops", "top"], [" ".join(t for _, triggers, _ in op.TAXONOMY for t in triggers)], ["éclat tee", "teé"]])
def test_kinds_match_a_search_for_each_trigger(lines):
    automaton = op._automaton()
    assert op.classify(lines, automaton)[0] == op.classify(lines, automaton, True)[0] == brute_kinds(lines)


def test_keywords():
    kinds, words = op.classify(["slim cargo shorts", "tank top"], op._automaton())
    assert kinds == ["bottoms", "tops"]
    assert words == ["pants", "trousers", "leggings", "joggers", "shorts", "shirt", "tee", "blouse", "top", "polo", "cargo", "cargo shorts", "slim cargo shorts", "tank", "tank top"]
    many = [f"thing{k} other{k}" for k in range(100)]
    assert len(op.classify(many, op._automaton())[1]) == 80 and op.classify(many, op._automaton(), True) == ([], [])


OFFER = "doc_id long, pos long, promotion_title string, promotion_type string, discount_type string, discount_value string, requires_membership boolean, requires_app boolean, promo_code string, product_keywords_explicit array<string>, product_keywords_contextual array<string>, matched_product_examples array<string>"


def test_collapse(spark):
    def offer(doc, pos, title, value="20%", kind="sale", code=None, words=("w",)):
        return doc, pos, title, kind, "percentage_off", value, False, None, code, list(words), [f"c{pos}"], [title or "x"]

    rows = [offer(1, k, f"Item {k}", words=[f"k{k}", "same"]) for k in range(40)] + [offer(1, 90, "Join", kind="reward")]  # a grid, and one that is dropped with it
    rows += [offer(2, 1, "Half off"), offer(2, 2, "HALF OFF!"), offer(2, 3, ""), offer(2, 4, None), offer(2, 5, "Join", kind="reward")]  # less than 80 %: added
    rows += [offer(3, 1, "Nearly", "36% off", code="C"), offer(3, 2, "Other", "5%", code="C")]  # within 15 points
    rows += [offer(4, 1, "All", None, code="C", words=())]  # neither has keywords of its own
    rows += [offer(5, 1, "A"), offer(5, 2, "B")]  # no card
    card = "doc_id long, promotion_title string, promotion_type string, discount_type string, discount_value string, product_keywords_explicit array<string>, product_keywords_contextual array<string>, matched_product_examples array<string>"
    made = [(d, f"Card {d}", "sale", "percentage_off", "up to 50% off", [], ["own", "c3"], ["ITEM 2"]) for d in (1, 2, 3, 4, 6)]
    got = {}
    for r in op.collapse_grid_offers(spark.createDataFrame(rows, OFFER).repartition(3), spark.createDataFrame(made, card)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    titles = {d: sorted((r["promotion_title"] or "-", r["synthesized"]) for r in own) for d, own in got.items()}
    assert titles == {1: [("Card 1", True)], 2: [("-", False), ("-", False), ("Card 2", True), ("Half off", False), ("Join", False)], 3: [("Nearly", False), ("Other", False)], 4: [("All", False)], 5: [("A", False), ("B", False)], 6: [("Card 6", True)]}
    one = got[1][0]
    assert one["product_keywords_explicit"] == ["k0", "same", *(f"k{k}" for k in range(1, 29))] and len(one["product_keywords_contextual"]) == 40
    assert one["product_keywords_contextual"][:4] == ["own", "c3", "c0", "c1"] and one["matched_product_examples"] == ["ITEM 2", "Item 0", "Item 1", *(f"Item {k}" for k in range(3, 15))]


@pytest.mark.parametrize("marker,excerpt,want", [
    ("/running", "Save 20% off running shoes. [deal_url:/running]", "https://www.example.com/running"),
    ("/accessibility", "Save 20% off running shoes.", None),
    ("//evil.test/running", "Save 20% off running shoes. [deal_url://evil.test/running]", None),
    ("/running", None, "https://www.example.com/running"),
])
def test_links(spark, marker, excerpt, want):
    offers = spark.createDataFrame([(1, "a", "20% off running shoes", None, None, "example.com", excerpt)], "pos int, source string, promotion_title string, short_summary string, deal_url string, website_domain string, excerpt string")
    texts = spark.createDataFrame([("a", f"Save 20% off running shoes. [deal_url:{marker}]")], "source string, text string")
    assert op.backfill_deal_urls(offers, texts).first()["deal_url"] == want


def test_best_link_earliest_of_equals_and_no_shared_word(spark):
    text = "shoes [deal_url:/one] " + "x " * 400 + "crimson shoes [deal_url:/two] " + "x " * 400 + "crimson shoes [deal_url:/three]"
    offers = spark.createDataFrame([(1, "Crimson shoes", None), (2, "With that offer", None), (3, "Hats", None), (4, "Blue shoes", "https://k/"), (5, None, None)], "pos int, promotion_title string, deal_url string")
    offers = offers.withColumns({"source": F.lit("a"), "short_summary": F.lit("").cast("string"), "website_domain": F.lit(None).cast("string"), "excerpt": F.lit(None).cast("string")})
    got = {r["pos"]: r["deal_url"] for r in op.backfill_deal_urls(offers, spark.createDataFrame([("a", text), ("b", None)], "source string, text string")).collect()}
    assert got == {1: "/two", 2: None, 3: None, 4: "https://k/", 5: None}
