"""Search rules on small tables with results written by hand."""

from pyspark.sql import functions as F

from tallyloom.operators import search as op

WORDS = [("Acme Air", "alias", 0, "aa"), ("Acme Air", "alias", 1, "acair"), ("Acme Air", "taxonomy", 0, "flights"), ("Kibble", "tag", 0, "dog food"), ("Kibble", "blocked", 0, "food")]
SCHEMA = "pos int, brand string, promotion_title string, short_summary string, promo_code string, category string, keywords_explicit array<string>, keywords_contextual array<string>, product_categories array<string>, global_quality_score double, distance_km double"


def matched(spark, queries, offers):
    words = spark.createDataFrame(WORDS, "brand string, kind string, place int, term string")
    rows = op.search_match(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(offers, SCHEMA), words).collect()
    return {(r.query, r.pos): (r.tier, round(r.score, 3)) for r in rows}


def test_tiers_and_points(spark):
    offers = [
        (1, "Acme Air", "Fly away", None, "GO-5", "travel", None, [], None, 0.0, None),
        (2, "Kibble", "Treats", "dog food box", None, "food", ["bowl"], None, None, 40.0, 1.0),
        (3, None, None, None, None, None, None, None, None, None, None),
        (4, "Shoes!", "Boots", None, None, "fashion", ["Sneakers", "boots"], ["boot"], [""], 100.0, None),
    ]
    got = matched(spark, ["ACME AIR", "acme", "a.a.", "air", "flights", "go5", "food", "boots", "boot", "", None, "!!", "bowls"], offers)
    assert got == {
        ("acme air", 1): (1, 100.0), ("acme", 1): (2, 80.0), ("aa", 1): (3, 90.0), ("air", 1): (4, 60.0), ("flights", 1): (8, 60.0), ("go5", 1): (3, 70.0),
        ("bowls", 2): (5, 92.0), ("boots", 4): (5, 155.0), ("boot", 4): (5, 145.0),
    }


def test_repeats_and_empty_tables(spark):
    one = (1, "B", "T", None, None, "c", None, None, None, 0.0, None)
    assert matched(spark, ["b", "B "], [one]) == {("b", 1): (1, 100.0)}
    assert matched(spark, [], [one]) == {} == matched(spark, ["b"], [])


def test_contained_finds_short_and_long_texts(spark):
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    got = op.contained(texts("a", "ab", "bcd", "", None, "zz"), texts("xabcd" * 2000, "a", "b", None, ""))
    assert {(r.inner, len(r.outer)) for r in got.collect()} == {("a", 10000), ("ab", 10000), ("bcd", 10000), ("a", 1)}


def test_interest_decays(spark):
    rows = [(1, "Tech", 1.0, "2024-01-30 00:00:00"), (1, "Tech", 2.0, "2024-01-10 00:00:00"), (1, "Food", 1.0, "2023-12-01 00:00:00"), (2, "Food", 9.0, "2024-01-24 00:00:00"), (2, None, 9.0, "2024-01-23 00:00:00")]
    d = spark.createDataFrame(rows, "user_id int, category string, weight double, at string").withColumn("created_at", F.to_timestamp("at"))
    got = op.category_interest(d, F.expr("timestamp '2024-01-31 00:00:00'")).collect()
    assert {(r.user_id, r.category, r.interest, r.promoted, r.boost) for r in got} == {(1, "Tech", 2.2, True, 11.0), (2, "Food", 9.0, True, 25.0)}


def test_interest_counts_whole_days_by_microseconds(spark):
    """A part of a second after midnight is not yet another day: 8 days less a moment count in full, 31 less a moment still count."""
    rows = [(1, "Tech", 1.0, "2024-01-23 00:00:00.000001"), (2, "Tech", 1.0, "2024-01-23 00:00:00"), (3, "Tech", 1.0, "2023-12-31 00:00:00.9"), (4, "Tech", 1.0, "2023-12-31 00:00:00"), (5, "Tech", 1.0, "2024-01-31 00:00:00.5")]
    for kind in ("timestamp", "timestamp_ntz"):
        d = spark.createDataFrame(rows, "user_id int, category string, weight double, at string").withColumn("created_at", F.col("at").cast(kind))
        got = op.category_interest(d, F.expr("timestamp '2024-01-31 00:00:00'")).collect()
        assert {r.user_id: r.interest for r in got} == {1: 1.0, 2: 0.6, 3: 0.6, 5: 1.0}
