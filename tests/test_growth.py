"""Jobs that must not grow faster than their input, on rows that tell the ways to do them apart."""

from pyspark.sql import functions as F

from tallyloom.functions.text import any_date, rounded
from tallyloom.operators import learning, messages, ranking

STATE = "user_id long, promotion_id string, impressions long, clicks long, redeemed boolean, saved boolean, dismissed boolean"


def test_rounding_goes_by_the_product(spark):
    got = spark.createDataFrame([(56.449999999999996,), (-2.5,), (None,)], "x double").select(rounded("x", 1).alias("a"), rounded("x", 0).alias("b")).collect()
    assert [tuple(r) for r in got] == [(56.5, 56.0), (-2.5, -3.0), (None, None)]


def test_dates_in_every_form(spark):
    texts = ["2024-01-05T10:00:00", "2024-01-05t10:00:00z", " 2024-01-05 ", "01/05/2024", "January 5, 2024", "Jan 5, 2024", "5 January 2024", "Jan. 5, 2024"]
    odd = ["2024-1-5", "5 Jan 2024", "", "January 5 2024", "2024-01-05 10:00:00", None]
    d = spark.createDataFrame([(t,) for t in texts + odd], "t string").select("t", any_date(F.col("t")).cast("string").alias("d"))
    got = {r["t"]: r["d"] for r in d.collect()}
    assert [got[t] for t in texts] == ["2024-01-05"] * len(texts) and [got[t] for t in odd] == [None] * len(odd)


def test_brand_scores_from_summed_up_offers(spark):
    wanted = spark.createDataFrame([(1, "A"), (2, "A"), (3, "C")], "user_id long, brand string")
    offers = spark.createDataFrame([("A", "food", 10.0), ("A", "food", 40.0), ("A", "tech", 5.0), ("B", "food", 90.0)], "brand string, category string, score double")
    weights = spark.createDataFrame([(1, "food", 0.5)], "user_id long, category string, weight double")
    interest = spark.createDataFrame([(2, "tech", 1.0)], "user_id long, category string, interest double")
    got = {(r["user_id"], r["category"]): r["brand_score"] for r in ranking.brand_level_score(wanted, offers, weights, interest).collect()}
    assert got == {(1, "food"): 49.0, (1, "tech"): 7.0, (2, "food"): 44.0, (2, "tech"): 12.0}


def test_stores_within_near_the_pole_and_over_the_date_line(spark):
    users = spark.createDataFrame([(1, 80.0, 0.0), (2, 10.0, 179.99), (3, 37.0, -122.0)], "user_id long, lat double, lng double")
    stores = spark.createDataFrame([("a", 80.0, 0.4), ("b", 10.0, -179.98), ("c", 37.2, -122.0), ("d", 37.05, -122.0), ("d", 37.06, -122.0)], "brand string, lat double, lng double")
    got = {(r["user_id"], r["brand"]): round(r["distance_km"], 2) for r in ranking.stores_within(users, stores).collect()}
    assert got == {(1, "a"): 7.72, (2, "b"): 3.29, (3, "d"): 5.56}


def _offers(spark, n):
    rows = [(f"p{k:02}", "A", "food" if k % 2 else "tech", 90.0 - k) for k in range(n)]
    d = spark.createDataFrame(rows, "promotion_id string, brand string, category string, global_quality_score double")
    none = {c: F.lit(0.0) for c in ("economic_value_score", "expiration_urgency_score")}
    text = {"membership_cost": "", "promotion_title": "x", "discount_type": "free_item", "discount_value": "", "promotion_type": "sale", "deal_scope": "brand_level", "redemption_method": "in_store", "status": "active"}
    return d.withColumns({**none, **{k: F.lit(v) for k, v in text.items()}, "requires_membership": F.lit(False), "confidence_score": F.lit(0.9)})


def test_near_offers_meet_users_by_their_place_in_the_list(spark):
    """A user sees the first of a brand, and behind the acted ones the next; no user meets all offers of a brand."""
    users = spark.createDataFrame([(1, "B", "none"), (2, "B", "food"), (3, "B", "none")], "user_id long, favorite_brand string, favorite_category string")
    near = spark.createDataFrame([(1, "A", 1.0), (2, "A", 1.0), (3, "A", 1.0)], "user_id long, brand string, distance_km double")
    acts = spark.createDataFrame([(3, f"p{k:02}", 1, 0, False, k < 4, k >= 4) for k in range(6)] + [(3, "p20", 1, 1, False, False, False)], STATE)
    offers = _offers(spark, 30)
    met = ranking.near_candidates(users, offers, acts, near).groupBy("user_id").count().collect()
    assert {r["user_id"]: r["count"] for r in met} == {1: 3, 2: 5, 3: 11}
    feed = ranking.take_diverse(ranking.near_me(users, offers, acts, near))
    got = {}
    for r in sorted(feed.collect(), key=lambda r: r["place"]):
        got.setdefault(r["user_id"], []).append(r["promotion_id"])
    assert got == {1: ["p00", "p01"], 2: ["p01", "p03"], 3: ["p06", "p07"]}


def test_users_alike_are_fed_once(spark):
    users = spark.createDataFrame([(k, "A" if k < 50 else None, "food") for k in range(100)], "user_id long, favorite_brand string, favorite_category string")
    acts = spark.createDataFrame([(7, "p00", 1, 0, False, False, True)], STATE)
    fed = []

    def feed(some):
        fed.extend(r["user_id"] for r in some.select("user_id").collect())
        return some.select("user_id", F.coalesce("favorite_brand", F.lit("none")).alias("what"))

    got = {r["user_id"]: r["what"] for r in ranking.for_alike(users, acts, ["favorite_brand", "favorite_category"], feed).collect()}
    assert sorted(fed) == [0, 7, 50] and got == {k: "A" if k < 50 else "none" for k in range(100)}


def test_pushes_by_lists_of_what_users_like(spark):
    """Each user gets the best unsent candidate by bonuses; one without a brand counts by its category, as SQL has it."""
    at = F.expr("timestamp '2024-01-31 00:00:00'")
    users = spark.createDataFrame([(1, "A", "food"), (2, None, "tech"), (3, None, None), (4, "A", "food"), (5, None, None)], "user_id long, favorite_brand string, favorite_category string")
    offers = [("a1", "A", "food", 70.0), ("a2", "A", "food", 69.0), ("a3", "A", "tech", 88.0), ("b1", "B", "tech", 80.0), ("n1", None, "tech", 95.0), ("c1", "C", "books", 64.0), ("c2", "C", "books", 120.0), ("c3", "C", "books", 115.0)]
    candidates = spark.createDataFrame(offers, "promo_id string, brand string, category string, notify_score double")
    sent = spark.createDataFrame([(4, "a1"), (4, "a3"), (5, "c2"), (2, "c2"), (2, "c3")], "user_id long, promo_id string").withColumn("sent_at", at)
    none = spark.createDataFrame([], "user_id long, event_type string, brand string, category string, created_at timestamp")
    asked = spark.createDataFrame([], "user_id long, query string, created_at timestamp")
    got = {r["user_id"]: (r["promo_id"], r["score"], r["reason"]) for r in messages.push_selection(users, candidates, sent, none, asked, at).collect()}
    assert got == {1: ("a1", 125.0, "fav_brand"), 2: ("n1", 115.0, "fav_cat"), 3: ("c2", 120.0, "none"), 4: ("a2", 124.0, "fav_brand"), 5: ("c3", 115.0, "none")}


def test_features_meet_users_by_sorts_of_offers(spark):
    """All offers of a brand as if each pair were worked out alone, labels of the own offer left out; users meet sorts, not offers."""
    at = F.expr("timestamp '2024-01-31 00:00:00'")
    k = F.col("id")
    offers = spark.range(120).select(
        F.concat(F.lit("p"), k).alias("promotion_id"), F.when(k < 100, "A").when(k < 118, "B").alias("brand"), F.when(k % 2 == 0, "Food ").alias("category"), F.lit("sale").alias("promotion_type"), F.when(k % 4 < 2, "points").alias("discount_type"),
        (k % 2 == 0).alias("requires_membership"), (k * 1.0).alias("global_quality_score"), F.when(k % 4 == 0, F.concat(F.lit("BOGO "), k)).otherwise(F.concat(F.lit("Shoes "), k)).alias("promotion_title"), F.when(k % 4 == 2, "online_only").when(k % 4 == 1, F.lit(None)).otherwise("brand_level").alias("deal_scope"))
    rows = [(1, "p0", 1, 0), (1, "p4", 0, 1), (1, "p3", 1, 2), (1, "p101", 1, 3), (1, "p119", 1, 4), (2, "p110", 0, 5), (2, "p7", 1, 120)]
    labels = spark.createDataFrame(rows, "user_id long, promotion_id string, label int, days int").select("user_id", "promotion_id", "label", (at - F.make_dt_interval("days")).alias("at"))
    wanted = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (3, "B"), (3, "none")], "user_id long, brand string")
    users = spark.createDataFrame([(1, ["a"], ["food"], ["bogo"]), (2, [], None, ["nearby", "online"])], "user_id long, favorite_brands array<string>, favorite_categories array<string>, deal_priorities array<string>")
    members = spark.createDataFrame([(1, "a ", True), (3, "B", False)], "user_id long, brand string, is_member boolean")
    near = spark.createDataFrame([(2, "A", 1.5), (1, "B", 2.0)], "user_id long, brand string, distance_km double")
    pairs = wanted.join(offers, "brand").select("user_id", "promotion_id", "brand").union(labels.join(offers, "promotion_id").select("user_id", "promotion_id", "brand")).distinct().join(near, ["user_id", "brand"], "left").drop("brand")
    want = learning.preference_features(pairs, labels, offers, at, users, members)
    got = learning.brand_features(wanted, labels, offers, at, users, members, near)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) == 200 + 18 + 3
    assert learning._by_sort(offers)[1].groupBy("brand").count().where("count > 4").isEmpty()


def test_offers_of_one_sort_are_met_in_lists(spark):
    """Many offers alike are dealt to tasks as bounded lists, each pair is there once, and labels of an offer still are no evidence for it."""
    at = F.expr("timestamp '2024-01-31 00:00:00'")
    n = 3 * learning.LISTED + 1
    k = F.col("id")
    offers = spark.range(n).select(F.concat(F.lit("p"), k).alias("promotion_id"), F.lit("A").alias("brand"), F.lit("food").alias("category"), F.lit("sale").alias("promotion_type"), F.lit("points").alias("discount_type"), F.lit(False).alias("requires_membership"), (k % 100.0).alias("global_quality_score"))
    labels = spark.createDataFrame([(1, "p7", 1), (1, f"p{n - 1}", 0)], "user_id long, promotion_id string, label int").withColumn("at", at)
    wanted = spark.createDataFrame([(1, "A"), (2, "A")], "user_id long, brand string")
    got = learning.brand_features(wanted, labels, offers, at)
    want = learning.preference_features(wanted.join(offers, "brand").select("user_id", "promotion_id"), labels, offers, at)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) == 2 * n
    tasks = got.where("user_id = 2").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < n
