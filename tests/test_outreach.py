"""Membership, store, evidence and notification rules on small tables with results written by hand."""

from pyspark.sql import functions as F

from tallyloom.operators import captures, catalog, messages, ranking

NOON = "timestamp '2024-01-31 12:00:00'"


def times(df, *columns):
    return df.withColumns({c: F.to_timestamp(c) for c in columns})


def test_gender_and_signals(spark):
    rows = [(1, ["Women's tops"], None), (2, None, "for men/women"), (3, [], "Baby"), (4, ["kids"], "him"), (5, None, None), (6, [""], "mentions women. only")]
    d = spark.createDataFrame(rows, "id int, lines array<string>, text string")
    got = {r.id: r.g for r in d.select("id", captures.detect_gender(F.col("lines"), F.col("text")).alias("g")).collect()}
    assert got == {1: "women", 2: "unisex", 3: "kids", 4: "men", 5: None, 6: None}
    texts = spark.createDataFrame([("SALE today, 10% OFF",), ("sale",), (None,), ("x" * 100_000 + " free coupon",)], "t string")
    assert [r.s for r in texts.select(captures.has_deal_signals(F.col("t")).alias("s")).collect()] == [True, False, False, True]


def test_memberships_leave_out_fillers(spark):
    mails = times(spark.createDataFrame([("A", "Hi:", "Harbor Club. Blue Sky Circle! Harbor Club.", "2024-01-02"), ("C", "Meet Elm Club", "Oak Perks", "2024-01-02"), ("B", None, None, "2024-01-03")], "brand string, subject string, body string, sent_at string"), "sent_at")
    stated = [("A", True, "A Rewards"), ("A", True, "n/a or so"), ("A", False, "Silver Tier"), ("A", True, "Gold Tier"), ("A", True, None), (None, True, "Iron Tier")]
    offers = spark.createDataFrame(stated, "brand string, requires_membership boolean, membership_name string").withColumn("email_date", F.lit("2024-01-01").cast("timestamp"))
    known = times(spark.createDataFrame([("Z", "Gold Tier", "2024-01-01")], "brand string, program string, last_seen string"), "last_seen")
    got = {(r.program, r.brand) for r in messages.detect_memberships(mails, offers, known).collect()}
    assert got == {("Harbor Club", "A"), ("Blue Sky Circle", "A"), ("Meet Elm Club\nOak Perks", "C"), ("Gold Tier", "Z"), ("Iron Tier", None)}


def test_open_stores_need_their_tags(spark):
    schema = "id int, kind string, lat double, lng double, center_lat double, center_lng double, tags map<string,string>"
    rows = [
        (1, "node", 40.0, -100.0, None, None, {"name": "Acme"}),
        (2, "way", None, None, 40.0, -100.0, {"name": "acme", "shop": "yes"}),
        (3, "node", 40.0, -100.0, None, None, {"name": "Acme", "was:shop": "yes"}),
        (4, "node", 60.0, -100.0, None, None, {"name": "Acme"}),
        (5, "node", 40.0, -100.0, None, None, {"name": "Acme", "lifecycle": "razed"}),
        (6, "node", None, None, 40.0, -100.0, {"name": "Acme"}),
        (7, "node", 40.0, -100.0, None, None, None),
    ]
    aliases = spark.createDataFrame([("A", "Acme", None, False, None), ("B", None, "ac.e", True, {"shop": "yes"})], "brand string, name string, pattern string, ignore_case boolean, extra map<string,string>")
    stores = ranking.open_stores(spark.createDataFrame(rows, schema), aliases)
    assert sorted((r.brand, r.id) for r in stores.collect()) == [("A", 1), ("B", 2)]
    assert ranking.open_stores(spark.createDataFrame([], schema), aliases).count() == 0


def test_evidence_takes_failures_and_newer_proof(spark):
    new = times(spark.createDataFrame([(i, f"o{i}", "u", f"h{i}", s, "2024-01-10") for i, s in ((1, "supported"), (2, "supported"), (3, "unverified"), (4, "supported"))], "id int, offer string, source_url string, content_hash string, status string, checked_at string"), "checked_at")
    old = [("x", "u", "h1", "unverified", "2024-01-01", "2024-01-10"), ("o2", "u", "h2", "supported", "2024-01-20", None), ("o3", "u", "h3", "supported", "2024-01-20", None), ("o4", "u", "h4", "supported", "2024-02-20", "2024-01-09")]
    old = times(spark.createDataFrame(old, "offer string, source_url string, content_hash string, status string, checked_at string, check_failed_at string"), "checked_at", "check_failed_at")
    got = {r.id: (r.status, str(r.checked_at)[:10], r.needs_review) for r in catalog.carry_forward_evidence(new, old, F.expr(NOON)).collect()}
    assert got == {1: ("unverified", "2024-01-10", True), 2: ("supported", "2024-01-20", False), 3: ("unverified", "2024-01-10", True), 4: ("supported", "2024-01-10", False)}


def test_policy_limits(spark):
    users = spark.createDataFrame([(u, "A", "food") for u in range(1, 7)], "user_id int, favorite_brand string, favorite_category string")
    offers = spark.createDataFrame([("p1", "A", "food", 70.0), ("p2", "B", "food", 75.0), ("p3", "A", "food", 59.0), ("p4", "C", "tech", 100.0)], "promo_id string, brand string, category string, notify_score double")
    history = [(2, "A", "2024-01-25 23:00:00"), (3, "C", "2024-01-31 09:00:00"), (4, "C", "2024-01-31 01:00:00"), (4, "D", "2024-01-31 02:00:00"), (6, "A", "2024-01-24 10:00:00")]
    history = times(spark.createDataFrame(history, "user_id int, brand string, sent_at string"), "sent_at")
    events = spark.createDataFrame([], "user_id int, brand string, event_type string")
    feedback = times(spark.createDataFrame([(5, "A", "x", "2024-01-01", False), (5, "A", "x", "2024-01-02", True)], "user_id int, brand string, category string, created_at string, interested boolean"), "created_at")
    run = lambda at: {(r.user_id, r.promo_id, r.score) for r in messages.notification_policy(users, offers, history, events, feedback, at).collect()}
    assert run(F.expr(NOON)) == {(1, "p1", 135.0), (2, "p2", 100.0), (5, "p2", 100.0), (6, "p1", 135.0)}
    assert run(F.expr("timestamp '2024-01-31 22:00:00'")) == set() == run(F.expr("timestamp '2024-01-31 07:59:00'"))


def test_surfaces(spark):
    schema = "pos int, status string, promotion_type string, discount_type string, discount_value string, redemption_method string, deal_scope string, valid_days array<string>, confidence_score double, category string, membership_cost string, requires_membership boolean, global_quality_score double, member boolean"
    rows = [
        (1, "active", "sale", "percentage_off", "50% off", "online", None, ["Wednesday"], 0.8, "food", None, False, 50.0, False),
        (2, "active", "sale", "amount_off", "$500", "show_code", "online_only", None, 1.0, "food", None, False, 50.0, False),
        (3, "active", "sale", "amount_off", None, "online", None, ["tue"], 1.0, "food", None, False, 50.0, False),
        (4, "active", "reward", None, None, "online", None, ["tue"], 0.8, "food", "Paid yearly", True, 80.0, False),
        (5, "expired", "reward", "free_item", None, None, None, [], None, None, None, True, None, True),
        (6, "active", "reward", None, None, None, None, None, 0.8, "finance", None, False, 99.0, True),
    ]
    d = spark.createDataFrame(rows, schema)
    assert {r.pos: round(r.score, 6) for r in ranking.online_feed(d, F.expr(NOON)).collect()} == {1: 56.0, 2: 80.0}
    assert {r.pos: (r.score, r.quality) for r in ranking.rewards_feed(d, F.expr(NOON)).collect()} == {4: (45.0, False), 5: (25.0, True)}
    assert ranking.online_feed(d.limit(0), F.expr(NOON)).count() == 0
