"""Quality reports by example."""

from pyspark.sql import functions as F

from tallyloom.operators import reports as rp

SCHEMA = "pos long, brand string, promotion_title string, status string, confidence_score double, global_quality_score double, redemption_method string, deal_scope string, promotion_type string, category string, end_date string, source_url string, fast_redemption struct<eligible: boolean, action_type: string, button_label: string>"


def at(day):
    return F.lit(f"2024-01-{day} 08:00:00").cast("timestamp")


def offer(pos, **kw):
    base = {"brand": "A", "promotion_title": "T", "status": "active", "confidence_score": 0.9, "global_quality_score": 50.0, "redemption_method": "online", "deal_scope": "brand_level", "promotion_type": "sale", "category": "food", "end_date": None, "source_url": "https://a.example.com", "fast_redemption": (True, "open_url", "Shop Now")}
    return (pos, *({**base, **kw}[c.strip().split(" ")[0]] for c in SCHEMA.split(",")[1:13]))


def report(spark, rows, day, path):
    d = rp.quality_report(spark.createDataFrame(rows, SCHEMA), at(day), path)
    return {(r["section"], r["name"]): (r["value"], r["previous"], r["delta"]) for r in d.collect()}


def test_runs_are_compared_and_repeat_alike(spark, tmp_path):
    path = str(tmp_path / "runs")
    many = [offer(k) for k in range(10)]
    first = report(spark, many, 10, path)
    assert first["counts", "visible"] == (10.0, None, None) and ("warnings", "visible_dropped") not in first
    few = [offer(k, confidence_score=0.7, end_date="2024-01-01") for k in range(6)] + [offer(9, status="expired")]
    second = report(spark, few, 11, path)
    assert second["counts", "visible"] == (6.0, 10.0, -4.0) and second["counts", "avg_confidence"] == (0.7, 0.9, -0.2)
    assert second["warnings", "visible_dropped"] == (6.0, 10.0, -4.0)
    assert second["warnings", "expired_visible"][0] == 6 and second["warnings", "unsure_at_top"][0] == 6
    assert second["counts", "expired_hidden"][0] == 1
    assert report(spark, few, 11, path) == second  # started again
    assert report(spark, many[:7], 12, path)["counts", "visible"] == (7.0, 6.0, 1.0)
    seven = report(spark, many[:7], 10, path)  # an earlier run again: nothing before it
    assert seven["counts", "visible"] == (7.0, None, None)
    assert report(spark, many[:5], 11, path)["counts", "visible"] == (5.0, 7.0, -2.0)
    assert ("warnings", "visible_dropped") not in report(spark, many[:5], 11, path)  # 5 of 7 is over 70 %


def test_nulls_bands_and_days(spark, tmp_path):
    rows = [
        offer(1, confidence_score=None), offer(2, status=None), offer(3, confidence_score=0.65, end_date="2024-01-10", brand=" "), offer(4, confidence_score=0.8, end_date="2024-01-13T23:00:00", promotion_title=None),
        offer(5, confidence_score=0.899, end_date="2024-01-14", source_url="", fast_redemption=None), offer(6, end_date="soon", global_quality_score=None, category="travel", redemption_method=None),
    ]
    got = {k[1]: v[0] for k, v in report(spark, rows, 10, str(tmp_path / "a")).items() if k[0] == "counts"}
    want = {"visible": 4, "confidence_90": 1, "confidence_80": 2, "confidence_65": 1, "confidence_dropped": 1, "expires_today": 1, "expires_in_3_days": 1, "no_expiry": 1, "missing_brand": 1, "missing_title": 1, "missing_source_url": 1, "no_fast_redeem": 1, "scored": 3, "online": 3, "near_me": 0}
    assert {k: got[k] for k in want} == want
    empty = report(spark, rows[:0], 10, str(tmp_path / "b"))
    assert set(v[0] for v in empty.values()) == {0.0} and not [k for k in empty if k[0] == "warnings"]


def test_surfaces_and_ties(spark):
    rows = [offer(k, global_quality_score=None if k == 0 else float(k // 3), redemption_method="in_store" if k % 2 else "online") for k in range(40)]
    rows += [offer(90, redemption_method="in_app", deal_scope="online_only", global_quality_score=99.0, fast_redemption=(False, None, "")), offer(91, promotion_type="reward", global_quality_score=98.0), offer(92, category="finance", redemption_method="in_store", global_quality_score=99.0)]
    top = rp.top_offers(spark.createDataFrame(rows, SCHEMA)).orderBy("surface", "place").collect()
    online, near = ([r["pos"] for r in top if r["surface"] == s] for s in ("online", "near_me"))
    assert online == [90, *sorted((k for k in range(40) if k % 2 == 0), key=lambda k: (-(k // 3), k))[:9]]
    assert near == [91, *sorted((k for k in range(40) if k % 2), key=lambda k: (-(k // 3), k))[:9]]
    assert [r["action"] for r in top if r["pos"] in (90, 91)] == ["Shop Now", "—"]
    shown = {r["action_type"]: r["n"] for r in rp.redemption_distribution(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert shown == {"open_url": 42, "not_supported": 1}
