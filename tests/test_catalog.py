"""The catalog works out and stores what a query reads, and what it is read for needs one reading."""

import re

from pyspark.sql import functions as F

from tallyloom.operators import ranking, scoring
from tallyloom.plans import outreach
from tallyloom.plans import ranking as plans

SF = "/root/testdata/sf0.001"


def test_catalog_of_some_columns(spark):
    whole, some = plans.catalog(spark, SF), plans.catalog(spark, SF, "brand", "global_quality_score")
    assert some.columns == ["pos", "brand", "global_quality_score", "promotion_id"]
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(*some.columns).collect()))


def test_online_surface_stores_no_scores(spark):
    assert "global_quality_score" not in outreach._surfaces(spark, SF).columns


def test_audit_reads_once_and_counts_none(spark):
    d = spark.createDataFrame([(["a", "b"], False), (["a"], False), ([], True)], "reliability_reasons array<string>, reliable boolean")
    audit = ranking.reliability_audit(d)
    assert {r["what"]: r["n"] for r in audit.collect()} == {"a": 2, "b": 1, "total": 3, "eligible": 1}
    assert {r["what"]: r["n"] for r in ranking.reliability_audit(d.where("false")).collect()} == {"total": 0, "eligible": 0}
    once = ranking.reliability_audit(spark.read.parquet(f"{SF}/part.parquet").select(F.array("p_brand").alias("reliability_reasons"), F.lit(False).alias("reliable")))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_hints_as_each_pattern_says(spark):
    words = "fries chip SIDE coffee teas latte frappe smoothie frappuccino soda bagels brownies burger Big  big mac sub tacos entrée entree pizza ice cream scoop lip gloss mascara foundation face cream hoodie coats jeans dress tops boots totes card holder bag"
    titles = [*words.split(), "big mac", "ice  cream", "lip gloss", "a face cream", "Free-side", "insides", "xtee", "teepee", "25% off large ring", "", None, "Top 5 bags", "éside", "entrées"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "k int, promotion_title string")
    got = {r["k"]: r["h"] for r in rows.select("k", scoring._hint().alias("h")).collect()}
    first = lambda t: next((v for p, v in scoring.TITLE_HINTS if re.search(f"(?i){p}", t or "")), None)
    assert got == {k: first(t) for k, t in enumerate(titles)}
