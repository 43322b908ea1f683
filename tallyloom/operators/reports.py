"""A catalog's quality report: what users see, what is wrong with it, and what has changed since the run before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import any_date
from tallyloom.sources.files import read_snapshot, write_snapshot

C = F.col
# What is shown to users, and the bounds of the report.
VISIBLE, LEAST_CONFIDENCE = ("active", "probably_active", "online_only"), 0.65
NOT_NEAR = ("travel", "finance")
SURE, TOP, TOP_SURE = 0.75, 10, 20
#: The share of the visible offers of the run before below which there is a warning.
LEAST_KEPT = 0.70
#: The metrics that are compared with the run before.
COMPARED = ["visible", "near_me", "online", "fast_redeem_eligible", "avg_confidence"]


def _confidence() -> Column:
    return F.coalesce("confidence_score", F.lit(0.0))


def visible() -> Column:
    """Whether users see an offer: its status, and confidence of 0.65 or more."""
    return F.coalesce(C("status").isin(*VISIBLE), F.lit(False)) & (_confidence() >= LEAST_CONFIDENCE)


def is_online() -> Column:
    """Whether an offer is redeemed online: by its method, or by a code or app where it is online only; never a program's."""
    method, scope, kind = (F.coalesce(c, F.lit("")) for c in ("redemption_method", "deal_scope", "promotion_type"))
    return ~kind.isin("reward", "membership_benefit") & ((method == "online") | ((scope == "online_only") & method.isin("show_code", "in_app")))


def is_near_me() -> Column:
    return ~is_online() & ~F.coalesce("category", F.lit("")).isin(*NOT_NEAR)


def top_offers(offers: DataFrame, n: int = TOP) -> DataFrame:
    """The n visible offers of the greatest quality of each surface (near_me, online), equals by pos: surface, place and what is
    told of them. No score counts as 0. Each surface is a top-n of its own, so no group of offers meets in one task."""
    score = F.coalesce("global_quality_score", F.lit(0.0))
    action = F.coalesce(F.nullif(C("fast_redemption.button_label"), F.lit("")), C("fast_redemption.action_type"), F.lit("—"))
    row = F.struct((-score).alias("k"), "pos", F.coalesce("brand", F.lit("?")).alias("brand"), F.substring(F.coalesce("promotion_title", F.lit("")), 1, 48).alias("title"), score.alias("score"), _confidence().alias("confidence"), action.alias("action"))
    seen = offers.where(visible())
    parts = []
    for surface, where in (("near_me", is_near_me()), ("online", is_online())):
        best = seen.where(where).select(row.alias("o")).orderBy("o.k", "o.pos").limit(n)
        ranked = best.agg(F.sort_array(F.collect_list("o")).alias("all")).select(F.posexplode("all").alias("place", "o"))
        parts.append(ranked.select(F.lit(surface).alias("surface"), (C("place") + 1).alias("place"), "o.pos", "o.brand", "o.title", "o.score", "o.confidence", "o.action"))
    return parts[0].unionByName(parts[1])


def redemption_distribution(offers: DataFrame) -> DataFrame:
    """How many visible offers have each quick action; not_supported for those that have none."""
    fits = F.coalesce("fast_redemption.eligible", F.lit(False))
    action = F.when(fits, F.coalesce("fast_redemption.action_type", F.lit("unknown"))).otherwise("not_supported")
    return offers.where(visible()).groupBy(action.alias("action_type")).agg(F.count("*").alias("n"))


def quality_metrics(offers: DataFrame, as_of: Column) -> DataFrame:
    """One row of all counts of a catalog, in one pass over it; an empty catalog gives zeros."""
    seen, sure = visible(), _confidence()
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    fits = F.coalesce("fast_redemption.eligible", F.lit(False))
    end, today = any_date(F.substring(C("end_date").cast("string"), 1, 10)), F.to_date(as_of)
    d = offers.withColumns({"_end": end, "_seen": seen})
    seen, left = C("_seen"), F.date_diff("_end", today)
    count = {
        "visible": seen, "near_me": seen & is_near_me(), "online": seen & is_online(), "fast_redeem_eligible": seen & fits, "no_fast_redeem": seen & ~fits,
        "scored": seen & C("global_quality_score").isNotNull(), "missing_title": seen & empty("promotion_title"), "missing_source_url": seen & empty("source_url"), "missing_brand": seen & empty("brand"),
        "expired_visible": seen & (left < 0), "confidence_90": seen & (sure >= 0.90), "confidence_80": seen & (sure >= 0.80) & (sure < 0.90), "confidence_65": seen & (sure < 0.80), "confidence_dropped": sure < LEAST_CONFIDENCE,
        "active": seen & (C("status") == "active"), "probably_active": seen & (C("status") == "probably_active"), "online_only": seen & (C("status") == "online_only"),
        "expires_today": seen & (left == 0), "expires_in_3_days": seen & left.between(1, 3), "no_expiry": seen & C("_end").isNull(), "expired_hidden": C("status") == "expired", "needs_review_hidden": C("status") == "needs_review",
    }
    mean = F.coalesce(F.round(F.sum(F.when(seen, sure)) / F.nullif(F.count_if(seen), F.lit(0)), 3), F.lit(0.0))
    return d.agg(*(F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in count.items()), mean.alias("avg_confidence"))


def unsure_at_top(offers: DataFrame, n: int = TOP_SURE) -> DataFrame:
    """How many of the n visible offers of the greatest quality have a confidence below 0.75."""
    best = offers.where(visible()).orderBy(F.desc(F.coalesce("global_quality_score", F.lit(0.0))), "pos").limit(n)
    return best.agg(F.count_if(_confidence() < SURE).alias("unsure_at_top"))


def quality_report(offers: DataFrame, as_of: Column, path: str) -> DataFrame:
    """The report of this run, as rows of section, name and value, with what the run before had and the change.

    The metrics of each run are kept as a table that write_snapshot() switches under path; the run before is the latest one that
    is earlier than as_of. A run that is repeated, or starts again after it died, replaces its own row and reports the same.
    Sections: counts (all metrics; those of COMPARED with previous and delta) and warnings (only those that hold)."""
    spark = offers.sparkSession
    now = quality_metrics(offers, as_of).select(as_of.cast("timestamp").alias("run_at"), "*", unsure_at_top(offers).scalar().alias("unsure_at_top"))
    kept = read_snapshot(spark, path)
    runs = now if kept is None else kept.where(C("run_at") != as_of).unionByName(now)
    write_snapshot(runs.coalesce(1), path)
    runs = read_snapshot(spark, path)
    last = runs.where(C("run_at") < as_of).orderBy(F.desc("run_at")).limit(1)
    names = [c for c in runs.columns if c != "run_at"]
    before = last.select(F.stack(F.lit(len(COMPARED)), *(x for c in COMPARED for x in (F.lit(c), C(c).cast("double")))).alias("name", "previous"))
    rows = runs.where(C("run_at") == as_of).select(F.stack(F.lit(len(names)), *(x for c in names for x in (F.lit(c), C(c).cast("double")))).alias("name", "value"))
    counts = rows.join(before, "name", "left").select(F.lit("counts").alias("section"), "name", "value", "previous", F.round(C("value") - C("previous"), 3).alias("delta"))
    wrong = (C("name").isin("expired_visible", "missing_source_url", "no_fast_redeem", "unsure_at_top") & (C("value") > 0)) | ((C("name") == "visible") & (C("previous") > 0) & (C("value") < C("previous") * LEAST_KEPT))
    warned = counts.where(wrong).withColumns({"section": F.lit("warnings"), "name": F.when(C("name") == "visible", "visible_dropped").otherwise(C("name"))})
    return counts.unionByName(warned)
