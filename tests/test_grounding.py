"""Offers and the passages that do or don't support them."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyloom.operators import grounding as op
from tallyloom.sources import files

AT = "2026-10-09T12:00:00+00:00"
URL, DOMAIN = "https://example.com/offers", "example.com"
OFFER = {
    "brand": "Example", "promotion_title": "20% off running shoes", "discount_type": "percentage_off", "discount_value": "20%", "promotion_type": "coupon", "promo_code": "RUN20",
    "minimum_spend": None, "end_date": None, "start_date": None, "terms_text": None, "membership_name": None, "requires_membership": False, "requires_app": False,
    "purchase_required": False, "new_user_only": False, "synthesized": False, "redemption_method": "online", "redemption_steps": ["Enter RUN20 at checkout."],
}
GOOD = "Save 20% off running shoes. Use code RUN20."
TERMS = "Save 20% off running shoes on orders over $100. Use RUN20. Ends October 10, 2026."
PAGES = "=== https://example.com/ ===\nHome\n=== https://example.com/shoes ===\nSave 20% off running shoes. Use RUN20."
#: name -> (text, changes of the offer, status, what is told of it)
CASES = {
    "plain": (GOOD, {}, "supported", GOOD),
    "other number": ("Save 120% off running shoes. Use code RUN20.", {}, "unverified", None),
    "price, not a cut": ("Running shoes $20. Use code RUN20.", {}, "unverified", None),
    "other goods": ("Save 20% off jackets. Use code RUN20.", {}, "unverified", None),
    "other code": ("Save 20% off running shoes. Use code OTHER20.", {}, "unverified", None),
    "up to": ("Up to 20% off running shoes. Use code RUN20.", {}, "unverified", None),
    "new customers": ("Save 20% off running shoes for new customers only. Use code RUN20.", {}, "unverified", None),
    "members": ("Save 20% off running shoes for rewards members. Use code RUN20.", {}, "unverified", None),
    "minimum left out": ("Save 20% off running shoes on orders over $100. Use code RUN20.", {}, "unverified", None),
    "minimum and date": (TERMS, {"minimum_spend": "$100", "end_date": "2026-10-10"}, "supported", TERMS),
    "other minimum": (TERMS, {"minimum_spend": "$150"}, "unverified", None),
    "other year": (TERMS, {"minimum_spend": "$100", "end_date": "2027-10-10"}, "unverified", None),
    "no date": (TERMS, {"minimum_spend": "$100", "end_date": "soon"}, "unverified", None),
    "far apart": ("Save 20% off running shoes.\n" + "Regular items\n" * 6 + "Code RUN20.", {}, "unverified", None),
    "within four lines": ("x\nSave 20% off running shoes.\nRegular\nitems\nCode RUN20.\nmore", {}, "supported", "Save 20% off running shoes.\nRegular\nitems\nCode RUN20."),
    "regular price": ("Running shoes $100. Save $20 off. Use RUN20.", {"discount_type": "amount_off", "discount_value": "$100"}, "unverified", None),
    "cents": ("Take $20.00 off running shoes with RUN20", {"discount_type": "amount_off", "discount_value": "$20"}, "supported", "Take $20.00 off running shoes with RUN20"),
    "selected": ("Save 20% off selected running shoes. Use RUN20.", {}, "unverified", None),
    "selected and said": ("Save 20% off selected running shoes. Use RUN20.", {"terms_text": "Selected running shoes only."}, "supported", "Save 20% off selected running shoes. Use RUN20."),
    "two pages": ("=== https://example.com/shoes ===\nSave 20% off running shoes.\n=== https://example.com/jackets ===\nCode RUN20.", {}, "unverified", None),
    "second page": (PAGES, {}, "supported", "Save 20% off running shoes. Use RUN20."),
    "foreign page": (PAGES.replace("example.com/shoes", "evil.test/shoes"), {}, "unverified", None),
    "synthesized": (GOOD, {"synthesized": True}, "unverified", ["synthesized_offer_needs_review"]),
    "no steps": (GOOD, {"redemption_steps": []}, "unverified", ["missing_redemption_steps"]),
    "no code": (GOOD, {"promo_code": None}, "unverified", ["missing_promo_code"]),
    "no name": (GOOD, {"requires_membership": True}, "unverified", ["missing_membership_name"]),
    "no text": ("  \n", {}, "unverified", ["source_text_missing"]),
    "free shipping": ("FREE  Standard\tShipping on running shoes, code run20", {"discount_type": "free_shipping", "discount_value": None}, "supported", "FREE  Standard\tShipping on running shoes, code run20"),
    "free": ("A complimentary pair of running shoes: RUN20", {"discount_type": "free_item", "discount_value": None}, "supported", "A complimentary pair of running shoes: RUN20"),
    "other value": ("Triple points on running shoes: RUN20", {"discount_type": "points", "discount_value": "Triple Points"}, "supported", "Triple points on running shoes: RUN20"),
    "no value": (GOOD, {"discount_type": "points", "discount_value": ""}, "unverified", ["offer_not_grounded_in_captured_text"]),
    "odd code": (GOOD + r" \E(20", {"promo_code": r"\E(20"}, "supported", GOOD + r" \E(20"),
}


@pytest.fixture(scope="module")
def grounded(spark):
    kind = ", ".join(f"{c} {'array<string>' if c == 'redemption_steps' else 'boolean' if isinstance(v, bool) else 'string'}" for c, v in OFFER.items())
    rows = [(k, name, *(OFFER | change).values()) for k, (name, (_, change, _, _)) in enumerate(CASES.items())]
    offers = spark.createDataFrame(rows, f"pos int, source string, {kind}")
    texts = spark.createDataFrame([(n, t, URL, AT, DOMAIN) for n, (t, *_) in CASES.items()], "source string, text string, source_url string, checked_at string, trusted_domain string")
    return op.build_source_evidence(offers, texts)


@pytest.fixture(scope="module")
def told(grounded):
    return {r["source"]: r["source_evidence"] for r in grounded.collect()}


@pytest.mark.parametrize("name", CASES)
def test_cases(told, name):
    _, _, status, more = CASES[name]
    e = told[name]
    assert e["status"] == status, e
    if status == "supported":
        assert e["excerpt"] == more and e["reasons"] == []
        assert e["source_url"] == ("https://example.com/shoes" if name == "second page" else URL)
    elif more:
        assert e["reasons"] == more and e["excerpt"] is None


def test_snapshot_and_hash(told):
    import hashlib

    e = told["plain"]
    assert (e["schema_version"], e["validator"], e["checked_at"], e["content_hash"]) == (1, "captured_text_v1", AT, hashlib.sha256(GOOD.encode()).hexdigest())
    assert len(e["offer"]) == 22 and e["offer"]["promo_code"] == "RUN20" and e["offer"]["timezone"] == "America/New_York" and e["offer"]["valid_days"] == []


def test_sources_without_text_dates_and_many_offers_of_one_source(spark):
    """A source with more offers than a block, a long excerpt, and what is wrong with captures."""
    base = spark.createDataFrame([Row(**OFFER)], ", ".join(f"{c} {'array<string>' if c == 'redemption_steps' else 'boolean' if isinstance(v, bool) else 'string'}" for c, v in OFFER.items()))
    many = base.crossJoin(spark.range(300).select(F.col("id").cast("int").alias("pos"))).withColumn("source", F.when(F.col("pos") < 290, "hot").otherwise(F.concat(F.lit("s"), F.col("pos") % 5)))
    text = GOOD + " word" * 300
    texts = [("hot", text, URL, AT, DOMAIN), ("s0", GOOD, URL, "2026-10-09T12:00:00", DOMAIN), ("s1", GOOD, URL, "never", DOMAIN), ("s2", GOOD, "https://evil.test/", None, DOMAIN), ("s3", None, URL, AT, DOMAIN)]
    got = {r["pos"]: r["source_evidence"] for r in op.build_source_evidence(many, spark.createDataFrame(texts, "source string, text string, source_url string, checked_at string, trusted_domain string")).collect()}
    assert len(got) == 300 and all(got[k]["status"] == "supported" and got[k]["excerpt"] == text[:700] for k in range(290))
    assert [got[290 + k]["reasons"] for k in range(5)] == [["capture_timezone_missing"], ["capture_date_missing"], ["untrusted_source_url", "capture_date_missing"], ["source_text_missing"], ["untrusted_source_url", "capture_date_missing", "source_text_missing"]]


def _evidence(e, **changes):
    return e.asDict() | changes


def test_outcomes_refresh_quarantine_and_are_idempotent(spark, grounded, told, tmp_path):
    later, e = "2026-10-20T12:00:00+00:00", told["plain"]
    rows = [(1, "Same", e.asDict()), (2, "Same", _evidence(e, content_hash="other")), (3, "Same", _evidence(e, status="unverified", reasons=["source_fetch_failed"], check_failed_at=AT)), (4, "Same", _evidence(e, source_url="https://evil.test/")), (5, "Failed", e.asDict()), (6, "Failed", _evidence(e, status="unverified")), (7, "New", e.asDict()), (8, "Same", None)]
    schema = grounded.schema["source_evidence"].dataType.simpleString()
    catalog = spark.createDataFrame([(k, b, "example.com", "active", AT, x) for k, b, x in rows], f"pos int, brand string, website_domain string, status string, last_confirmed string, source_evidence {schema}")
    outcomes = spark.createDataFrame([("Same", "failed", None, None, AT), ("Same", "skipped_duplicate_hash", e["content_hash"], [URL], later), ("Failed", "failed", None, None, later), ("New", "success", "h", [URL], later)], "brand string, outcome string, content_hash string, captured_urls array<string>, at string")
    once = op.apply_capture_outcome(catalog, outcomes)
    got = {r["pos"]: r for r in once.collect()}
    assert {k for k, r in got.items() if r["last_confirmed"] == later} == {1, 3}
    assert all(got[k]["source_evidence"]["status"] == "supported" and got[k]["source_evidence"]["checked_at"] == later and got[k]["source_evidence"]["check_failed_at"] is None for k in (1, 3))
    assert got[5]["status"] == "needs_review" and got[5]["source_evidence"]["reasons"] == ["source_fetch_failed"] and got[5]["source_evidence"]["checked_at"] == AT and got[5]["source_evidence"]["check_failed_at"] == later
    assert all(got[k]["status"] == "active" for k in (2, 4, 6, 7, 8)) and got[8]["source_evidence"] is None
    # The stored catalog: each run writes a snapshot of its own and then switches to it; a run that dies changes nothing.
    path = str(tmp_path / "catalog")
    assert files.read_snapshot(spark, path) is None
    files.write_snapshot(catalog, path)
    for _ in range(2):
        files.write_snapshot(op.apply_capture_outcome(files.read_snapshot(spark, path), outcomes), path)
        assert sorted(files.read_snapshot(spark, path).collect(), key=lambda r: r["pos"]) == [got[k] for k in sorted(got)]
    broken = catalog.withColumn("status", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        files.write_snapshot(broken, path)
    assert files.read_snapshot(spark, path).count() == 8


def _every_passage(text, url):
    """Passages as they are defined: four lines from each line that is no header, up to a header, normalised as a whole."""
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if op._head(line):
            url = op._head(line)
        elif line.strip():
            end = next((k for k in range(i + 1, min(i + 4, len(lines))) if lines[k].startswith("=== ") or op._head(lines[k])), i + 4)
            excerpt = "\n".join(lines[i:end]).strip()[:700]
            said = " ".join(excerpt.casefold().split())
            yield i, url, excerpt, said, op._named(said)


def test_lines_are_searched_once(monkeypatch):
    """The same passages as from each one's whole text, with amounts over lines' ends, cut excerpts and blank lines."""
    bits = ["Save 20", "% off", "  ", "Take $", "15.00 off", "FREE", "Standard", "shipping for all", "a complimentary ẞTRASSE", "=== https://a.example/x ===", "=== no page", "x" * 340 + " 30% $12", "$5 " + "y" * 330, "plain words", "free\u2028delivery", "20.00%", "z" * 695 + " $155"]
    text = "\n".join(bits[(k * k + k // 5) % len(bits)] for k in range(600))
    want = list(_every_passage(text, "u"))
    assert list(op._passages(text, "u", set(), True)) == want
    wanted = {"20%", "$15", "free_shipping"}
    got = list(op._passages(text, "u", wanted, False))
    assert all(p in want for p in got) and [p for p in got if p[4] & wanted] == [p for p in want if p[4] & wanted]
    searched = []
    monkeypatch.setattr(op, "_named", lambda said, named=op._named: searched.append(said) or named(said))
    list(op._passages("Save 20% off\n" * 400, "u", wanted, False))
    assert len(searched) == 400


def test_passages_without_an_offers_words_stay_in_python():
    """Pairs that cannot be supported for lack of the title's words are not made; the others leave with their offer's others."""
    import pyarrow as pa

    offers = [{"key": "20%", "value": "20%", "title": "20% off running shoes", "anchors": ["running", "shoes"]}, {"key": "20%", "value": "20%", "title": "hats", "anchors": ["hats"]}]
    batch = pa.RecordBatch.from_pylist([{"text": "20% on shoes\n\n=== x\n20% on running shoes\n=== x\n20% on hats and running shoes", "source_url": "u", "trusted_domain": "d", "offers": offers}])
    got = [(r["o"]["title"], r["line"]) for b in op._meet(iter([batch])) for r in b.to_pylist()]
    assert got == [*((offers[0]["title"], k) for k in (2, 3, 4, 5)), ("hats", 4), ("hats", 5)]


class _Read:
    """Rows of texts that count how often each is read."""

    def __init__(self, spark, rows, schema):
        self.seen = spark.sparkContext.accumulator(0)
        frame, seen = spark.createDataFrame(rows, schema), self.seen

        def read(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        self.frame = frame.mapInArrow(read, frame.schema)


def test_outcomes_read_texts_once(spark):
    """Hashes, reasons and passages come from one reading of the texts, and what is told of a source is there for outcomes too."""
    texts = _Read(spark, [(n, GOOD, URL, AT, DOMAIN) for n in "abc"], "source string, text string, source_url string, checked_at string, trusted_domain string")
    kind = ", ".join(f"{c} {'array<string>' if c == 'redemption_steps' else 'boolean' if isinstance(v, bool) else 'string'}" for c, v in OFFER.items())
    offers = spark.createDataFrame([(k, n, *OFFER.values()) for k, n in enumerate("aabx")], f"pos int, source string, {kind}")
    told = facts, _ = op.grounds(offers, texts.frame)
    catalog = op.build_source_evidence(offers, texts.frame, told=told).select("pos", F.col("source").alias("brand"), F.lit(DOMAIN).alias("website_domain"), F.lit("active").alias("status"), F.lit(AT).alias("last_confirmed"), "source_evidence")
    outcomes = facts.select(F.col("source").alias("brand"), F.lit("failed").alias("outcome"), "content_hash", F.array("source_url").alias("captured_urls"), F.lit("2026-10-20T12:00:00+00:00").alias("at"))
    got = {r["pos"]: (r["status"], r["source_evidence"]["status"]) for r in op.apply_capture_outcome(catalog, outcomes).collect()}
    assert got == {0: ("needs_review", "unverified"), 1: ("needs_review", "unverified"), 2: ("needs_review", "unverified"), 3: ("active", "unverified")}
    assert texts.seen.value == 3 and sorted(r["source"] for r in facts.collect()) == ["a", "b", "c"]


def test_passages_without_what_an_offer_needs_stay_in_python():
    """Codes, years of dates and minimums are looked for before pairs are made."""
    import pyarrow as pa

    base = {"key": "20%", "value": "20%", "title": "shoes", "anchors": ["shoes"], "needs": [], "minimum": None, "minimum_key": None, "not_up_to": False}
    offers = [base | {"needs": ["run20"]}, base | {"needs": ["2026"]}, base | {"minimum": "$100", "minimum_key": "$100"}, base | {"not_up_to": True}]
    text = "20% on shoes\n=== x\nrun20: 20% on shoes\n=== x\n20% on shoes until 2026\n=== x\nup to 20% on shoes from $100"
    batch = pa.RecordBatch.from_pylist([{"text": text, "source_url": "u", "trusted_domain": "d", "offers": offers}])
    got = [(offers.index({c: r["o"][c] for c in base}), r["line"]) for b in op._meet(iter([batch])) for r in b.to_pylist()]
    assert got == [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6), *((3, k) for k in range(5))]
