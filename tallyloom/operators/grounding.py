"""Evidence for offers in the texts that they were taken from, and what later captures do to it.

`build_source_evidence` meets offers and texts in blocks: the offers of a source are dealt to groups of about `BLOCK`, each
of which meets the text once, so a source with very many offers is shared by many tasks and no task holds them all. A text is
cut into pages at its URL headers and a page into passages of four lines, of which only those that name an amount ("20%",
"$15") or something free are looked at, unless an offer's value is neither. What passages are and which offers have their
value in them is found by one walk over the lines in Python; all else is column expressions on these few pairs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.joins import BROADCAST_ROWS, small, stored
from tallyloom.functions.text import matches_domain

C = F.col
#: Offers of a source that meet its text together, about, and pairs that leave Python together.
BLOCK, PAIRS = 32, 1024
PASSAGE_LINES, EXCERPT = 4, 700

# The fields of an offer that evidence keeps, its version, words of titles that prove nothing, and conditions.
TEXT_FIELDS = ["brand", "promotion_title", "promotion_type", "discount_type", "discount_value", "promo_code", "minimum_spend", "membership_name", "start_date", "end_date", "redemption_method", "terms_text", "time_start", "time_end"]
FLAG_FIELDS = ["requires_membership", "requires_app", "purchase_required", "new_user_only", "birthday_related"]
LIST_FIELDS = ["redemption_steps", "valid_days"]
TIME_ZONE = "America/New_York"
SCHEMA_VERSION, VALIDATOR = 1, "captured_text_v1"
NO_ANCHOR = "a an the and or on in at to for of with your you our off save up get buy free discount offer deal sale code promo online only all items select purchase order orders first use extra plus exclusive".split()
FREE_SHIPPING, FREE_ITEM = r"\bfree\s+(?:standard\s+)?(?:shipping|delivery)\b", r"\bfree\b|\bcomplimentary\b"
CUT_BEFORE, CUT_AFTER = r"(?:\bsave\b|\bsavings\b|\brebate\b|\bdiscount\b)(?:\s+\w+){0,3}\s*", r"\s+(?:off|discount|rebate|savings)\b"
OMITTED = {
    "new_user_only": r"\bfirst (?:order|purchase)\b|\bnew (?:customers?|users?|members?) only\b",
    "purchase_required": r"\bwith (?:any |a |qualifying )?purchase\b",
    "requires_app": r"\b(?:app.only|in.app only)\b",
    "requires_membership": r"\bmembers? only\b|\b(?:rewards|loyalty) members\b",
}
MINIMUM = r"\b(?:orders?|purchases?|spend) (?:of |over |above |at least )?\$\s*\d|\$\d+(?:\.\d+)?\+"
SELECTED = r"\bselect(?:ed)?\b"
# What a passage holds if it fits a pattern: told much faster than the pattern, and in Python once for all offers of a passage.
SIGNS = {
    OMITTED["new_user_only"]: ("first ", "new "), OMITTED["purchase_required"]: ("purchase",), OMITTED["requires_app"]: ("app",),
    OMITTED["requires_membership"]: ("member",), MINIMUM: ("$",), SELECTED: ("select",),
}

_SHARE, _SUM = re.compile(r"(?<![\d.])(\d+(?:\.\d+)?)\s*%"), re.compile(r"\$\s*(\d+(?:\.\d+)?)")
_FREE = {"free_shipping": re.compile(FREE_SHIPPING), "free_item": re.compile(FREE_ITEM)}
_NOTHING: frozenset[str] = frozenset()
_HEAD = re.compile(r"=== (https?://\S+) ===")
#: White space of all scripts.
_SPACE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def normal(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends; null is empty."""
    return F.btrim(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss")), f"[{_SPACE}]+", " "))


def _stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def _like(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?U){pattern}")


def _has(offers: DataFrame, name: str, kind: str) -> Column:
    return C(name).cast(kind) if name in offers.columns else F.lit(None).cast(kind)


def _first_number(value: Column) -> Column:
    """The first number of a text without a final .00; null if it has none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(value, r"\d+(?:\.\d+)?", 0), r"\.00$", ""), F.lit(""))


def amount_key(value: Column) -> Column:
    """The amount that a (normalised) value names: "20%" or "$15"; null for other values."""
    number = _first_number(value)
    return F.when(value.contains("%"), F.concat(number, F.lit("%"))).when(value.contains("$"), F.concat(F.lit("$"), number))


def _named(said: str) -> set[str]:
    """All amounts that a normalised text names ("20%", "$15"), and what it gives for free."""
    shares = {x.removesuffix(".00") + "%" for x in _SHARE.findall(said)} if "%" in said else set()
    sums = {"$" + x.removesuffix(".00") for x in _SUM.findall(said)} if "$" in said else set()
    free = {kind for kind, pattern in _FREE.items() if pattern.search(said)} if "free" in said or "complimentary" in said else set()
    return shares | sums | free


def _passages(text: str, url: str | None, wanted: set[str], every: bool):
    """(line, page_url, excerpt, said, keys) of each passage that names a wanted amount or something free, or of every one.

    Lines are normalised and searched once, not once for each passage they are in; only what runs over a line's end, and a
    last line that the excerpt cuts, is looked at again.
    """
    lines, folded = text.splitlines(), text.casefold().splitlines()  # folding neither makes nor takes an end of a line
    n, speaks = len(lines), [every or "%" in x or "$" in x or "free" in x or "complimentary" in x for x in folded]
    if True not in speaks:
        return
    told = list(map(_flat, folded))
    heads = list(map(_head, lines)) if "=== http" in text else [None] * n
    stops = [line.startswith("=== ") or head is not None for line, head in zip(lines, heads, strict=True)] + [True]
    named = [_named(x) if speaks[i] else _NOTHING for i, x in enumerate(told)]
    full = [i for i in range(n) if told[i]]
    runs = {i: k for i, k in zip(full, full[1:], strict=False) if _runs_on(told[i], told[k])}
    at = -1
    for i in range(n):
        if at < i:
            at = next((k for k in range(i, n) if speaks[k]), n)
        if at == n:
            return
        if heads[i]:
            url = heads[i]
        elif told[i] and at < i + PASSAGE_LINES:
            end = i + 1
            while end < i + PASSAGE_LINES and not stops[end]:
                end += 1
            parts, whole, keys = told[i:end], None, named[i].union(*named[i + 1 : end])
            over = bool(runs) and min(runs.get(k, n) for k in range(i, end)) < end
            if sum(map(len, lines[i:end])) + end - i > EXCERPT:
                whole = "\n".join(lines[i:end]).strip()
                if len(whole) > EXCERPT:
                    last = whole.count("\n", 0, EXCERPT)
                    whole = whole[:EXCERPT]
                    parts = [*told[i : i + last], _plain(whole[whole.rfind("\n") + 1 :])]
                    keys = set().union(*named[i : i + last], _named(parts[-1]))
                    seen = [x for x in parts if x]
                    over = any(map(_runs_on, seen, seen[1:]))
            if every or over or not keys.isdisjoint(wanted):
                said = " ".join(x for x in parts if x)
                yield i, url, "\n".join(lines[i:end]).strip() if whole is None else whole, said, _named(said) if over else keys


def _plain(line: str) -> str:
    return _flat(line.casefold())


def _flat(line: str) -> str:
    """White space as single spaces, none at the ends; most lines have it so already."""
    so = line.isascii() and "  " not in line and "\t" not in line and "\x1f" not in line and line[:1] != " " and line[-1:] != " " and "\n" not in line
    return line if so else " ".join(line.split())


def _runs_on(line: str, following: str) -> bool:
    """Whether an amount or something free may begin in a line and end in the following one."""
    return (following[0] == "%" and line[-1].isdigit()) or (line[-1] == "$" and following[0].isdigit()) or line.endswith(("free", "standard"))


def _head(line: str) -> str | None:
    """The URL of a page's header."""
    found = "=== http" in line and _HEAD.fullmatch(line.strip())
    return found[1] if found else None


def _day(raw: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd")))


def _day_pattern(raw: Column) -> Column:
    """A pattern of the ways to write an ISO date or time's day; of nothing at all if it is none. Null for none given."""
    day = _day(raw)
    n = lambda unit: F.date_format(day, unit)
    p = F.concat(F.lit(r"(?U)\b(?:"), F.lower(n("MMM")), F.lit(r"\.?|"), F.lower(n("MMMM")), F.lit(r")\s+0?"), n("d"), F.lit(r"(?:st|nd|rd|th)?[,\s]+"), n("yyyy"), F.lit(r"\b|\b"), n("yyyy"), F.lit("-0?"), n("M"), F.lit("-0?"), n("d"), F.lit(r"\b|\b0?"), n("M"), F.lit("/0?"), n("d"), F.lit("/"), n("yyyy"), F.lit(r"\b"))
    return F.when(F.coalesce(raw, F.lit("")) != "", F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ]\d{2}:\d{2})"), F.coalesce(p, F.lit("(?!)"))).otherwise("(?!)"))


def snapshot(offers: DataFrame) -> Column:
    """The fields of an offer that its evidence is about."""
    texts = [_has(offers, c, "string").alias(c) for c in TEXT_FIELDS]
    flags = [F.coalesce(_has(offers, c, "boolean"), F.lit(False)).alias(c) for c in FLAG_FIELDS]
    lists = [F.coalesce(_has(offers, c, "array<string>"), F.array().cast("array<string>")).alias(c) for c in LIST_FIELDS]
    return F.struct(*texts, *flags, *lists, F.coalesce(_has(offers, "timezone", "string"), F.lit(TIME_ZONE)).alias("timezone"))


def _source_reasons() -> Column:
    """What keeps all offers of a text from being looked for."""
    at = F.coalesce("checked_at", F.lit(""))
    dated = at.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$") & F.to_date(F.try_to_timestamp(F.substring(at, 1, 10), F.lit("yyyy-MM-dd"))).isNotNull()
    rules = [
        (~matches_domain(C("source_url"), C("trusted_domain")), "untrusted_source_url"),
        (dated & ~at.rlike(r"(Z|[T ].*[+-]\d{2}:?\d{2})$"), "capture_timezone_missing"),
        (~dated, "capture_date_missing"),
        (~F.coalesce(C("text").rlike(f"[^{_SPACE}]"), F.lit(False)), "source_text_missing"),
    ]
    return _told(rules)


def _told(rules: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*(F.when(c, r) for c, r in rules)), lambda r: r.isNotNull())


#: What is told of the offers of a source that has no text.
NO_TEXT = ["untrusted_source_url", "capture_date_missing", "source_text_missing"]


def _reasons(offers: DataFrame) -> Column:
    """What else keeps an offer from being looked for."""
    blank = lambda c: F.coalesce(_has(offers, c, "string"), F.lit("")) == ""
    yes = lambda c: F.coalesce(_has(offers, c, "boolean"), F.lit(False))
    steps = F.exists(F.coalesce(_has(offers, "redemption_steps", "array<string>"), F.array().cast("array<string>")), lambda s: F.coalesce(_stripped(s) != "", F.lit(False)))
    rules = [
        (yes("synthesized"), "synthesized_offer_needs_review"),
        (F.coalesce(_has(offers, "discount_type", "string"), F.lit("unknown")) == "unknown", "unknown_discount"),
        (~steps, "missing_redemption_steps"),
        (yes("requires_membership") & blank("membership_name"), "missing_membership_name"),
        (F.coalesce((_has(offers, "promotion_type", "string") == "coupon") | (_has(offers, "redemption_method", "string") == "show_code"), F.lit(False)) & blank("promo_code"), "missing_promo_code"),
    ]
    return _told(rules)


def _normals(offers: DataFrame) -> dict[str, Column]:
    """The normalised texts that _wanted reads: columns of their own, so that each is worked out once."""
    return {f"_{c}": normal(_has(offers, c, "string")) for c in ("promotion_title", "discount_value", "minimum_spend", "promo_code", "terms_text")}


def _wanted(offers: DataFrame) -> Column:
    """What a passage must and must not say to support an offer, by its columns and those of _normals."""
    text = lambda c: _has(offers, c, "string")
    title, value, minimum, code, kind = C("_promotion_title"), C("_discount_value"), C("_minimum_spend"), C("_promo_code"), text("discount_type")
    number = F.replace(_first_number(value), F.lit("."), F.lit(r"\."))
    number = F.concat(number, F.when(number.contains("."), "").otherwise(r"(?:\.00)?"))
    token = F.when(kind == "amount_off", F.concat(F.lit(r"\$\s*"), number, F.lit(r"(?!\d|\.\d)"))).when(kind == "percentage_off", F.concat(F.lit(r"(?<![\d.])"), number, F.lit(r"\s*%")))
    anchors = F.filter(F.array_distinct(F.regexp_extract_all(title, F.lit("[a-z]{3,}"), 0)), lambda word: ~word.isin(NO_ANCHOR))
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(code, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    needs = F.array_compact(F.array(F.nullif(code, F.lit("")), *(F.date_format(_day(text(c)), "yyyy") for c in ("start_date", "end_date"))))
    free = kind.isin("free_shipping", "free_item")
    return F.struct(
        F.when(free, kind).otherwise(amount_key(value)).alias("key"), F.when(free, F.lit(None)).otherwise(value).alias("value"), kind.isin("amount_off", "percentage_off").alias("cut"),
        F.concat(F.lit("(?U)"), F.lit(CUT_BEFORE), token, F.lit("|"), token, F.lit(CUT_AFTER)).alias("claim"),
        ((kind == "percentage_off") & ~value.contains("up to")).alias("not_up_to"), F.when(code != "", quoted).alias("code"),
        F.when(minimum != "", minimum).alias("minimum"), amount_key(minimum).alias("minimum_key"), _day_pattern(text("start_date")).alias("start"), _day_pattern(text("end_date")).alias("end"),
        title.alias("title"), anchors.alias("anchors"), needs.alias("needs"), *(F.coalesce(_has(offers, c, "boolean"), F.lit(False)).alias(c) for c in OMITTED),
        _like(F.concat_ws(" ", title, C("_terms_text")), SELECTED).alias("selected"),
    )


def _meet(batches):
    """Rows (text, source_url, trusted_domain, offers, fact) as pairs of an offer and a passage that has its value and all words
    without which it cannot support the offer; the facts leave as rows of their own."""
    rows = []

    def pairs(batch):
        rows.sort(key=lambda r: r[0])  # an offer's pairs stay together, so that its patterns are compiled once
        at = np.array([t for t, _ in rows], np.int64)
        told = [pa.array(x, k) for x, k in zip(zip(*(r for _, r in rows), strict=True), _KINDS, strict=True)]
        offers = batch.column("offers").flatten().take(pa.array(at))
        rows.clear()
        return whole(batch, offers, told)

    def whole(batch, offers, told, fact=None):
        """Rows as all rows leave, with a column for facts where the texts have them."""
        if "fact" not in batch.schema.names:
            return pa.RecordBatch.from_arrays([offers, *told], ["o", *_PAIR])
        return pa.RecordBatch.from_arrays([offers, *told, pa.nulls(len(offers), batch.schema.field("fact").type) if fact is None else fact], ["o", *_PAIR, "fact"])

    def fits(k, said, named):
        if not (minimum_keys[k] in named if minimum_keys[k] else minimums[k] is None or minimums[k] in said) or (not_up_to[k] and "up to" in said):
            return False
        return all(x in said for x in needs[k] or ()) and (sum(a in said for a in anchors[k]) >= min(2, len(anchors[k])) or titles[k] in said)

    for batch in batches:
        column = batch.column("offers")
        first, flat = np.cumsum([0, *(len(x) for x in column)]), column.flatten()
        of = {c.name: pa.compute.struct_field(flat, c.name).to_pylist() for c in flat.type if c.name in _TOLD}
        keys, values, titles, anchors, needs, minimums, minimum_keys, not_up_to = (of.get(c) or [None] * len(flat) for c in _TOLD)
        for r in range(batch.num_rows):
            own = range(first[r], first[r + 1])
            text, url, domain = (batch.column(c)[r].as_py() for c in ("text", "source_url", "trusted_domain"))
            by_key = defaultdict(list)
            for k in own:
                by_key[keys[k]].append(k)
            others = [k for k in by_key.pop(None, []) if values[k]]
            for line, page, excerpt, said, named in _passages(text or "", url, set(by_key), bool(others)):
                near = [k for key in by_key if key in named for k in by_key[key]] + [k for k in others if values[k] in said]
                near = [k for k in near if fits(k, said, named)]
                if near:
                    told = (domain, line, page, excerpt, said, _signs(said))
                    rows += [(k, told) for k in near]
                if len(rows) >= PAIRS:
                    yield pairs(batch)
        if rows:
            yield pairs(batch)
        if "fact" in batch.schema.names:
            yield whole(batch, pa.nulls(batch.num_rows, flat.type), [pa.nulls(batch.num_rows, k) for k in _KINDS], batch.column("fact"))


def _signs(said: str) -> int:
    """A bit for each pattern of SIGNS that a passage may fit."""
    bits = 0
    for k, words in enumerate(SIGNS.values()):
        for word in words:
            if word in said:
                bits |= 1 << k
                break
    return bits


_PAIR, _KINDS = ["trusted_domain", "line", "page_url", "excerpt", "said", "signs"], [pa.string(), pa.int32(), *[pa.string()] * 3, pa.int32()]
_TOLD = ["key", "value", "title", "anchors", "needs", "minimum", "minimum_key", "not_up_to"]


def _supports(o: Column) -> Column:
    """Whether the passage said supports the offer o, whose value, minimum and needs are known to be there. What costs least comes first."""
    said = C("said")
    says = lambda pattern: (C("signs").bitwiseAND(1 << list(SIGNS).index(pattern)) != 0) & _like(said, pattern)
    out = reduce(and_, (o[flag] | ~says(pattern) for flag, pattern in OMITTED.items()))
    out &= o["selected"] | ~says(SELECTED)
    out &= o["minimum"].isNotNull() | ~says(MINIMUM)
    for pattern in ("code", "start", "end"):
        out &= o[pattern].isNull() | F.regexp_like(said, o[pattern])
    out &= ~o["cut"] | F.coalesce(F.regexp_like(said, o["claim"]), F.lit(False))
    # With a lambda in it Spark makes many short methods of the condition, not one that is too long to be compiled.
    met = F.size(F.filter(F.array_intersect(o["anchors"], F.regexp_extract_all(said, F.lit("[a-z]{3,}"), 0)), lambda word: word != ""))
    return out & ((F.size(o["anchors"]) == 0) | said.contains(o["title"]) | (met >= F.least(F.lit(2), F.size(o["anchors"]))))


def grounds(offers: DataFrame, texts: DataFrame, id_col: str = "pos") -> tuple[DataFrame, DataFrame]:
    """What the texts tell, in one reading of them: of themselves (their columns but the text, content_hash, and what keeps
    their offers from being looked for), and of each supported offer the first passage that supports it."""
    facts = texts.select(F.struct(*(c for c in texts.columns if c != "text"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), _source_reasons().alias("_of_source")).alias("fact"), "text")
    clean = offers.drop("source_url", "checked_at", "trusted_domain")
    open_ = clean.where(F.size(_reasons(clean)) == 0)
    asked = open_.withColumns(_normals(clean)).select("source", F.struct(C(id_col).alias("id"), *(_wanted(clean)[c].alias(c) for c in _WANTED)).alias("o"))
    groups = open_.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("_groups"))
    count, many = groups.agg(F.sum("_groups"), F.count_if(C("_groups") > 1)).first()
    if many:  # only a source with more offers than a block is dealt
        dealt = groups.where(C("_groups") > 1)
        asked = asked.join(F.broadcast(dealt) if many <= BROADCAST_ROWS else dealt, "source", "left")
    asked = asked.withColumn("_group", F.pmod(F.xxhash64("o.id"), C("_groups")) if many else F.lit(0))
    blocks = asked.groupBy("source", "_group").agg(F.collect_list("o").alias("offers"))
    kind, fact = blocks.schema["offers"].dataType, facts.schema["fact"].dataType
    met = facts.withColumn("source", C("fact.source")).join(F.broadcast(blocks) if (count or 0) <= 20_000 else blocks, "source", "left")
    looked = C("offers").isNotNull() & (F.size("fact._of_source") == 0)
    met = met.select(F.when(looked, C("text")).alias("text"), "fact.source_url", "fact.trusted_domain", F.when(looked, C("offers")).otherwise(F.array().cast(kind)).alias("offers"), "fact")
    pairs = met.mapInArrow(_meet, T.StructType([T.StructField("o", kind.elementType), *T.StructType.fromDDL("trusted_domain string, line int, page_url string, excerpt string, said string, signs int").fields, T.StructField("fact", fact)]))
    told = pairs.where(C("fact").isNotNull() | (_supports(C("o")) & matches_domain(C("page_url"), C("trusted_domain"))))
    told = stored(told.groupBy(C("o.id").alias(id_col), C("fact.source").alias("_source")).agg(F.min_by(F.struct("excerpt", "page_url"), "line").alias("_found"), F.any_value("fact").alias("_fact")))
    return told.where(C("_fact").isNotNull()).select("_fact.*"), told.where(C("_fact").isNull()).select(id_col, "_found")


def build_source_evidence(offers: DataFrame, texts: DataFrame, id_col: str = "pos", told: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """offers (id_col, source, ...) with source_evidence, by texts (source, text, source_url, checked_at, trusted_domain), of
    which there is one a source: supported with the first passage that supports the offer, or unverified for reasons.
    told: their grounds, where they have been worked out already."""
    facts, found = told or grounds(offers, texts, id_col)
    clean = offers.drop("source_url", "checked_at", "trusted_domain")
    known = clean.join(facts.select("source", "source_url", "checked_at", "content_hash", "_of_source"), "source", "left").withColumn("content_hash", F.coalesce("content_hash", F.sha2(F.lit(""), 256)))
    known = known.withColumn("_reasons", F.concat(F.coalesce("_of_source", F.array(*map(F.lit, NO_TEXT))), _reasons(known))).drop("_of_source")
    out = known.join(found, id_col, "left")
    hit = C("_found").isNotNull()
    reasons = F.when(hit, F.array().cast("array<string>")).when(F.size("_reasons") == 0, F.array(F.lit("offer_not_grounded_in_captured_text"))).otherwise(C("_reasons"))
    evidence = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(VALIDATOR).alias("validator"), F.when(hit, "supported").otherwise("unverified").alias("status"),
        F.when(hit, C("_found.page_url")).otherwise(C("source_url")).alias("source_url"), C("checked_at"), F.lit(None).cast("string").alias("check_failed_at"),
        C("_found.excerpt").alias("excerpt"), C("content_hash"), snapshot(clean).alias("offer"), reasons.alias("reasons"),
    )
    return out.select(*clean.columns, evidence.alias("source_evidence"))


_WANTED = ["key", "value", "cut", "claim", "not_up_to", "code", "minimum", "minimum_key", "start", "end", "title", "anchors", "needs", *OMITTED, "selected"]


def apply_capture_outcome(catalog: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The catalog (brand, website_domain, status, last_confirmed, source_evidence, ...) after the latest fetch of each brand.

    outcomes: brand, outcome, content_hash, captured_urls, at (ISO text). The text fetched before (skipped_duplicate_hash)
    confirms offers whose evidence is of that text and of a page just fetched; a failed fetch sends supported offers to review.
    Other outcomes and brands change nothing, and applying an outcome again gives the same catalog.
    """
    last = outcomes.groupBy("brand").agg(F.max_by(F.struct("outcome", "content_hash", "captured_urls", C("at")), C("at")).alias("_o"))
    d, e, o = catalog.join(small(last), "brand", "left"), C("source_evidence"), C("_o")
    known = (e["schema_version"] == SCHEMA_VERSION) & (e["validator"] == VALIDATOR)
    standing = (e["status"] == "supported") | (e["reasons"] == F.array(F.lit("source_fetch_failed")))
    same = (o["outcome"] == "skipped_duplicate_hash") & known & standing & (e["content_hash"] == o["content_hash"]) & F.array_contains(o["captured_urls"], e["source_url"]) & matches_domain(e["source_url"], C("website_domain"))
    lost = (o["outcome"] == "failed") & (e["status"] == "supported")
    same, lost = F.coalesce(same, F.lit(False)), F.coalesce(lost, F.lit(False))
    # Field by field in one struct, so that a reader of some fields moves no others.
    none, told = F.lit(None).cast("string"), F.array().cast("array<string>")
    changes = {
        "checked_at": F.when(same, o["at"]), "status": F.when(same, "supported").when(lost, "unverified"),
        "reasons": F.when(same, told).when(lost, F.array(F.lit("source_fetch_failed"))), "check_failed_at": F.when(same, none).when(lost, o["at"]),
    }
    fields = catalog.schema["source_evidence"].dataType.names
    evidence = F.when(e.isNotNull(), F.struct(*((changes[c].otherwise(e[c]) if c in changes else e[c]).alias(c) for c in fields)))
    return d.withColumns({
        "source_evidence": evidence,
        "last_confirmed": F.when(same, o["at"]).otherwise(C("last_confirmed")),
        "status": F.when(lost, "needs_review").otherwise(C("status")),
    }).drop("_o").select(*catalog.columns)
