"""Offers that a page's prices imply, the products beside them, and links back to the page.

`price_grid_sale` reads each text once: one walk over its prices gives the markdowns between neighbours, counted by percentage,
and one over its lines the products beside prices. Headline, confidence and summary come from the counts by column
expressions, without a shuffle, and a page with very many prices is no more than its 66 counts.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.arrow import parts
from tallyloom.functions.joins import stored
from tallyloom.functions.text import matches_domain
from tallyloom.operators.captures import detect_gender

C = F.col

# Prices, and what stands between or before two of them.
PRICE = r"\$\s*(\d[\d,]*(?:\.\d{2})?)|(?<![.\d])(\d+\.\d{2})(?![.\d])"
RANGES = ("-", "–", "to")
NOT_BETWEEN = ("save", "refine", "filter", "rebate")
BEFORE_SALE = ("now", "sale price", "our price", "today only", "special price", "you pay")
BEFORE_ORIGINAL = ("was", "reg.", "regular", "original", "compare at", "msrp", "list", "retail", "valued at")
LETTERS_BETWEEN, CUE_CHARS = 20, 80
LEAST_PRICE, MOST_PRICE = 1.0, 5000
LEAST_CUT, MOST_CUT, LEAST_MARKDOWN, NEAR_POINTS, NEAR_CHARS = 10, 85, 20, 5, 500
# Lines of products.
PRICE_LINE = r"\$\s*\d+|-\d+%"
ONLY_PRICE = r"^\s*[\$\-\+]?\s*\d[\d\.,]*\s*%?\s*$"
NO_PRODUCT = r"(?i)(cookie|privacy|cart|checkout|log\s*in|sign\s*in|menu|filter|sort|view|search|copyright|terms|policy|newsletter|subscribe|javascript|wishlist|account|share|follow|©|all rights)"
ONLY_SIZE, SIZES = r"(?i)^(XS|S|M|L|XL|XXL|XXXL|\d+|one\s+size)$", r"\b(xs|s|m|l|xl|xxl|xxxl|one\s+size)\b"
NEAR_LINES, MOST_LINES, MOST_EXAMPLES = 5, 30, 10
# Kinds of products, the words that tell them, and the words to find them by.
TAXONOMY = [
    ("outerwear", ["jacket", "coat", "blazer", "bomber", "parka", "anorak", "windbreaker", "vest", "gilet", "outerwear"], ["jacket", "coat", "blazer", "bomber", "parka"]),
    ("bottoms", ["pants", "trousers", "chinos", "leggings", "joggers", "shorts", "bottoms"], ["pants", "trousers", "leggings", "joggers", "shorts"]),
    ("denim", ["jeans", "denim"], ["jeans", "denim"]),
    ("dresses", ["dress", "gown", "midi", "maxi", "minidress"], ["dress", "gown"]),
    ("skirts", ["skirt"], ["skirt"]),
    ("tops", ["shirt", "tee", "t-shirt", "blouse", "top", "polo"], ["shirt", "tee", "blouse", "top", "polo"]),
    ("sweaters", ["hoodie", "sweatshirt", "sweater", "cardigan", "knit", "pullover"], ["hoodie", "sweatshirt", "sweater", "cardigan"]),
    ("shoes", ["shoes", "sneakers", "boots", "sandals", "heels", "loafers", "flats", "mules", "espadrilles", "footwear"], ["shoes", "sneakers", "boots", "sandals", "heels"]),
    ("bags", ["bag", "handbag", "purse", "tote", "wallet", "crossbody", "clutch", "satchel", "backpack"], ["bag", "handbag", "purse", "tote", "wallet", "crossbody"]),
    ("accessories", ["belt", "hat", "cap", "scarf", "sunglasses", "jewelry", "necklace", "bracelet", "earrings", "ring", "watch", "accessories"], ["belt", "hat", "scarf", "sunglasses", "jewelry", "watch"]),
    ("intimates", ["bra", "underwear", "lingerie", "socks", "intimates"], ["bra", "underwear", "lingerie", "socks"]),
    ("swimwear", ["swimwear", "swim", "bikini", "one-piece", "boardshort", "trunks"], ["swimwear", "bikini", "swim trunks"]),
    ("fragrance", ["perfume", "fragrance", "cologne", "scent", "eau de"], ["perfume", "fragrance", "cologne"]),
    ("makeup", ["makeup", "lipstick", "mascara", "foundation", "concealer", "blush", "eyeshadow"], ["makeup", "lipstick", "mascara", "foundation"]),
    ("skincare", ["skincare", "moisturizer", "cleanser", "serum", "sunscreen", "toner", "retinol"], ["skincare", "moisturizer", "cleanser", "serum"]),
    ("suits", ["suit", "tuxedo", "blazer set"], ["suit", "tuxedo"]),
    ("luggage", ["luggage", "suitcase", "duffle", "travel bag"], ["luggage", "suitcase"]),
]
# Words of product names that don't say what a thing is.
NO_KEYWORD = {
    *"red blue black white green yellow purple pink orange gray grey brown beige navy cream ivory tan taupe olive coral teal mint khaki gold silver nude rose lilac lavender burgundy maroon mustard charcoal ecru".split(),
    *"cotton linen polyester nylon leather faux silk wool cashmere canvas suede velvet mesh jersey satin chiffon tweed fleece flannel modal synthetic organic recycled blend mixed knit woven ribbed terry denim chambray".split(),
    *"slim regular relaxed straight loose fitted oversized cropped long short high low mid wide flared tapered skinny bootcut classic essential basic lightweight heavy stretch comfort plus petite tall asymmetric wrap".split(),
    *"striped plaid floral solid print printed pattern graphic logo embroidered tie dye checkered abstract leopard animal geometric tropical vintage washed".split(),
    *"new sale clearance original limited edition collection and the with for from into fit cut leg neck sleeve collar zip button pocket lined unlined padded size small medium large extra one piece set".split(),
}
MOST_KEYWORDS, CARD_KEYWORDS, CARD_CATEGORIES = 80, 25, 5
GRID_DISCOUNTS = ("percentage_off", "sale_price", "amount_off")
MERGED_EXPLICIT, MERGED_CONTEXTUAL, MERGED_EXAMPLES = 30, 40, 15
GRID_SHARE, OVERLAP_POINTS = 0.8, 15
# Markers of links in texts, words that are everywhere, and the window around a marker.
DEAL_URL = r"\[deal_url:(/[^\]]*)\]"
COMMON_WORDS = {"that", "this", "with", "from", "your", "save", "sale", "deal", "offer", "free", "shop", "brand", "item", "more"}
BEFORE_MARKER, AFTER_MARKER, LEAST_WORD = 400, 200, 4

_PRICE, _DEAL_URL, _WORD = re.compile(PRICE), re.compile(DEAL_URL), re.compile(r"\w+")
_PRICE_LINE, _ONLY_PRICE, _NO_PRODUCT, _ONLY_SIZE, _SIZES = map(re.compile, (PRICE_LINE, ONLY_PRICE, NO_PRODUCT, ONLY_SIZE, SIZES))


def lines_of(text: str) -> list[str]:
    """Names of products: lines within five lines of one with a price or cut, without sizes, each once, in order, 30 at most."""
    lines = text.splitlines()
    priced = [bool(("$" in line or "%" in line) and _PRICE_LINE.search(line)) for line in lines]
    names: dict[str, None] = {}
    for i, line in enumerate(lines):
        if len(names) == MOST_LINES:
            break
        if not any(priced[max(0, i - NEAR_LINES) : i + NEAR_LINES + 1]):
            continue
        raw = line.strip()
        if len(raw) < 4 or raw[0] == "$" or ("%" in raw and len(raw) < 8) or _ONLY_PRICE.match(raw) or _NO_PRODUCT.search(raw) or _ONLY_SIZE.match(raw):
            continue
        name = " ".join(_SIZES.sub("", raw.lower()).split()).strip(" ,.-")
        if len(name) >= 3:
            names[name] = None
    return list(names)


def product_lines(texts: DataFrame) -> DataFrame:
    """texts (text, ...) with product_lines instead of text."""

    @F.arrow_udf("array<string>")
    def told(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        return pa.concat_arrays([pa.array([], kind), *(pa.array([lines_of(x.as_py() or "") for x in part], kind) for part in parts(column))])

    return texts.withColumn("product_lines", told("text")).drop("text")


def _automaton() -> ahocorasick.Automaton:
    """All trigger words, each with the numbers of the kinds that it tells."""
    kinds: dict[str, list[int]] = {}
    for k, (_, triggers, _) in enumerate(TAXONOMY):
        for t in triggers:
            kinds.setdefault(t, []).append(k)
    out = ahocorasick.Automaton()
    for t, own in kinds.items():
        out.add_word(t, (len(t), own))
    out.make_automaton()
    return out


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def classify(lines: list[str], automaton: ahocorasick.Automaton, taxonomy_only: bool = False) -> tuple[list[str], list[str]]:
    """Kinds of the products in some lines, and keywords: those of the kinds, then words, word pairs and whole lines."""
    text = " ".join(lines).lower()
    told = set()
    for end, (n, kinds) in automaton.iter(text):
        start = end - n + 1
        if not (start and _inside(text[start - 1])) and not (end + 1 < len(text) and _inside(text[end + 1])):
            told.update(kinds)
    keywords = dict.fromkeys(w for k in sorted(told) for w in TAXONOMY[k][2])
    for line in [] if taxonomy_only else lines:
        words = [w for w in re.split(r"[\s\-/]+", line.lower()) if len(w) >= 3 and w not in NO_KEYWORD]
        keywords |= dict.fromkeys(words)
        keywords |= dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
        if 4 <= len(line) <= 60:
            keywords[line] = None
        if len(keywords) > MOST_KEYWORDS:  # later ones are cut anyway
            break
    return [TAXONOMY[k][0] for k in sorted(told)], list(keywords)[:MOST_KEYWORDS]


def classify_products(df: DataFrame, lines_col: str = "product_lines", taxonomy_only: bool = False) -> DataFrame:
    """df with product_categories and product_keywords of the lines, by one automaton over all trigger words a task."""

    @F.arrow_udf("struct<product_categories: array<string>, product_keywords: array<string>>")
    def told(column: pa.Array) -> pa.Array:
        automaton = _automaton()
        both = [classify([x for x in row if x is not None], automaton, taxonomy_only) if row else ([], []) for row in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([b[k] for b in both], pa.list_(pa.string())) for k in (0, 1)], ["product_categories", "product_keywords"])

    return df.withColumn("_told", told(lines_col)).select(*df.columns, "_told.*")


def markdowns(text: str):
    """(percentage, place, saving) of neighbouring prices that are an original and a sale price."""
    before = None
    for m in _PRICE.finditer(text):
        first, before = before, m
        if first is None:
            continue
        between = text[first.end() : m.start()]
        low = between.lower()
        if between.strip() in RANGES or any(w in low for w in NOT_BETWEEN) or sum(map(str.isalpha, between)) > LETTERS_BETWEEN:
            continue
        a, b = (float((x[1] or x[2]).replace(",", "")) for x in (first, m))
        if not (LEAST_PRICE < a < MOST_PRICE and LEAST_PRICE < b < MOST_PRICE):
            continue
        if a < b:
            cue = lambda x, words: any(w in text[max(0, x.start() - CUE_CHARS) : x.start()].lower() for w in words)
            if not cue(first, BEFORE_SALE) and not cue(m, BEFORE_ORIGINAL):
                continue
        high, low_ = max(a, b), min(a, b)
        cut = round((high - low_) / high * 100)
        if LEAST_CUT <= cut <= MOST_CUT:
            yield cut, first.start(), high - low_


_SCAN = "counts array<struct<cut: long, n: long, first_place: long, last_place: long, most_saved: double>>, product_lines array<string>, product_categories array<string>, product_keywords array<string>"


def scan(texts: DataFrame) -> DataFrame:
    """texts (text, ...) that have a real markdown, with the start of their text and, from one reading of it: their markdowns
    counted by percentage (at most 66 entries, ascending), and their products with kinds and keywords."""
    rest = [c for c in texts.columns if c != "text"]

    def run(batches):
        automaton = _automaton()
        for batch in (part for whole in batches for part in parts(whole, whole.column("text"))):
            at, rows, starts = [], [], []
            for k, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                by: dict[int, list] = {}
                for cut, place, saved in markdowns(text):
                    x = by.setdefault(cut, [0, place, place, 0.0])
                    x[0], x[2], x[3] = x[0] + 1, place, max(x[3], saved)
                if any(cut >= LEAST_MARKDOWN for cut in by):
                    lines = lines_of(text)
                    at.append(k)
                    starts.append(text[:2000])
                    counts = [dict(zip(_COUNT, (cut, *by[cut]), strict=True)) for cut in sorted(by) if cut >= LEAST_MARKDOWN]
                    rows.append((counts, lines, *classify(lines, automaton)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            told = [pa.array(c, t) for c, t in zip(columns, (pa.list_(_COUNTED), *[pa.list_(pa.string())] * 3), strict=True)]
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(starts, pa.string()), *told], [*rest, "start", "counts", "product_lines", "product_categories", "product_keywords"])

    schema = T.StructType([*(texts.schema[c] for c in rest), *T.StructType.fromDDL("start string, " + _SCAN).fields])
    return texts.select(*rest, "text").mapInArrow(run, schema)


_COUNT = ("cut", "n", "first_place", "last_place", "most_saved")
_COUNTED = pa.struct([(c, pa.float64() if c == "most_saved" else pa.int64()) for c in _COUNT])


def headlines(scanned: DataFrame) -> DataFrame:
    """Those with markdowns enough, with n_pairs, least_cut, most_cut, headline_cut, confidence_score and most_saved."""
    n = lambda own: F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    each = lambda name: F.transform("counts", lambda x: x[name])
    d = scanned.withColumns({"n_pairs": n(C("counts")), "least_cut": F.array_min(each("cut")), "most_cut": F.array_max(each("cut")), "most_saved": F.array_max(each("most_saved")), "_span": F.array_max(each("last_place")) - F.array_min(each("first_place"))})
    d = d.where((C("n_pairs") >= 3) | ((C("n_pairs") == 2) & (C("_span") <= NEAR_CHARS)))
    near = n(F.filter("counts", lambda x: x["cut"] >= C("most_cut") - NEAR_POINTS))
    ninth = F.element_at(F.filter("counts", lambda x: n(F.filter("counts", lambda y: y["cut"] <= x["cut"])) > F.floor(0.9 * (C("n_pairs") - 1))), 1)["cut"]
    spread = C("most_cut") - C("least_cut")
    sure = F.when(C("n_pairs") < 3, 0.52).when(C("n_pairs") <= 4, 0.60).when(C("n_pairs") <= 9, 0.68).otherwise(0.75) - F.when(spread > 40, 0.08).when(spread > 25, 0.04).otherwise(0.0)
    return d.withColumns({"headline_cut": F.when(near >= 2, C("most_cut")).otherwise(ninth), "confidence_score": F.round(F.least(F.greatest(sure, F.lit(0.40)), F.lit(0.75)), 2)}).drop("_span", "counts")


def price_grid_sale(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One synthesized sale card for each text (id_col, brand, category, text) whose prices show one."""
    d = headlines(scan(texts.select(id_col, "brand", "category", "text")))
    saved = F.when(C("most_saved") == F.floor("most_saved"), F.format_number("most_saved", 0)).otherwise(F.format_number("most_saved", 2))
    range_ = F.concat(C("brand"), F.lit(" has items on sale with discounts from "), C("least_cut"), F.lit("% to "), C("headline_cut"), F.lit("% off."))
    summary = F.when(C("most_saved") >= 50, F.concat(C("brand"), F.lit(" has items on sale up to "), C("headline_cut"), F.lit("% off, saving up to $"), saved, F.lit("."))).otherwise(range_)
    kinds = F.when(F.size("product_categories") > 0, F.concat(F.lit(" On sale: "), F.array_join("product_categories", ", "), F.lit("."))).otherwise("")
    return d.select(
        id_col, "brand", "category", F.concat("brand", F.lit(" Sale")).alias("promotion_title"), F.concat(summary, kinds).alias("short_summary"), F.lit("sale").alias("promotion_type"), F.lit("percentage_off").alias("discount_type"),
        F.concat(F.lit("up to "), C("headline_cut"), F.lit("% off")).alias("discount_value"), *(F.lit(False).alias(c) for c in ("requires_membership", "requires_app", "purchase_required")),
        F.lit("online").alias("redemption_method"), F.lit("online_only").alias("deal_scope"), F.lit("low").alias("friction_level"), "confidence_score", F.lit("success").alias("extraction_status"), F.lit(True).alias("synthesized"), F.lit("price_grid_markdown").alias("synthesis_reason"),
        F.slice("product_categories", 1, CARD_CATEGORIES).alias("product_categories"), F.array().cast("array<string>").alias("product_keywords_explicit"), F.slice("product_keywords", 1, CARD_KEYWORDS).alias("product_keywords_contextual"),
        F.slice(F.transform(F.filter("product_lines", lambda x: F.length(x) >= 4), F.upper), 1, MOST_EXAMPLES).alias("matched_product_examples"), detect_gender(C("product_lines"), C("start")).alias("target_gender"), "n_pairs", "least_cut", "most_cut", "headline_cut", "most_saved",
    )


def _first_of_title(offers: DataFrame, id_col: str) -> DataFrame:
    """Offers without later ones of the same text whose title differs by case and final marks only; empty titles all stay."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce("promotion_title", F.lit("")))), "[.!?,;]+$", "")
    key = F.when(key == "", F.concat(F.lit("\x00"), C("pos").cast("string"))).otherwise(key)
    keep = offers.groupBy(id_col, key.alias("_key")).agg(F.min("pos").alias("pos")).select(id_col, "pos")
    return offers.join(keep, [id_col, "pos"], "left_semi")


_FIELDS = ["promotion_title", "promotion_type", "discount_type", "discount_value", "product_keywords_explicit", "product_keywords_contextual", "matched_product_examples"]


def collapse_grid_offers(offers: DataFrame, cards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Offers of each text after its synthesized card: (id_col, pos, synthesized, title, type, discount, keywords, examples).

    Where two or more offers, and 80 % of the text's, look like products of a grid, the card takes their place with their
    keywords merged into its own. Elsewhere the card is added (pos null), unless a sale among the offers is within 15 points of it
    or neither has keywords of its own. A text has one card, so offers meet it by the text's id alone.
    """
    cards = stored(cards.select(id_col, *_FIELDS))
    own = _first_of_title(offers, id_col)
    no = lambda c: ~F.coalesce(C(c).cast("boolean"), F.lit(False))
    priced = (C("promotion_type") == "sale") & C("discount_type").isin(*GRID_DISCOUNTS)
    own = own.withColumn("_grid", F.coalesce(priced & no("requires_membership") & no("requires_app") & (F.coalesce("promo_code", F.lit("")) == ""), F.lit(False)))
    own = stored(own.select(id_col, "pos", "_grid", *_FIELDS))
    points = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+)\s*%", 1), F.lit("")).cast("int")
    card = cards.select(id_col, points(C("discount_value")).alias("_points"), (F.size("product_keywords_explicit") > 0).alias("_focused"))
    met = own.join(card, id_col, "left")
    mine = points(C("discount_value"))
    close = (C("_points") != 0) & (mine != 0) & (F.abs(C("_points") - mine) <= OVERLAP_POINTS)
    unfocused = (F.coalesce(F.size("product_keywords_explicit"), F.lit(0)) <= 0) & ~C("_focused")
    facts = met.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if("_grid").alias("grid"), F.coalesce(F.bool_or(priced & (F.coalesce(close, F.lit(False)) | unfocused)), F.lit(False)).alias("overlaps"), F.first("_points").isNotNull().alias("_carded"))
    replace = C("_carded") & (C("n") >= 2) & (C("grid") >= 2) & (C("grid") / C("n") >= GRID_SHARE)
    facts = facts.select(id_col, F.coalesce(replace, F.lit(False)).alias("replaces"), "overlaps")
    stays = own.join(facts.where("replaces"), id_col, "left_anti").select(id_col, "pos", F.lit(False).alias("synthesized"), *_FIELDS)
    fate = cards.join(facts, id_col, "left")
    added = fate.where("replaces is null or not (replaces or overlaps)").select(id_col, F.lit(None).cast("long").alias("pos"), F.lit(True).alias("synthesized"), *_FIELDS)
    merged = _merged(fate.where("replaces"), own.where("_grid").join(facts.where("replaces"), id_col, "left_semi"), id_col)
    return stays.unionByName(added).unionByName(merged)


def _merged(cards: DataFrame, grid: DataFrame, id_col: str) -> DataFrame:
    """The cards with the lists of the offers merged into their own: each thing once, the card's first, then in order."""
    out = cards
    for name, most, key in (("product_keywords_explicit", MERGED_EXPLICIT, C("x")), ("product_keywords_contextual", MERGED_CONTEXTUAL, C("x")), ("matched_product_examples", MERGED_EXAMPLES, F.upper("x"))):
        parts = [cards.select(id_col, F.lit(-1).cast("long").alias("pos"), F.posexplode(name).alias("i", "x")), grid.select(id_col, C("pos").cast("long").alias("pos"), F.posexplode(name).alias("i", "x")).where("x <> ''")]
        first = parts[0].unionByName(parts[1]).groupBy(id_col, key.alias("key")).agg(F.min(F.struct("pos", "i", "x")).alias("s"))
        kept = first.withColumn("turn", F.row_number().over(Window.partitionBy(id_col).orderBy("s.pos", "s.i", "key"))).where(C("turn") <= most)
        lists = kept.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", C("s.x").alias("x")))), lambda s: s["x"]).alias("_list"))
        out = out.join(lists, id_col, "left").withColumn(name, F.coalesce("_list", F.array().cast("array<string>"))).drop("_list")
    return out.select(id_col, F.lit(None).cast("long").alias("pos"), F.lit(True).alias("synthesized"), *_FIELDS)


def _markers(texts: DataFrame) -> DataFrame:
    """(source, at, path, words): the links in texts, and the words in the window around each."""

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, whole.column("text"))):
            rows = []
            for source, text in zip(batch.column("source"), batch.column("text"), strict=True):
                text = text.as_py() or ""
                for m in _DEAL_URL.finditer(text) if "[deal_url:/" in text else ():
                    window = text[max(0, m.start() - BEFORE_MARKER) : m.start() + AFTER_MARKER].lower()
                    rows.append((source.as_py(), m.start(), m[1], list({w for w in _WORD.findall(window) if len(w) >= LEAST_WORD} - COMMON_WORDS)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())), strict=True)], ["source", "at", "path", "words"])

    return texts.select(C("source").cast("string").alias("source"), "text").mapInArrow(run, "source string, at long, path string, words array<string>")


def backfill_deal_urls(offers: DataFrame, texts: DataFrame, id_col: str = "pos") -> DataFrame:
    """offers (id_col, source, promotion_title, short_summary, deal_url, website_domain, excerpt) with deal_url filled in, where
    it is missing, from the link of their source's text (source, text) that shares most words; the earliest of equals.

    Words lead from an offer to the links near them, so nothing is compared that shares no word. Offers with evidence (excerpt
    not null) take only links that their excerpt holds and that stay on their domain.
    """
    said = F.lower(F.concat_ws(" ", F.coalesce("promotion_title", F.lit("")), F.coalesce("short_summary", F.lit(""))))
    words = F.array_distinct(F.filter(F.regexp_extract_all(said, F.lit(r"(?U)\w+"), 0), lambda w: (F.length(w) >= LEAST_WORD) & ~w.isin(*sorted(COMMON_WORDS))))
    open_ = offers.where(F.coalesce("deal_url", F.lit("")) == "").select(id_col, C("source").cast("string").alias("source"), F.explode(words).alias("word"))
    links = _markers(texts).select("source", "at", "path", F.explode("words").alias("word"))
    scores = open_.join(links, ["source", "word"]).groupBy(id_col, "at").agg(F.count("*").alias("score"), F.first("path").alias("path"))
    best = scores.groupBy(id_col).agg(F.max_by("path", F.struct("score", -C("at"))).alias("_path"))
    d = offers.join(best, id_col, "left")
    domain = F.nullif("website_domain", F.lit(""))
    full = F.when(domain.isNull(), C("_path")).when(C("_path").startswith("//"), F.concat(F.lit("https:"), C("_path"))).otherwise(F.concat(F.lit("https://www."), domain, C("_path")))
    marker = F.concat(F.lit("[deal_url:"), C("_path"), F.lit("]"))
    good = C("excerpt").isNull() | (C("excerpt").contains(marker) & matches_domain(full, domain))
    filled = F.when((F.coalesce("deal_url", F.lit("")) == "") & C("_path").isNotNull() & good, full).otherwise(C("deal_url"))
    return d.withColumn("deal_url", filled).select(*offers.columns)
