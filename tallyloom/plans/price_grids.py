"""Queries on prices, products and links of shop pages over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import captures as cap
from tallyloom.operators import price_grids as op
from tallyloom.plans.domain import ctes, domain

C = F.col


def _texts(spark, sf_dir):
    return domain(spark, sf_dir, "shop_texts")


def _cards(spark, sf_dir):
    return op.price_grid_sale(_texts(spark, sf_dir))


def _joined(df, *columns):
    return df.select(*(F.array_join(c, "\x1f").alias(c) if c in columns else c for c in df.columns))


_LISTS = ("product_categories", "product_keywords_explicit", "product_keywords_contextual", "matched_product_examples")


def _sales(spark, sf_dir):
    d = _cards(spark, sf_dir).withColumn("most_saved", F.round("most_saved", 2))
    return _joined(d.select("doc_id", "brand", "promotion_title", "discount_value", "confidence_score", "n_pairs", "least_cut", "most_cut", "headline_cut", "most_saved", "product_categories", "product_keywords_contextual", "matched_product_examples", "target_gender"), *_LISTS)


def _lines(spark, sf_dir):
    d = op.product_lines(_texts(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", F.posexplode("product_lines").alias("place", "name"))


def _classes(spark, sf_dir):
    d = op.product_lines(_texts(spark, sf_dir).select("doc_id", "text"))
    return _joined(op.classify_products(d).drop("product_lines"), "product_categories", "product_keywords")


#: Three offers (k = 0 to 2) of each text, in SQL that Spark and DuckDB read alike.
_OFFER = {
    "promotion_title": "case k when 0 then 'Denim jacket' when 1 then case when doc_id % 6 = 0 then 'DENIM jacket!' else 'Leather boots' end else 'Floral dress' end",
    "promotion_type": "case when k = 2 and doc_id % 3 = 0 then 'reward' else 'sale' end",
    "discount_type": "case k when 0 then 'percentage_off' when 1 then 'sale_price' else 'amount_off' end",
    "discount_value": "case when k = 0 and doc_id % 7 > 0 then concat(10 + doc_id % 60, '% off') when k = 1 then '$45.50' else null end",
    "promo_code": "case when doc_id % 5 = 0 and k > 0 then 'X' else null end",
    "keyword": "case when doc_id % 2 = 0 then concat('word ', k % 2) else '' end",
}


def _offers(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    d = rows.select("doc_id", (C("doc_id") * 3 + C("k")).alias("pos"), *(F.expr(e).alias(c) for c, e in _OFFER.items()), F.lit(False).alias("requires_membership"), F.lit(None).cast("boolean").alias("requires_app"))
    word = F.when(C("keyword") == "", F.array().cast("array<string>")).otherwise(F.array("keyword"))
    return d.withColumns({"product_keywords_explicit": word, "product_keywords_contextual": F.array(F.lower("promotion_title"), F.lit("denim")), "matched_product_examples": F.array("promotion_title")}).drop("keyword")


def _collapsed(spark, sf_dir):
    return _joined(op.collapse_grid_offers(_offers(spark, sf_dir), _cards(spark, sf_dir)).drop("promotion_type", "discount_type"), *_LISTS)


def _links(spark, sf_dir):
    k = C("doc_id") % 5
    texts = _texts(spark, sf_dir).select(C("doc_id").cast("string").alias("source"), "text", "website_domain")
    d = _texts(spark, sf_dir).select(
        C("doc_id").alias("pos"), C("doc_id").cast("string").alias("source"), F.when(k == 0, "Leather boots").when(k == 1, "Denim").when(k == 2, "Save on this").when(k == 3, "Jacket and more").otherwise("Nowhere near").alias("promotion_title"),
        F.when(C("doc_id") % 2 == 0, "for your jacket").alias("short_summary"), F.when(C("doc_id") % 13 == 0, "https://kept.example.com/").alias("deal_url"), F.when(C("doc_id") % 11 > 0, C("website_domain")).alias("website_domain"),
        F.when(C("doc_id") % 3 == 0, F.concat(F.lit("boots [deal_url:"), F.when(C("doc_id") % 4 == 0, "//evil.test").otherwise(""), F.lit("/boots]"))).alias("excerpt"),
    )
    return op.backfill_deal_urls(d, texts).select("pos", "deal_url")


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_W = r"[^\p{L}\p{N}_]"
_SIZE = rf"(^|{_W})(xs|s|m|l|xl|xxl|xxxl|one\s+size)($|{_W})"
_LINES_SQL = rf"""{ctes("shop_texts")},
split as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from shop_texts),
near as (select doc_id, i, trim(line) as raw, max(cast(regexp_matches(line, '\$\s*\d+|-\d+%') as int)) over (partition by doc_id order by i rows between 5 preceding and 5 following) as near from split),
cleaned as (
  select doc_id, i, trim(regexp_replace(regexp_replace(regexp_replace(lower(raw), '{_SIZE}', '\1\3', 'g'), '{_SIZE}', '\1\3', 'g'), '\s+', ' ', 'g'), ' ,.-') as name from near
  where near = 1 and length(raw) >= 4 and not regexp_matches(raw, '^\s*[\$\-\+]?\s*\d[\d\.,]*\s*%?\s*$') and not regexp_matches(raw, '{op.NO_PRODUCT}') and not regexp_matches(raw, '(?i)^(XS|S|M|L|XL|XXL|XXXL|\d+|one\s+size)$')
    and not raw ^@ '$' and not (contains(raw, '%') and length(raw) < 8)
),
product_lines as materialized (select doc_id, name, row_number() over (partition by doc_id order by min(i)) - 1 as place from cleaned where length(name) >= 3 group by doc_id, name qualify place < 30)"""

_KINDS_SQL = " union all ".join(f"select doc_id, {k} as k, '{label}' as label, '{'|'.join(words)}' as words from combined where regexp_matches(said, '(^|{_W})({'|'.join(triggers)})($|{_W})')" for k, (label, triggers, words) in enumerate(op.TAXONOMY))
_CLASSES_SQL = rf"""{_LINES_SQL},
combined as materialized (select doc_id, lower(string_agg(name, ' ' order by place)) as said from product_lines group by doc_id),
kinds as materialized ({_KINDS_SQL}),
tokens as (
  select doc_id, place, w, row_number() over (partition by doc_id, place order by j) as j from (
    select doc_id, place, unnest(string_split_regex(name, '[\s\-/]+')) as w, generate_subscripts(string_split_regex(name, '[\s\-/]+'), 1) as j from product_lines)
  where length(w) >= 3 and w not in ({_quoted(sorted(op.NO_KEYWORD))})
),
told as (
  select doc_id, -1 as place, 0 as kind, k * 100 + generate_subscripts(string_split(words, '|'), 1) as j, unnest(string_split(words, '|')) as w from kinds
  union all select doc_id, place, 0, j, w from tokens
  union all select doc_id, place, 1, j, w from (select doc_id, place, j, concat(w, ' ', lead(w) over (partition by doc_id, place order by j)) as w, lead(w) over (partition by doc_id, place order by j) as next from tokens) where next is not null
  union all select doc_id, place, 2, 0, name from product_lines where length(name) between 4 and 60
),
keywords as materialized (select doc_id, w, row_number() over (partition by doc_id order by min((place, kind, j))) as turn from told group by doc_id, w qualify turn <= 80),
listed as (
  select doc_id, string_agg(label, chr(31) order by k) as product_categories, string_agg(label, chr(31) order by k) filter (where turn <= 5) as five_categories
  from (select *, row_number() over (partition by doc_id order by k) as turn from kinds) group by doc_id
),
worded as (select doc_id, string_agg(w, chr(31) order by turn) as product_keywords, string_agg(w, chr(31) order by turn) filter (where turn <= 25) as some_keywords from keywords group by doc_id),
shown as (
  select doc_id, string_agg(upper(replace(name, 'ß', 'ss')), chr(31) order by place) as examples from (select * from product_lines where length(name) >= 4 qualify row_number() over (partition by doc_id order by place) <= 10) group by doc_id
),
classes as (
  select doc_id, coalesce(product_categories, '') as product_categories, coalesce(five_categories, '') as five_categories, coalesce(product_keywords, '') as product_keywords, coalesce(some_keywords, '') as some_keywords, coalesce(examples, '') as examples
  from shop_texts left join listed using (doc_id) left join worded using (doc_id) left join shown using (doc_id)
)"""

_GENDER = ", ".join(f"list_has_any(words, [{_quoted(words)}]) as {g}" for g, words in cap.GENDER_WORDS.items())
_SALES_SQL = rf"""{_CLASSES_SQL},
parts as (
  select doc_id, text, unnest(regexp_extract_all(text, '\$\s*\d[\d,]*(?:\.\d{{2}})?|[.\d]+')) as token, unnest(list_slice(string_split_regex(text, '\$\s*\d[\d,]*(?:\.\d{{2}})?|[.\d]+'), 1, -2)) as gap,
    generate_subscripts(regexp_extract_all(text, '\$\s*\d[\d,]*(?:\.\d{{2}})?|[.\d]+'), 1) as i from shop_texts
),
placed as (select *, sum(length(gap) + length(token)) over (partition by doc_id order by i) as stop from parts),
prices as (
  select doc_id, text, i, cast(stop - length(token) as bigint) as start, cast(stop as bigint) as stop, cast(replace(ltrim(token, '$ ' || chr(10)), ',', '') as double) as value
  from placed where token ^@ '$' or regexp_matches(token, '^\d+\.\d{{2}}$')
),
following as (select *, lead(start) over w as start2, lead(value) over w as value2 from prices window w as (partition by doc_id order by i)),
between_ as (
  select *, substr(text, stop + 1, start2 - stop) as gap, lower(substr(text, greatest(start - 80, 0) + 1, start - greatest(start - 80, 0))) as before1, lower(substr(text, greatest(start2 - 80, 0) + 1, start2 - greatest(start2 - 80, 0))) as before2
  from following where start2 is not null
),
cuts as (
  select doc_id, start, greatest(value, value2) - least(value, value2) as saved, cast(round_even((greatest(value, value2) - least(value, value2)) / greatest(value, value2) * 100, 0) as bigint) as cut from between_
  where trim(gap, ' ' || chr(10)) not in ({_quoted(op.RANGES)}) and not regexp_matches(lower(gap), '{"|".join(op.NOT_BETWEEN)}') and length(regexp_replace(gap, '[^\p{{L}}]', '', 'g')) <= 20
    and value > 1 and value < 5000 and value2 > 1 and value2 < 5000 and value <> value2
    and (value > value2 or regexp_matches(before1, 'now|sale price|our price|today only|special price|you pay') or regexp_matches(before2, 'was|reg\.|regular|original|compare at|msrp|list|retail|valued at'))
),
sums as (
  select doc_id, count(*) as n_pairs, min(cut) as least_cut, max(cut) as most_cut, list_sort(list(cut)) as cuts, max(start) - min(start) as span, max(saved) as most_saved from cuts where cut between 20 and 85 group by doc_id
),
headlines as (
  select *, case when len([x for x in cuts if x >= most_cut - 5]) >= 2 then most_cut else cuts[cast(floor(0.9 * (n_pairs - 1)) as bigint) + 1] end as headline_cut,
    round(greatest(0.40, least(0.75, case when n_pairs < 3 then 0.52 when n_pairs <= 4 then 0.60 when n_pairs <= 9 then 0.68 else 0.75 end - case when most_cut - least_cut > 40 then 0.08 when most_cut - least_cut > 25 then 0.04 else 0 end)), 2) as confidence_score
  from sums where n_pairs >= 3 or (n_pairs = 2 and span <= 500)
),
spoken as (select t.doc_id, string_split_regex(lower(concat(coalesce(said, ''), ' ', substr(text, 1, 2000))), '[\s\-/'']+') as words from shop_texts t left join combined c on t.doc_id = c.doc_id),
genders as (select doc_id, case when women and men then 'unisex' when women then 'women' when men then 'men' when kids then 'kids' end as target_gender from (select doc_id, {_GENDER} from spoken)),
cards as materialized (
  select doc_id, brand, concat(brand, ' Sale') as promotion_title, concat('up to ', headline_cut, '% off') as discount_value, cast(confidence_score as double) as confidence_score, n_pairs, least_cut, most_cut, headline_cut,
    round(most_saved, 2) as most_saved, five_categories as product_categories, some_keywords as product_keywords_contextual, examples as matched_product_examples, target_gender
  from headlines join shop_texts using (doc_id) join classes using (doc_id) join genders using (doc_id)
)"""

_COLLAPSED_SQL = rf"""{_SALES_SQL},
offers as (select doc_id, doc_id * 3 + k as pos, {", ".join(f"{e} as {c}" for c, e in _OFFER.items())} from (select doc_id, unnest([0, 1, 2]) as k from shop_texts)),
own as (select * from offers qualify row_number() over (partition by doc_id, rtrim(lower(promotion_title), '.!?,;') order by pos) = 1),
facts as (
  select o.doc_id, c.doc_id is not null and count(*) filter (where promotion_type = 'sale' and promo_code is null) >= 2 and count(*) filter (where promotion_type = 'sale' and promo_code is null) >= 0.8 * count(*) as replaces,
    coalesce(bool_or(promotion_type = 'sale' and (keyword = '' or abs(headline_cut - cast(nullif(regexp_extract(o.discount_value, '(\d+)%', 1), '') as int)) <= 15 is true)), false) as overlaps
  from own o left join cards c on o.doc_id = c.doc_id group by o.doc_id, c.doc_id
),
words as (
  select doc_id, -1 as pos, 'contextual' as list, unnest(string_split(product_keywords_contextual, chr(31))) as x, generate_subscripts(string_split(product_keywords_contextual, chr(31)), 1) as i from cards
  union all select doc_id, -1, 'examples', unnest(string_split(matched_product_examples, chr(31))), generate_subscripts(string_split(matched_product_examples, chr(31)), 1) from cards
  union all select doc_id, pos, 'explicit', keyword, 1 from own union all select doc_id, pos, 'contextual', unnest([lower(promotion_title), 'denim']), unnest([1, 2]) from own union all select doc_id, pos, 'examples', promotion_title, 1 from own
),
merged as (
  select doc_id, list, arg_min(x, (pos, i)) as x, row_number() over (partition by doc_id, list order by min((pos, i))) as turn from words join facts using (doc_id) where replaces and x <> ''
  group by doc_id, list, case when list = 'examples' then upper(replace(x, 'ß', 'ss')) else x end
),
lists as (
  select doc_id, coalesce(string_agg(x, chr(31) order by turn) filter (where list = 'explicit' and turn <= 30), '') as explicit, coalesce(string_agg(x, chr(31) order by turn) filter (where list = 'contextual' and turn <= 40), '') as contextual,
    coalesce(string_agg(x, chr(31) order by turn) filter (where list = 'examples' and turn <= 15), '') as examples from merged group by doc_id
)
select doc_id, pos, false as synthesized, promotion_title, discount_value, keyword as product_keywords_explicit, concat(lower(promotion_title), chr(31), 'denim') as product_keywords_contextual, promotion_title as matched_product_examples from own join facts using (doc_id) where not replaces
union all
select c.doc_id, null, true, promotion_title, discount_value, coalesce(l.explicit, ''), coalesce(l.contextual, product_keywords_contextual), coalesce(l.examples, matched_product_examples)
from cards c join facts f on c.doc_id = f.doc_id left join lists l on c.doc_id = l.doc_id where f.replaces or not f.overlaps"""

_LINKS_SQL = rf"""{ctes("shop_texts")},
offers as (
  select doc_id as pos, case doc_id % 5 when 0 then 'leather boots' when 1 then 'denim' when 2 then 'save on this' when 3 then 'jacket and more' else 'nowhere near' end || case when doc_id % 2 = 0 then ' for your jacket' else '' end as said,
    case when doc_id % 13 = 0 then 'https://kept.example.com/' end as deal_url, case when doc_id % 11 > 0 then website_domain end as domain,
    case when doc_id % 3 = 0 then concat('boots [deal_url:', case when doc_id % 4 = 0 then '//evil.test' else '' end, '/boots]') end as excerpt from shop_texts
),
marks as (
  select doc_id, text, unnest(regexp_extract_all(text, '\[deal_url:(/[^\]]*)\]', 1)) as path, unnest(list_slice(string_split_regex(text, '\[deal_url:/[^\]]*\]'), 1, -2)) as gap, generate_subscripts(regexp_extract_all(text, '\[deal_url:/[^\]]*\]'), 1) as i from shop_texts
),
windows as (select doc_id, i, path, lower(substr(text, greatest(spot - 400, 0) + 1, spot + 200 - greatest(spot - 400, 0))) as said from (select *, cast(sum(length(gap) + length(path) + 11) over (partition by doc_id order by i) - length(path) - 11 as bigint) as spot from marks)),
shared as (
  select pos, i, path, len(list_intersect(list_filter_words(o.said), list_filter_words(w.said))) as score from offers o join windows w on o.pos = w.doc_id
),
best as (select pos, arg_max(path, (score, -i)) as path from shared where score > 0 group by pos),
full_ as (select o.*, path, case when domain is null then path when path ^@ '//' then concat('https:', path) else concat('https://www.', domain, path) end as url from offers o left join best using (pos))
select pos, case when deal_url is null and path is not null and (excerpt is null or (contains(excerpt, concat('[deal_url:', path, ']')) and domain is not null and regexp_matches(url, concat('^https://www\.', domain, '/')))) then url else deal_url end as deal_url from full_"""
_FILTERED = rf"[w for w in string_split_regex(\1, '{_W}+') if length(w) >= 4 and w not in ({_quoted(sorted(op.COMMON_WORDS))})]"


def _with_words(sql: str) -> str:
    for side in ("o.said", "w.said"):
        sql = sql.replace(f"list_filter_words({side})", _FILTERED.replace(r"\1", side))
    return sql


QUERIES = {"product_lines": _lines, "classify_products": _classes, "price_grid_sale": _sales, "collapse_grid_offers": _collapsed, "backfill_deal_urls": _links}

ORACLE_SQL = {
    "product_lines": f"{_LINES_SQL} select doc_id, cast(place as int) as place, name from product_lines",
    "classify_products": f"{_CLASSES_SQL} select doc_id, product_categories, product_keywords from classes",
    "price_grid_sale": f"{_SALES_SQL} select * from cards",
    "collapse_grid_offers": _COLLAPSED_SQL,
    "backfill_deal_urls": _with_words(_LINKS_SQL),
}
