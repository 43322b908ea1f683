"""The corpus operators as queries over the test tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bitplanes, bpe, decontam, embeddings, html, langid, lexical, minhash, packing, pii, sharding, toxicity, urls
from tallyloom.llm.common import table

#: Stands for a secret that a deployment would pass in.
PII_KEY = "surrogate key of the test tables"
RANKS = "byte_bpe_50k.tiktoken"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, count_col="n_replaced")


def op6_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.fit(docs.where(remainder != 2).select("text", "lang"))
    held_out = F.coalesce(remainder == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs.select("doc_id", held_out, "text"), model)


#: host, path prefix, verdict
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Hosts with such a word in their name are known for spam; the URLs of their pages make the list.
SPAM_HOST = "(^|[.-])(spam|pills|casino|warez)([.-]|$)"


def op7_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = urls.host_path(F.col("url"))
    listed = pages.where(host.rlike(SPAM_HOST)).select("url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(pages, rules, listed).drop("url")


def op8_html_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages, html.fit(pages))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


TOKENIZER = "byte_bpe_50k.json"


def op12_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


def op13_bit_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_karmarkar_karp": op3_karmarkar_karp,
    "op4_toxic_severity": op4_toxic_severity,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_language_bitmask": op6_language_bitmask,
    "op7_url_bloom": op7_url_bloom,
    "op8_html_labeller": op8_html_labeller,
    "op9_decontamination": op9_decontamination,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_hilbert_packing": op12_hilbert_packing,
    "op13_bit_plane_clusters": op13_bit_plane_clusters,
}

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """k centroids over so many rounds, each a step of the WITH clause."""
    steps = [
        """kept as (select row_number() over () as r, vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where len(embedding) = 64 and len([x for x in embedding if x is not null and isfinite(x)]) = 64)""",
        "x as materialized (select r, unnest(range(64)) as d, unnest(v) as v from kept)",
        f"first as (select v, row_number() over (order by sha256(concat('3:', vec_id)), v) - 1 as c from kept order by c limit {k})",
        "c0 as materialized (select cast(c as int) as c, unnest(range(64)) as d, unnest(v) as v from first)",
    ]
    for i in range(rounds + 1):
        steps.append(f"far{i} as (select x.r, c.c, cast(sum((x.v - c.v) * (x.v - c.v)) as bigint) as far from x join c{i} c on x.d = c.d group by all)")
        steps.append(f"a{i} as materialized (select r, arg_min(c, (far, c)) as c, min(far) as far from far{i} group by r)")
        if i < rounds:
            mean = f"select a.c, x.d, cast(sum(x.v) as bigint) as s, count(*) as n from a{i} a join x on a.r = x.r group by all"
            steps.append(f"c{i + 1} as materialized (select o.c, o.d, case when m.n is null then o.v else (m.s - ((m.s % m.n) + m.n) % m.n) // m.n end as v from c{i} o left join ({mean}) m on o.c = m.c and o.d = m.d)")
    steps.append(f"sha as (select c, sha256(string_agg(cast(v as varchar), ',' order by d)) as sha from c{rounds} group by c)")
    return "with " + ",\n".join(steps) + f"""
select kept.vec_id, a.c as cluster, a.far as distance, cast(sum(a.far) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.far) over () as bigint) as inertia, sha.sha as centroid_sha256
from a{rounds} a join kept on a.r = kept.r join sha on a.c = sha.c"""


#: None of the rest can be said in SQL: they are tested against brute force, round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op7_url_bloom": r"""
with parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages)
), canonical as (
  select *, case when host <> '' then regexp_replace(host, '^www\.', '') || regexp_replace(regexp_replace(path, '(index)?\.html?$', ''), '/+$', '') end as canon from parts
), rules(rule_host, rule_path, rule_verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), listed as (
  select distinct canon from canonical where regexp_matches(host, '(^|[.-])(spam|pills|casino|warez)([.-]|$)')
), best as (
  select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(rule_verdict, length(rule_host || rule_path)) as verdict
  from (select distinct host, path from canonical) join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path
)
select c.page_id, c.host, c.path, b.rule, coalesce(b.verdict, case when l.canon is not null then 'block' else 'allow' end) as verdict
from canonical c left join best b on c.host = b.host and c.path = b.path left join listed l on c.canon = l.canon
""",
    "op11_ranked_search": f"""
with words as (select doc_id, unnest(regexp_extract_all({_LOWER}, {_TERM})) as term from documents),
asked as (select item_id, term, count(*) as repeats from (select item_id, unnest(regexp_extract_all({_LOWER}, {_TERM})) as term from benchmark) group by all),
lengths as (select doc_id, count(*) as n from words group by all),
total as (select count(*) as docs, cast(sum(n) as bigint) as terms from lengths),
tf as (select doc_id, term, count(*) as tf from words where term in (select term from asked) group by all),
weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, total group by term, docs),
scored as (
  select item_id, doc_id, cast(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) as bigint) as score
  from asked join weights using (term) join tf using (term) join lengths using (doc_id), total group by all
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
from scored where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20
""",
    "op13_bit_plane_clusters": _cluster_sql(),
}
