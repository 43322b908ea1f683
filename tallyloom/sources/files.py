"""Readers and writers of brand documents, sources, captures, e-mails, catalogs and logs, with explicit schemas."""

from __future__ import annotations

import email
import email.policy
import re
import uuid
from email.utils import parseaddr, parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFFER = "brand string, category string, promotion_title string, short_summary string, terms_text string, promotion_type string, discount_type string, discount_value string, promo_code string, minimum_spend string, requires_membership boolean, membership_name string, membership_cost string, requires_app boolean, redemption_method string, redemption_steps array<string>, deal_scope string, start_date string, end_date string, valid_days array<string>, deal_url string, source_url string, confidence_score double, extraction_status string"
EMAIL = "path string, brand string, sender string, subject string, sent_at timestamp, message_id string, text string, html string, links array<string>, error string"


def read_brand_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per offer of per-brand JSON documents; documents without an array of offers give none."""
    docs = spark.read.schema(f"brand string, category string, source_path string, promotions array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in OFFER.split(','))}>>, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    each = docs.select(F.col("brand").alias("doc_brand"), F.col("category").alias("doc_category"), "source_path", F.posexplode("promotions").alias("pos", "p")).where("p is not null")
    return each.select("pos", "source_path", F.coalesce("p.brand", "doc_brand").alias("brand"), F.coalesce("p.category", "doc_category").alias("category"), *(F.col(f"p.{c.split()[0]}") for c in (x.strip() for x in OFFER.split(",")) if c.split()[0] not in ("brand", "category")))


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """The registry of sources; a single url counts as a list of one."""
    d = spark.read.schema("brand string, category string, url string, urls array<string>, source_type string, allowed_to_fetch boolean, online_only boolean").option("multiLine", True).json(path)
    return d.withColumn("urls", F.coalesce(F.when(F.size("urls") > 0, F.col("urls")), F.when(F.col("url").isNotNull(), F.array("url")), F.array().cast("array<string>"))).withColumn("url", F.get("urls", F.lit(0)))


def filter_sources(sources: DataFrame, brand: str | None = None, category: str | None = None, allowed_only: bool = True, first: int | None = None) -> DataFrame:
    """The sources of a brand (a part of its name) or category that may be fetched; the first of them by name, if asked."""
    d = sources.where(F.coalesce("allowed_to_fetch", F.lit(True))) if allowed_only else sources
    d = d.where(F.lower("brand").contains(brand.lower())) if brand else d
    d = d.where(F.lower("category") == category.lower()) if category else d
    return d.orderBy("brand", "url").limit(first) if first is not None else d


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with the metadata beside them, joined on the file's stem; missing metadata is null."""
    stem = lambda ext: F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*){re.escape(ext)}$", 1)
    texts = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(stem(".txt").alias("stem"), F.col("value").alias("text"))
    meta = spark.read.schema("brand string, category string, url string, scraped_at timestamp, content_hash string, title string").option("multiLine", True).option("pathGlobFilter", "*.meta.json").json(folder).select(stem(".meta.json").alias("stem"), "*")
    return texts.join(meta, "stem", "left")


def parse_eml(raw: DataFrame) -> DataFrame:
    """Mails from (path, content): sender, subject, time, id, text, html and at most fifty different links.

    A mail that cannot be read (no content, an unknown charset) gives a row of its path and the error, all else null."""

    def body(m, kind):
        part = m.get_body((kind,))
        return part.get_content() if part is not None else ""

    def read(path, content):
        m = email.message_from_bytes(bytes(content), policy=email.policy.default)
        name, address = parseaddr(str(m["From"] or ""))
        text, html = body(m, "plain"), body(m, "html")
        try:
            sent = pd.Timestamp(parsedate_to_datetime(str(m["Date"]))).tz_convert("UTC").tz_localize(None)
        except (ValueError, TypeError):
            sent = pd.NaT
        links = list(dict.fromkeys(re.findall(r"https?://[^\s<>\"']+", f"{text}\n{html}")))[:50]
        return (path, name or address.split("@")[-1].split(".")[0], address, str(m["Subject"] or ""), sent, str(m["Message-ID"] or ""), text.strip() or re.sub(r"<[^>]+>", " ", html).strip(), html, links, None)

    def tried(path, content):
        try:
            return read(path, content)
        except (ValueError, TypeError, LookupError, AttributeError, KeyError) as e:  # what the mail's own bytes can cause
            return (path, *[None] * 3, pd.NaT, *[None] * 4, f"{type(e).__name__}: {e}")

    def run(parts):
        for pdf in parts:
            rows = [tried(path, content) for path, content in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EMAIL.split(", ")])

    return raw.select("path", "content").mapInPandas(run, EMAIL)


def write_catalog(offers: DataFrame, path: str) -> None:
    """The catalog by brand, and one row of totals beside it."""
    offers.write.mode("overwrite").partitionBy("brand").parquet(f"{path}/offers")
    offers.agg(F.countDistinct("brand").alias("brand_count"), F.count("*").alias("promotion_count")).write.mode("overwrite").json(f"{path}/stats")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_review_csv(review: DataFrame, path: str) -> None:
    review.write.mode("overwrite").option("header", True).csv(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """df as a new snapshot under path, which read_snapshot() gives from then on. The snapshot is written aside and named in
    the file CURRENT, which is replaced in one step; df may come from the snapshot before, which stays."""
    spark = df.sparkSession
    name = f"snapshot-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    next_, current = (jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in (f"_next-{name}", "CURRENT"))
    out = next_.getFileSystem(conf).create(next_)
    out.write(bytearray(name.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(next_.getFileSystem(conf).getUri(), conf).rename(next_, current, how)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest snapshot that was wholly written; none if there is none."""
    current = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    if not current.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(current):
        return None
    return spark.read.parquet(f"{path}/{spark.read.text(str(current.toString())).first()[0]}")
