"""A corpus pipeline: toxicity, near-dedup, benchmark decontamination, PII surrogates, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again before the next. All stages but the last return the columns of documents.

Defined cases: null, empty and wordless texts are kept by all stages (as near-duplicates of nothing); rows with a null
doc_id are kept unless a stage rejects their text; of rows that share a doc_id one stays; texts count whole, however long;
extra columns, whatever their names, stay until the last stage; empty tables give no rows; without labels of both kinds
nothing is rejected as toxic, and an empty benchmark hits nothing.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe, decontam, minhash, pii, toxicity
from tallyloom.llm.common import ensure_checkpoint_dir, table
from tallyloom.llm.queries import PII_KEY, RANKS


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the severity model rejects."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each near-duplicate class."""
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that hold a window of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in the place of personal data and secrets."""
    return pii.replace(docs, PII_KEY)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes it again, and returns the digests of both."""
    return bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii_surrogates", pii_stage),
    ("byte_bpe", bpe_stage),
]

#: The stages hash by seeds, fit a model and run BPE, which SQL can't express; a test holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes between them lies in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = os.path.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
