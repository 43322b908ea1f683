"""Toxic severity by cumulative-link ordinal regression on sparse word features.

Grades: 0 for documents labelled clean, 1 for toxic ones of good quality, 2 for toxic ones of bad quality. The labels hold no
finer severity, so that grade 2 is a stand-in, and deployments with graded labels should pass those. P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector for all ordered thresholds; x holds
1 + ln(count) of each chosen word that occurs. The expected severity is the sum of these probabilities; a document is rejected when
P(grade >= 1) is at least `REJECT`.

The words are chosen from counts over the labelled sample (at most about `MAX_LABELLED` rows, taken by hash). The sample's
sparse features (at most `MAX_WORDS` a document) are fitted on the driver, the fitted words are broadcast, and every
whole text is scored.

Defined cases: null, empty and wordless texts have no features, so they get the thresholds' severity alone and are kept
unless nearly all labelled documents are toxic; without labels of both kinds nothing is learned, severity is 0 and
nothing is rejected; labels that are null or repeated are left out or taken at their greatest; repeated rows are
judged alike, whole texts of any length; other columns are kept, and added ones renamed where they clash; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import at_most, checkpoint, fresh, slices
from tallyloom.llm.decontam import Lookup
from tallyloom.llm.words import words_of

MAX_LABELLED = 20_000
MAX_WORDS = 2_000
LEAST_DOCS = 4
#: A word is chosen if its likelihood ratio statistic is at least this.
LEAST_RATIO = 15.0
#: Half of the usual 0.5, as a quarter of the labels of toxic documents and more are noise.
REJECT = 0.25
RIDGE = 0.02


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # rising; empty if nothing was learned

    def exceed(self, eta: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each document and k from 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -500, 500)))


def fit_ordinal(row, col, val, grade: np.ndarray, n_words: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model with a ridge penalty, by Adam on the whole sample."""
    n, top = len(grade), int(grade.max())
    share = np.array([(grade >= k).mean() for k in range(1, top + 1)])
    start = np.log((1 - share) / share)
    p = np.concatenate([np.zeros(n_words), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for s in range(1, steps + 1):
        w, theta = p[:n_words], np.cumsum(np.concatenate([p[n_words : n_words + 1], np.exp(p[n_words + 1 :])]))
        eta = np.bincount(row, val * w[col], minlength=n)
        q = np.ones((n, top + 2))
        q[:, -1] = 0
        q[:, 1:-1] = 1 / (1 + np.exp(np.clip(theta[None, :] - eta[:, None], -30, 30)))
        at = np.arange(n)
        lo, hi = q[at, grade], q[at, grade + 1]
        inv = 1 / np.maximum(lo - hi, 1e-12)
        dlo, dhi = lo * (1 - lo) * inv, hi * (1 - hi) * inv
        g_eta = -(dlo - dhi)
        g_theta = np.array([(dlo[grade == k]).sum() - (dhi[grade == k - 1]).sum() for k in range(1, top + 1)])
        gaps = np.concatenate([[1.0], np.exp(p[n_words + 1 :])])
        g = np.concatenate([np.bincount(col, val * g_eta[row], minlength=n_words) + RIDGE * w, np.cumsum(g_theta[::-1])[::-1] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**s)) / (np.sqrt(v / (1 - 0.999**s)) + 1e-8)
    return p[:n_words], np.cumsum(np.concatenate([p[n_words : n_words + 1], np.exp(p[n_words + 1 :])]))


def features(texts: pa.Array, look: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, 1 + ln(count)) of the chosen words of each text."""
    w = words_of(texts)
    at = look.find(w.hash)
    of = np.searchsorted(w.first, at, side="right") - 1
    key, n = np.unique(of * len(look.keys) + np.searchsorted(look.keys, w.hash[at]), return_counts=True)
    return key // max(len(look.keys), 1), key % max(len(look.keys), 1), 1 + np.log(n)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(text, grade) of a sample of labelled documents, chosen by the hash of their ids; of rows that share an id, the one
    with the smallest text."""
    grades = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    grades = grades.select(F.col(id_col).alias("id"), F.when(F.col("toxic") > 0, F.when(F.col("quality") > 0, 1).otherwise(2)).otherwise(0).alias("grade"))
    n = grades.count()
    if n > most:
        grades = grades.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    grades = F.broadcast(grades) if at_most(grades, 2 * most) else grades
    return checkpoint(texts.join(grades, "id").groupBy("id", "grade").agg(F.min("text").alias("text")).select("text", "grade"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> Model:
    sample = labelled(docs, labels, id_col, text_col, most)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    totals = {bool(r["toxic"]): r["n"] for r in sample.groupBy((F.col("grade") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return none

    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words_of(batch.column("text"))
                of = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
                order = np.lexsort((of, w.hash))
                h, of = w.hash[order], of[order]
                new = np.ones(len(h), np.bool_)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                h, of = h[new], of[new]
                if not len(h):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                bad = (np.array(batch.column("grade").to_pylist()) > 0).astype(np.int64)[of]
                yield pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(np.add.reduceat(bad, starts)), pa.array(np.diff(np.append(starts, len(h))))], ["word", "bad", "n"])

    words = sample.mapInArrow(count, "word long, bad long, n long").groupBy("word").agg(F.sum("bad").cast("double").alias("bad"), F.sum("n").cast("double").alias("n")).where(F.col("n") >= LEAST_DOCS)
    share = totals[True] / (totals[True] + totals[False])
    good = F.col("n") - F.col("bad")
    term = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * p))).otherwise(0.0)
    words = words.withColumn("ratio", 2 * (term(F.col("bad"), share) + term(good, 1 - share))).where(F.col("ratio") >= LEAST_RATIO)
    keys = np.sort(np.array([r["word"] for r in words.orderBy(F.desc("ratio"), "word").limit(MAX_WORDS).select("word").collect()], np.int64).view(np.uint64))
    if not len(keys):
        return none

    def sparse(batches):
        look = Lookup(keys)
        for whole in batches:
            for batch in slices(whole, "text"):
                row, col, val = features(batch.column("text"), look)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.ListArray.from_arrays(ends, pa.array(col.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(val.astype(np.float64)))], ["grade", "col", "val"])

    got = sample.mapInArrow(sparse, "grade int, col array<int>, val array<double>").toArrow()
    got = got.combine_chunks()
    grade, col, val = (got.column(c).combine_chunks() for c in ("grade", "col", "val"))
    lengths = np.array(pa.compute.list_value_length(col))
    order = np.argsort(np.repeat(np.arange(len(grade)), lengths), kind="stable")
    row = np.repeat(np.arange(len(grade)), lengths)[order]
    grades = np.array(grade)
    present = np.unique(grades)
    grades = np.searchsorted(present, grades)  # a grade that never occurs has no threshold
    w, theta = fit_ordinal(row, np.array(col.flatten()), np.array(val.flatten()), grades, len(keys))
    return Model(keys, w, theta)


def _eta(batch: pa.RecordBatch, text_col: str, model: Model, look: Lookup) -> np.ndarray:
    row, col, val = features(batch.column(text_col), look)
    return np.bincount(row, val * model.weights[col], minlength=batch.num_rows) if len(row) else np.zeros(batch.num_rows)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, without the text, with severity (expected), grade (the highest one whose threshold is passed with a chance of at
    least REJECT) and toxic (whether it is rejected)."""
    rest = [c for c in docs.columns if c != text_col]
    names = fresh(docs.drop(text_col), "severity", "grade", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(n, k, False) for n, k in zip(names, (T.DoubleType(), T.IntegerType(), T.BooleanType()), strict=True))])

    def run(batches):
        model, look = shared.value, Lookup(shared.value.words)
        for whole in batches:
            for batch in slices(whole, text_col):
                q = model.exceed(_eta(batch, text_col, model, look))
                toxic = q[:, 0] >= REJECT if q.shape[1] else np.zeros(len(q), np.bool_)
                cols = [pa.array(q.sum(axis=1)), pa.array((q >= REJECT).sum(axis=1).astype(np.int32)), pa.array(toxic)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *cols], [*rest, *names])

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, look = shared.value, Lookup(shared.value.words)
        for whole in batches:
            for batch in slices(whole, text_col):
                q = model.exceed(_eta(batch, text_col, model, look))
                yield batch.filter(pa.array(q[:, 0] < REJECT)) if q.shape[1] else batch

    return docs.mapInArrow(run, docs.schema)
