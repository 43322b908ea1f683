"""Language of a text by language-bitmask n-gram filters.

Training keeps, for each language, its common character n-grams: seen at least `LEAST` times in a sample of labelled rows
(about `MAX_PER_LANGUAGE` a language, taken by hash; the counts are Spark aggregates), not much rarer than in
the language where they are commonest, and among its `MAX_GRAMS` commonest. All sets share one bit-sliced Bloom
filter: a slot holds one bit for each language, and the AND of an n-gram's slots is the set of all languages that may
have it. A text's score for a language is how many of its n-grams the filter gives to it, corrected for the language's
false positive rate; the best corrected count decides.

Text is lower-cased; everything but letters separates words. Defined cases: null, empty and letterless texts are `und` with
score 0; equal counts go to the language that sorts first; with nothing learned every text is `und`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import fresh, slices, text_bytes
from tallyloom.llm.words import mix

GRAM = 4
SLOT_BITS = 22
HASHES = 2
MAX_PER_LANGUAGE = 4_000
MAX_GRAMS = 60_000
LEAST = 3
#: A language holds an n-gram only if it is there at least so much of its commonest relative frequency.
LEAST_SHARE = 0.1

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point, its lower-case letter; 0 for everything else."""
    if not _letters:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                out[c] = ord(s.lower()[0])
        _letters.append(out)
    return _letters[0]


def grams(texts: pa.Array, n: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of every n-gram with a letter in it, by text; and whether each text has letters."""
    data, offsets = text_bytes(texts)
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        fixed = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return grams(pa.array(fixed, pa.string()), n)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    x = _letter_table()[points]
    keep = x != 0
    keep[1:] |= x[:-1] != 0
    at = np.concatenate([[0], np.cumsum(keep)])[starts]
    x = x[keep]
    count = len(texts)
    pad = n - 1
    padded = np.zeros(len(x) + pad * (count + 1), np.uint64)
    shift = np.repeat(np.arange(1, count + 1) * pad, np.diff(at))
    padded[np.arange(len(x)) + shift] = x
    of = np.repeat(np.arange(count), np.diff(at) + pad)
    m = len(padded) - pad
    h, some = np.zeros(m, np.uint64), np.zeros(m, np.bool_)
    for k in range(n):
        part = padded[k : k + m]
        h = h * np.uint64(0x1000193) + part
        some |= part != 0
    has = np.bincount(of[padded[pad : pad + m] != 0], minlength=count) > 0
    return of[some], mix(h[some]), has


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray = field(default_factory=lambda: np.zeros((1 << SLOT_BITS, 1), np.uint8))  # a bit for each language
    false_rate: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        out = None
        for slot in _slots(hashes):
            got = self.table[slot]
            out = got if out is None else out & got
        return out

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hits by text and language, n-grams by text, whether the text has letters)."""
        of, h, has = grams(texts)
        masks, n = self.masks(h), len(texts)
        hits = np.zeros((n, len(self.languages)), np.int64)
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        for b in range(self.table.shape[1]):
            seen = np.bincount(of * 256 + masks[:, b], minlength=n * 256).reshape(n, 256)
            hits[:, b * 8 : b * 8 + 8] = (seen @ bits)[:, : len(self.languages) - b * 8]
        return hits, np.bincount(of, minlength=n), has

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        hits, n, has = self.counts(texts)
        real = np.maximum((hits - n[:, None] * self.false_rate) / (1 - self.false_rate), 0)
        best = np.argmax(real, axis=1)
        total = real.sum(axis=1)
        score = np.divide(real[np.arange(len(best)), best], total, out=np.zeros(len(best)), where=total > 0)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, has, strict=True)], np.where(has, score, 0.0)


def _slots(hashes: np.ndarray):
    for k in range(HASHES):
        yield ((hashes >> np.uint64(k * 24)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = MAX_PER_LANGUAGE) -> Model:
    """The filter of the languages in labelled, which needs no other columns."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([])
    share = F.element_at(F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, most / r["n"])))), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                of, h, _ = grams(batch.column("text"))
                code = {x: k for k, x in enumerate(languages)}
                lang = np.array([code[x] for x in batch.column("lang").to_pylist()], np.int32)[of]
                order = np.lexsort((h, lang))
                lang, h = lang[order], h[order]
                starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])])) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(lang[starts]), pa.array(h[starts].view(np.int64)), pa.array(np.diff(np.append(starts, len(h))))], ["lang", "gram", "n"])

    seen = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = seen.groupBy("lang").agg(F.sum("n").alias("total"))
    common = seen.where(F.col("n") >= LEAST).join(F.broadcast(totals), "lang").withColumn("f", F.col("n") / F.col("total"))
    top = common.groupBy("gram").agg(F.max("f").alias("top"))
    kept = common.join(top, "gram").where(F.col("f") >= LEAST_SHARE * F.col("top"))
    got = kept.where(F.col("n") >= _least_counts(kept, len(languages))).select("lang", "gram").toPandas()
    table = np.zeros((1 << SLOT_BITS, -(-len(languages) // 8)), np.uint8)
    for lang, part in got.groupby("lang"):
        for slot in _slots(part["gram"].to_numpy(np.int64).view(np.uint64)):
            table[slot, lang // 8] |= np.uint8(1 << (lang % 8))
    filled = np.array([((table[:, k // 8] >> (k % 8)) & 1).mean() for k in range(len(languages))])
    return Model(languages, table, filled**HASHES)


def _least_counts(kept: DataFrame, languages: int):
    """For each row's language, the count from which on it has at most MAX_GRAMS n-grams: from a histogram of counts, whose
    classes grow by a sixteenth, so that no task sorts a language."""
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(17 / 16)).cast("int")
    bars = kept.groupBy("lang", step.alias("step")).agg(F.count("*").alias("grams"), F.min("n").alias("least")).collect()
    least = {}
    for lang in range(languages):
        mine, total, low = sorted((r for r in bars if r["lang"] == lang), key=lambda r: -r["step"]), 0, 1 << 62
        for r in mine:
            total += r["grams"]
            if total > MAX_GRAMS:
                break
            low = r["least"]
        least[lang] = low
    return F.element_at(F.create_map(*(F.lit(x) for pair in least.items() for x in pair)), F.col("lang"))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, without the text, with lang_pred and score."""
    rest = [c for c in docs.columns if c != text_col]
    names = fresh(docs.drop(text_col), "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(names[0], T.StringType(), False), T.StructField(names[1], T.DoubleType(), False)])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col, 1 << 20):
                lang, score = shared.value.predict(batch.column(text_col))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(lang, pa.string()), pa.array(score)], [*rest, *names])

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
