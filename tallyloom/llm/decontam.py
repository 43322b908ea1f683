"""Benchmark passages in documents, by a prefix-filtered set join with exact verification.

Every item is cut into windows of `window` consecutive words (an item of fewer words, but not none, is one window). A
window is a set of shingles, ordered by how rare they are in all documents. A document that holds the window holds all of
its shingles, so the rarest one alone (the necessary prefix at full containment) makes the candidates; a window with a
shingle that no document holds is out at once. Candidates must leave room for the window on both sides of the shingle
(length and positional bounds), and the words themselves are then compared.

Documents are read twice, once to count the items' shingles and once to find the prefix shingles with the words around
them. What is sent to executors is at most `MAX_TOKENS` longs; a larger benchmark is worked off in as many parts as it
needs, over documents that are numbered and written once. Joins and sums run on the few hits, not on texts.

Defined cases: null, empty and wordless documents have no words and no hits; null or wordless items match nothing; items
that share an id count once; an empty benchmark hits nothing; equal documents, documents that share an id and those of no
id are all reported, each for itself; whole texts count, however long; other columns are not looked at.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import at_most, checkpoint, fresh, slices
from tallyloom.llm.words import shingles, words_of

WINDOW, SHINGLE = 10, 5
MAX_TOKENS = 1 << 20
BROADCAST_ROWS = 1 << 18


def windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, size: int) -> DataFrame:
    """(item, words, n, g, tokens): each window's words joined by spaces, their number, and its shingles of g words in order."""
    picked = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words_of(batch.column("text"))
                items, words, lengths, gs, tokens = [], [], [], [], []
                for d, item in enumerate(batch.column("item").to_pylist()):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    n = min(window, b - a)
                    if not n:
                        continue
                    g = min(size, n)
                    h, _ = shingles(w.hash[a:b], np.array([0, b - a]), g)
                    h = h.view(np.int64)
                    for k in range(b - a - n + 1):
                        items.append(item)
                        words.append(w.texts(a + k, a + k + n).decode())
                        lengths.append(n)
                        gs.append(g)
                        tokens.append(h[k : k + n - g + 1].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(words, pa.string()), pa.array(lengths, pa.int32()), pa.array(gs, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], ["item", "words", "n", "g", "tokens"])

    return picked.mapInArrow(run, "item string, words string, n int, g int, tokens array<long>")


class Lookup:
    """Which of many 64-bit hashes are in a sorted list: a bit table first, then the list."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(16, int(len(keys)).bit_length() + 5)
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, np.bool_)
        self.table[keys >> self.shift] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[hashes >> self.shift])
        at = np.searchsorted(self.keys, hashes[maybe])
        at[at == len(self.keys)] = 0
        return maybe[self.keys[at] == hashes[maybe]]


def _parts(tokens: DataFrame) -> list[dict[int, np.ndarray]]:
    """The tokens (g, token), sorted by g, in parts that are small enough to be sent to executors."""
    n = tokens.count()
    parts = -(-n // MAX_TOKENS)
    out = []
    for k in range(parts):
        mine = tokens.where(F.pmod(F.xxhash64("token"), F.lit(parts)) == k).toPandas()
        out.append({int(g): np.sort(x["token"].to_numpy(np.int64).view(np.uint64)) for g, x in mine.groupby("g")})
    return out


def _counts(docs: DataFrame, part: dict[int, np.ndarray]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(part)

    def run(batches):
        lookups = {g: Lookup(k) for g, k in shared.value.items()}
        sums = {g: np.zeros(len(k), np.int64) for g, k in shared.value.items()}
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words_of(batch.column("text"))
                for g, look in lookups.items():
                    h, _ = shingles(w.hash, w.first, g)
                    sums[g] += np.bincount(np.searchsorted(look.keys, h[look.find(h)]), minlength=len(look.keys))
        for g, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g, np.int32)), pa.array(shared.value[g][some].view(np.int64)), pa.array(n[some])], ["g", "token", "n"])

    return docs.select("text").mapInArrow(run, "g int, token long, n long")


def _probe(docs: DataFrame, part: dict[int, np.ndarray], window: int, rest: list[str]) -> DataFrame:
    """Each document's columns but its text, n_words, and where prefix shingles are, with the words around."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(part)
    place = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("token", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("left", T.IntegerType()), T.StructField("around", T.ArrayType(T.StringType()))])
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place))])
    arrow = pa.list_(pa.struct([("g", pa.int32()), ("token", pa.int64()), ("pos", pa.int64()), ("left", pa.int32()), ("around", pa.list_(pa.string()))]))

    def run(batches):
        lookups = {g: Lookup(k) for g, k in shared.value.items()}
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words_of(batch.column("text"))
                places = [[] for _ in range(batch.num_rows)]
                for g, look in lookups.items():
                    h, at = shingles(w.hash, w.first, g)
                    for i in look.find(h):
                        p = int(at[i])
                        d = int(np.searchsorted(w.first, p, side="right")) - 1
                        a, b = int(w.first[d]), int(w.first[d + 1])
                        lo, hi = max(a, p - window + g), min(b, p + window)
                        around = [w.text(k).decode() for k in range(lo, hi)]
                        places[d].append({"g": g, "token": int(h[i].view(np.int64)), "pos": p - a, "left": p - lo, "around": around})
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(np.diff(w.first).astype(np.int64)), pa.array(places, arrow)], [*rest, "n_words", "places"])

    return docs.select(*rest, "text").mapInArrow(run, schema)


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """One row per document: the columns `keep`, n_words, n_hit, and items, the sorted ids of items with a window in it."""
    names = [f"k{i}" for i in range(len(keep))]
    picked = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_col).cast("string").alias("text"))
    wins = checkpoint(windows(benchmark, item_col, item_text_col, window, size))
    tokens = wins.select("g", F.explode("tokens").alias("token")).distinct()
    token_parts = _parts(tokens)
    numbered = _row_numbered(picked)
    if len(token_parts) > 1:
        numbered = checkpoint(numbered)  # read once a part, always under the same numbers
    names = ["rid", *names]
    counts = None
    for part in token_parts:
        c = _counts(numbered, part)
        counts = c if counts is None else counts.union(c)
    prefixes, parts = None, [{}]
    if counts is not None:
        counts = counts.groupBy("g", "token").agg(F.sum("n").alias("n_docs"))
        each = wins.select("words", "n", "g", F.posexplode("tokens").alias("offset", "token")).distinct()
        rare = each.join(counts, ["g", "token"], "left").groupBy("words", "n", "g").agg(F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "token", "offset")).alias("p"))
        prefixes = checkpoint(rare.where("p.n_docs > 0").select("words", "n", "g", "p.token", "p.offset"))
        parts = _parts(prefixes.select("g", "token").distinct()) or [{}]
    found = [checkpoint(_probe(numbered, part, window, names)) for part in parts]
    names = names[1:]
    base = found[0].select("rid", *names, "n_words")
    if prefixes is None:
        return base.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    near = functools.reduce(DataFrame.union, [x.select("rid", F.explode("places").alias("p")) for x in found]).select("rid", "p.*")
    small = F.broadcast(prefixes) if at_most(prefixes, BROADCAST_ROWS) else prefixes
    fits = (F.col("left") >= F.col("offset")) & (F.col("left") - F.col("offset") + F.col("n") <= F.size("around"))
    same = F.array_join(F.slice("around", F.greatest(F.col("left") - F.col("offset") + 1, F.lit(1)), F.col("n")), " ") == F.col("words")
    exact = near.join(small, ["g", "token"]).where(fits & same).select("rid", (F.col("pos") - F.col("offset")).alias("start"), F.col("n").cast("long").alias("n"), "words").distinct()
    exact = checkpoint(exact)
    item_of = wins.select("words", "item").distinct()
    item_of = F.broadcast(item_of) if at_most(item_of, BROADCAST_ROWS) else item_of
    items = exact.select("rid", "words").distinct().join(item_of, "words").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))
    cover = F.aggregate("spans", zero, lambda acc, x: F.struct((acc["hit"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["n"] - F.greatest(acc["end"], x["start"]))).alias("hit"), F.greatest(acc["end"], x["start"] + x["n"]).alias("end")))["hit"]
    covered = exact.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans")).select("rid", cover.alias("n_hit"))
    out = base.join(covered, "rid", "left").join(items, "rid", "left")
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _row_numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("rid", F.monotonically_increasing_id())


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the ids joined by commas) and contaminated, one row per document."""
    found = hits(docs, benchmark, [id_col], text_col, **how)
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs without those that hold a window of an item; a document is known by the digest of its text."""
    key, bad = fresh(docs, "text_key", "bad_key")
    keyed = docs.withColumn(key, F.md5(F.col(text_col).cast("string")))
    found = checkpoint(hits(keyed, benchmark, [key], text_col, **how).where("n_hit > 0").select(F.col(key).alias(bad)).distinct())
    found = F.broadcast(found) if at_most(found, BROADCAST_ROWS) else found
    return keyed.join(found, keyed[key] == found[bad], "left_anti").drop(key)
