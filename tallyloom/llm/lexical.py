"""Ranked lexical search of a set of items in all documents: hybrid term-at-a-time, document-at-a-time.

Documents are read once and become segments of an inverted index over the items' terms: a segment has its documents' ids
and lengths and, by term, the documents and frequencies, in order of documents. Document counts and lengths are summed over
all segments, which then answer every item:

* term at a time: lists that are short in a segment are summed into accumulators, which from then on are one list, bounded
  by its greatest sum;
* document at a time: that list and the long ones are walked together, in windows of documents. A window whose lists can't
  reach the item's threshold together (its greatest impacts there) is skipped. In others the lists that can't reach it
  by themselves are not walked but only looked up, at the documents that can still reach it.

The threshold is the score of the last of the best documents that a task has seen so far, whatever the segment. A task gives
at most `most` documents an item, of which the best are kept. Items are worked off in parts of `PART_WORDS` words, which
bounds what is sent to executors; a segment is bounded by `SEGMENT_DOCS` documents and about `SEGMENT_POSTINGS` postings.

Defined cases: null, empty and wordless texts have no terms, match nothing and count nowhere; items are rows that differ in
id or text (repeated rows count once, two texts of one id are ranked each for itself); every document row is a document
of its own, so repeated rows are ranked repeatedly; of equal scores the smaller id comes first, a null id last; whole texts
count, however long; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpoint, release, slices
from tallyloom.llm.decontam import Lookup
from tallyloom.llm.words import Words, words_of

MOST = 20
PART_WORDS = 1 << 20
SEGMENT_DOCS, SEGMENT_POSTINGS = 8192, 1 << 21
#: Documents of a window; a list of at most this share of a segment's documents is short.
WINDOW, SHORT = 512, 1 / 32
_LAST = np.iinfo(np.int64).max


@dataclass
class Terms:
    """Terms by ascending hash, with their bytes one after the other."""

    hash: np.ndarray
    start: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, terms: list[bytes]) -> tuple[Terms, list[bytes]]:
        w = words_of(pa.array(terms, pa.binary()))
        order = np.argsort(w.hash, kind="stable")
        sorted_terms = [terms[i] for i in order]
        ends = np.cumsum([0, *map(len, sorted_terms)])
        return cls(w.hash[order], ends, np.frombuffer(b"".join(sorted_terms), np.uint8)), sorted_terms

    def equal(self, words: Words, at: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Which of the words are, byte by byte, the terms."""
        n = words.end[at] - words.start[at]
        same = n == self.start[term + 1] - self.start[term]
        at, term, n = at[same], term[same], n[same]
        if len(at):
            first = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(first, n)
            fits = words.lower[np.repeat(words.start[at], n) + step] == self.data[np.repeat(self.start[term], n) + step]
            same[same] = np.logical_and.reduceat(fits, first)
        return same

    def find(self, words: Words, look: Lookup) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of all words that are terms."""
        maybe = look.find(words.hash)
        first = np.searchsorted(self.hash, words.hash[maybe])
        found = []
        for extra in range(int(np.unique(self.hash, return_counts=True)[1].max(initial=1))):  # terms of one hash: one, save by a miracle
            term = np.minimum(first + extra, len(self.hash) - 1)
            term_at = maybe[self.hash[term] == words.hash[maybe]]
            term = term[self.hash[term] == words.hash[maybe]]
            ok = self.equal(words, term_at, term)
            found.append((term_at[ok], term[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_SEGMENT = "ids array<long>, n_docs long, n_terms long, lengths binary, terms binary, starts binary, docs binary, counts binary"


def _segments(docs: DataFrame, shared) -> DataFrame:
    """The index over the shared terms, one row a segment."""

    def segment(parts) -> pa.RecordBatch:
        ids, lengths, doc, term, count = zip(*parts, strict=True)
        base = np.cumsum([0, *map(len, ids)])
        doc = np.concatenate([d + b for d, b in zip(doc, base[:-1], strict=True)])
        term, count, lengths = np.concatenate(term), np.concatenate(count), np.concatenate(lengths)
        order = np.argsort(term, kind="stable")
        terms, starts = np.unique(term[order], return_index=True)
        binary = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        columns = [pa.array([[i for x in ids for i in x.to_pylist()]], pa.list_(pa.int64())), pa.array([len(lengths)]), pa.array([int(lengths.sum())])]
        columns += [binary(lengths, "<i8"), binary(terms, "<i4"), binary(np.append(starts, len(term)), "<i4"), binary(doc[order], "<i4"), binary(count[order], "<i8")]
        return pa.RecordBatch.from_arrays(columns, ["ids", "n_docs", "n_terms", "lengths", "terms", "starts", "docs", "counts"])

    def run(batches):
        terms = shared.value
        look, parts, n, postings = Lookup(np.unique(terms.hash)), [], 0, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                words = words_of(batch.column("text"))
                lengths = np.diff(words.first)
                known = np.flatnonzero(lengths)  # documents without terms are in no list
                if not len(known):
                    continue
                at, term = terms.find(words, look)
                doc = np.searchsorted(words.first, at, side="right") - 1
                pair, count = np.unique(np.searchsorted(known, doc) * len(terms.hash) + term, return_counts=True)
                parts.append((batch.column("id").take(pa.array(known)), lengths[known], pair // len(terms.hash), pair % len(terms.hash), count))
                n, postings = n + len(known), postings + len(pair)
                if n >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                    yield segment(parts)
                    parts, n, postings = [], 0, 0
        if parts:
            yield segment(parts)

    return docs.mapInArrow(run, _SEGMENT)


def _document_counts(segments: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term."""

    def run(batches):
        sums = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                sums[np.frombuffer(terms.as_buffer(), "<i4")] += np.diff(np.frombuffer(starts.as_buffer(), "<i4"))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term", "df"])

    told = segments.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(n_terms, np.int64)
    out[told["term"].to_numpy(np.int64)] = told["df"]
    return out


class Best:
    """The best documents of an item so far."""

    def __init__(self, most: int):
        self.most = most
        self.score, self.id, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.bool_)

    @property
    def least(self) -> int:
        """The score that a document needs to be among them."""
        return int(self.score[-1]) if len(self.score) == self.most else 1

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        score, ids, known = np.append(self.score, score), np.append(self.id, ids), np.append(self.known, known)
        order = np.lexsort((ids, ~known, -score))[: self.most]
        self.score, self.id, self.known = score[order], ids[order], known[order]


class Index:
    """A segment, ready to be searched."""

    def __init__(self, ids: pa.Array, lengths: np.ndarray, terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.known = ids.fill_null(_LAST).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        scale = 75 + (25 * lengths * n_docs) // n_terms
        self.lists = {int(t): k for k, t in enumerate(terms)}
        self.starts, self.docs = starts, docs
        self.impact = (1_000_000_000 * counts) // (1000 * counts + 12 * scale[docs])
        self.n, self.windows = len(lengths), -(-len(lengths) // WINDOW)
        self.cuts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def windowed(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where list k enters each window, and its greatest impact there."""
        if k not in self.cuts:
            a, b = self.starts[k], self.starts[k + 1]
            self.cuts[k] = _windowed(self.docs[a:b], self.impact[a:b], self.windows)
        return self.cuts[k]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best, short: float = SHORT) -> None:
        """Adds the documents that reach `best`, by terms and their weights (0 or more)."""
        own = [(self.lists[t], int(w)) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if w > 0 and t in self.lists]
        few = short * self.n
        brief = [(k, w) for k, w in own if self.starts[k + 1] - self.starts[k] <= few]
        walked = []
        for k, w in own:
            if self.starts[k + 1] - self.starts[k] > few:
                a, b = self.starts[k], self.starts[k + 1]
                walked.append((self.docs[a:b], self.impact[a:b], w, *self.windowed(k)))
        if brief:
            sums = np.zeros(self.n, np.int64)
            for k, w in brief:
                a, b = self.starts[k], self.starts[k + 1]
                sums[self.docs[a:b]] += w * self.impact[a:b]
            docs = np.flatnonzero(sums)
            walked.append((docs, sums[docs], 1, *_windowed(docs, sums[docs], self.windows)))
        if not walked:
            return
        tops = np.stack([w * top for _, _, w, _, top in walked])
        reach = tops.sum(axis=0)
        for window in np.flatnonzero(reach > 0):
            if reach[window] >= best.least:
                self._walk(walked, tops[:, window], int(window), best)

    def _walk(self, walked, tops: np.ndarray, window: int, best: Best) -> None:
        base, least = window * WINDOW, best.least
        order = np.argsort(tops, kind="stable")
        below = np.cumsum(tops[order])
        looked_up = int(np.searchsorted(below, least))  # so many lists, even together, don't reach it
        score, seen = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.bool_)
        for i in order[looked_up:]:
            docs, impact, w, cut, _ = walked[i]
            a, b = cut[window], cut[window + 1]
            at = docs[a:b] - base
            score[at] += w * impact[a:b]
            seen[at] = True
        rest = np.flatnonzero(seen)
        for turn in range(looked_up - 1, -1, -1):
            rest = rest[score[rest] + below[turn] >= least]
            if not len(rest):
                return
            docs, impact, w, cut, _ = walked[order[turn]]
            a, b = cut[window], cut[window + 1]
            if a == b:
                continue
            place = np.minimum(np.searchsorted(docs[a:b], rest + base), b - a - 1)
            met = docs[a:b][place] == rest + base
            score[rest[met]] += w * impact[a:b][place[met]]
        rest = rest[score[rest] >= least]
        if len(rest):
            best.add(score[rest], self.ids[rest + base], self.known[rest + base])


def _windowed(docs: np.ndarray, impact: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    cut = np.searchsorted(docs, np.arange(windows + 1) * WINDOW)
    top = np.zeros(windows, np.int64)
    some = np.flatnonzero(cut[1:] > cut[:-1])
    if len(some):
        top[some] = np.maximum.reduceat(impact, cut[some])
    return cut, top


def _best(segments: DataFrame, shared, n_docs: int, n_terms: int, most: int) -> DataFrame:
    """(item, doc, score): the best documents of each item in each task; items are numbers."""

    def run(batches):
        items, weight = shared.value
        best = [Best(most) for _ in items]
        for batch in batches:
            for row in range(batch.num_rows):
                array = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)  # noqa: B023, E731
                lengths, terms, starts = array("lengths", "<i8"), array("terms", "<i4"), array("starts", "<i4").astype(np.int64)
                index = Index(batch.column("ids")[row].values, lengths, terms, starts, array("docs", "<i4").astype(np.int64), array("counts", "<i8"), n_docs, n_terms)
                for own, (terms, repeats) in zip(best, items, strict=True):
                    index.search(terms, weight[terms] * repeats, own)
        for k, own in enumerate(best):
            if len(own.id):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.id), k)), pa.array(own.id, pa.int64(), mask=~own.known), pa.array(own.score)], ["item", "doc", "score"])

    return segments.drop("n_docs", "n_terms").mapInArrow(run, "item long, doc long, score long")


def _item_words(items: DataFrame) -> DataFrame:
    """(item, id, n, terms, repeats): the different terms of each item and how often it has them."""
    numbered = items.distinct().withColumn("item", F.monotonically_increasing_id())

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words_of(batch.column("text"))
                bags = [Counter(w.text(i) for i in range(w.first[d], w.first[d + 1])) for d in range(batch.num_rows)]
                columns = [batch.column("item"), batch.column("id"), pa.array([len(b) for b in bags], pa.int64())]
                columns += [pa.array([list(b) for b in bags], pa.list_(pa.binary())), pa.array([list(b.values()) for b in bags], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["item", "id", "n", "terms", "repeats"])

    return numbered.mapInArrow(run, "item long, id long, n long, terms array<binary>, repeats array<long>").where("n > 0")


def rank(docs: DataFrame, items: DataFrame, most: int = MOST, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The best documents of each item: item_col, rank, id_col, score."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = checkpoint(_item_words(items.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))))
    parts = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // PART_WORDS))
    found = []
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("item").collect()
        if not mine:
            continue
        terms, names = Terms.of(sorted({bytes(t) for r in mine for t in r["terms"]}))
        number = {t: k for k, t in enumerate(names)}
        shared = spark.sparkContext.broadcast(terms)
        segments = checkpoint(_segments(texts, shared))
        n_docs, n_terms = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if n_docs:
            df = _document_counts(segments, len(names))
            weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
            bags = [(np.array([number[bytes(t)] for t in r["terms"]], np.int64), np.array(r["repeats"], np.int64)) for r in mine]
            asking = spark.sparkContext.broadcast((bags, weight))
            names_of = spark.createDataFrame([(k, r["id"]) for k, r in enumerate(mine)], "item long, item_id long")
            told = _best(segments, asking, int(n_docs), int(n_terms), most)
            place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
            ranked = told.withColumn("rank", place).where(F.col("rank") <= most)
            found.append(checkpoint(ranked.join(F.broadcast(names_of), "item").select("item_id", "rank", "doc", "score")))
            asking.destroy()
        shared.destroy()
        release(segments)
    release(asked)
    if not found:
        found = [spark.createDataFrame([], "item_id long, rank int, doc long, score long")]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
