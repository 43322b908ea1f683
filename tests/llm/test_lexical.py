"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, most):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, bag, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if nil else i, -s) for k, (s, nil, i) in enumerate(sorted(scored)[:most])]
    return sorted(out, key=str)


def ranked(spark, docs, items, most=20, parts=3):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(parts)
    q = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.rank(d, q, most).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeñ") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 60)))) for k in range(n)]
    docs += [(n + k, "one text that many share ba ba") for k in range(n // 3)]
    return docs, [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 25)))) for k in range(25)]


@pytest.mark.parametrize("window,short,segment", [(512, 1 / 32, 8192), (16, 0.0, 64), (8, 1.0, 64), (32, 0.1, 200)])
def test_ranks_match_brute_force(spark, monkeypatch, window, short, segment):
    """Also with no short lists at all, with short lists only, and with many segments and windows."""
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical.Index.search, "__defaults__", (short,))
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", segment)
    docs, items = corpus(1, 600)
    if window != 512:  # one process, where the settings hold
        assert in_process(docs, items, 20, segment) == brute(docs, items, 20)
    else:
        assert ranked(spark, docs, items) == brute(docs, items, 20)


def in_process(docs, items, most, segment):
    """The index and the search, segment by segment in this process."""
    import pyarrow as pa

    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    names = {t: k for k, t in enumerate(sorted({t for _, x in items for t in terms(x)}))}
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in names])
    best = [lexical.Best(most) for _ in items]
    for at in range(0, n_docs, segment):
        own = bags[at : at + segment]
        lists = {t: [(d, b[t]) for d, (_, b, _) in enumerate(own) if b[t]] for t in names}
        lists = {t: x for t, x in lists.items() if x}
        flat = np.array([p for x in lists.values() for p in x], np.int64).reshape(-1, 2)
        starts = np.cumsum([0, *map(len, lists.values())])
        index = lexical.Index(pa.array([i for i, _, _ in own], pa.int64()), np.array([n for _, _, n in own]), np.array([names[t] for t in lists]), starts, flat[:, 0], flat[:, 1], n_docs, n_terms)
        for (_, text), b in zip(items, best, strict=True):
            bag = Counter(terms(text))
            ids = np.array([names[t] for t in bag])
            index.search(ids, weight[ids] * np.array(list(bag.values())), b)
    return sorted(((item, k + 1, int(i), int(s)) for (item, _), b in zip(items, best, strict=True) for k, (i, s) in enumerate(zip(b.id, b.score, strict=True))), key=str)


def test_windows_that_cannot_reach_are_not_walked(monkeypatch):
    walked = []
    real = lexical.Index._walk
    monkeypatch.setattr(lexical, "WINDOW", 16)
    monkeypatch.setattr(lexical.Index, "_walk", lambda self, *a: walked.append(a[2]) or real(self, *a))
    docs, items = corpus(2, 900)
    assert in_process(docs, items, 3, 8192) == brute(docs, items, 3)
    assert len(walked) < 0.8 * len(items) * (len(docs) // 16)


def test_odd_texts_ties_repeats_and_parts(spark, monkeypatch):
    docs = [(1, None), (2, ""), (3, "?!"), (4, "Straße İstanbul ABC abc"), (5, "straße"), (5, "straße"), (None, "straße"), (7, "STRAßE"), (8, "x_y straße z"), (9, "long " * 100_000), (6, "straße")]
    items = [(1, "straße straße"), (1, "straße straße"), (1, "abc long"), (2, None), (3, "..."), (4, "nowhere"), (None, "y"), (6, "İstanbul 7")]
    want = brute(docs, items, 20)
    assert ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, 2) == brute(docs, items, 2)
    monkeypatch.setattr(lexical, "PART_WORDS", 2)
    assert ranked(spark, docs, items) == want
    assert ranked(spark, [], items, 20, 1) == ranked(spark, docs, []) == ranked(spark, [(1, None)], items) == []


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    from tallyloom.llm.decontam import Lookup

    t, names = lexical.Terms.of([b"aa", b"bb", b"cc"])
    t.hash = np.full(3, 7, np.uint64)
    words = lexical.words_of(pa.array(["bb xx aa cc bb aaa"]))
    words.hash = np.full(6, 7, np.uint64)
    at, term = t.find(words, Lookup(np.unique(t.hash)))
    assert sorted((int(a), names[k]) for a, k in zip(at, term, strict=True)) == [(0, b"bb"), (2, b"aa"), (3, b"cc"), (4, b"bb")]
