"""Near-duplicate classes against brute force over all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import minhash
from tallyloom.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < 5:
        return Counter([tuple(w)] if w else [])
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def brute(rows, threshold=0.8):
    bags = [bag(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            both = sum((bags[x] & bags[y]).values())
            total = sum((bags[x] | bags[y]).values())
            if (total and both >= threshold * total) or rows[y][0] == i:
                a, b = root(i), root(rows[y][0])
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in rows}


def near_copies(rng, n, words=60):
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(words)] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    return out


def corpus():
    rng = random.Random(7)
    texts = near_copies(rng, 60) + near_copies(rng, 9) + near_copies(rng, 2) + [" ".join(rng.choice("abcdefgh") * 3 for _ in range(40)) for _ in range(10)]
    texts += ["One two three.", "one TWO three", "", "?!", None, "Çà ÇÀ été naïve", "Çà ÇÀ été naïve"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def check(spark, rows):
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_classes_match_brute_force(spark):
    check(spark, corpus())


def test_tiles_match_brute_force(spark, monkeypatch):
    """With small limits, hot groups go through visits to large components and through tiles of crowded buckets."""
    for name, value in (("LARGE_COMPONENT", 8), ("TILE_ROWS", 7), ("SMALL_BUCKET", 2), ("CENTRE_ROUNDS", 1)):
        monkeypatch.setattr(minhash, name, value)
    check(spark, corpus())


@pytest.mark.parametrize("whole", [0, 100])
def test_tiles_alone_match_brute_force(spark, monkeypatch, whole):
    for name, value in (("WHOLE_GROUP_TILES", whole), ("LARGE_COMPONENT", 10**6), ("TILE_ROWS", 7), ("SMALL_BUCKET", 2), ("CENTRE_ROUNDS", 0)):
        monkeypatch.setattr(minhash, name, value)
    check(spark, corpus())


@pytest.mark.parametrize("seed", [15, 49])
def test_small_bucket_with_one_member_of_a_large_component(spark, seed):
    """The last document shares buckets with no other but the edge of a group of 71, and those buckets are small."""
    base = [f"w{k}" for k in range(300)]
    edge = [*base, *(f"t{seed}x{k}" for k in range(70))]
    rows = list(enumerate([*(" ".join([*base, f"v{k}"]) for k in range(70)), " ".join(edge), " ".join(edge[69:])]))
    assert set(brute(rows).values()) == {0}
    check(spark, rows)


def test_long_text_repeats_and_shared_ids(spark):
    long = " ".join(f"t{k % 5000}" for k in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "alpha beta gamma delta epsilon zeta"), (3, "alpha beta gamma delta epsilon zeta"), (4, "same words here again and again"), (5, "one text of five words"), (5, "quite another text of six words")]
    check(spark, rows)


@pytest.mark.parametrize("turned", [False, True])
def test_rows_that_share_an_id_in_any_order(spark, turned):
    """Every text of an id is compared, whichever row comes first."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    c = " ".join(f"c{k}" for k in range(60))
    rows = [(1, a), (1, b), (1, c), (2, b + " more"), (0, c + " more"), (4, None), (4, a + " and more")]
    check(spark, rows[::-1] if turned else rows)


def test_many_copies_meet_their_class(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_COPIES", 3)
    rows = [(k, "one text that is there very often") for k in range(9)] + [(20 + k, "another one that is there twice") for k in range(2)] + [(30, "and a third")]
    check(spark, rows)


def test_keep_one_keeps_columns_and_null_ids(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f!", None), (None, "a b c d e f", "y"), (4, "others are left alone here", "z"), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = minhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r[0] or 0, r[2] or "") for r in got.collect()) == [(0, "y"), (1, "x"), (4, "z"), (5, "")]
    assert minhash.keep_one(docs.limit(0)).count() == 0


def test_signature_agreement_follows_weighted_similarity():
    left, right = "a b c d e f g h i j " * 8 + "k l m n o p q r s t", "a b c d e f g h i j " * 6 + "k l m n o p q r s t"
    texts = pa.array([left, right])
    of, item, count, _ = minhash.bags(texts, 5)
    sig = minhash.dart_signatures(of, item, count, 2, 4000)
    true = minhash.similarity(texts[:1], texts[1:], 5)[0]
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04
    half = minhash.dart_signatures(np.array([0, 0, 1, 1]), np.array([5, 9, 5, 9], np.uint64), np.array([0.5, 1.5, 0.25, 3.5]), 2, 4000)
    assert abs((half[0] == half[1]).mean() - (0.25 + 1.5) / (0.5 + 3.5)) < 0.04


def test_components_of_chains_and_cycles(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (200, 150), (150, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100, 150: 150, 200: 150}


def test_features_count_every_repeat(spark):
    """Shared features are the shared weight, also of shingles that occur more than 65,536 times."""
    sizes = [70_000, 150_000, 149_000]
    texts = spark.createDataFrame([(k, "a " * n + "b c") for k, n in enumerate(sizes)], "id long, text string")
    rows = {r["id"]: r["features"] for r in minhash.features_of(texts, 5).collect()}
    assert [len(set(rows[k])) for k in range(3)] == [n - 2 for n in sizes]
    assert len(set(rows[1]) & set(rows[2])) == 149_000 - 4 + 2 and len(set(rows[0]) & set(rows[1])) == 70_000 - 4 + 2


def test_a_chain_of_long_repeats_is_one_class(spark):
    """Each text is 1.1 times as long as the one before: 0.91 alike, whatever the length is."""
    texts = [("a " * int(70_000 * 1.1**k), k) for k in range(6)] + [("a " * int(700 * 1.1**k), 100 + k) for k in range(6)]
    got = {r["doc_id"]: r for r in minhash.classes(spark.createDataFrame([(k, t) for t, k in texts], "doc_id long, text string")).collect()}
    column = next(c for c in got[0].asDict() if "class" in c)
    assert len({got[k][column] for k in range(6)}) == 1 and len({got[100 + k][column] for k in range(6)}) == 1
