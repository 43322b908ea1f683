"""Bit planes against plain integer arithmetic."""

import hashlib
import random

import numpy as np
import pytest

from tallyloom.llm import bitplanes


@pytest.mark.parametrize("width", [2, 11, 28])
def test_products_sums_and_norms_are_exact(width):
    rng = np.random.default_rng(width)
    x = rng.integers(-(1 << (width - 1)), 1 << (width - 1), (300, 64))
    x[0], x[1], x[2] = 0, -(1 << (width - 1)), (1 << (width - 1)) - 1
    planes = bitplanes.pack(x, width)
    assert (bitplanes.dots(planes, planes[7]) == x @ x[7]).all()
    assert (bitplanes.norms(planes) == (x * x).sum(axis=1)).all()
    assert (bitplanes.component_sums(planes) == x.sum(axis=0)).all()
    of, far = bitplanes.nearest(planes, bitplanes.norms(planes), x[:5])
    want = ((x[:, None, :] - x[None, :5, :]) ** 2).sum(axis=2)
    assert (of == want.argmin(axis=1)).all() and (far == want.min(axis=1)).all()


def brute(rows, k, rounds):
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    first = sorted(good, key=lambda r: (r[0] is None, digest(r[0]), r[1]))
    centroids = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in good]

    for _ in range(rounds):
        of = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(good, of, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    of = assign()
    inertia = [sum(d for d, c in of if c == n) for n in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(good, of, strict=True)), key=str)


def rows_of(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<double>, cluster string, planes int"


def test_clusters_match_brute_force(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # a group of copies
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
    rows += [(300 + i, v) for i, v in enumerate(bad)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (400, [0.0] * 64), (401, [-3.5] * 64)]
    got = rows_of(bitplanes.cluster(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5), 8, 10))
    assert got == brute(rows, 8, 10)


def test_ties_few_vectors_and_empty_tables(spark):
    rows = [(1, [1.0] + [0.0] * 63), (2, [-1.0] + [0.0] * 63), (3, [0.0] * 64), (4, [0.0] * 64)]
    for k in (2, 8):
        assert rows_of(bitplanes.cluster(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), k, 3)) == brute(rows, k, 3)
    assert bitplanes.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert bitplanes.cluster(spark.createDataFrame([(1, None, "", 0)], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        bitplanes.cluster(spark.createDataFrame([(1, [1e300] + [0.0] * 63, "", 0)], SCHEMA))
