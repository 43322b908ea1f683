"""Centroid clustering of integer vectors by bit planes and popcounts.

A vector of 64 components keeps, for each bit of their two's complement, one 64-bit number that holds this bit of all
components. The dot product of two vectors is then the sum over pairs of planes of popcount(plane AND plane), weighted by
the powers of two of both (negative for the sign's plane): exact, as are the squared distances and the sums of a cluster's
components, which are popcounts of columns. The planes are made once and stored; each round reads them, and a task gives
at most one row of sums per centroid. Centroids are all that the driver holds and sends out: `k` times 64 numbers.

Defined cases: vectors that are null, have another number of components, or hold null, infinite or NaN components are left
out; a null vec_id comes last among the first centroids; rows that share an id, and equal vectors, count each for itself;
with fewer than k vectors there are fewer centroids; an empty table gives no rows; other columns are not looked at;
components beyond `LARGEST` raise an error, as distances would no longer fit 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpoint

COMPONENTS = 64
#: Scaled components lie between -LARGEST and LARGEST, so that squared distances stay below 2 ** 63.
LARGEST = 1 << 27
#: Vectors that one numpy pass looks at.
ROWS = 1 << 14


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """The planes (n x width) of integer vectors (n x 64)."""
    out = np.empty((len(values), width), np.uint64)
    for bit in range(width):
        ones = ((values >> bit) & 1).astype(np.uint8)
        out[:, bit] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def weights(width: int) -> np.ndarray:
    """What a one in each plane counts."""
    out = np.int64(1) << np.arange(width, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def dots(planes: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Dot products of all vectors with one vector (its planes)."""
    weight = weights(planes.shape[1])
    out = np.zeros(len(planes), np.int64)
    for bit, plane in enumerate(one):
        out += weight[bit] * (np.bitwise_count(planes & plane).astype(np.int64) @ weight)
    return out


def norms(planes: np.ndarray) -> np.ndarray:
    """Squared lengths of all vectors."""
    weight = weights(planes.shape[1])
    out = np.zeros(len(planes), np.int64)
    for bit in range(planes.shape[1]):
        out += weight[bit] * (np.bitwise_count(planes & planes[:, bit : bit + 1]).astype(np.int64) @ weight)
    return out


def nearest(planes: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's centroid, the first of equally near ones, and the squared distance to it."""
    of, least = np.zeros(len(planes), np.int32), np.full(len(planes), np.iinfo(np.int64).max)
    for k, centroid in enumerate(centroids):
        own = pack(centroid[None, :], planes.shape[1])[0]
        far = norm + int(centroid @ centroid) - 2 * dots(planes, own)
        closer = far < least
        of[closer], least[closer] = k, far[closer]
    return of, least


def component_sums(planes: np.ndarray) -> np.ndarray:
    """The 64 sums of the vectors' components."""
    width = planes.shape[1]
    ones = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(len(planes), width, 8), axis=2, bitorder="little")
    return weights(width) @ ones.sum(axis=0, dtype=np.int64)


def _blocks(batch: pa.RecordBatch, width: int):
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        col = part.column("planes")
        offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
        data = col.buffers()[2][int(offsets[0]) : int(offsets[-1])]
        yield part, np.frombuffer(data, np.uint64).reshape(len(col), width), part.column("norm").to_numpy()


def _packed(vectors: DataFrame, width: int) -> DataFrame:
    """(id, planes, norm) of vectors (id, v)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = batch.column("v").flatten().to_numpy().reshape(-1, COMPONENTS)
                planes = pack(np.floor(x * 1024).astype(np.int64), width)
                ends = np.arange(len(planes) + 1, dtype=np.int32) * (8 * width)
                packed = pa.Array.from_buffers(pa.binary(), len(planes), [None, pa.py_buffer(ends), pa.py_buffer(planes)])
                yield pa.RecordBatch.from_arrays([batch.column("id"), packed, pa.array(norms(planes))], ["id", "planes", "norm"])

    return vectors.mapInArrow(run, "id long, planes binary, norm long")


def _totals(packed: DataFrame, centroids: np.ndarray, width: int) -> dict[int, tuple[int, int, np.ndarray]]:
    """For each centroid that has vectors: their number, the sum of their distances and the sums of their components."""

    def run(batches):
        n, far, sums = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64), np.zeros((len(centroids), COMPONENTS), np.int64)
        for batch in batches:
            for _, planes, norm in _blocks(batch, width):
                of, least = nearest(planes, norm, centroids)
                for k in np.unique(of):
                    own = of == k
                    n[k] += own.sum()
                    far[k] += least[own].sum()
                    sums[k] += component_sums(planes[own])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(far[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["k", "n", "far", "sums"])

    told = packed.select("planes", "norm").mapInArrow(run, "k int, n long, far long, sums array<long>")
    summed = told.groupBy("k").agg(F.sum("n"), F.sum("far"), F.array(*(F.sum(F.col("sums")[d]) for d in range(COMPONENTS))))
    return {k: (n, far, np.array(sums, np.int64)) for k, n, far, sums in summed.collect()}


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector kept: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    value = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), value.alias("v")).where((F.size("v") == COMPONENTS) & finite)
    low, high = kept.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    low, high = (0.0 if x is None else np.floor(x * 1024) for x in (low, high))
    if not -LARGEST <= low <= high <= LARGEST:
        raise ValueError(f"components times 1024 must lie between -{LARGEST} and {LARGEST}")
    width = 1 + max(int(high).bit_length(), int(-low - 1).bit_length() if low < 0 else 0)
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = np.floor(np.array([r["v"] for r in first], np.float64).reshape(-1, COMPONENTS) * 1024).astype(np.int64)
    packed = checkpoint(_packed(kept, width))
    for _ in range(rounds):
        for c, (n, _, sums) in _totals(packed, centroids, width).items():
            centroids[c] = sums // n
    far = {c: t[1] for c, t in _totals(packed, centroids, width).items()}
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    inertia = sum(far.values())

    def run(batches):
        for batch in batches:
            for part, planes, norm in _blocks(batch, width):
                of, least = nearest(planes, norm, centroids)
                own = pa.array([far[c] for c in of.tolist()], pa.int64())
                sha = pa.DictionaryArray.from_arrays(of, pa.array(shas, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(of), pa.array(least), own, pa.array(np.full(len(of), inertia, np.int64)), sha], ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    out = packed.mapInArrow(run, "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.withColumnRenamed("id", id_col)
