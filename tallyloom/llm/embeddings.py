"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, full precision where they can't decide.

Equal vectors are merged first. The different ones are dealt to tiles by hash, and every pair of tiles meets in one
task as int8 codes, scales and errors of the unit vectors. With a vector's code c, scale s and error e = |u - s c|, the true cosine of u and
v is within e_v + (1 + e_v) e_u of s_u s_v (c_u . c_v); the integer product is exact in float32. Only pairs whose bound
reaches the threshold, without their lower bound doing so too, are computed again in double precision: a task hands on up
to `OPEN_PAIRS` such pairs, which then meet their vectors; where it has more, its two tiles meet again with their vectors.
Of all else a task hands on link counts and a spanning forest, so a group of n near copies costs it no more than n rows.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths do not link; rows with a null vec_id are compared like all others, each a node of its own: they count as
links and connect, and only where no vec_id is reachable is component_id null, one row of such a component being kept; rows
that share a vec_id count as vectors of their own but are one node of the graph; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpoint
from tallyloom.llm.components import components

THRESHOLD = 0.9
TILE_ROWS = 8192
#: So many tiles at least, that small tables too are shared by many tasks.
MIN_TILES = 6
BLOCK = 512
#: Pairs that codes can't decide and that a task of two tiles hands on.
OPEN_PAIRS = 8192
_EXACT_DIM = (1 << 24) // (127 * 127)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of the rows of x, which have length 1."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    error = np.linalg.norm(x - codes * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return codes, scale, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, as float32 or (for long vectors) float64."""
    out = None
    for k in range(0, a.shape[1], _EXACT_DIM):
        part = a[:, k : k + _EXACT_DIM].astype(np.float32) @ b[:, k : k + _EXACT_DIM].astype(np.float32).T
        out = part if out is None and a.shape[1] <= _EXACT_DIM else part.astype(np.float64) if out is None else out + part
    return out


class Unions:
    """Union-find over row numbers that takes whole arrays of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.label[u], self.label[v]
            differ = a != b
            if not differ.any():
                return
            u, v, a, b = u[differ], v[differ], a[differ], b[differ]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(jump := self.label[self.label], self.label):
                self.label = jump


def linked(x: np.ndarray | None, codes, scale, error, rows: np.ndarray, cols: np.ndarray, threshold: float):
    """Links between rows and cols (numbers of vectors), block by block, as pairs of numbers, and the pairs that codes can't
    decide; with the unit vectors x those are decided too."""
    slack = 1e-6
    e_top = error[cols].max()
    none = np.zeros(0, np.int64)
    for k in range(0, len(rows), BLOCK):
        r = rows[k : k + BLOCK]
        p = products(codes[r], codes[cols])
        p *= scale[cols].astype(p.dtype)
        least = (threshold - slack - error[r] - (1 + error[r]) * e_top) / scale[r]
        i, j = np.nonzero(p >= least.astype(p.dtype)[:, None])
        near, u, v = p[i, j].astype(np.float64) * scale[r[i]], r[i], cols[j]
        bound = error[u] + (1 + error[u]) * error[v] + slack
        ok, open_ = near - bound >= threshold, near + bound >= threshold
        again = np.flatnonzero(open_ & ~ok)
        if x is None:
            yield u[ok], v[ok], u[again], v[again]
            continue
        for a in range(0, len(again), 1 << 16):
            some = again[a : a + (1 << 16)]
            ok[some] = np.einsum("ij,ij->i", x[u[some]], x[v[some]]) >= threshold
        yield u[ok], v[ok], none, none


def _cell(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """What two tiles (or one with itself) tell. Sort 0: how many vectors of the other tile a vector links with, and its
    local root. Sort 1: the heads of a pair that codes can't decide. Sort 2: the tiles have too many such pairs."""
    hid, ids, copies, tile = (pdf[c].to_numpy() for c in ("hid", "id", "copies", "tile"))
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    if "unit" in pdf:
        x = np.stack(pdf["unit"].to_numpy())
        codes, scale, error = quantise(x)
    else:
        x, codes = None, np.stack([np.frombuffer(c, np.int8) for c in pdf["code"]])
        scale, error = pdf["scale"].to_numpy(), pdf["error"].to_numpy()
    rows, cols, one = np.flatnonzero(tile == i), np.flatnonzero(tile == j), i == j
    links, groups, open_, n_open = np.zeros(len(ids), np.int64), Unions(len(ids)), [], 0
    if len(rows) and len(cols):
        for u, v, a, b in linked(x, codes, scale, error, rows, cols, threshold):
            if one:
                u, v = u[u != v], v[u != v]
                a, b = a[a < b], b[a < b]
            n_open += len(a)
            if n_open > OPEN_PAIRS:
                return pd.DataFrame({"sort": [2], "hid": [i], "id": [j], "links": [codes.shape[1]], "root": [0]})
            open_.append((hid[a], hid[b]))
            links += np.bincount(u, copies[v], minlength=len(ids)).astype(np.int64)
            if not one:
                links += np.bincount(v, copies[u], minlength=len(ids)).astype(np.int64)
            groups.add(u, v)
    some = np.flatnonzero(links)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, groups.label, ids)
    told = pd.DataFrame({"sort": 0, "hid": hid[some], "id": ids[some], "links": links[some], "root": least[groups.label[some]]})
    if not n_open:
        return told
    left, right = (np.concatenate(x) for x in zip(*open_, strict=True))
    return pd.concat([told, pd.DataFrame({"sort": 1, "hid": left, "id": right, "links": 0, "root": 0})])


def _coded(batches):
    for batch in _by_length(batches, "unit"):
        code, scale, error = quantise(_matrix(batch.column("unit")))
        kept = [batch.column(c) for c in ("hid", "id", "copies", "tile", "dim")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale, pa.float64()), pa.array(error, pa.float64())], ["hid", "id", "copies", "tile", "dim", "code", "scale", "error"])


def _matrix(column) -> np.ndarray:
    """The rows of a column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _decided(pairs: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """Both directions of those open pairs (hid, id being the heads) that link, like the rows of sort 0."""
    side = lambda k: heads.select(*(F.col(c).alias(c + k) for c in ("hid", "id", "copies", "unit")))
    both = pairs.select(F.col("hid").alias("hid_a"), F.col("id").alias("hid_b")).join(side("_a"), "hid_a").join(side("_b"), "hid_b")

    def run(batches):
        for batch in batches:
            u, v = _matrix(batch.column("unit_a")), _matrix(batch.column("unit_b"))
            ok = pa.array(np.einsum("ij,ij->i", u, v) >= threshold)
            for a, b in (("a", "b"), ("b", "a")):
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in (f"hid_{a}", f"id_{a}", f"copies_{b}", f"id_{b}")], ["hid", "id", "links", "root"])

    # Vectors of one length to a batch, as a pair's are.
    return both.mapInArrow(lambda batches: run(_by_length(batches, "unit_a")), "hid long, id long, links long, root long")


def _by_length(batches, column: str):
    for batch in batches:
        sizes = np.array(pa.compute.list_value_length(batch.column(column)))
        for n in np.unique(sizes):
            yield batch.filter(pa.array(sizes == n))


def _units(batches):
    """Each vector at length 1; null where it can't link with anything."""
    for batch in batches:
        out = []
        for x in batch.column("unit").to_pylist():
            x = np.array(x or [], np.float64)  # a null component is NaN
            top = np.abs(x).max(initial=0)
            x = x / top if np.isfinite(top) and top > 0 else x[:0]
            out.append(x / np.sqrt(x @ x) if len(x) and np.isfinite(x).all() else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("nameless"), pa.array(out, pa.list_(pa.float64()))], ["id", "nameless", "unit"])


def near(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept."""
    # A row without an id gets a node number from the other end of the longs, so that ids stay the smallest of a component.
    node = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1) - F.monotonically_increasing_id())
    rows = vectors.select(node.alias("id"), F.col(id_col).isNull().alias("nameless"), F.col(vector_col).cast("array<double>").alias("unit"))
    rows = checkpoint(rows.mapInArrow(_units, "id long, nameless boolean, unit array<double>"))
    heads = rows.where("unit is not null").groupBy("unit").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    heads = checkpoint(heads.withColumn("hid", F.monotonically_increasing_id()))
    n = heads.count()
    tiles = max(MIN_TILES, -(-n // TILE_ROWS))
    dealt = heads.withColumn("tile", F.pmod(F.xxhash64("unit"), F.lit(tiles)).cast("int")).withColumn("dim", F.size("unit"))
    coded = checkpoint(dealt.select("hid", "id", "copies", "tile", "dim", "unit").mapInArrow(_coded, "hid long, id long, copies long, tile int, dim int, code binary, scale double, error double"))
    met = lambda df: df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("i", F.least("tile", "k")).withColumn("j", F.greatest("tile", "k")).drop("k")
    schema = "sort int, hid long, id long, links long, root long"
    told = checkpoint(met(coded).groupBy("dim", "i", "j").applyInPandas(lambda pdf: _cell(pdf, threshold), schema))
    undecided = told.where("sort = 2").select(F.col("hid").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.col("links").cast("int").alias("dim"))
    cells = undecided.withColumn("tile", F.explode(F.array_distinct(F.array("i", "j"))))
    again = dealt.select("hid", "id", "copies", "tile", "dim", "unit").join(cells, ["dim", "tile"])
    again = again.groupBy("dim", "i", "j").applyInPandas(lambda pdf: _cell(pdf, threshold), schema)
    found = told.where("sort = 0").union(again).drop("sort").union(_decided(told.where("sort = 1"), heads, threshold))
    found = checkpoint(found)
    own = heads.select("unit", "hid", F.col("id").alias("head"), "copies")
    known = rows.where("unit is not null").join(own, "unit").select("id", "nameless", "hid", "head", "copies")
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(known.select(F.col("id").alias("a"), F.col("head").alias("b")))
    labels = components(edges.where("a <> b").distinct())
    sums = found.groupBy("hid").agg(F.sum("links").alias("links"))
    counted = known.join(sums, "hid", "left").select("id", "nameless", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lone = rows.where("unit is null").select("id", "nameless", F.lit(0).cast("long").alias("n_links"))
    out = counted.unionByName(lone).join(labels.withColumnRenamed("node", "id"), "id", "left")
    out = out.withColumn("component", F.coalesce("component", "id")).withColumn("kept", F.col("component") == F.col("id"))
    no_ids = rows.where("nameless").select(F.col("id").alias("component"), F.lit(True).alias("no_id"))
    out = out.withColumn("no_id", F.lit(None).cast("boolean")) if no_ids.isEmpty() else out.join(no_ids, "component", "left")
    return out.select(F.when(~F.col("nameless"), F.col("id")).alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.when(F.col("no_id").isNull(), F.col("component")).alias("component_id"), "kept")
