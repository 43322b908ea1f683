"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step is two aggregations and a join; the edges are written to the shared checkpoint folder after each round, those of
the round before are deleted, and the number of rounds grows with the logarithm of the longest chain. No task holds a whole
component: a node's neighbours are only reduced to their smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpoint, release

MAX_ROUNDS = 60


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes in each partition, at most one for each node there."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 1_000_000:  # what has been gathered goes out before it fills the task's memory
                yield _pairs(parent, root)
                parent.clear()
        yield _pairs(parent, root)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _pairs(parent, root) -> pa.RecordBatch:
    pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
    a, b = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each node's component, for every node of an edge with two ends.

    edges: long columns a and b; nulls and loops are left out, repeats do no harm, no edges give no rows.
    """
    e = forest(edges.where("a is not null and b is not null and a <> b"))
    e = checkpoint(e.distinct())
    for _ in range(MAX_ROUNDS):
        # Large star: neighbours above a node go to the smallest of its neighbours and itself.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours, and the node, go to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        step = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        step, before = checkpoint(step), e
        release(before)
        if _stars(step):
            e = step
            break
        e = step
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _stars(e: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: each component is a star around its smallest node."""
    twice = e.groupBy("a").count().where("count > 1").select("a")
    inner = e.select("a").join(e.select(F.col("b").alias("a")), "a", "left_semi")
    return twice.union(inner).limit(1).count() == 0
