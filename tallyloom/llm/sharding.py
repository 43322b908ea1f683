"""Shards of nearly equal bytes, by Karmarkar-Karp differencing of indivisible groups.

Documents with equal texts form a group that stays together. Groups are dealt to chunks by the hash of their text. In
each chunk every group starts as a partial partition (its bytes in one of the shards, nothing in the others); the two
partial partitions of largest spread are combined, the largest part of one with the smallest of the other, until one is
left. The chunks' partitions are then combined by the same rule, in a tree of bounded fan-in, so that no task holds more
than `CHUNK` groups. Copies are summed before anything is shuffled by group.

Defined cases: a null text has no bytes (size 8, crc32 0) and null texts are one group, apart from empty texts; repeated rows
each get a slot; an empty table gives no rows; sizes are equal up to what a group larger than a share makes impossible.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpoint

SHARDS = 24
CHUNK = 1 << 15
FAN_IN = 512
SLOT_ROWS = 20_000


def difference(parts: np.ndarray) -> np.ndarray:
    """For n partial partitions into k parts (n x k sums), the k-way label that each part gets: n x k."""
    n, k = parts.shape
    labels = np.zeros((n, k), np.int32)
    if not n:
        return labels
    first = np.argsort(-parts, axis=1, kind="stable")
    sums = np.zeros((2 * n - 1, k), np.int64)
    sums[:n] = np.take_along_axis(parts, first, axis=1)
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums[:n])]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    for m in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        sums[m] = both[order]
        made.append((a, b, order))
        heapq.heappush(heap, (-int(sums[m, 0] - sums[m, -1]), m))
    got = np.zeros((2 * n - 1, k), np.int32)
    got[2 * n - 2] = np.arange(k)
    for m in range(2 * n - 2, n - 1, -1):
        a, b, order = made[m - n]
        up = np.empty(k, np.int32)
        up[order] = got[m]
        got[a], got[b] = up, up[::-1]
    np.put_along_axis(labels, first, got[:n], axis=1)
    return labels


def _combined(parts: DataFrame, shards: int) -> DataFrame:
    """(chunk, label, shard) for the chunks' partitions (chunk, label, bytes), by levels of FAN_IN chunks."""
    spark, level = parts.sparkSession, 0
    cells = parts.select("chunk", "label", "bytes")
    maps = []
    while True:
        n = cells.select("chunk").distinct().count()
        cells = cells.withColumn("parent", F.floor(F.col("chunk") / FAN_IN).cast("int"))

        def join_level(pdf: pd.DataFrame) -> pd.DataFrame:
            wide = pdf.pivot_table(index="chunk", columns="label", values="bytes", fill_value=0, aggfunc="sum").reindex(columns=range(shards), fill_value=0)
            got = difference(wide.to_numpy(np.int64))
            return pd.DataFrame({"chunk": np.repeat(wide.index.to_numpy(np.int32), shards), "label": np.tile(np.arange(shards, dtype=np.int32), len(wide)), "parent": np.int32(pdf["parent"].iloc[0]), "up": got.reshape(-1), "bytes": wide.to_numpy(np.int64).reshape(-1)})

        done = checkpoint(cells.groupBy("parent").applyInPandas(join_level, "chunk int, label int, parent int, up int, bytes long"))
        maps.append(done)
        if n <= FAN_IN:
            break
        cells = done.groupBy(F.col("parent").alias("chunk"), F.col("up").alias("label")).agg(F.sum("bytes").alias("bytes"))
        level += 1
    out = maps[0].select("chunk", "label", F.col("parent").alias("at"), F.col("up").alias("shard"))
    for m in maps[1:]:
        step = m.select(F.col("chunk").alias("at"), F.col("label").alias("shard"), F.col("parent").alias("next"), F.col("up").alias("next_shard"))
        out = out.join(step, ["at", "shard"]).select("chunk", "label", F.col("next").alias("at"), F.col("next_shard").alias("shard"))
    return out.select("chunk", "label", "shard")


def assign(groups: DataFrame, shards: int = SHARDS, chunk: int = CHUNK) -> DataFrame:
    """(key, shard) for groups (key, bytes) with different keys."""
    groups = checkpoint(groups.select("key", F.col("bytes").cast("long").alias("bytes")))
    chunks = max(1, -(-groups.count() // chunk))
    dealt = groups.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        start = np.zeros((len(pdf), shards), np.int64)
        start[:, 0] = pdf["bytes"]
        return pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "label": difference(start)[:, 0], "bytes": pdf["bytes"]})

    local = checkpoint(dealt.groupBy("chunk").applyInPandas(one, "key string, chunk int, label int, bytes long"))
    top = _combined(local.groupBy("chunk", "label").agg(F.sum("bytes").alias("bytes")), shards)
    return local.join(top, ["chunk", "label"]).select("key", "shard")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHARDS) -> DataFrame:
    """Each document's doc_id, size, text_crc32, law, shard, slot and grown_shard."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), F.coalesce(F.concat(F.md5(text), F.hex(F.octet_length(text))), F.lit("null")).alias("key"))
    rows = checkpoint(rows)
    placed = assign(rows.groupBy("key").agg(F.sum("size").alias("bytes")), n)
    cells = max(1, -(-rows.count() // (n * SLOT_ROWS)))
    rows = checkpoint(rows.join(placed, "key").withColumn("cell", F.pmod(F.xxhash64("id", "key"), F.lit(cells)).cast("int")))
    before = rows.groupBy("shard", "cell").count().withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count"))
    turn = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "key")) - 1
    out = rows.withColumn("turn", turn).join(F.broadcast(before.select("shard", "cell", "before")) if n * cells <= 100_000 else before.select("shard", "cell", "before"), ["shard", "cell"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("turn")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
