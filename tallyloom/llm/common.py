"""Small shared pieces of the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass looks at; bounds a task's memory whatever the batch size is.
SLICE_BYTES = 2 << 20
SLICE_ROWS = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that do not clash with the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; set a folder of our own only where none is named, on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "spark-checkpoints"))


def checkpoint(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared checkpoint folder and read again, so that later steps survive the loss
    of executors, read only the columns they need, and know the table's size."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete what checkpoint() wrote for tables that nothing reads any more."""
    for df in tables:
        if df is not None and hasattr(df, "written_to"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has no more than so many rows."""
    return (df.limit(rows + 1) if rows < 1000 else df).count() <= rows


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Parts of an Arrow batch with about `most` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    offsets = text_offsets(batch.column(column))
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n, at + SLICE_ROWS)
        yield batch.slice(at, to - at)
        at = to


def text_offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    buf = arr.buffers()[1]
    if buf is None:
        return np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(buf, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text starts (one more than texts); null is empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    offsets = text_offsets(arr)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def string_input(df: DataFrame, column: str):
    return F.col(column).cast("string")
