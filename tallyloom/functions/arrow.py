"""Arrow batches in parts of bounded size, for work that turns texts into Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose Python objects exist at one time; bounds a task's memory whatever the batch size is.
PART_BYTES = 1 << 20


def parts(batch: pa.RecordBatch | pa.Array, texts: pa.Array | None = None, most: int = PART_BYTES) -> Iterator:
    """batch (with its texts; none: it is an array of them) cut into parts of about `most` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch if texts is None else texts), 0)
    ends = np.cumsum(np.asarray(sizes, np.int64))
    at, done = 0, 0
    while at < len(ends):
        to = max(int(np.searchsorted(ends, done + most, side="right")), at + 1)
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])
