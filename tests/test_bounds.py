"""Work on texts in Python holds the objects of a part of its batch, not of all of it."""

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tallyloom.functions.arrow import PART_BYTES, parts
from tallyloom.operators import pages, price_grids

TEXT = "Denim jacket\n$80.00 $40.00\nBoots\n$60.00 $30.00\nDress\n$50.00 $20.00\n[deal_url:/x]\n" + "word " * 400


class _Texts:
    """What a job asks of its texts; it hands the job one batch and keeps what comes back."""

    def __init__(self, **columns):
        self.columns = list(columns)
        self.batch = pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], self.columns)
        self.schema = T.StructType([T.StructField(c, T.StringType()) for c in self.columns])

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return list(run(iter([self.batch])))


def test_parts_hold_all_rows_in_order():
    texts = pa.array(["a" * 600, None, "", "b" * 500, "c" * 5000, "d", "e"])
    got = [x.to_pylist() for x in parts(texts, most=1000)]
    assert [y for x in got for y in x] == texts.to_pylist() and [len(x) for x in got] == [3, 1, 1, 2]
    assert [x.to_pylist() for x in parts(texts.slice(3, 3), most=1000)] == [["b" * 500], ["c" * 5000], ["d"]]
    assert list(parts(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("job", ["scan", "markers", "pages"])
def test_batches_are_worked_on_in_parts(spark, job):
    n = 4000
    names = [str(k) for k in range(n)]
    if job == "scan":
        out = price_grids.scan(_Texts(doc_id=names, text=[TEXT] * n))
    elif job == "markers":
        out = price_grids._markers(_Texts(source=names, text=[TEXT] * n))
    else:
        out = pages.clean_visible_text(_Texts(page_id=names, html=[TEXT] * n))
    assert [x for b in out for x in b.column(0).to_pylist()] == names
    assert max(b.num_rows for b in out) * len(TEXT) <= PART_BYTES
