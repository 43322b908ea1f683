"""Packing against the tokenizers library, and the curve against its definition."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tallyloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_once_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    key = packing.hilbert(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    along = cells[np.argsort(key)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_equal_texts_have_one_key_and_kindred_ones_are_near():
    import pyarrow as pa

    texts = ["alpha beta gamma " * 50, None, "der die das und " * 50, "alpha beta gamma " * 49 + "delta", "alpha beta gamma " * 50, ""]
    x = packing.project(pa.array(texts))
    assert (x[0] == x[4]).all() and not x[1].any() and not x[5].any()
    assert np.abs(x[0] - x[3]).max() < np.abs(x[0] - x[2]).max() / 4


SPECIAL = "one<|endoftext|>two  <|endoftext|>"
TEXTS = [None, "", "x", "Hello, world's  end\n\n", SPECIAL, " " * 5000, "a" + " " * 3000 + "b", "ñandú 東京 🙂 " * 40, "\x00\x7f ", *(f"document {k} of a kind, number {k * k}. " * (k % 37 + 1) for k in range(150)), *["the same text again and again. " * 30] * 60, "no break here" * 12_000, "word and word " * 12_000]


@pytest.mark.parametrize("text", TEXTS[:12] + TEXTS[-2:])
def test_ids_are_those_of_the_tokenizers_library(tokenizer, text):
    from tallyloom.llm import bpe

    ranks, pattern, special = packing.read_tokenizer(PATH)
    want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    assert packing.ids_of(text, bpe.codec(ranks, pattern), special).tolist() == want


def held(rows):
    """doc_id -> pieces; checks the sequences."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        documents[r["doc_id"]].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0  # no padding
    return documents


def test_every_id_is_in_one_piece_and_nothing_is_padded(spark, tokenizer):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, start int").repartition(4)
    documents = held(packing.pack(docs, PATH).collect())
    assert sorted(documents) == list(range(len(TEXTS)))
    for k, t in enumerate(TEXTS):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(documents[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_neighbours_share_sequences(spark):
    """Two kinds of documents in turn: along the curve few sequences hold both."""
    kinds = ["red green blue yellow orange purple ", "uno dos tres cuatro cinco seis siete "]
    docs = spark.createDataFrame([(k, kinds[k % 2] * (5 + k % 7)) for k in range(600)], "doc_id long, text string").coalesce(1)
    kind = defaultdict(set)
    for r in packing.pack(docs, PATH).collect():
        kind[r["sequence_id"]].add(r["doc_id"] % 2)
    assert sum(len(x) == 2 for x in kind.values()) <= 12


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "a b c"), (None, "a b c"), (5, "again"), (5, "again"), (5, "other")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    documents = held(got)
    assert sum(r["length"] for r in documents[None]) == 2 * documents[None][0]["doc_tokens"] and len(documents[5]) >= 3
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        packing.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
