"""Byte-level BPE encoding and decoding by a local rank file.

`encode` and `decode` work on Arrow batches; the rank file (checked to be small) is broadcast, so executors need no
local copy of it. Special tokens are never made: their strings are ordinary text.

Defined cases: a null or empty text has no ids and decodes to empty bytes; very long texts are cut where the split
pattern always ends a match, so the ids are those of the whole text; extra columns are kept by `encode`.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import fresh, slices

#: The largest rank file that is sent to executors.
MAX_RANK_BYTES = 16 << 20
#: Texts of more characters than this are cut before they are encoded.
PIECE_CHARS = 1 << 16
#: A letter, digit or punctuation mark before a space or line feed: no match of the pattern spans this place, and what
#: follows is matched as it would be at the start of a text.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n])")

#: White space as the split pattern has it, in runs so long that the pattern would exhaust its stack.
_LONG_SPACE = regex.compile(r"\p{White_Space}{1024,}")

_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    """tiktoken's encoding of one rank file and split pattern, with cuts for long texts."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        self.decimal = [b"%d" % i for i in range(top)]
        self.token_bytes = [b""] * top
        for k, i in ranks.items():
            self.token_bytes[i] = k

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE_CHARS:
            cut = _SAFE.search(text, at + PIECE_CHARS)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) < 1024:
            return self.encoding.encode_ordinary(text)
        ids, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            # The pattern matches a run at the end of a text as a whole, and any other but for its last character, which
            # goes with what follows. It never matches across the start of a run.
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self._plain(text[at : run.start()])
            ids += self.encoding._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in self.encoding.encode_ordinary(piece)]

    def decode(self, ids) -> bytes | None:
        """The bytes of ids; null if one of them is none of the ranks."""
        if len(ids) and not (0 <= min(ids) and max(ids) < len(self.token_bytes)):
            return None
        return b"".join(map(self.token_bytes.__getitem__, ids))


def codec(rank_file: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def _shared(spark: SparkSession, rank_path: str):
    with open(rank_path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"rank file over {MAX_RANK_BYTES} bytes: {rank_path}")
    return spark.sparkContext.broadcast(data)


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with the token ids of every text, in ids_col (with a final _ where df has a column of that name)."""
    (ids_col,) = fresh(df, ids_col)
    ranks = _shared(df.sparkSession, rank_path)
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        c = codec(ranks.value, pattern)
        for whole in batches:
            for batch in slices(whole, text_col):
                ids = [c.encode(t.as_py()) for t in batch.column(text_col)]
                lengths = np.fromiter(map(len, ids), np.int32, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))
                col = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*batch.columns, col], [*batch.schema.names, ids_col])

    return df.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the raw bytes that the ids stand for, in bytes_col (with a final _ where df has a column of that name); null
    ids, and ids outside the ranks, give null."""
    (bytes_col,) = fresh(df, bytes_col)
    ranks = _shared(df.sparkSession, rank_path)
    schema = T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches):
        c = codec(ranks.value, pattern)
        for batch in batches:
            col = pa.array([None if x is None else c.decode(x) for x in batch.column(ids_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, col], [*batch.schema.names, bytes_col])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """df, without its text, with n_tokens, ids_sha256, decoded_sha256 and round_trip (decoded bytes are the text's).

    Ids and decoded bytes of one text at a time live in the task; only digests leave it.
    """
    ranks = _shared(df.sparkSession, rank_path)
    rest = [c for c in df.columns if c != text_col]
    names = fresh(df.drop(text_col), "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.BooleanType()]
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(n, k, False) for n, k in zip(names, kinds, strict=True))])

    def run(batches):
        c = codec(ranks.value, pattern)
        for whole in batches:
            for batch in slices(whole, text_col):
                n, ids_sha, out_sha, same = [], [], [], []
                for t in batch.column(text_col):
                    text = t.as_py() or ""
                    ids = c.encode(text)
                    raw = c.decode(ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(b" ".join(map(c.decimal.__getitem__, ids))).hexdigest())
                    out_sha.append(hashlib.sha256(raw).hexdigest())
                    same.append(raw == text.encode())
                cols = [pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(out_sha), pa.array(same)]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), *cols], [*rest, *names])

    return df.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
