"""The pipeline against plain Python, stage after stage."""

import base64
import hashlib
import math
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
from test_minhash import brute
from test_text_operators import brute_hits
from test_text_operators import words as words_in

from tallyloom.llm import pii, toxicity
from tallyloom.llm.words import words_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def rejected(spark, docs, labels, texts):
    """Ids of the documents that the fitted weights reject, by a loop over their words."""
    import pyarrow as pa

    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    out = set()
    for k, t in enumerate(texts):
        words = Counter(words_of(pa.array([t or ""])).hash.tolist())
        assert sum(words.values()) == len(words_in(t))
        eta = sum((1 + math.log(n)) * weight.get(h, 0) for h, n in words.items())
        if 1 / (1 + math.exp(model.thresholds[0] - eta)) >= toxicity.REJECT:
            out.add(k)
    return out


def test_pipeline_matches_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("mentions")
    rows = [tuple(r) for r in docs.collect()]
    i, t = docs.columns.index("doc_id"), docs.columns.index("text")
    like = lambda n, text: tuple(n if k == i else text if k == t else None for k in range(len(rows[0])))
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows += [like(10**6, None), like(10**6 + 1, ""), like(None, "a text without an id, mail a.b@example.com"), like(10**6 + 2, rows[0][t]), like(10**6 + 3, f"so {bench[0][1]} end"), rows[1], like(10**6 + 4, "long " * 50_000 + "4532015112830366")]
    rows = [(*r, k) for k, r in enumerate(rows)]
    all_docs = spark.createDataFrame(rows, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in docs.schema)}, bad_key int")
    all_docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")

    bad = rejected(spark, all_docs, spark.read.parquet(f"{SF}/labels.parquet"), [r[t] for r in rows])
    left = [r for k, r in enumerate(rows) if k not in bad]
    heads = brute([(r[i], r[t]) for r in left if r[i] is not None])
    once = {}
    for r in left:
        if r[i] is not None and heads[r[i]] == r[i]:
            once.setdefault(r[i], r)
    left = [*once.values(), *(r for r in left if r[i] is None)]
    hit = Counter((r[0], r[1]) for r in brute_hits([(r[i], r[t]) for r in left], bench) if r[5])
    clean = {r[0] for r in brute_hits([(r[i], r[t]) for r in left], bench) if not r[5]}
    assert sum(hit.values()) and len(clean) < len(left)

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == clean
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    entity = regex.compile(pii.ENTITY)
    worth = lambda i, c: int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4))
    # Long numbers that are no card, by their check digit, stay as they are.
    number = lambda m: regex.fullmatch(r"\d(?:[ -]?\d){12,18}", m) and sum(worth(i, c) for i, c in enumerate(reversed(regex.sub(r"\D", "", m)))) % 10 != 0
    touched = 0
    for r in left:
        if r[i] not in clean:
            continue
        same = hashlib.sha256((r[t] or "").encode()).hexdigest() == got[r[i]]["decoded_sha256"]
        if any(not number(m[0]) for m in entity.finditer(r[t] or "")):
            touched += 1
            assert not same
        else:
            assert same and got[r[i]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, plain.encode_ordinary(r[t] or ""))).encode()).hexdigest()
    assert touched and 10**6 + 2 not in got and 10**6 + 3 not in got


def test_pipeline_of_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
