"""Each registered query on the smallest tables against a plain version of what it returns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import public_tokenizers
from scenequery.llm import bpe, common, queries
from test_text_operators import linked

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in common.documents(spark, SF).collect()}


def run(spark, n):
    return queries.QUERIES[next(q for q in queries.QUERIES if q.startswith(f"op{n}_"))](spark, SF)


def test_all_thirteen_are_there():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES] == list(range(1, 14))


def test_op1(spark, docs):
    want = linked([(i, r.text) for i, r in docs.items()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, 1).collect()} == want


def test_op2(spark, docs):
    got = {r.doc_id: r for r in run(spark, 2).collect()}
    for i, d in docs.items():
        raw = d.text.encode()
        padded = raw + b" " * (-len(raw) % 192 or 0)
        assert (got[i].n_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def test_op3(spark, docs):
    from tokenizers import Tokenizer

    whole, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r in run(spark, 3).orderBy("doc_id").collect():
        ids = [*whole.encode(docs[r.doc_id].text, add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op4(spark, docs):
    import tiktoken

    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in run(spark, 4).collect():
        ids = whole.encode_ordinary(docs[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].text.encode()).hexdigest())


def test_op5_finds_each_query_itself(spark, docs):
    got = run(spark, 5).collect()
    assert {r.query_id for r in got} == {i for i in docs if i % 50 == 0}
    best = {r.query_id: r for r in got if r["rank"] == 1}
    assert all(docs[q].text.split() and docs[r.doc_id].text.split() for q, r in best.items())


def test_op6_agrees_with_clean_labels(spark, docs):
    got = {r.doc_id: r.toxic for r in run(spark, 6).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(got) == set(docs) and sum(got[i] for i, t in labels.items() if not t) <= 0.02 * len(labels)


def test_op8(spark, docs):
    rows = run(spark, 8).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(docs) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id].text.encode()) + 1, zlib.crc32(docs[r.doc_id].text.encode()), "rows", None) for r in rows)


def test_op9(spark, docs):
    rows = run(spark, 9).collect()
    taken = Counter()
    target = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[docs[r.doc_id].source] += r.taken
        target[docs[r.doc_id].source] = r.target
    assert len(rows) == len(docs) and all(abs(taken[s] - t) <= 0.03 * t + 64 for s, t in target.items())


def test_op10_on_what_was_held_out(spark, docs):
    rows = run(spark, 10).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
