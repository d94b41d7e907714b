import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumaframe.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(RANKS, P.PATTERN)
TOLD = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", " ", "Hello  world's 123\n\n x", "aaaaaaaaaaaaaaaa", "é" * 700, "naïve ÜBER straße 漢字", "<|endoftext|>", "a" * 3000 + "b" * 77, "thethethe" * 500, "​\t\x1c x"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_library(text):
    ids = np.frombuffer(CODEC.encode(text), "<u4").tolist()
    assert ids == TOLD.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)).decode() == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == TOLD.encode_ordinary(text)


def test_rank_queue_orders_and_skips():
    queue = bpe.RankQueue(50_000)
    for rank, position in [(49_999, 3), (7, 9), (7, 2), (4096, 1), (63, 5), (64, 4)]:
        queue.push(rank, position)
    assert [queue.pop() for _ in range(6)] == [(7, 2), (7, 9), (63, 5), (64, 4), (4096, 1), (49_999, 3)]
    assert not queue.root and not any(queue.leaf) and not queue.buckets


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "Hello there", None), (2, "Hello there", None), (None, "x" * 5000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip(df, PATH, P.PATTERN).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(TOLD.encode_ordinary(t or "")) for _, t, _ in rows)
    for r in got:
        if r.doc_id is None:
            assert r.decoded_sha256 == hashlib.sha256(b"x" * 5000).hexdigest()
    kept = bpe.encode(df, PATH, P.PATTERN)
    back = bpe.decode(kept, PATH)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op1_bpe(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(TOLD.encode_ordinary(docs[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_memo_is_bounded_inside_a_text(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 500)
    monkeypatch.setattr(bpe, "SPLIT_CHARS", 1000)
    codec = bpe.Codec(RANKS, P.PATTERN)
    text = " ".join(f"w{i * 7919}" for i in range(20_000))
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == TOLD.encode_ordinary(text)
    assert len(codec.memo) <= 500 and len(codec.memo.old) <= 500


def test_very_long_texts():
    for text in ("long words and lines\n" * 500_000, "x" * 300_000):
        ids = np.frombuffer(CODEC.encode(text), "<u4").tolist()
        assert CODEC.decode(CODEC.encode(text)).decode() == text and (len(text) > 10**6 or ids == TOLD.encode_ordinary(text))
