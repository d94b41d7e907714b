import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumaframe.llm import queries, suffix_dedup

from . import oracle

SF = "/root/testdata/sf0.01"
N = suffix_dedup.LENGTH


def plain(docs):
    """(key, bytes, removed, spans, digest) of each document by a table of all strings."""
    least = {}
    raw = [(k, (t or "").encode()) for k, t in docs]
    for k, b in raw:
        for i in range(len(b) - N + 1):
            s = b[i : i + N]
            if least.get(s, k) >= k:
                least[s] = k
    out = []
    for k, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - N + 1):
            if least[b[i : i + N]] < k:
                gone[i : i + N] = b"\1" * N
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def made(seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "a", "in", "ka", "lo", "mi", "é", "ß", "x" * 9])
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(rng.randrange(9, 60)) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(shared)[rng.randrange(9) :] if rng.random() < 0.4 else line(rng.randrange(3, 50)) for _ in range(rng.randrange(1, 8)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(40)] + [(300, None), (301, ""), (302, "a" * 49), (303, "a" * 50), (304, "a" * 500), (305, "b" + "a" * 70), (306, "ab" * 40), (307, "ba" * 40)]
    docs += [(400, "".join(rng.choice("abcdefgh ") for _ in range(5000)))]
    docs += [(401, docs[-1][1][100:149] + "é" + docs[-1][1][200:250] + "|" + docs[-1][1][300:420] + docs[-1][1][330:500])]
    return docs


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.op2_suffix_dedup(spark, SF)) == plain(docs)


def test_many_buckets_and_edges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 9000)
    monkeypatch.setattr(suffix_dedup, "SHARD_TEXT", 7000)
    docs = made()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, bucket string, n_bytes int")
    got = suffix_dedup.drop_repeated_bytes(df)
    assert rows_of(queries.cut_digests(got)) == plain(docs)
    twice = df.where("doc_id in (3, 200)").union(df.where("doc_id = 3")).union(df.where("doc_id = 3").selectExpr("null", "text", "bucket", "n_bytes"))
    found = sorted(((r.doc_id or -1), r.n_removed) for r in queries.cut_digests(suffix_dedup.drop_repeated_bytes(twice)).collect())
    size = len(dict(docs)[3].encode())
    assert found == [(-1, 0), (3, size), (3, size), (200, size)]
    assert suffix_dedup.drop_repeated_bytes(df.limit(0)).count() == 0


def test_hot_anchors(monkeypatch):
    """The same rows whether the windows of anchors are dealt out on their own or not."""
    docs = made(12)
    want = plain(docs)
    for hot in (0, 3, 10**9):
        monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
        shards = 5
        buckets = [suffix_dedup.Bucket([k for k, _ in part], [t or "" for _, t in part], shards) for part in (docs[0::3], docs[1::3], docs[2::3])]
        told = [[] for _ in buckets]
        for s in range(shards):
            rows = [(n, suffix_dedup._unpack_rising(body)) for n, b in enumerate(buckets) for shard, body in b.anchor_rows() if shard == s]
            if rows:
                for (n, _), f in zip(rows, suffix_dedup.shared_anchors([r for _, r in rows]), strict=True):
                    told[n].append((s, np.packbits(f, axis=1).tobytes()))
        for b, t in zip(buckets, told, strict=True):
            b.choose(t)
        back = [[] for _ in buckets]
        for s in range(shards):
            rows = [(n, suffix_dedup._unpack(body)) for n, b in enumerate(buckets) for shard, body in b.context_rows() if shard == s]
            if rows:
                keys, windows, anchor, body = (np.concatenate(x) for x in zip(*(r for _, r in rows), strict=True))
                mask = suffix_dedup.earlier(keys, windows.astype(np.int64), anchor.astype(np.int64), body)
                for (n, r), own in zip(rows, np.split(mask, np.cumsum([len(r[0]) for _, r in rows])[:-1]), strict=True):
                    hit = np.flatnonzero(own)
                    back[n].append((s, np.stack([hit.astype(np.uint32), own[hit]]).tobytes()))
        got = []
        for part, b, r in zip((docs[0::3], docs[1::3], docs[2::3]), buckets, back, strict=True):
            for i, n, spans, kept in b.cut(r):
                got.append((part[i][0], n, int(sum(e - a for a, e in spans)), len(spans), hashlib.sha256(kept).hexdigest()))
        assert sorted(got) == want


def test_long_documents_in_pieces(monkeypatch):
    docs = made(9)
    data = np.frombuffer("".join(t or "" for _, t in docs).encode(), np.uint8)
    bounds = np.array([0, 70, 71, 7000, len(data)])
    whole = suffix_dedup.contexts_of(data, bounds)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 1 << 11)
    parts = suffix_dedup.contexts_of(data, bounds)
    assert parts.windows.sum() == whole.windows.sum() == sum(max(0, n - N + 1) for n in np.diff(bounds))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=60, max_size=140), min_size=1, max_size=9))
def test_suffix_sort(texts):
    text = np.frombuffer("".join(texts).encode(), np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    own = suffix_dedup.Suffixes(text, np.arange(len(text)) - np.repeat(begin, size))
    at = np.concatenate([b + np.arange(n - N + 1) for b, n in zip(begin, size, strict=True)])
    group = at % 3
    order = own.sort(at, group)
    told = sorted(range(len(at)), key=lambda i: (group[i], text[at[i] : at[i] + N].tobytes()))
    assert [text[at[i] : at[i] + N].tobytes() for i in order] == [text[at[i] : at[i] + N].tobytes() for i in told]


def test_sql(spark):
    oracle.compare(spark, queries.op2_suffix_dedup, queries.OP2_SQL, "/root/testdata/sf0.001")
