import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumaframe.llm import periodic_runs, queries

SF = "/root/testdata/sf0.01"


def plain_runs(words, least=12):
    """All maximal stretches, each with its smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def plain(words, least=12):
    runs = plain_runs(words, least)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    return runs, [w for k, w in enumerate(words) if k not in gone]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def told(words_of, least=12):
    texts = [" ".join(map(str, w)).encode() for w in words_of]
    return [(runs, kept.decode().split()) for _, runs, kept in periodic_runs._batch(texts, least)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=5), st.integers(2, 9))
def test_small_alphabets(docs, least):
    want = [(r, [str(w) for w in k]) for r, k in (plain(d, least) for d in docs)]
    assert told(docs, least) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 30), min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
def test_repeated_blocks(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert told([words, words])[1] == (plain(words)[0], [str(w) for w in plain(words)[1]])


def test_tree_against_all_suffixes():
    rng = random.Random(4)
    for _ in range(60):
        s = np.array([rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))] + [-1])
        levels = periodic_runs._ranks(s)
        leaves = sorted(range(len(s)), key=lambda i: s[i:].tolist() + [10**6] * 0)
        assert np.argsort(levels[-1]).tolist() == leaves
        common = [0] + [int(periodic_runs._agree(levels, np.array([a]), np.array([b]))[0]) for a, b in zip(leaves, leaves[1:], strict=False)]
        for a, b, c in zip(leaves, leaves[1:], common[1:], strict=False):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert k == c
        nodes = set(zip(*(x.tolist() for x in periodic_runs._nodes(np.array(common))[:3]), strict=True))
        want = set()
        for first in range(len(s)):
            for last in range(first + 1, len(s)):
                depth = min(common[first + 1 : last + 1])
                if depth and (first == 0 or common[first] < depth) and (last + 1 == len(s) or common[last + 1] < depth):
                    want.add((depth, first, last))
        assert nodes == want


def test_powers_and_long_strings():
    assert told([["a"] * 5000])[0] == ([(0, 5000, 1)], ["a"])
    words = [f"w{i}" for i in range(700)] * 6 + ["x"] + ["y", "z"] * 900
    assert told([words])[0][0] == [(0, 4200, 700), (4201, 1800, 2)]
    fibonacci = ["a"], ["a", "b"]
    while len(fibonacci[1]) < 900:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert told([fibonacci[1]])[0][0] == plain_runs(fibonacci[1])


def test_edges(spark):
    run = "a b c " * 5
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, run), (4, run), (None, "x y " * 12), (5, "one two"), (6, "\x1fa " * 12), (7, "é\n" * 13 + "end")]
    df = spark.createDataFrame([(k, t, 1, "z", []) for k, t in rows], "doc_id long, text string, n_words int, collapsed string, runs array<int>")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.collapse(df).collect()), key=repr)
    assert got == sorted(
        [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 15, [(0, 15, 3)], "a b c"), (4, 15, [(0, 15, 3)], "a b c"), (0, 12, [(0, 12, 1)], "x y"), (5, 2, [], "one two"), (6, 12, [(0, 12, 1)], "\x1fa"), (7, 14, [(0, 13, 1)], "é end")],
        key=repr,
    )
    assert periodic_runs.collapse(df.limit(0)).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    with_runs = 0
    for d in docs:
        words = split(d.text)
        made = planted(d.doc_id, words)
        runs, kept = plain(words if made is None else made)
        r, with_runs = got[d.doc_id], with_runs + bool(runs)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert with_runs > 50


def test_query_edges(spark, tmp_path):
    docs = [(k, f"w{k} " * (k % 23) + "tail end") for k in range(200)] + [(300, None), (301, ""), (None, "q " * 20), (302, " "), (302, "again " * 30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_runs, r.collapsed_sha256) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    want = []
    for k, t in docs:
        made = None if k is None else planted(k, split(t))
        runs, kept = plain(split(t) if made is None else made)
        want.append((-1 if k is None else k, len(runs), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert got == sorted(want)


def test_very_long_text(spark):
    text = " ".join(f"w{i % 911}" for i in range(400_000)) + " " + " ".join(f"v{i * i % 100_003}" for i in range(300_000))
    r = periodic_runs.collapse(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_words == 700_000 and tuple(r.runs[0]) == (0, 400_000, 911)
