import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumaframe.llm import components, jaccard, queries, shingles

from . import oracle

SF = "/root/testdata/sf0.01"


def plain_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_classes(docs, size, percent):
    sets = [(k, plain_set(t, size)) for k, t in docs]
    root = {k: k for k, _ in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (k, a) in enumerate(sets):
        for m, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(k), find(m)))
                root[y] = x
    return {k: (len(s), find(k)) for k, s in sets}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: find(k) for k in root}


def test_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_jaccard_join(spark, SF).collect()}
    assert got == plain_classes(docs, 4, 85)


def test_edges(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, "one"), (7, "w " * 30_000), (8, "w w w w w w w")]
    for k in range(10, 60):  # a chain of near copies at and around the threshold
        words = list(base)
        for i in range(k - 10):
            words[(i * 37) % 120] = f"x{k % 3}{i}"
        docs.append((k, " ".join(words)))
    df = spark.createDataFrame([(*d, "c") for d in docs] + [(4, "one two", "d"), (None, "one two", "e")], "doc_id long, text string, component_id string")
    for size, percent in ((4, 85), (5, 80)):
        got = jaccard.classes(df, size, percent).collect()
        want = plain_classes(docs, size, percent)
        assert len(got) == len(docs) + 2
        for r in got:
            if r.doc_id in (4, 5, None):
                assert r.component_id is None and r.n_shingles == 1  # the null key is the smallest
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id], r
    assert jaccard.classes(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 40), max_size=25), max_size=40), st.sampled_from([50, 80, 85]))
def test_tree_join_is_exact(sets, percent):
    own = [np.array(sorted({int(shingles.mix(np.array([x], np.uint64))[0]) for x in s}), np.uint64) for s in sets if s]
    links = jaccard.forest(own, percent)
    docs = [(i, s) for i, s in enumerate(s for s in sets if s)]
    root = list(range(len(own)))

    def find(r, k):
        while r[k] != k:
            k = r[k]
        return k

    want = list(root)
    for i, a in docs:
        for j, b in docs[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(want, i), find(want, j)))
                want[y] = x
    for a, b in links:
        assert jaccard.similar(own[a], own[b], percent)
        x, y = sorted((find(root, a), find(root, b)))
        root[y] = x
    assert [find(root, k) for k in root] == [find(want, k) for k in range(len(own))]


def test_single_short_texts():
    words = [b"a", b"bc", b"D", b"ef", b"g"]
    for size in (4, 5):
        long = shingles.shingle_sets([b" ".join(words[:n]) for n in range(1, 6)] + [b"w " * 9], size)
        for n in range(1, 6):
            alone = shingles.shingle_sets([b" ".join(words[:n])], size)
            assert len(alone) == 1 and len(alone[0]) == max(1, n - size + 1)
            assert alone[0].tolist() == long[n - 1].tolist()


def _texts(rng, groups, copies, words, changed):
    """groups bases of words each; copies of each with up to changed words replaced."""
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(9999)}" for _ in range(words)]
        for c in range(copies):
            own = list(base)
            for i in rng.sample(range(words), c % (changed + 1)):
                own[i] = f"x{g}y{c}z{i}"
            yield " ".join(own)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 700)
    monkeypatch.setattr(jaccard, "WHOLE_SHINGLES", 500)
    monkeypatch.setattr(jaccard, "TASK_SHINGLES", 2000)
    docs = list(enumerate(_texts(random.Random(11), 3, 90, 60, 5)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_classes(docs, 5, 80)


def test_null_keys_stay_linear(spark):
    docs = [(None, t) for t in _texts(random.Random(12), 500, 4, 40, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    own = jaccard.F.xxhash64("text")
    rows = jaccard.written(jaccard._profiles(df, 5, "doc_id", "text", own), "profiles")
    nodes, joined = jaccard._joined(df, rows, 5, 80, "doc_id", "text", own)
    links = joined.groupBy("component").count().collect()
    sets = [plain_set(t, 5) for _, t in docs]
    assert nodes.count() == len({frozenset(s) for s in sets}) and joined.select("id").distinct().count() == joined.count()
    want = [c for k, c in plain_classes([(i, t) for i, (_, t) in enumerate(docs)], 5, 80).values()]
    assert len(links) == sum(1 for k in set(want) if len({frozenset(sets[i]) for i, c in enumerate(want) if c == k}) > 1)
    assert jaccard.one_of_each_class(df).count() == len(set(want))


def test_chains_of_unlike_texts_form_no_group(spark):
    rng = random.Random(13)
    words = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    docs = [(i, " ".join(words[i * 46 : i * 46 + 100])) for i in range(600)]  # neighbours of similarity 0.35
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.classes(df, 5, 80)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, i) for i in range(600)}


def test_sql(spark):
    oracle.compare(spark, queries.op7_jaccard_join, queries.OP7_SQL, "/root/testdata/sf0.001")
