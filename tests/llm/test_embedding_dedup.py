import numpy as np

from lumaframe.llm import embedding_dedup, queries

from . import oracle

SF = "/root/testdata/sf0.01"


def plain(ids, vectors, cosine=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for v, o in zip(vectors, ok)]
    links, root = [0] * len(ids), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine - 1e-12:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, links[i], least[find(i)], least[find(i)] == k) for i, k in enumerate(ids))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert rows_of(queries.op6_embedding_dedup(spark, SF)) == plain([r.vec_id for r in rows], [r.embedding for r in rows])


def test_around_the_threshold_and_edges(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(8)
    vectors = []
    for _ in range(40):
        base = rng.normal(size=32)
        base /= np.linalg.norm(base)
        for c in (0.9495, 0.9505, 0.951, 0.96, 0.99, 1.0):
            off = rng.normal(size=32)
            off -= (off @ base) * base
            vectors.append((base * c + off / np.linalg.norm(off) * np.sqrt(1 - c * c)) * rng.uniform(0.1, 9))
        vectors.append(base)
    vectors = [v.astype(np.float32).astype(float).tolist() for v in vectors]
    vectors += [vectors[0]] * 150 + [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [float("inf")] + [0.0] * 31, [1.0, 2.0], [2.0, 4.0], [1e-30] * 32, [1.0] * 32]
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    assert rows_of(embedding_dedup.near_duplicates(df)) == plain([r[0] for r in rows], vectors)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    twice = embedding_dedup.near_duplicates(df.limit(3).union(df.limit(3)))
    assert twice.count() == 6 and twice.agg({"n_links": "min"}).first()[0] >= 1


def test_plan_grows_slowly():
    small, large = embedding_dedup.Plan(64, 50_000, 0.95), embedding_dedup.Plan(64, 10**10, 0.95)
    assert small.depth <= 4 and large.depth <= 20 and large.tables <= 20


def test_sql(spark):
    oracle.compare(spark, queries.op6_embedding_dedup, queries.OP6_SQL, SF)


def test_recall_of_pairs_at_the_threshold(spark):
    """A table of many cells with pairs planted at cosines from 0.95 on: all are found, and none below."""
    rng = np.random.default_rng(21)
    vectors = rng.normal(size=(6000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    planted = []
    for i in range(600):
        c = 0.95 + 1e-6 + (i % 5) * 0.003 if i % 6 else 0.949
        off = rng.normal(size=64)
        off -= (off @ vectors[i]) * vectors[i]
        planted.append(c * vectors[i] + np.sqrt(1 - c * c) * off / np.linalg.norm(off))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([vectors, planted]))]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0")
    assert {r.vec_id for r in found.collect()} == {i + d for i in range(600) if i % 6 for d in (0, 6000)}
