import re

from lumaframe.llm import mixing, queries

from .oracle import compare

SF = "/root/testdata/sf0.01"


def fixed_point(sizes, weights, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, got = share * sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]] if free else []
        if not over:
            return got | {s: left * weight[s] / total for s in free}
        for s in over:
            got[s] = most * sizes[s]
        left -= sum(got[s] for s in over)
        free -= set(over)


def test_oracle(spark):
    assert compare(spark, queries.op4_mixing, queries.OP4_SQL, SF) == 1000


def test_targets_and_nearness(spark):
    rows = mixing.copies(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    sizes, taken, longest = {}, {}, {}
    for r in rows:
        sizes[r.source] = r.source_size
        taken[r.source] = taken.get(r.source, 0) + r.n_copies * r["size"]
        longest[r.source] = max(longest.get(r.source, 0), r["size"])
        assert 0 <= r.n_copies <= 2
    want = fixed_point(sizes, (5.0, 2.0, 1.0))
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y  z\x0b w v", None), (4, "b " * 900, "b"), (4, "b " * 900, "b"), (None, "q", "c")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, size int")
    got = {(r.doc_id, r["size"]): r for r in mixing.copies(df).collect()}
    assert {k[1] for k in got} == {0, 4, 900, 1} and mixing.copies(df).count() == 6
    assert got[(1, 0)].target == 0 and got[(1, 0)].n_copies == 0
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    words = sum(len(re.findall(mixing.WORD, r.text)) for r in mixed.collect())
    total = sum(len(re.findall(mixing.WORD, t or "")) for _, t, _ in rows)
    assert total <= words <= 2 * total
    assert mixing.copies(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_many_sources(spark):
    df = spark.range(4000).selectExpr("id * 6000 AS doc_id", "CASE WHEN id % 50 > 0 THEN repeat('w ', cast(1 + id * id % 90 AS int)) END AS text", "CASE WHEN id % 97 > 0 THEN concat('host', id % 1500) END AS source")
    rows = mixing.copies(df).collect()
    sizes, taken, longest, target = {}, {}, {}, {}
    for r in rows:
        sizes[r.source], target[r.source] = r.source_size, r.target
        taken[r.source] = taken.get(r.source, 0) + r.n_copies * r["size"]
        longest[r.source] = max(longest.get(r.source, 0), r["size"])
    for s, t in fixed_point(sizes, (5.0, 2.0, 1.0)).items():
        assert abs(target[s] - t) < 1e-6 * max(1, t) and abs(taken[s] - t) <= longest[s]


def test_keys_in_strides_or_all_alike_meet_many_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 10)
    for key in ("id * 6000", "NULL"):
        df = spark.range(3000).selectExpr(f"cast({key} AS bigint) AS doc_id", "concat('a b ', id) AS text", "'s' AS source")
        placed = mixing._placed(mixing._counted(df, "doc_id", "text", "source"), 100)
        most = placed.groupBy("class", "cell").count().agg({"count": "max"}).first()[0]
        assert most < 70
        assert sum(r.n_copies for r in mixing.copies(df).collect()) == sum(r.n_copies for r in mixing.copies(df.repartition(3)).collect()) == 4500


def test_equal_rows_are_one_document_of_many_ranks(spark, monkeypatch):
    """100,000 equal rows among others: taken as often as the mix says, from many tasks, with and without other columns."""
    df = spark.range(130_000).selectExpr("if(id < 100000, 7, id) AS doc_id", "if(id < 100000, 'one two three', concat('a b ', id)) AS text", "if(id % 2 = 0 OR id < 100000, 's', 't') AS source", "id % 3 AS other", "'x' AS row", "0 AS m")
    rows = mixing.copies(df)
    got = rows.groupBy("source", "source_size", "target").agg({"n_copies": "sum", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in got) == 130_000
    taken = {r.source: r.asDict() for r in rows.selectExpr("source", "size * n_copies AS words", "target").groupBy("source", "target").agg({"words": "sum"}).collect()}
    for r in taken.values():
        assert abs(r["sum(words)"] - r["target"]) <= 3
    hot = rows.where("doc_id = 7")
    dealt = hot.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert sum(r["count"] for r in dealt) == 100_000 and max(r["count"] for r in dealt) < 60_000 and len(dealt) > 1
    ranked = mixing._ranked(df, "doc_id", "text", "source", mixing.WEIGHTS, mixing.SHARE, mixing.MOST, mixing.SEED)
    assert ranked.count() == 30_001
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    count = {(r.doc_id, r.source): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    want = {(r.doc_id, r.source): r["sum(n_copies)"] for r in rows.groupBy("doc_id", "source").agg({"n_copies": "sum"}).collect() if r["sum(n_copies)"]}
    assert count == want
    numbers = mixing._numbered(df.where("doc_id = 7").selectExpr("doc_id AS key", "source", "1L AS spread", "other")).agg({"j": "max", "*": "count"}).first()
    assert (numbers["max(j)"], numbers["count(1)"]) == (100_000, 100_000)
