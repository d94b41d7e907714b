from lumaframe.llm import line_dedup, queries

from .oracle import compare

SF = "/root/testdata/sf0.01"


def plain(docs):
    """Brute force over (key, text) rows in key order."""
    seen, cut = {}, {}
    for k, text in docs:
        filled = [i for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\x0b\x0c\r")]
        lines = (text or "").split("\n")
        for w in range(len(filled) - 2):
            window = tuple(lines[i] for i in filled[w : w + 3])
            if seen.setdefault(window, (k, w)) != (k, w):
                cut.setdefault(k, set()).update(filled[w : w + 3])
    return {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut.get(k, ())) for k, t in docs}


def test_oracle(spark):
    assert compare(spark, queries.op3_line_dedup, queries.OP3_SQL, SF) == 1000


def test_brute_force(spark):
    docs = [
        (1, "a\nb\nc\nd"), (2, "x\na\nb\n\nc\nd\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "z\nz\nz\nz\nz"), (7, "b\nc\nd\ny\nq"),
        (8, "\n".join(f"row {i % 700}" for i in range(3000))), (9, "a \nb\nc"), (10, " \n\t\n \n \n"),
    ]
    df = spark.createDataFrame([(k, t, 0, "s") for k, t in docs], "doc_id long, text string, n_lines int, h1 string")
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(df).collect()}
    assert {k: r.text for k, r in got.items()} == plain(docs)
    assert got[6].n_removed == 4 and got[4].n_lines == 0 and got[1].h1 == "s"


def test_edges(spark):
    rows = [(None, "a\nb\nc"), (None, "a\nb\nc"), (3, "a\nb\nc\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.drop_repeated_lines(df)
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "a\nb\nc"), (0, "a\nb\nc"), (3, "d")]
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_a_window_in_every_document_is_split(spark):
    """AQE deals the hot window over tasks, as both sides of the join are plain exchanges."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        seen = spark.range(0, 60_000, 1, 16).selectExpr("if(id % 3 = 0, 1L, id) AS h1", "if(id % 3 = 0, 1L, id) AS h2", "named_struct('k1', id, 'k2', id * 7, 'w', 0) AS at")
        again = seen.union(spark.range(100).selectExpr("id AS h1", "id AS h2", "named_struct('k1', id + 70000, 'k2', 0L, 'w', 0) AS at"))
        later = line_dedup._later(again)
        dealt = [r["count"] for r in later.selectExpr("h1", "spark_partition_id() AS p").where("h1 = 1").groupBy("p").count().collect()]
        assert sum(dealt) == 20_002 - 1 and max(dealt) < sum(dealt) / 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_common_window_and_a_text_above_a_megabyte(spark):
    menu = "home page\nall articles\nsign in"
    docs = [(k, f"{menu}\nown line {k}\nmore of {k}\nlast of {k}") for k in range(3000)] + [(5000, "\n".join(f"line {i % 90_000} of a long text" for i in range(100_000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got == plain(docs)
    assert len(docs[-1][1]) > 2_000_000 and menu not in got[1] and got[0].startswith(menu)
