import re
from itertools import permutations

from lumaframe.llm import filter_audit, queries

from .oracle import compare

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, part int, mask string, n int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = len(re.findall("[A-Z]", text))
    return {x for x, bad in zip("ABCD", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(text), bool(re.search(r"[#$%&*|]", text))), strict=True) if bad}


def plain(docs, labels):
    """Applies every order to the documents one by one."""
    rows = []
    for k, text, source in docs:
        t = text or ""
        bad = fails(t)
        if k is not None and any(o is not None and o < k and (u or "") == t for o, u, _ in docs):
            bad.add("E")
        of = [x for x in labels if x[0] is not None and x[0] == k]
        rows.append((source or "", bad, any(x[1] == 1 for x in of), any(x[2] == 1 for x in of)))
    found = {}
    for part in {r[0] for r in rows}:
        mine, removed_by = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                before = [r for r in mine if r not in left or r[1] & set(order[: step - 1])]
                left = [r for r in left if x not in r[1]]
                removed_by[x] += len(gone)
                found[part, order, step] = [len(left), len(gone), sum(x in r[1] for r in before if r[1] & set(order[: step - 1])), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in found.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return found


def told(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in df.collect()}


def test_oracle(spark):
    assert compare(spark, queries.op11_filter_audit, queries.OP11_SQL, SF) == 20 * 600


def test_matrices():
    m = filter_audit.matrices()
    assert all(m[k].shape == (32, 600) for k in ("kept", "removed", "redundant", "unique_fails"))
    after = m["kept"].reshape(32, 120, 5)
    assert (after[:, :, 4].sum(axis=0) == 1).all() and (after[:, :, 4] == after[:, :1, 4]).all()  # only those that fail nothing stay, in any order
    assert ((m["removed"] + m["redundant"]).reshape(32, 120, 5).sum(axis=2) == [[bin(k).count("1")] for k in range(32)]).all()
    assert (m["removed"].reshape(32, 120, 5).sum(axis=2) <= 1).all()


def test_brute_force_and_edges(spark):
    long = " ".join(f"word{i}" for i in range(60))
    same = " ".join(["tick"] * 60)
    docs = [
        (1, long, "a"), (2, long, "a"), (2, long, "b"), (3, long.upper(), "a"), (4, same, None), (5, same + " #", ""), (6, None, "b"), (7, "", "b"), (8, "short & SWEET", "b"),
        (None, long, "a"), (None, None, None), (9, long + " été" * 40, "ü"), (9, long + " été" * 40, "ü"), (10, "\x0b\t\n", "ü"), (11, long + "\n|", "a"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (None, 1, 1), (8, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*d, 5, "x", 0) for d in docs], SCHEMA)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = told(filter_audit.filter_audit(df, marks))
    assert got == plain(docs, labels) and len(got) == 4 * 600
    assert told(filter_audit.filter_audit(df.limit(0), marks)) == {}
    assert told(filter_audit.filter_audit(df, marks.limit(0))) == plain(docs, [])


def test_one_text_for_most_rows_and_a_long_text(spark):
    df = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 3 > 0, 'the same', concat('text ', id)) AS text", "if(id % 3 > 0, 'hot', concat('s', id % 300)) AS source")
    df = df.union(spark.createDataFrame([(10**6, "aB" * 1_500_000 + " end", "long")], df.schema))
    found = {(r.doc_id): r.mask for r in filter_audit.masks(df).collect()}
    assert found[1] == 1 and all(found[k] == 17 for k in range(2, 30_000) if k % 3) and found[10**6] == 5
    labels = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality", "cast(id % 2 AS int) AS toxic")
    got = told(filter_audit.filter_audit(df, labels))
    assert got["hot", "EABCD", 1] == [1, 19_999, 0, 0, 19_999, 9_999, sum(v[1] for k, v in got.items() if k[0] == "hot" and k[1][k[2] - 1] == "E")]
