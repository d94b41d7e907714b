import itertools

import numpy as np

from lumaframe.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    field = langid.Field(["a", "b", "c"], np.zeros(0, np.uint64))
    field.links = rng.normal(size=(3, 3))
    scores = rng.normal(size=(9, 3))
    counts = np.array([5, 0, 4])
    got = field.marginals(scores, counts)
    at = 0
    for n in counts[counts > 0]:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            total = sum(scores[at + i, y] for i, y in enumerate(path))
            total += sum(field.links[x, y] for x, y in itertools.pairwise(path))
            weight = np.exp(total) * np.exp(field.links[:, path[0]]).sum()  # a uniform label stands before the first word
            for i, y in enumerate(path):
                want[i, y] += weight
        np.testing.assert_allclose(got[at : at + n], want / want.sum(1, keepdims=True), rtol=1e-8)
        at += n


def test_chunks_do_not_matter(monkeypatch):
    rng = np.random.default_rng(2)
    field = langid.Field(["a", "b"], np.zeros(0, np.uint64))
    field.links = rng.normal(size=(2, 2))
    scores, counts = rng.normal(size=(500, 2)), np.array([1, 333, 32, 33, 101])
    once = field.marginals(scores, counts)
    monkeypatch.setattr(langid, "CHUNK", 7)
    np.testing.assert_allclose(field.marginals(scores, counts), once, rtol=1e-8)


def test_words():
    w = langid.words_of(["Éa é!", "", None or " 12 ", "éa"])
    assert w.counts.tolist() == [2, 0, 0, 1] and w.hashes[0] == w.hashes[2] != w.hashes[1]


def test_held_out_accuracy(spark):
    rows = queries.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 100
    right = sum(r.lang_pred == r.lang for r in held) / len(held)
    assert right > 0.95, right
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switch_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = langid.train(docs)
    de, fr = (docs.where(f"lang = '{x}' and n_chars > 900").orderBy("doc_id").first()["text"][:800] for x in ("de", "fr"))
    w = langid.words_of([de + " " + fr])
    labels = field.marginals(field.scores(w), w.counts).argmax(1)
    assert (labels == field.labels.index("de")).any() and (labels == field.labels.index("fr")).any()
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 — !!", "x"), (4, "les " * 40_000, "x"), (4, "les " * 40_000, "x"), (None, "der", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = langid.predict(df, field).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got)[1:4] == [(1, "und"), (2, "und"), (3, "und")]
    assert {r.lang_pred for r in got if r.doc_id == 4} == {"fr"}
    assert langid.train(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), field).count() == 0


def test_sample_is_bounded_whatever_the_keys(spark, monkeypatch):
    got = []
    monkeypatch.setattr(langid, "fit", lambda rows, **_: got.append(rows))
    docs = spark.range(6000).selectExpr("7 AS doc_id", "concat('some words ', id) AS text", "concat('l', id % 3) AS lang")
    same = spark.range(3000).selectExpr("7 AS doc_id", "'equal words' AS text", "'l0' AS lang")
    langid.train(docs.union(same), docs=150)
    assert len(got[0]) == 450 and len(set(got[0])) == 450
    langid.train(docs.union(same), docs=20, labels=2, most_bytes=15)
    assert len(got[1]) == 40 and {y for _, y in got[1]} == {"l0", "l1"} and all(len(t) <= 15 for t, _ in got[1])


def test_sample_has_one_bound_for_all_bytes(spark, monkeypatch):
    got = []
    monkeypatch.setattr(langid, "fit", lambda rows, **_: got.append(rows))
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat(repeat('word ', 200), id) AS text", "concat('l', id % 30) AS lang")
    langid.train(docs, sample_bytes=60_000)
    sizes = {}
    for t, y in got[0]:
        sizes[y] = sizes.get(y, 0) + len(t.encode())
    assert len(sizes) == 30 and max(sizes.values()) <= 2000 and sum(sizes.values()) <= 60_000
    langid.train(docs)
    assert len(got[1]) > 1500  # the bound of all bytes does not touch a sample this small


def test_text_above_a_megabyte(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = langid.train(docs)
    long = " ".join(r.text for r in docs.where("lang = 'fr' AND length(text) > 1000").limit(300).collect())
    text = (long + " ") * (1 + 1_500_000 // len(long))
    r = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).first()
    assert r.lang_pred == "fr" and 0.5 < r.score <= 1


def test_slope_of_the_links():
    rng = np.random.default_rng(3)
    field = langid.Field(["a", "b"], np.zeros(0, np.uint64))
    field.links = rng.normal(size=(2, 2))
    scores, counts, y = rng.normal(size=(40, 2)), np.array([40]), rng.integers(0, 2, 40)

    def likelihood(links):
        step, total = np.exp(links), 0.0
        message = np.exp(scores[0])
        for t in range(1, 40):
            message = (message @ step) * np.exp(scores[t])
            total += np.log(message.sum())
            message = message / message.sum()
        return scores[np.arange(40), y].sum() + links[y[:-1], y[1:]].sum() - total

    field.links[:] -= np.log(np.exp(field.links).sum(0))  # a uniform label before the first word then adds nothing
    _, seen = field.marginals(scores, counts, pairs=True)
    real = np.zeros((2, 2))
    np.add.at(real, (y[:-1], y[1:]), 1.0)
    for i in range(2):
        for j in range(2):
            off = np.zeros((2, 2))
            off[i, j] = 1e-5
            slope = (likelihood(field.links + off) - likelihood(field.links - off)) / 2e-5
            assert abs(slope - (real - seen)[i, j]) < 1e-3
