"""Each stage of the pipeline against a brute-force version, on whole small tables."""

import hashlib
import re

import corpus_pipeline as cp
import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from lumaframe.llm import bpe, langid, shared

from .test_jaccard import plain_classes
from .test_line_dedup import plain
from .test_mixing import fixed_point

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = shared.documents(spark, SF)
    columns = docs.columns
    rows = docs.collect()
    field = langid.train(docs)
    one = shared.written(cp.language_id(spark, docs, SF), "t1")
    want = set()
    for r in rows:
        best, score = field.predict([r.text])
        if best[0] >= 0 and score[0] >= cp.LEAST_SCORE and any(c.isalpha() for c in r.text):
            want.add(r.doc_id)
    assert {r.doc_id for r in one.collect()} == want and one.columns == columns
    assert len(want) >= 990

    two = shared.written(cp.lines(spark, one, SF), "t2")
    cut = plain(sorted((r.doc_id, r.text) for r in one.collect()))
    assert {r.doc_id: r.text for r in two.collect()} == cut and two.columns == columns
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = shared.written(cp.near_duplicates(spark, two, SF), "t3")
    groups = plain_classes([(r.doc_id, r.text) for r in two.collect()], 5, 80)
    assert sorted(r.doc_id for r in three.collect()) == sorted(k for k, (_, c) in groups.items() if k == c)
    assert three.columns == columns

    four = shared.written(cp.mixture(spark, three, SF), "t4")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words, taken, most = {}, {}, {}
    for r in three.collect():
        words[r.source] = words.get(r.source, 0) + size(r.text)
        most[r.source] = max(most.get(r.source, 0), size(r.text))
    for r in four.collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    for s, t in fixed_point(words, (5.0, 2.0, 1.0)).items():
        assert abs(taken.get(s, 0) - t) <= most[s]
    assert set(four.distinct().collect()) <= set(three.collect()) and four.columns == columns

    five = cp.tokens(spark, four, SF).collect()
    told = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = {r.doc_id: r.text for r in four.collect()}
    assert sorted(r.doc_id for r in five) == sorted(r.doc_id for r in four.collect())
    for r in five:
        ids = told.encode_ordinary(text[r.doc_id])
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_and_edges(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34", "en", "a", 5), (4, "the house and the garden", "en", "a", 24), (4, "the house and the garden", "en", "a", 24)]
    rows += [(i, f"the word {i} and some other {i * 7} words of the text", "en", f"s{i % 3}", 50) for i in range(5, 60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = cp.run(spark, f"{tmp_path}/a").collect()
    assert got and {r.doc_id for r in got} <= set(range(4, 60))
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("k", "key", "row", "n", "score", "lang_pred", "size", "copy", "id", "w1"):
        extra = extra.withColumn(name, F.lit("own"))
    extra.write.parquet(f"{tmp_path}/c/documents.parquet")
    docs = shared.documents(spark, f"{tmp_path}/c")
    for name, stage in cp.STAGES[:-1]:
        docs = shared.written(stage(spark, docs, ""), name)
        assert docs.columns == extra.columns and {r.score for r in docs.collect()} == {"own"}
    assert cp.STAGES[-1][1](spark, docs, "").count() == docs.count() > 0
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/b").count() == 0


def test_near_duplicates_by_text(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (None, text(3)), (5, text(4)), (5, text(5)), (6, text(5) + " more"), (7, text(6)), (7, text(6)), (8, text(1)), (9, ""), (9, None), (9, ""), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.lit("x")).coalesce(1)
    got = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect()]
    want = [(None, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (7, text(6)), (9, ""), (9, None), (9, ""), (None, " ")]
    assert sorted(got, key=str) == sorted(want, key=str)
