import hashlib
import math
import tarfile
import zlib
from collections import Counter
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from lumaframe.llm import media, queries

SF = "/root/testdata/sf0.01"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700))
def test_round_trip(body):
    payload = media.pad(body)
    assert len(payload) % 64 == 0 and len(payload) > 0 and len(payload) - len(body) <= 64 and payload.startswith(body)
    image = media.to_image(payload)
    assert media.from_image(image) == payload
    assert media.read_header(image[: media.HEADER_BYTES]) == (64, len(payload) // 64, 8)


def plain_feature(payload):
    n, count = len(payload), Counter(payload)
    mean = sum(payload) / n
    spread = math.sqrt(sum((x - mean) ** 2 for x in payload) / n)
    bits = -sum(c / n * math.log2(c / n) for c in count.values())
    return f"64x{n // 64}x8;mean={mean:.4f};sd={spread:.4f};bits={abs(bits):.4f};distinct={len(count)}"


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op10_media_columns(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id].encode()
        payload = media.pad(raw)
        image = media.to_image(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(image))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(image).hexdigest() and r.feature == plain_feature(payload)


def test_shards_and_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (3, "x" * 64), (None, "y"), (5, "é" * 90_000), *((i, f"text {i}") for i in range(10, 200))]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, shard string").coalesce(2)
    manifest = media.store(df, shard_bytes=20_000)
    found = manifest.collect()
    assert len(found) == len(rows) and len({r.shard for r in found}) > 3
    for r in found:
        path = Path(r.folder.removeprefix("file:")) / r.shard
        body = path.read_bytes()[r.offset : r.offset + r.length]
        assert hashlib.sha256(body).hexdigest() == r.digest
        with tarfile.open(path) as tar:
            assert f"{r.digest}.png" in tar.getnames()
    assert sorted(bytes(r.payload).rstrip(b"\0") for r in media.load(manifest).collect()) == sorted((t or "").encode() for _, t in rows)
    assert {(r.width, r.depth) for r in media.metadata(manifest).collect()} == {(64, 8)}
    told = media.described(df, shard_bytes=20_000)
    assert told.count() == len(rows) and told.columns[:3] == ["doc_id", "n_bytes", "digest"]
    assert len({r.feature for r in told.where("doc_id in (1, 2)").collect()}) == 1
    assert {(r.width, r.height, r.depth) for r in told.where("doc_id = 5").collect()} == {(64, 2813, 8)}
    assert media.described(df.limit(0)).count() == 0


def test_equal_texts_name_one_member(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id % 7) AS text").repartition(5)
    manifest = media.store(df, shard_bytes=3000)
    assert manifest.select("digest", "shard", "offset").distinct().count() == 7 and manifest.count() == 400


def test_very_long_text(spark):
    text = "é0" * 7_000_000
    r = media.described(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    payload = media.pad(text.encode())
    assert r.n_bytes == 21_000_000 and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.height == len(payload) // 64
