import base64
import gzip
import hashlib
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumaframe.llm import queries, warc

from .oracle import compare

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, archive string, key int"


def sha1(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def plain(pages, at_least=0):
    first = {}
    for k, _, html in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(html or "", k)
    found = []
    for k, _, html in pages:
        body = (html or "").encode()
        names = first.get(html or "") if len(body) >= at_least else None
        revisit = names is not None and names != k
        found.append((k, len(body), sha1(body), "revisit" if revisit else "response", names if revisit else None))
    return sorted(found, key=repr)


def told(archives, **options):
    rows = warc.index(warc.chunks(archives, **options)).collect()
    number = lambda x: None if x is None else int(x)
    return sorted(((number(r.key), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in rows), key=repr)


def files(archives):
    return [r.archive.removeprefix("file:") for r in archives.collect()]


def test_oracle(spark):
    assert compare(spark, queries.op12_warc, queries.OP12_SQL, SF) == 250


def test_brute_force_and_edges(spark):
    pages = [
        (5, "http://a/ä b", "same"), (2, "http://b/", "same"), (9, None, "same"), (9, None, "same"), (None, "x", "same"), (2, "http://b/", "same"), (1, "u\r\nX: y", None), (3, "", ""),
        (4, "u", "é" * 90_000), (6, "u", "WARC/1.1\r\n\r\n"), (7, "u", "\r\n\r\n" * 50), (None, "u", "alone"), (None, "u", "alone"), (-8, "u", "x"), (8, "u", "x"),
    ]
    df = spark.createDataFrame([(*p, "z", 7) for p in pages], SCHEMA)
    archives = warc.write(df, archive_bytes=300)
    assert told(archives) == plain(pages)
    assert len({gzip.decompress(open(f, "rb").read())[:4] for f in files(archives)} - {b"WARC"}) == 0
    assert sum(r.n_records for r in archives.collect()) == len(pages) and len(files(archives)) > 1
    assert told(archives, chunk_bytes=7) == plain(pages)
    assert told(warc.write(df, at_least=5)) == plain(pages, 5)
    assert warc.write(df.limit(0)).count() == 0 and warc.index(warc.chunks(warc.write(df.limit(0)))).count() == 0


def test_chunk_rows(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000)) + "é"
    df = spark.createDataFrame([(1, "u", text), (2, "v", text), (3, "w", "")], "page_id long, url string, html string")
    rows = sorted(warc.chunks(warc.write(df), chunk_bytes=300).collect(), key=lambda r: (int(r.key), r.chunk))
    own, body = [r for r in rows if r.key == "1"], text.encode()
    assert [len(r.data) for r in own] == [300, 300, 300, 102] and [r.last for r in own] == [False, False, False, True]
    assert b"".join(bytes(r.data) for r in own) == body
    assert [(r.bytes_so_far, r.digest_so_far) for r in own] == [(n, sha1(body[:n])) for n in (300, 600, 900, 1002)]
    (revisit,) = [r for r in rows if r.key == "2"]
    assert revisit.record_type == "revisit" and revisit.refers_to == "1" and bytes(revisit.data) == b"" and revisit.declared_bytes == 1002 and revisit.declared_digest == sha1(body)
    assert own[0].record_id != revisit.record_id and own[0].url == "u"


def test_members_are_gzip_and_headers_whole(spark):
    df = spark.createDataFrame([(1, "http://a/", "text"), (2, "http://b/", "text")], "page_id long, url string, html string")
    (path, *_) = files(warc.write(df))
    packed = open(path, "rb").read()
    raw = gzip.decompress(packed)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: re") and raw.endswith(b"\r\n\r\n") and b"WARC-Payload-Digest: sha1:" + sha1(b"text").encode() in raw
    member = zlib.decompressobj(31)
    assert member.decompress(packed).count(b"WARC/1.1") == 1 and member.eof  # a member for each record


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6), st.booleans(), st.integers(1, 50))
def test_records_of_any_bytes(bodies, packed, size):
    out = b""
    for k, body in enumerate(bodies):
        record = warc.head(str(k), "u", "d", len(body), sha1(body), None) + body + b"\r\n\r\n"
        out += gzip.compress(record) if packed else record
    got = [(f["warc-source-key"], b"".join(p)) for f, _, p in warc.records(io.BytesIO(out))]
    assert got == [(str(k), b) for k, b in enumerate(bodies)]
    skipped = [f["warc-source-key"] for f, _, _ in warc.records(io.BytesIO(out))]
    assert skipped == [str(k) for k in range(len(bodies))]
    assert [len(x) for x in warc._even(iter([out]), size)][:-1] == [size] * max(0, -(-len(out) // size) - 1)


def test_damage_is_told(spark):
    body = b"payload " * 40
    record = warc.head("1", "u", "d", len(body), sha1(body), None) + body + b"\r\n\r\n"
    for broken in (gzip.compress(record)[:-30], record[:-60], record[:30], b"nonsense\r\n\r\n"):
        with pytest.raises(ValueError):
            for _ in warc.records(io.BytesIO(broken)):
                pass


def test_wrong_digest_fails(spark, tmp_path):
    body = b"payload"
    (tmp_path / "a.warc").write_bytes(warc.head("1", "u", "d", len(body), sha1(b"other"), None) + body + b"\r\n\r\n")
    with pytest.raises(Exception, match="damaged"):
        warc.chunks(spark.createDataFrame([(f"file:{tmp_path}/a.warc",), (None,)], "archive string")).collect()


def test_one_payload_for_most_pages_and_a_very_long_one(spark):
    df = spark.range(20_000).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 > 0, 'hot', concat('p', id)) AS html")
    df = df.union(spark.createDataFrame([(10**6, "u", "0é" * 6_000_000)], df.schema))
    rows = warc.index(warc.chunks(warc.write(df))).collect()
    assert len(rows) == 20_001 and {r.refers_to for r in rows if r.record_type == "revisit"} == {"1"}
    assert sum(r.record_type == "revisit" for r in rows) == 13_332
    assert [r.payload_bytes for r in rows if r.key == "1000000"] == [18_000_000]


def test_a_long_payload_is_never_held():
    class Zeros:
        """A plain record of a gigabyte."""

        def __init__(self, n):
            self.first, self.left = warc.head("1", "u", "d", n, "X", None), n

        def read(self, n):
            if self.first:
                piece, self.first = self.first[:n], self.first[n:]
                return piece
            piece = bytes(min(n, self.left))
            self.left -= len(piece)
            return piece

    total, most = 0, 0
    for _, _, pieces in warc.records(Zeros(1 << 30)):
        for piece in pieces:
            total += len(piece)
            most = max(most, len(piece))
    assert total == 1 << 30 and most <= warc.CHUNK_BYTES
