"""WARC archives: records written from rows, and read back as a table of payload chunks.

Writing. A record is a gzip member of its own; a task packs its rows into archives of
ARCHIVE_BYTES in the shared folder. Payloads that occur again are written once: the others
become revisit records (identical-payload-digest) that name the response. Which record is
the response comes from an aggregation over digests, salted so that one payload of very many
pages is no one task. An archive counts only once Spark has committed the task that wrote
it, so retries and lost executors leave at most files that nobody names.

Reading. Archives are inflated in pieces. A payload comes out as rows (record, chunk number)
of at most CHUNK_BYTES, each with the bytes and the SHA-1 so far, so no record is ever
held whole and the last chunk of a record has its length and digest without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import beside
from .shared import new_folder, small_batches, written

ARCHIVE_BYTES, CHUNK_BYTES = 64 << 20, 1 << 16
#: Payload bytes that one Arrow batch of chunks holds at most, give or take a chunk.
BATCH_BYTES = 4 << 20
#: Tasks that read archives at most; more archives share them.
READERS = 20_000
LEVEL = 5
#: Fixed values of the format.
VERSION, REVISIT = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP, _MIME = "application/http;msgtype=response", "text/html; charset=utf-8"
#: Fields of this library's own: the key of the row that a record was made of, and of the one that a revisit names.
KEY, REFERS = "WARC-Source-Key", "WARC-Refers-To-Source-Key"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record_id(key: str | None, digest: str) -> str:
    """The same for the same key and payload, so that a revisit can name a record which another task writes."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key!r} {digest}')}>"


def head(key: str | None, url: str | None, date: str, n_bytes: int, digest: str, refers_to: str | None) -> bytes:
    """Header of a record and of the HTTP response in its block, up to the payload; a revisit has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {_MIME}\r\nContent-Length: {n_bytes}\r\n\r\n"
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if key is not None:
        fields.append((KEY, quote(key, safe=" ")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to, digest)), (REFERS, quote(refers_to, safe=" "))]
    fields += [("Content-Type", _HTTP), ("Content-Length", str(len(http) + (0 if revisit else n_bytes)))]
    return (f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + http).encode("ascii")


class Archive:
    """Writes records to gzip members of archives below a folder, a new archive when one is full."""

    def __init__(self, folder: str, limit: int):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.limit, self.out, self.done = limit, None, []

    def add(self, header: bytes, payload: memoryview) -> None:
        if self.out is None or self.done[-1][1] >= self.limit:
            self.close()
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.out = self.store.open_output_stream(f"{self.path}/{name}", compression=None)  # by name it would pack the members again
            self.done.append([name, 0, 0])
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        pieces = [header, *(payload[k : k + CHUNK_BYTES] for k in range(0, len(payload), CHUNK_BYTES)), b"\r\n\r\n"]
        for piece in pieces:
            self._write(pack.compress(piece))
        self._write(pack.flush())
        self.done[-1][2] += 1

    def _write(self, body: bytes) -> None:
        if body:
            self.out.write(body)
            self.done[-1][1] += len(body)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _revisits(rows: DataFrame, at_least: int) -> DataFrame:
    """(key, mark, refers_to) of the rows that another key's equal payload stands for; rows has key, mark, n and row."""
    # nulls come after every key: a null key is a response only if no other key has its payload
    all_rows = beside(rows.where(F.col("n") >= at_least), ["mark"], "row", first=(F.min, "key"))
    named = all_rows.where(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")))
    return named.select("key", "mark", F.col("first").alias("refers_to")).distinct()


def write(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", at_least: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(archive, n_bytes, n_records), a table of the archives that hold one record for each row of df.

    The payload is the text in UTF-8 (null: empty). Of rows with equal payloads of at least
    at_least bytes (SHA-256 and length agree) those of the smallest key become responses, also
    when they repeat it, and the others revisits; smaller payloads are all responses. A null
    key comes after all others, its record has no key field; a null url is left out. Other
    columns are dropped; an empty df has no archives.
    """
    spark = df.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "warc")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("body"))
    rows = rows.select("*", F.octet_length("body").cast("long").alias("n"), F.unhex(F.sha2("body", 256)).alias("mark"))
    known = written(rows.select("key", "mark", "n", F.monotonically_increasing_id().alias("row")), "digests")
    again = written(_revisits(known, at_least), "revisits").withColumnsRenamed({"key": "k", "mark": "m"})
    rows = rows.join(again, F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m")), "left")
    sent = F.when(F.col("refers_to").isNull(), F.col("body"))  # only responses need their payload
    rows = rows.select(F.col("key").cast("string"), "url", "n", F.unhex(F.sha1("body")).alias("sha1"), F.col("refers_to").cast("string"), sent.alias("sent"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Archive(folder, archive_bytes)
        for batch in batches:
            for k, u, n, sha1, refers, text in zip(*batch.columns, strict=True):
                view = memoryview(text.as_buffer() if text.is_valid else b"")  # no copy of the payload
                out.add(head(k.as_py(), u.as_py(), date, n.as_py(), base32(sha1.as_py()), refers.as_py()), view)
        out.close()
        names, sizes, counts = zip(*out.done, strict=True) if out.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in names], pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["archive", "n_bytes", "n_records"])

    return written(rows.mapInArrow(run, "archive string, n_bytes bigint, n_records bigint"), "archives")


class Inflated:
    """Bytes of an archive of gzip members (or of a plain one), read in pieces; never more than a few chunks are held."""

    def __init__(self, source):
        self.source, self.held, self.raw = source, bytearray(), b""
        first = source.read(2)
        self.raw, self.plain, self.member = first, first != b"\x1f\x8b", None

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(CHUNK_BYTES)
            if not self.raw:
                if self.member is not None and not self.member.eof:
                    raise ValueError("the archive ends inside a member")
                return False
        if self.plain:
            self.held += self.raw
            self.raw = b""
            return True
        if self.member is None or self.member.eof:
            self.member = zlib.decompressobj(31)
        self.held += self.member.decompress(self.raw, CHUNK_BYTES)
        self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def read(self, n: int) -> bytes:
        """At most n bytes, at least one unless the archive is at its end."""
        while not self.held and self._more():
            pass
        piece = bytes(self.held[:n])
        del self.held[:n]
        return piece

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        """Bytes up to and with mark; empty at the end of the archive."""
        at = 0
        while (found := self.held.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.held)
            if at > most:
                raise ValueError("a header without end")
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a header")
                return b""
        return self.read(found + len(mark))


def _fields(header: bytes) -> dict[str, str]:
    """Names in lower case of `Name: value` lines after the first."""
    lines = header.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def records(source) -> Iterator[tuple[dict[str, str], dict[str, str], Iterator[bytes]]]:
    """(fields, HTTP fields, payload pieces) of each record of an open archive; pieces not taken are skipped."""
    data = Inflated(source)
    while header := data.until(b"\r\n\r\n"):
        header = header.lstrip(b"\r\n")
        if not header:  # what ends a record
            continue
        if not header.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = _fields(header)
        left = int(fields["content-length"])
        http = {}
        if fields.get("content-type", "").startswith("application/http") and left:
            block = data.until(b"\r\n\r\n")
            left -= len(block)
            http = _fields(block)
        if left < 0:
            raise ValueError("a block shorter than its header")

        def pieces(n: int = left) -> Iterator[bytes]:
            while n:
                piece = data.read(min(n, CHUNK_BYTES))
                if not piece:
                    raise ValueError("the archive ends inside a record")
                n -= len(piece)
                yield piece

        body = pieces()
        yield fields, http, body
        for _ in body:
            pass


def _even(pieces: Iterator[bytes], size: int) -> Iterator[bytes]:
    """The same bytes in pieces of size, the last one shorter; one empty piece if there are none."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while len(held) > size:
            yield bytes(held[:size])
            del held[:size]
    yield bytes(held)


CHUNK = (
    "archive string, number bigint, record_id string, record_type string, key string, url string, refers_to string, declared_digest string, declared_bytes bigint, "
    "chunk bigint, data binary, bytes_so_far bigint, digest_so_far string, last boolean"
)


def chunks(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each chunk of each record's payload in archives (a column archive of paths; others are dropped).

    A record is (archive, number). Chunks have chunk_bytes, the last of a record may have
    fewer; an empty payload, and so a revisit, has one empty chunk. bytes_so_far and
    digest_so_far (SHA-1 in base32) cover the payload up to and with the chunk; where last is
    true they are the record's. declared_digest and declared_bytes are the header's, which
    for a revisit describe the payload it names; a response that differs from them, or an
    archive that ends early, raises an error. key and refers_to are null where the record has
    no such field. Null paths are left out.
    """
    rows = archives.where(F.col("archive").isNotNull()).select("archive")
    tasks = max(1, min(rows.count(), READERS))
    names = [x.split(" ")[0] for x in CHUNK.split(", ")]
    schema = pa.schema([pa.field(x.split(" ")[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split(" ")[1]]) for x in CHUNK.split(", ")])

    def told(value: str | None) -> str | None:
        return None if value is None else unquote(value)

    def of(path: str) -> Iterator[tuple]:
        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_stream(inner, compression=None) as source:
            for number, (fields, http, pieces) in enumerate(records(source)):
                kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").rpartition(":")[2] or None
                size = int(http["content-length"]) if "content-length" in http else None
                sha1, total, last = hashlib.sha1(), 0, None
                fixed = (path, number, fields.get("warc-record-id"), kind, told(fields.get(KEY.lower())), fields.get("warc-target-uri"), told(fields.get(REFERS.lower())), digest, size)
                for k, piece in enumerate(_even(pieces, chunk_bytes)):
                    if last is not None:
                        yield (*fixed, *last, False)
                    sha1.update(piece)
                    total += len(piece)
                    last = (k, piece, total, base32(sha1.digest()))
                if kind == "response" and ((digest is not None and last[3] != digest) or (size is not None and total != size)):
                    raise ValueError(f"record {number} of {path} is damaged")
                yield (*fixed, *last, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names)

        held, size = [], 0
        for batch in batches:
            for path in batch.column(0):
                for row in of(path.as_py()):
                    held.append(row)
                    size += len(row[10])
                    if size >= BATCH_BYTES or len(held) >= 2000:
                        yield made(held)
                        held, size = [], 0
        if held:
            yield made(held)

    return rows.repartition(tasks).mapInArrow(run, CHUNK)


def index(table: DataFrame) -> DataFrame:
    """(archive, number, key, record_type, payload_bytes, payload_digest, refers_to) of chunks(), one row for each record.

    Length and digest are those of the full payload: for a response what its chunks amount to,
    for a revisit what its header declares.
    """
    own = F.col("record_type") != "revisit"
    return table.where("last").select(
        "archive", "number", "key", "record_type",
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"), "refers_to",
    )
