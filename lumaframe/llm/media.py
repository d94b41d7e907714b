"""Media columns: payloads as images in tar shards, rows that carry digest, offset and length.

Each task packs the payloads of its rows into tar shards of SHARD_BYTES in the shared
folder, one member for each digest it meets, named by that digest; all rows of one text
then name the same member. A shard has a name of
its own and a row names a shard only once Spark has committed the task that wrote it, so
retries and lost executors leave at most unreferenced files. Payloads are 8-bit grey
images of WIDTH samples a row (PNG, lossless), a third to a half of the text's bytes.

Metadata columns come from range reads of the fixed-size image header alone; payloads
are read back by range. Shards are opened with Arrow's filesystem layer, so the shared
folder may be local, HDFS or an object store that it knows.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import new_folder, small_batches, written

SHARD_BYTES, WIDTH, LEVEL = 64 << 20, 64, 4
#: Signature and header of an image: all that a metadata read fetches.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(text: bytes, unit: int = WIDTH) -> bytes:
    """text with zero bytes up to a positive multiple of unit."""
    return text + bytes(-len(text) % unit if text else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes) -> bytes:
    """A grey image whose samples are the payload, WIDTH to a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with filter type 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample from the first HEADER_BYTES of an image."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not an image header")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def from_image(image: bytes) -> bytes:
    """The payload of an image that to_image made; checksums are verified."""
    width, height, _ = read_header(image[:HEADER_BYTES])
    at, body = HEADER_BYTES, b""
    while at < len(image):
        (size,) = struct.unpack(">I", image[at : at + 4])
        part = image[at + 4 : at + 8 + size]
        if zlib.crc32(part) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged image")
        if part[:4] == b"IDAT":
            body += part[4:]
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


class Shards:
    """Writes members to tar shards below a folder, a new shard when one is full."""

    def __init__(self, folder: str, limit: int):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.limit, self.out, self.name, self.at = limit, None, "", 0

    def add(self, name: str, body: bytes) -> tuple[str, int, int]:
        """Shard, offset of the body's first byte, and length."""
        if self.out is None or self.at + len(body) > self.limit:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.store.open_output_stream(f"{self.path}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(body)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + body + bytes(-len(body) % 512))
        offset = self.at + len(head)
        self.at = offset + len(body) + (-len(body) % 512)
        return self.name, offset, len(body)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(key, n_bytes, digest) of every row of df and (digest, folder, shard, offset, length) of every digest, as tables.

    digest is the SHA-256 of the stored form, 32 bytes. A null text counts as empty; an empty
    text is WIDTH zero samples. Equal texts have one digest, which names one member, whichever
    task wrote it first by name; members of the same digest in other shards (tasks don't
    know of each other's) are named by no row. Other columns are dropped.
    """
    spark = df.sparkSession
    small_batches(df.sparkSession)
    folder = new_folder(spark, "media")
    place, path = fs.FileSystem.from_uri(folder)
    place.create_dir(path, recursive=True)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = Shards(folder, shard_bytes), {}
        for batch in batches:
            sizes, found = [], []
            for t in batch.column(1):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                mark = hashlib.sha256(raw).digest()
                if mark not in known:
                    image, last = to_image(pad(raw)), shards.name
                    digest = hashlib.sha256(image)
                    member = (*shards.add(f"{digest.hexdigest()}.png", image), digest.digest())
                    if shards.name != last:
                        known.clear()  # no more is remembered than one shard holds
                    known[mark] = member
                sizes.append(len(raw))
                found.append(known[mark])
            shard, offset, length, digest = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(shard, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(digest, pa.binary())],
                ["key", "n_bytes", "shard", "offset", "length", "digest"],
            )
        shards.close()

    packed = rows.mapInArrow(run, f"key {kind}, n_bytes bigint, shard string, offset bigint, length bigint, digest binary")
    packed = written(packed, "packed")
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    members = packed.groupBy("digest").agg(place).select("digest", F.lit(folder).alias("folder"), "place.*")
    return packed.select(F.col("key").alias(key), "n_bytes", "digest"), written(members, "members")


def store(df: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, n_bytes, folder, shard, offset, length, digest in hex): whole texts as media, one row for each row of df; see pack."""
    packed, members = pack(df, key, text, shard_bytes)
    found = members.withColumnRenamed("digest", "d")
    return packed.join(found, F.col("digest") == F.col("d")).select(*[c for c in packed.columns if c != "digest"], "folder", "shard", "offset", "length", _hex("digest"))


def _hex(name: str) -> Column:
    return F.lower(F.hex(name)).alias(name)


def _read(manifest: DataFrame, columns: list[str], take, schema: str, size: int | None, dealt: bool = False) -> DataFrame:
    """manifest with what take makes of the first size bytes of each member (None: all of it).

    Rows go to tasks by shard, in the order of their offsets, unless they are dealt so
    already; a shard is bounded, and so are the rows that one task of pack() made of it.
    """
    rows = manifest.select(F.struct(*[f"`{c}`" for c in manifest.columns]).alias("row"), "folder", "shard", "offset", "length")
    if not dealt:
        shards = manifest.select("shard").distinct().count()
        rows = rows.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                got = []
                for folder, shard, offset, length in zip(*(part.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    if (folder, shard) != name:
                        if source is not None:
                            source.close()
                        place, path = fs.FileSystem.from_uri(folder)
                        name, source = (folder, shard), place.open_input_file(f"{path}/{shard}")
                    got.append(take(source.read_at(length if size is None else min(size, length), offset)))
                made = [pa.array(list(x), t.type) for x, t in zip(zip(*got, strict=True), columns, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["row", *(c.name for c in columns)])
        if source is not None:
            source.close()

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, {schema}").select("row.*", *(c.name for c in columns))


def metadata(manifest: DataFrame) -> DataFrame:
    """manifest with width, height and depth, from reads of HEADER_BYTES for each row."""
    columns = [pa.field("width", pa.int64()), pa.field("height", pa.int64()), pa.field("depth", pa.int64())]
    return _read(manifest, columns, read_header, "width bigint, height bigint, depth bigint", HEADER_BYTES)


def described(df: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, n_bytes, digest) of pack() with length, width, height and depth, and what features() makes of the payload.

    Every digest is read once, its header by a range read of its own; rows of equal texts
    get the same values.
    """
    packed, members = pack(df, key, text, shard_bytes)
    found = features(metadata(members), dealt=True)
    size = F.concat_ws("x", "width", "height", "depth")
    columns = ["length", "width", "height", "depth", "payload_bytes", "tail_crc32", *(F.unhex(c).alias(c) for c in ("payload_sha256", "media_sha256"))]
    found = written(found.select(F.col("digest").alias("d"), *columns, F.concat_ws(";", size, "samples").alias("feature")), "described")
    both = packed.join(found, F.col("digest") == F.col("d")).drop("d")
    return both.withColumns({c: _hex(c) for c in ("digest", "payload_sha256", "media_sha256")})


def load(manifest: DataFrame) -> DataFrame:
    """manifest with the payload read back from its shard."""
    return _read(manifest, [pa.field("payload", pa.binary())], lambda image: (from_image(image),), "payload binary", None)


def features(manifest: DataFrame, dealt: bool = False) -> DataFrame:
    """manifest with payload_bytes, payload_sha256, tail_crc32, media_sha256 and samples, from stored bytes only.

    samples has mean, spread, entropy and number of distinct samples.
    """

    def take(image: bytes) -> tuple:
        payload = from_image(image)
        count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        share = count[count > 0] / len(payload)
        value = np.arange(256)
        mean = float((count * value).sum()) / len(payload)
        spread = max(0.0, float((count * value * value).sum()) / len(payload) - mean * mean) ** 0.5
        entropy = abs(float(-(share * np.log2(share)).sum()))
        text = f"mean={mean:.4f};sd={spread:.4f};bits={entropy:.4f};distinct={len(share)}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(image).hexdigest(), text

    columns = [pa.field("payload_bytes", pa.int64()), pa.field("payload_sha256", pa.string()), pa.field("tail_crc32", pa.int64()), pa.field("media_sha256", pa.string()), pa.field("samples", pa.string())]
    return _read(manifest, columns, take, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_sha256 string, samples string", None, dealt)
