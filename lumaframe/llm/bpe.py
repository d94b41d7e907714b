"""Byte-level BPE encoding and decoding.

Merges are driven by a hierarchical-bitmap rank queue: one bucket per merge rank holds
positions in a linked list of symbols, two levels of bit words mark the buckets that
hold any, find-first-set names the next rank, and entries that a merge has
overtaken are skipped when they surface. A pre-token of n bytes costs O(n log n) at
most, so one that spans a whole document is no special case.

The vocabulary file is a parameter; nothing of it is kept in the repository. The ranks
(a fixed-size table, under 1 MB) are read on the driver and sent to the workers once.
Encoding is row-local: no shuffle, no state but a bounded memo of short pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Longest pre-token kept in a worker's memo, and most of them kept in each of its two generations.
MEMO_CHARS, MEMO_ENTRIES = 40, 450_000
#: Characters of a text whose pre-tokens are split all at once.
SPLIT_CHARS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Positions by merge rank; pop gives the leftmost position of the lowest rank.

    Two levels of 256-bit words: a bit of a leaf marks a bucket that holds positions, a
    bit of the root a leaf that isn't zero. x & -x is the first set bit.
    """

    def __init__(self, size: int):
        self.leaf = [0] * (size // 256 + 1)
        self.root = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            word = rank >> 8
            self.leaf[word] |= 1 << (rank & 255)
            self.root |= 1 << word
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        word = (self.root & -self.root).bit_length() - 1
        bits = self.leaf[word]
        rank = (word << 8) + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.leaf[word] = bits = bits & (bits - 1)
            if not bits:
                self.root &= self.root - 1
        return rank, position


class Codec:
    """Encodes and decodes texts by the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split, self.walk = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.token = {rank: token for token, rank in ranks.items()}
        self.memo = _Memo(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n, queue = len(piece), self.queue
        push, pop = queue.push, queue.pop
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        rank_at = [rank_of(piece[i : i + 2]) for i in range(n - 1)]  # of the pair that starts here
        rank_at.append(None)
        for i, rank in enumerate(rank_at):
            if rank is not None:
                push(rank, i)
        while queue.root:
            rank, i = pop()
            if rank_at[i] != rank:
                continue  # stale: a merge has overtaken this entry
            gone = after[i]
            after[i] = end = after[gone]
            rank_at[gone] = None
            if end < n:
                before[end] = i
                rank_at[i] = new = rank_of(piece[i : after[end]])
                if new is not None:
                    push(new, i)
            else:
                rank_at[i] = None
            left = before[i]
            if left >= 0:
                old = rank_at[left]
                rank_at[left] = new = rank_of(piece[left:end])
                if new is not None and new != old:
                    push(new, left)
        ids, i, ranks = [], 0, self.ranks
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if len(text) <= SPLIT_CHARS:
            return b"".join(map(self.memo.__getitem__, self.split(text)))
        ids, known = bytearray(), self.memo
        for found in self.walk(text):  # pre-tokens of a very long text are never all held at once
            ids += known[found[0]]
        return bytes(ids)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memo(dict):
    """Ids by pre-token; when it is full, what the last generation has used again lives on."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = _pack(self.codec.merge(piece.encode()))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.age()
            self[piece] = ids
        return ids


_CODECS: dict[tuple[str, str], Codec] = {}


def worker_codec(name: str, ranks, pattern: str) -> Codec:
    """The codec of this Python worker: its memo serves all tasks that the worker runs."""
    if (name, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[name, pattern] = Codec(ranks.value, pattern)
    return _CODECS[name, pattern]


def encode(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary, n_tokens long): whole texts as token ids, one output row per input row.

    ids are little-endian unsigned 32-bit integers. Null and empty texts give no ids.
    Rows with a null or repeated key are encoded like any other; other columns are
    dropped, so their names can't clash.
    """
    small_batches(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(vocabulary, ranks, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # ids take more bytes than text; keep batches small
                part = batch.slice(start, 512)
                ids = [codec.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                    ["key", "ids", "n_tokens"],
                )

    out = rows.mapInArrow(run, f"key {kind}, ids binary, n_tokens bigint")
    return out.select(F.col("key").alias(key), "ids", "n_tokens")


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary): the bytes that token ids stand for. Null ids give empty bytes."""
    small_batches(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(vocabulary, ranks, "")
        for batch in batches:
            texts = [codec.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["key", "decoded"])

    return rows.mapInArrow(run, f"key {kind}, decoded binary").select(F.col("key").alias(key), "decoded")


def round_trip(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids; with_ids adds the ids.

    The ids stay in the worker that made them: sending them through the JVM to a second
    operator would move about twice the text. Nulls, repeats and extra columns as in encode.
    """
    small_batches(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    columns = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string()), pa.field("ids", pa.binary())]
    columns = columns[: 3 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(vocabulary, ranks, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # ids take more bytes than text; keep batches small
                part, got = batch.slice(start, 512), []
                for t in part.column(1):
                    ids = codec.encode(t.as_py())
                    got.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest(), ids)[: len(columns)])
                made = [pa.array(list(x), c.type) for x, c in zip(zip(*got, strict=True), columns, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["key", *(c.name for c in columns)])

    out = rows.mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
    return out.withColumnRenamed("key", key)
