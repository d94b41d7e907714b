"""Previews inside RAW files: the largest complete JPEG among a container's bytes.

A container is read in pieces that overlap by what a marker can straddle, so only a piece is
held whatever its size, and what is found is a place in it; the preview itself is one range
read more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How far an end is looked for, and the least size of a preview; what is smaller is a thumbnail.
SOI, EOI, FAR, LEAST = b"\xff\xd8\xff", b"\xff\xd9", 80 << 20, 200 << 10
PIECE = 1 << 20


def _find(read_at: Callable[[int, int], bytes], mark: bytes, start: int, end: int, piece: int) -> int:
    """Where mark begins first, from start on and wholly before end; -1 if nowhere."""
    while start + len(mark) <= end:
        some = read_at(start, min(piece, end - start))
        at = some.find(mark)
        if at >= 0:
            return start + at
        start += len(some) - len(mark) + 1  # the next piece takes up what may begin a mark
    return -1


def largest_jpeg(read_at: Callable[[int, int], bytes], size: int, least: int = LEAST, far: int = FAR, piece: int = PIECE) -> tuple[int, int] | None:
    """Offset and length of the largest complete JPEG of a container, the first of equals; None if it is under least bytes.

    An image begins with its marker and ends with the next end marker, which is looked for
    over far bytes; a beginning without an end is given up with all that was searched.
    """
    piece, at, best = max(piece, len(SOI)), 0, (0, 0)
    while (begin := _find(read_at, SOI, at, size, piece)) >= 0:
        limit = min(size - 1, begin + far)
        end = _find(read_at, EOI, begin + 2, limit + 1, piece)
        if end < 0:
            at = max(limit, begin + 1)
            continue
        at = end + 2
        best = max(best, (at - begin, -begin))
    return (-best[1], best[0]) if best[0] and best[0] >= least else None


def _previews(df: DataFrame, key: str, column: str, open_: Callable, least: int, piece: int) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.col(column).alias("source"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(1):
                place = None
                if value.is_valid:
                    read_at, size = open_(value)
                    place = largest_jpeg(read_at, size, least, FAR, piece)
                found.append(place or (None, None))
            offset, length = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["key", "offset", "length"])

    return rows.mapInArrow(run, f"key {kind}, offset bigint, length bigint").withColumnRenamed("key", key)


def embedded_previews(df: DataFrame, key: str, payload: str, least: int = LEAST, piece: int = PIECE) -> DataFrame:
    """(key, offset, length) of the preview in each row's bytes; nulls where there is none, or no bytes. Other columns are dropped."""

    def open_(value):
        view = memoryview(value.as_buffer())
        return (lambda at, n: bytes(view[at : at + n])), len(view)

    return _previews(df, key, payload, open_, least, piece)


def file_previews(df: DataFrame, key: str, path: str, least: int = LEAST, piece: int = PIECE) -> DataFrame:
    """(key, offset, length) of the preview in each row's file, by range reads; a path is one that Arrow's filesystem layer opens."""

    def open_(value):
        store, inner = fs.FileSystem.from_uri(value.as_py())
        source = store.open_input_file(inner)
        return (lambda at, n: source.read_at(n, at)), source.size()

    return _previews(df, key, path, open_, least, piece)
