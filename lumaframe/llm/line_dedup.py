"""Line de-duplication over overlapping windows of three lines.

Lines that hold more than white space are numbered within their document; every three
consecutive ones form a window with a 128-bit hash. A window that occurs again anywhere,
in document order, is removed there: the lines that the later occurrences cover are
merged and dropped, so an earlier copy of every dropped line stays. Blank lines stay.

Hashes, never lines, are shuffled to find repeats. First occurrences come from an
aggregation that combines map-side, and are written before windows meet them: both sides
of that join, and of the one that brings texts to their covered lines, are then plain
exchanges, which AQE splits where a window, or one text of many rows, is very common.
Texts move once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, written

LINES = 3


def _filled(text: Column) -> Column:
    """The lines of a text that hold more than white space."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)


def _hashes(lines: Column) -> Column:
    """(window number, two hashes) of each window of an array of lines."""
    def at(i: Column) -> list[Column]:
        return [F.get(lines, i + k) for k in range(LINES)]

    windows = F.sequence(F.lit(0), F.size(lines) - LINES)
    found = F.transform(windows, lambda i: F.struct(i.alias("w"), F.xxhash64(*at(i)).alias("h1"), F.xxhash64(F.lit("second"), *at(i)).alias("h2")))
    return F.when(F.size(lines) >= LINES, found)


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, windows: pd.Series) -> pd.Series:
    def cut(text, starts):
        covered = {w + k for w in starts for k in range(LINES)}
        kept, n = [], 0
        for line in text.split("\n"):
            filled = bool(line.strip(" \t\x0b\x0c\r"))
            if not (filled and n in covered):
                kept.append(line)
            n += filled
        return "\n".join(kept)

    return pd.Series([None if w is None else cut(t, w) for t, w in zip(texts, windows, strict=True)], dtype=object)


def _later(seen: DataFrame) -> DataFrame:
    """The windows (h1, h2, at) of seen that are not the first of their hashes."""
    first = seen.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last")
    first = written(first.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first"), "windows").hint("merge")
    return seen.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).where("at > first").select("h1", "h2", "at")


def drop_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the lines of later window occurrences cut from its text, and n_lines and n_removed appended.

    Occurrences are ordered by key (null first), text hash and window number. Rows that
    agree in key and text are one document and get the same result. A null text stays
    null with no lines; a text of fewer than three filled lines stays as it is. Columns
    of df keep their names and order; n_lines or n_removed of df are replaced.
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    low = F.lit(-(2**63)).cast("long")
    rows = df.select(row.alias("row"), F.coalesce(F.col(key).cast("long"), low).alias("k1"), F.xxhash64(text).alias("k2"), F.col(text).alias("t"))
    seen = rows.select("k1", "k2", _filled(F.col("t")).alias("lines")).select("k1", "k2", F.explode(_hashes(F.col("lines"))).alias("x"))
    seen = seen.select("x.h1", "x.h2", F.struct("k1", "k2", "x.w").alias("at"))
    cut = _later(seen).groupBy(F.col("at.k1").alias("c1"), F.col("at.k2").alias("c2")).agg(F.collect_set("at.w").alias("windows"))
    cut = written(cut, "covered").hint("merge")  # it grows with the texts: the same join at every size
    both = rows.join(cut, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    hit = F.col("windows").isNotNull()
    new = F.coalesce(_without(F.when(hit, F.col("t")), F.col("windows")), F.col("t"))
    gone = F.size(F.array_distinct(F.flatten(F.transform("windows", lambda w: F.sequence(w, w + LINES - 1)))))
    count = F.when(F.col("t").isNull(), 0).otherwise(F.size(F.split("t", "\n")))
    done = both.select("row", new.alias("new"), count.cast("long").alias("n_lines"), F.when(hit, gone).otherwise(0).cast("long").alias("n_removed"))
    columns = [F.col("new").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in keep]
    return done.select(*columns, "n_lines", "n_removed")
