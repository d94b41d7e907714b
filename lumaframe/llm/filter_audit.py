"""Audit of how document filters interact: what each removes in every order of application.

Every document has a mask of the filters it fails. All that an order of filters does follows
from counts of masks, so a part (a source) is three rows of 32 integers: how many documents,
good ones and toxic ones have each mask. These rows are stacked and multiplied by integer
matrices with a row for each mask and a column for each (order, step): 1 where a document of
that mask is kept, removed or found redundant there, or fails that filter alone. What a
filter removes over all orders is a sum of columns.

Texts are read once and leave as a mask and two digests. Copies are found by an aggregation
that is salted, so that one text of very many copies is not one task; masks and labels are
counted before they are gathered. A part is 96 numbers, however many documents it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import beside
from .shared import written

SPACES = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
MASKS, ORDERS = 1 << len(FILTERS), ["".join(p) for p in permutations(FILTERS)]
#: Limits of filters A (words), B (distinct words, per cent) and C (capitals, per cent).
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: Parts whose outcomes are held at once.
PARTS = 64
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@cache
def matrices() -> dict[str, np.ndarray]:
    """Integer matrices with a row for each mask and a column for each step of each order; `filter` names the column's filter."""
    filters = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
    bit = 1 << filters
    before = np.cumsum(bit, axis=1) - bit
    bit, before, mask = bit.ravel(), before.ravel(), np.arange(MASKS)[:, None]
    fails, failed = (mask & bit) != 0, (mask & before) != 0
    found = {"kept": ~fails & ~failed, "removed": fails & ~failed, "redundant": fails & failed, "unique_fails": mask == bit}
    return {k: v.astype(np.int64) for k, v in found.items()} | {"filter": filters.ravel()}


def outcomes(counts: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS, each (parts, 600), of (parts, 3, 32) counts of all, good and toxic documents by mask."""
    m = matrices()
    every, good, toxic = (counts[:, k, :] for k in range(3))
    found = {k: every @ m[k] for k in ("kept", "removed", "redundant", "unique_fails")}
    found |= {"good_lost": good @ m["removed"], "toxic_lost": toxic @ m["removed"]}
    by_filter = np.stack([found["removed"][:, m["filter"] == k].sum(axis=1) for k in range(len(FILTERS))], axis=1)
    return found | {"shapley": by_filter[:, m["filter"]]}


def _local_mask(text: Column) -> Column:
    """Bits of the filters that see one text: A few words, B few distinct words, C many capitals, D signs."""
    words = F.array_remove(F.split(text, SPACES), "")
    n = F.size(words).cast("long")
    short = n < LEAST_WORDS
    same = 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * n
    loud = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.char_length(text).cast("long")
    signs = text.rlike("[#$%&*|]")
    bits = [F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate((short, same, loud, signs))]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


def masks(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, part, mask), one row for each row of df.

    Bit k of mask is set if the document fails filter k of ABCDE. E fails where a smaller
    key has the same text (two digests of 256 and 64 bits agree); rows that repeat a key
    do not fail for each other, and a null key neither fails E nor makes others fail. A null
    text is empty, a null part the empty string; an empty text fails A alone, and E if
    repeated. Other columns are dropped.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), t.alias("t"))
    rows = rows.select("key", "part", _local_mask(F.col("t")).alias("mask"), F.unhex(F.sha2("t", 256)).alias("h1"), F.xxhash64("t").alias("h2"), F.monotonically_increasing_id().alias("row"))
    rows = beside(written(rows, "marks"), ["h1", "h2"], "row", first=(F.min, "key"))
    again = F.when(F.col("first") < F.col("key"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.select(F.col("key").alias(key), "part", (F.col("mask") + again).cast("int").alias("mask"))


def histograms(found: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic) of masks(): counts of documents, of those with quality = 1 and with toxic = 1.

    A key counts as good (toxic) if any of its label rows says so; keys without labels are
    neither, and label rows with a null key belong to none.
    """
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    known = written(known.where("good + toxic > 0"), "labels")
    rows = found.join(known, F.col(key) == F.col("k"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def audit(histogram: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of histograms().

    One row for each part, order of ABCDE and step; zeros are included, and no part has no row.
    """
    at = lambda name, k: F.sum(F.when(F.col("mask") == k, F.col(name)).otherwise(0))
    stacked = F.array(*[at(name, k) for name in ("n", "good", "toxic") for k in range(MASKS)])
    rows = histogram.groupBy("part").agg(stacked.alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = len(FILTERS)
        orders, numbers = np.repeat(np.array(ORDERS, dtype=object), steps), np.tile(np.arange(1, steps + 1, dtype=np.int32), len(ORDERS))
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS):
                some = batch.slice(start, PARTS)
                n = some.num_rows
                found = outcomes(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, 3, MASKS))
                names = some.column(0).take(pa.array(np.repeat(np.arange(n), len(orders))))
                made = [names, pa.array(np.tile(orders, n), pa.string()), pa.array(np.tile(numbers, n), pa.int32()), *(pa.array(found[c].ravel(), pa.int64()) for c in COUNTS)]
                yield pa.RecordBatch.from_arrays(made, ["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def filter_audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """audit() of all rows of df with their labels; nulls and repeats as in masks() and histograms()."""
    return audit(histograms(masks(df, key, text, part), labels, key))
