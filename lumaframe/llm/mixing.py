"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source_size copies. Within a source the
documents stand in a fixed order, the expected copies are summed along it from one
random offset, and a document is emitted once for each integer that its stretch of the
sum crosses. The order runs through size classes, so large and small documents are
sampled evenly and a source's words come close to its target.

The prefix sum is taken in steps: over the size classes of a source, over the shelves of a
class, over the cells of a shelf, and over the documents of a cell. Cells are dealt by a hash
of key and text, and a class has about as many shelves as a shelf has cells. Equal rows are
counted first and are one document of so many ranks. No task holds a source, a class or the
rows of one key or one document, so one that has a third of all rows is dealt out like any other. Sources are ranked and levelled by sums as well, and may be very many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import count_between, written

WORD, SPACES = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Rows that a cell holds when a third of all rows share a source and a size class.
CELL_ROWS = 2000
SEED = "mix"


def word_count(text: Column) -> Column:
    return count_between(text, SPACES)


def _in_order(sizes: DataFrame) -> DataFrame:
    """sizes with the place (from 0) of each source in code point order, null last."""
    last = F.col("source").asc_nulls_last()
    rows = written(sizes.repartitionByRange(last).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(last))
    return rows.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + within - 1).drop("part", "start")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source, as a table.

    Sources in code point order, null last, take the weights in turn. The budget is
    share times all sizes; a source stops at most times its size and what it leaves goes
    to the others by weight. The fixed point is min(cap, level * weight) with one level
    for all sources: it rises from what all would take until no more sources stop, by one
    sum over the sources for each step.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = _in_order(sizes).withColumn("weight", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int")))
    rows = written(rows.withColumn("cap", most * F.col("source_size")), "caps")
    level, budget = -1.0, share * (rows.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    while True:
        stops = F.col("cap") / F.col("weight") < level
        taken, free = rows.agg(F.sum(F.when(stops, F.col("cap")).otherwise(0.0)), F.sum(F.when(stops, 0.0).otherwise(F.col("weight")))).first()
        higher = (budget - taken) / free if free else float("inf")
        if higher == level or not free:
            break
        level = higher
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.lit(level) * F.col("weight")) if free else F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"))


def size_class(size: Column) -> Column:
    """Eight classes for each power of two; larger sizes have larger classes."""
    return F.when(size <= 0, F.lit(0)).otherwise(F.floor(F.log2(size.cast("double")) * 8).cast("int") + 1)


def offset(source: Column, seed: str) -> Column:
    """One offset in [0, 1) for each source, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(2**48)


def _spread(key: str, text: str) -> Column:
    """48 bits of a digest of key and text: the cell of a row."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _placed(rows: DataFrame, cells: int) -> DataFrame:
    """rows with the parts of their place in the order: source, size class, and shelf and cell."""
    shelf = math.isqrt(cells - 1) + 1
    rows = rows.select(
        "*",
        F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source")).alias("sk"),
        size_class(F.col("size")).alias("class"),
        F.pmod("spread", F.lit(cells)).alias("cell"),
    )
    return rows.withColumn("shelf", F.floor(F.col("cell") / shelf).cast("int"))


def _counted(df: DataFrame, key: str, text: str, source: str, *others: Column) -> DataFrame:
    return df.select(*others, F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _spread(key, text).alias("spread"))


def _ranked(df: DataFrame, key: str, text: str, source: str, weights, share: float, most: float, seed: str) -> DataFrame:
    """(key, source, size, spread, m, first, source_size, target, rate, begin), a table with a row for each document and its m equal rows.

    Equal rows follow each other in the order, so a document is a stretch of ranks, from
    first + 1 to first + m, however many rows it has. The sums ahead of a cell are taken over
    its shelf, over the shelves of its size class, and over the classes of its source, so
    neither a large source nor a large group of documents of equal size is one task.
    """
    groups = written(_counted(df, key, text, source).groupBy("key", "source", "size", "spread").agg(F.count("*").alias("m")), "sizes")
    cells = max(1, -(-(groups.agg(F.sum("m").alias("n")).first()["n"] or 0) // (3 * CELL_ROWS)))
    keys = ["source", "sk", "class", "shelf", "cell"]
    total = [F.sum("n").alias("n"), F.sum("words").alias("words")]
    by_cell = _placed(groups, cells).groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("size")).alias("words"))
    by_shelf = by_cell.groupBy(*keys[:4]).agg(*total)
    by_class = by_shelf.groupBy(*keys[:3]).agg(*total)
    goal = targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goal = goal.withColumnRenamed("source", "s")

    def ahead(rows: DataFrame, by: list[str], along: str, name: str) -> DataFrame:
        before = Window.partitionBy(*by).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*by, along, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(name))

    classes = ahead(by_class, ["source", "sk"], "class", "ahead").join(goal, F.col("source").eqNullSafe(F.col("s")))
    shelves = ahead(by_shelf, ["sk", "class"], "shelf", "upto").join(classes.select("sk", "class", "ahead", "source_size", "target"), ["sk", "class"])
    starts = ahead(by_cell, ["sk", "class", "shelf"], "cell", "within").join(shelves, ["sk", "class", "shelf"])
    rows = _placed(groups, cells).drop("shelf").join(starts.drop("shelf"), ["sk", "class", "cell"])
    inside = Window.partitionBy("sk", "class", "cell").orderBy("size", F.col("key").asc_nulls_last(), "spread").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("ahead") + F.col("upto") + F.col("within") + F.coalesce(F.sum("m").over(inside), F.lit(0))
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    return written(rows.select("key", "source", "size", "spread", "m", first.alias("first"), "source_size", "target", rate.alias("rate"), offset(F.col("source"), seed).alias("begin")), "ranked")


def _copies(rank: Column) -> Column:
    crossed = F.floor(F.col("begin") + rank * F.col("rate")) - F.floor(F.col("begin") + (rank - 1) * F.col("rate"))
    return F.when(F.col("size") == 0, 0).otherwise(crossed).cast("long")


def copies(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
) -> DataFrame:
    """(key, size, source, source_size, target, n_copies), one row for each input row.

    size is the number of words (null text: 0). n_copies is how often the mix takes the
    document, at most ceil(most). A null source is a source of its own; documents without
    words are never taken. Rows with equal key, source and text are interchangeable, so
    repeated rows give the same rows in every run. Other columns are dropped.
    """
    rows = _ranked(df, key, text, source, weights, share, most, seed)
    # a document of very many rows is laid out in parts, so that its rows are many tasks
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(CELL_ROWS).cast("long"))))
    parts = parts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = parts.withColumn("j", F.explode(F.sequence(F.col("part") + 1, F.least(F.col("m"), F.col("part") + CELL_ROWS))))
    return each.select(F.col("key").alias(key), "size", "source", "source_size", "target", _copies(F.col("first") + F.col("j")).alias("n_copies"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows of documents that have several, with j, the number of a row among those of its document.

    Rows are dealt over strands first and numbered from the sum of the strands before, so
    that no task meets all rows of a document.
    """
    by, strands = ["key", "source", "spread"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "repeated").withColumn("strand", F.pmod("id", F.lit(strands)))
    counts = rows.groupBy(*by, "strand").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("strand").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in [*by, "strand"]], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    same = F.col("strand") == F.col("_strand")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = F.row_number().over(Window.partitionBy(*by, "strand").orderBy("id"))
    return rows.join(starts, same).withColumn("j", F.col("start") + within)


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
) -> DataFrame:
    """The rows of df, each as often as the mix takes it (0, 1 or 2 times by default).

    Columns are those of df, whatever their names. Nulls and repeated rows as in copies.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    ranked = _ranked(df, key, text, source, weights, share, most, seed)
    told = ranked.select(*[F.col(c).alias(f"_{c}") for c in ("key", "source", "spread")], "size", "m", "first", "rate", "begin")
    rows = df.select(row.alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), _spread(key, text).alias("spread"))
    same = F.col("spread") == F.col("_spread")
    for c in ("key", "source"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = rows.join(told, same).drop("_key", "_source", "_spread")
    taken = found.where("m = 1").withColumn("j", F.lit(1)).select("row", _copies(F.col("first") + 1).alias("n"))
    if not ranked.where("m > 1").isEmpty():
        taken = taken.union(_numbered(found.where("m > 1")).select("row", _copies(F.col("first") + F.col("j")).alias("n")))
    return taken.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")
