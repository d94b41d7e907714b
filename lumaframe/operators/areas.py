"""Sums and means over boxes of a field, whatever the field's size or the box's.

A summed-area table holds at each cell the sum of all cells above and to the left of it, so
that any box is four of its entries. It is made in blocks: sums inside a block, and the
sums that the block's edges get from the blocks before it. A field of any size is as many
tasks as it has blocks, and a cell costs the same for every radius.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions.vectors import clamp
from lumaframe.sources.scratch import written

#: Cells of a block's side.
BLOCK = 128
ENDS = ["row_0", "row_1", "col_0", "col_1"]


def _whole(cells: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, row, col, v, n, row_0, row_1, col_0, col_1) of every cell of each field's rectangle, whose ends are the last four."""
    side = lambda c: [F.min(c).alias(f"{c}_0"), F.max(c).alias(f"{c}_1")]
    box = cells.groupBy(*key).agg(*side("row"), *side("col"))
    rows = box.withColumn("row", F.explode(F.sequence("row_0", "row_1"))).repartition(*key, "row")
    grid = rows.select(*key, "row", F.explode(F.sequence("col_0", "col_1")).alias("col"), F.lit(0.0).alias("v"), F.lit(0).cast("long").alias("n"), *ENDS)
    known = cells.select(*key, F.col("row"), F.col("col"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"), F.when(F.col(value).isNull(), 0).otherwise(1).cast("long").alias("n"))
    both = grid.unionByName(known, allowMissingColumns=True).groupBy(*key, "row", "col")
    return both.agg(F.sum("v").alias("v"), F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ENDS])


def summed(cells: DataFrame, key: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """(key, row, col, v, n, s, t, and the rectangle's ends): for every cell of a field's rectangle its own sum and count, and those of all cells up to it.

    cells (key, row, col, value) are points of a field for each key, which may lack cells, have
    null values, or have several rows for a cell; rows and columns are whole numbers.
    """
    at = lambda c: F.floor(F.col(c) / block).alias(f"b{c}")
    rows = _whole(cells, key, value).select("*", at("row"), at("col"))
    own = [*key, "brow", "bcol"]
    over = lambda *names, by: Window.partitionBy(*names).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartition(*own)  # both windows are of one block
    for by, of in (("col", "row"), ("row", "col")):
        first = by == "col"
        rows = rows.withColumns({a: F.sum(b if first else a).over(over(*own, of, by=by)) for a, b in (("s", "v"), ("t", "n"))})
    rows = written(rows, "blocks")
    last = lambda c: F.pmod(F.col(c), F.lit(block)) == block - 1
    edge = lambda rows, along: rows.withColumns({c: F.sum(c).over(over(*key, *(x for x in ("brow", "bcol", "row", "col") if x in rows.columns and x != along), by=along)) for c in ("s", "t")})
    # what a block's columns, rows and whole get from the blocks above it, to its left, and both
    above = edge(rows.where(last("row")).select(*own, "col", "s", "t"), "brow").withColumn("brow", F.col("brow") + 1)
    left = edge(rows.where(last("col")).select(*own, "row", "s", "t"), "bcol").withColumn("bcol", F.col("bcol") + 1)
    both = edge(edge(rows.where(last("row") & last("col")).select(*own, "s", "t"), "brow"), "bcol").withColumns({"brow": F.col("brow") + 1, "bcol": F.col("bcol") + 1})
    listed = lambda rows, c, kind: rows.select(*own, F.lit(kind).alias("kind"), F.struct(F.col(c).alias("i") if c else F.lit(0).alias("i"), "s", "t").alias("x"))
    carried = listed(above, "col", "a").unionByName(listed(left, "row", "l")).unionByName(listed(both, None, "b"))
    carried = carried.groupBy(*own).agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("x")))).alias(f"__{k}") for k in "alb"])
    carried = carried.withColumnsRenamed({c: f"__own_{c}" for c in own})
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"__own_{c}"))
    joined = rows.join(carried, same, "left")
    # a block's columns and rows are without holes, so the first one's number tells where each stands
    entry = lambda kind, c: F.get(f"__{kind}", (F.col(c) - F.get(f"__{kind}", F.lit(0))["i"]).cast("int") if c else F.lit(0))
    joined = joined.withColumns({"__a": entry("a", "col"), "__l": entry("l", "row"), "__b": entry("b", None)})
    add = lambda c, zero: (F.col(c) + F.coalesce(f"__a.{c}", zero) + F.coalesce(f"__l.{c}", zero) + F.coalesce(f"__b.{c}", zero)).alias(c)
    return joined.select(*key, "row", "col", "v", "n", add("s", F.lit(0.0)), add("t", F.lit(0)), *ENDS)


def box_means(cells: DataFrame, key: list[str], value: str, reaches: list[int], block: int = BLOCK) -> DataFrame:
    """(key, row, col, reach, mean, n) of each cell of cells: mean and number of the known values at most reach rows and columns away.

    Boxes end at the edges of the field's rectangle, a cell's mean is null if none is known.
    One summed-area table serves all reaches: each of its entries goes to the cells whose
    boxes it is a corner of, four entries a cell and reach, in one shuffle.
    """
    cells = written(cells.select(*key, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), value), "cells")
    rows = summed(cells, key, value, block).withColumn("reach", F.explode(F.array(*map(F.lit, reaches))))

    def used(c: str) -> Column:
        """(place, sign) of the cells whose box ends here, or begins behind it."""
        x, low, high, reach = (F.col(n) for n in (c, f"{c}_0", f"{c}_1", "reach"))
        ends = F.when(x == high, F.sequence(F.greatest(low, high - reach), high)).when(x - reach >= low, F.array(x - reach))
        begins = F.when(x + reach + 1 <= high, F.array(x + reach + 1))
        sign = lambda places, s: F.coalesce(F.transform(places, lambda p: F.struct(p.alias("at"), F.lit(s).alias("sign"))), F.array().cast("array<struct<at:bigint,sign:int>>"))
        return F.concat(sign(ends, 1), sign(begins, -1))

    put = rows.withColumn("__r", F.explode(used("row"))).withColumn("__c", F.explode(used("col")))
    signed = lambda c: (F.col(c) * F.col("__r.sign") * F.col("__c.sign")).alias(c)
    put = put.select(*key, F.col("__r.at").alias("row"), F.col("__c.at").alias("col"), "reach", signed("s"), signed("t"), F.lit(False).alias("own"))
    there = cells.select(*key, "row", "col", F.explode(F.array(*map(F.lit, reaches))).alias("reach"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("t"), F.lit(True).alias("own"))
    made = put.unionByName(there).groupBy(*key, "row", "col", "reach").agg(F.sum("s").alias("s"), F.sum("t").alias("n"), F.max("own").alias("own")).where("own")
    return made.select(*key, "row", "col", "reach", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("mean"), "n")


def mask_coverage(mask: DataFrame, key: list[str], shaded: str, opacity: float, softness: list[int]) -> DataFrame:
    """(key, row, col, softness, coverage, alpha) of a shadow mask, one row for each cell (key, row, col) and softness.

    coverage is the shaded part of the box softness cells round a cell that lies in the field
    (0: the cell itself), alpha the opacity of its paint, 0 to 255. A null is not shaded.
    """
    rows = mask.select(*key, "row", "col", F.coalesce(F.col(shaded), F.lit(False)).cast("int").alias("v"))
    found = box_means(rows, key, "v", [max(0, int(k)) for k in softness])
    whole = F.floor(clamp(F.lit(float(opacity)), 0.0, 1.0) * 255 + 0.5)
    return found.select(*key, "row", "col", F.col("reach").alias("softness"), F.col("mean").alias("coverage"), F.floor(whole * F.col("mean") + 0.5).cast("int").alias("alpha"))
