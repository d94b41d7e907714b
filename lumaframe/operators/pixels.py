"""Pixel statistics: weighted and circular moments, histograms, bands, zones, sliding windows."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions import colour

# Fixed values.
BANDS = (("red", 28), ("orange", 62), ("yellow", 100), ("green", 145), ("aqua", 195), ("blue", 255), ("purple", 305), ("magenta", 350))
CHROMA_FLOOR, HIST_BINS, STEPS = 0.02, 512, 21
HUE_BINS, HUE_REACH, MONO_FRACTION, VIGNETTE_SYMMETRY = 36, 2, 0.007, 0.62


def with_lab(pixels: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """pixels with L, a, b_, C and H.

    One step for each stage of the conversion, so a channel is decoded once and the
    generated code stays small.
    """
    keep = pixels.columns
    rows = pixels.select("*", *[colour.decode(F.col(c)).alias(f"__l{i}") for i, c in enumerate((r, g, b))])
    light = [F.col(f"__l{i}") for i in range(3)]
    rows = rows.select(*keep, *[F.cbrt(m[0] * light[0] + m[1] * light[1] + m[2] * light[2]).alias(f"__c{i}") for i, m in enumerate(colour.TO_CONE)])
    cone = [F.col(f"__c{i}") for i in range(3)]
    rows = rows.select(*keep, *[(m[0] * cone[0] + m[1] * cone[1] + m[2] * cone[2]).alias(n) for n, m in zip(("L", "a", "b_"), colour.TO_LAB, strict=True)])
    return rows.select("*", colour.chroma(F.col("a"), F.col("b_")).alias("C"), colour.hue(F.col("a"), F.col("b_")).alias("H"))


def moments(w: Column, L: str = "L", a: str = "a", b: str = "b_", C: str = "C") -> list[Column]:
    """Weighted aggregates of a region: sums only, so partial aggregation does the work before the shuffle."""
    n = F.sum(w)
    mean = lambda x: F.sum(w * x) / n
    mL, mC, ma, mb = (mean(F.col(c)) for c in (L, C, a, b))
    sd = lambda c, m: F.sqrt(F.greatest(F.lit(0.0), mean(F.col(c) * F.col(c)) - m * m))
    strength = F.when(mC > 1e-6, F.least(F.lit(1.0), colour.chroma(ma, mb) / mC)).otherwise(F.lit(0.0))
    return [
        n.alias("weight"), mL.alias("L_mean"), sd(L, mL).alias("L_sd"), mC.alias("C_mean"), sd(C, mC).alias("C_sd"),
        colour.hue(ma, mb).alias("hue_mean"), strength.alias("hue_strength"), ma.alias("a_mean"), mb.alias("b_mean"),
    ]


def zones(pixels: DataFrame) -> DataFrame:
    """One row for each pixel and zone that it belongs to, with the weight w of its membership."""
    return pixels.select("*", F.inline(colour.zone_weights(F.col("L")))).where("w > 0")


def histogram_bin(L: Column, bins: int = HIST_BINS) -> Column:
    inside = F.floor(L * (bins - 1)).cast("int")
    return F.when(L <= 0, 0).when(L >= 1, bins - 1).otherwise(inside)


def histogram_percentiles(binned: DataFrame, group: list[str], bins: int = HIST_BINS, steps: int = STEPS) -> DataFrame:
    """(group, step, level) from (group, bin, n): the first bin whose running sum reaches step's share of all.

    Pixels are aggregated to at most bins rows for each group before the window runs.
    """
    by_bin = binned.groupBy(*group, "bin").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(*group).orderBy("bin")
    summed = by_bin.withColumn("cum", F.sum("n").over(along)).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    stepped = summed.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    reached = stepped.where(F.col("cum") >= F.col("step") / F.lit(float(steps - 1)) * F.col("total"))
    # a share of nothing is reached before the first bin
    level = F.when(F.col("step") == 0, 0).otherwise(F.min("bin")) / F.lit(float(bins - 1))
    return reached.groupBy(*group, "step").agg(level.alias("level"))


def nearest_band(h: Column) -> Column:
    """Key of the band nearest to a hue in whole degrees; of equally near ones the first listed."""
    return colour.nearest_name(F.floor(h).cast("double"), BANDS)


def bands(pixels: DataFrame, group: list[str]) -> DataFrame:
    """(group, band, share, chroma, L, hue) of pixels that have a hue; bands without pixels have no row."""
    # whole degrees first: pixels are summed before bands are named, and grey ones leave afterwards, so that
    # no filter is pushed below the colour conversion and repeats it
    chromatic = lambda x: F.sum(F.when(F.col("C") >= CHROMA_FLOOR, x))
    by_degree = pixels.groupBy(*group, F.floor("H").cast("int").alias("__h")).agg(chromatic(F.lit(1)).alias("n"), *[chromatic(F.col(c)).alias(c) for c in ("C", "L", "a", "b_")])
    made = by_degree.where("n > 0").withColumn("band", nearest_band(F.col("__h"))).groupBy(*group, "band").agg(*[F.sum(c).alias(c) for c in ("n", "C", "L", "a", "b_")])
    mean = lambda c: F.col(c) / F.col("n")
    made = made.select(*group, "band", "n", mean("C").alias("chroma"), mean("L").alias("L"), colour.hue(mean("a"), mean("b_")).alias("hue"))
    return made.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def dominant(pixels: DataFrame, group: list[str]) -> DataFrame:
    """(group, L, C, H): the strongest cluster of neighbouring hues, weighted by colour and light.

    Pixels vote into HUE_BINS bins; the best run of 2 * HUE_REACH + 1 bins round the circle
    wins (the first on a tie). Grey images, by presence of colour or by the winner's chroma,
    give chroma 0 and the mean lightness of what is lit.
    """
    lit = colour.lit_weight(F.col("L"))
    above = F.greatest(F.lit(0.0), F.col("C") - CHROMA_FLOOR)
    votes = pixels.select(*group, "L", "a", "b_", lit.alias("lit"), (lit * above).alias("mass"), (lit * F.col("C") * above).alias("w"), (F.floor(F.col("H") / (360 / HUE_BINS)) % HUE_BINS).cast("int").alias("bin"))
    sums = votes.groupBy(*group, "bin").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("L")).alias("wL"), F.sum(F.col("w") * F.col("a")).alias("wa"), F.sum(F.col("w") * F.col("b_")).alias("wb"),
        F.sum("lit").alias("lit"), F.sum(F.col("lit") * F.col("L")).alias("litL"), F.sum("mass").alias("mass"),
    )
    whole = sums.groupBy(*group).agg(F.sum("w").alias("w_all"), F.sum("lit").alias("lit"), F.sum("litL").alias("litL"), F.sum("mass").alias("mass"))
    near = F.explode(F.transform(F.sequence(F.lit(-HUE_REACH), F.lit(HUE_REACH)), lambda k: F.pmod(F.col("bin") + k, F.lit(HUE_BINS))))
    spread = sums.select(*group, near.alias("centre"), "w", "wL", "wa", "wb")
    runs = spread.groupBy(*group, "centre").agg(*[F.sum(c).alias(c) for c in ("w", "wL", "wa", "wb")])
    best = runs.groupBy(*group).agg(F.max_by(F.struct("w", "wL", "wa", "wb"), F.struct(F.round("w", 9), -F.col("centre"))).alias("best"))
    both = whole.join(best, group)
    L, a, b = (F.col(f"best.{c}") / F.col("best.w") for c in ("wL", "wa", "wb"))
    mean = F.when(F.col("lit") > 0, F.col("litL") / F.col("lit"))
    none = (F.col("w_all") <= 0) | ((F.col("lit") > 0) & (F.col("mass") / F.col("lit") < MONO_FRACTION))
    colourless = none | (colour.chroma(a, b) < colour.ACHROMATIC_CHROMA)
    return both.select(
        *group,
        F.when(none, F.coalesce(mean, F.lit(0.5))).when(colourless, F.coalesce(mean, L)).otherwise(L).alias("L"),
        F.when(colourless, 0.0).otherwise(colour.chroma(a, b)).alias("C"),
        F.when(colourless, 0.0).otherwise(colour.hue(a, b)).alias("H"),
    )


def vignette(pixels: DataFrame, group: list[str], width: Column, height: Column) -> DataFrame:
    """(group, falloff, symmetry, usable): light at the centre against the four corners, in stops."""
    cx, cy = (width - 1) / 2, (height - 1) / 2
    r = F.hypot(F.col("x") - cx, F.col("y") - cy) / F.hypot(cx, cy)
    light = colour.luma(*(colour.decode(F.col(c)) for c in ("r", "g", "b")))
    corner = F.when(F.col("y") < cy, 0).otherwise(2) + F.when(F.col("x") < cx, 0).otherwise(1)
    rows = pixels.select(*group, light.alias("light"), r.alias("rad"), corner.alias("q"))
    part = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("light"))), F.lit(0.0))
    sums = rows.groupBy(*group).agg(part(F.col("rad") < 0.3).alias("centre"), *[part((F.col("rad") > 0.78) & (F.col("q") == i)).alias(f"c{i}") for i in range(4)])
    corners = [F.col(f"c{i}") for i in range(4)]
    mean = (corners[0] + corners[1] + corners[2] + corners[3]) / 4
    spread = sum(((c - mean) * (c - mean) for c in corners[1:]), (corners[0] - mean) * (corners[0] - mean)) / 4
    floor = F.lit(1e-4)
    symmetry = F.when(mean <= floor, 0.0).otherwise(F.exp(-2 * F.sqrt(spread) / F.when(mean <= floor, floor).otherwise(mean)))
    return sums.select(*group, F.log2(F.greatest(mean, floor) / F.greatest("centre", floor)).alias("falloff"), symmetry.alias("symmetry"), (symmetry >= VIGNETTE_SYMMETRY).alias("usable"))


def blockiness(rows: DataFrame, group: list[str], line: str, x: str, value: str) -> DataFrame:
    """(group, blockiness): mean step across 8-pixel boundaries over the mean step elsewhere; 1 where little happens."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*group, line).orderBy(x)))
    steps = rows.withColumn("__d", step).where("__d is not null")
    on = F.col(x) % 8 == 0
    off = F.coalesce(F.avg(F.when(~on, F.col("__d"))), F.lit(0.0))
    ratio = F.coalesce(F.avg(F.when(on, F.col("__d"))), F.lit(0.0)) / F.when(off == 0, 1.0).otherwise(off)
    return steps.groupBy(*group).agg(F.when(off < 0.45, 1.0).otherwise(ratio).alias("blockiness"))


def sliding_min(df: DataFrame, group: list[str], order: str, value: str, reach: int) -> DataFrame:
    """df with eroded: the least value within reach rows on both sides; edges clip the window."""
    along = Window.partitionBy(*group).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn("eroded", F.min(value).over(along))


def box_min(cells: DataFrame, group: list[str], reach: int) -> DataFrame:
    """cells (group, x, y, v) with eroded: the least v of the box round a cell, by rows and then by columns."""
    rows = Window.partitionBy(*group, "y").orderBy("x").rangeBetween(-reach, reach)
    columns = Window.partitionBy(*group, "x").orderBy("y").rangeBetween(-reach, reach)
    return cells.withColumn("__r", F.min("v").over(rows)).withColumn("eroded", F.min("__r").over(columns)).drop("__r")


def mask_cell(position: Column, size: Column, mask_size: Column) -> Column:
    """Index in a mask of a position along an image's edge."""
    return F.least(mask_size - 1, F.floor(position * mask_size / size).cast("int"))


def signature(pixels: DataFrame, group: list[str], width: Column, height: Column) -> DataFrame:
    """(group, cell, L, a, b): colours of a 4 by 4 grid by area average, to 4 digits."""
    cell = F.least(F.floor(F.col("y") * 4 / height), F.lit(3)) * 4 + F.least(F.floor(F.col("x") * 4 / width), F.lit(3))
    mean = pixels.groupBy(*group, cell.cast("int").alias("cell")).agg(*[F.avg(c).alias(c) for c in "rgb"])
    lab = with_lab(mean)
    return lab.select(*group, "cell", *[colour.half_up(F.col(c), 4).alias(n) for c, n in (("L", "L"), ("a", "a"), ("b_", "b"))])


def slope_through_origin(x: Column, y: Column) -> Column:
    """Aggregate: the slope of y on x without an intercept, null if all x are 0."""
    return F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0.0))


def sea_fraction(heights: Column, index: Column, stride: int = 16) -> Column:
    """Aggregate: the share of every stride-th cell that is at most 1 m high."""
    return F.avg(F.when(index % stride == 0, F.when(heights <= 1, 1.0).otherwise(0.0)))


def calibration_constant(kind: str, applied: Column, measured: Column) -> Column:
    """Aggregate: a control's constant from what was applied and what came of it.

    unit: effect of a full control. gain100: control for an effect of one, by the hundred.
    gainRaw: control for an effect of one.
    """
    if kind == "unit":
        return 100 * slope_through_origin(applied, measured)
    slope = slope_through_origin(measured, applied)
    return slope / 100 if kind == "gain100" else slope


def complete_tiles(cells: DataFrame, tile: list[str], size: int) -> DataFrame:
    """The cells of those tiles that have all size by size samples; a tile of another size is none."""
    whole = cells.groupBy(*tile).agg(F.count("*").alias("__n"), F.max("row").alias("__r"), F.max("col").alias("__c")).where(f"__n = {size * size} AND __r = {size - 1} AND __c = {size - 1}")
    return cells.join(whole.select(*tile), tile, "left_semi")
