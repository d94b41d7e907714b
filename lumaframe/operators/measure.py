"""All that is measured of an image's pixels, in one scan: the whole, its tonal zones, its masks and its bands of hue.

A pixel is laid out once as rows of (region, bin, weight): whole, zones and masks by bins of
lightness, hues by whole degree. They are summed before anything is shuffled, to a few
thousand sums an image, and written; statistics, curves and bands are read from those. Sampling
edges are strides over the same pixels, so a pyramid of them is no further scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions import colour
from lumaframe.sources.scratch import written

from .pixels import BANDS, CHROMA_FLOOR, HIST_BINS, STEPS, histogram_bin, mask_cell, nearest_band, with_lab

# Long edges at which images, looks and vignettes are sampled, and the level from which a mask holds a pixel.
EDGES, MASK_IN = (4000, 1024, 192), 128
ZONES = ("zone.shadow", "zone.midtone", "zone.highlight")
#: The region of sums by degree of hue.
HUES = "hue"
SUMS = ("w", "L", "LL", "C", "CC", "a", "b")


def sampled(pixels: DataFrame, edges=EDGES) -> DataFrame:
    """pixels (x, y, width, height) once for each edge whose stride meets them: edge, sx, sy, and the sampled sw and sh.

    The stride is the smallest that brings the long edge to at most edge; nothing is enlarged.
    """
    long = F.greatest("width", "height")
    stride = [F.greatest(F.lit(1), F.ceil(long / e)).cast("long") for e in edges]
    level = F.explode(F.array(*[F.struct(F.lit(e).alias("edge"), s.alias("s")) for e, s in zip(edges, stride, strict=True)]))
    rows = pixels.withColumn("__l", level).where((F.col("x") % F.col("__l.s") == 0) & (F.col("y") % F.col("__l.s") == 0))
    cut = lambda c: F.floor(F.col(c) / F.col("__l.s")).cast("long")
    size = lambda c: F.ceil(F.col(c) / F.col("__l.s")).cast("long")
    return rows.select("*", F.col("__l.edge").alias("edge"), cut("x").alias("sx"), cut("y").alias("sy"), size("width").alias("sw"), size("height").alias("sh")).drop("__l")


def masked(rows: DataFrame, masks: DataFrame, image: str) -> DataFrame:
    """rows of sampled() with regions, the masks that hold each pixel.

    masks (image, region, width, height, x, y, level) have grids of their own, one size for
    all masks of an image; a pixel takes the cell that its place falls in. An image without masks has no regions.
    """
    held = masks.where(F.col("level") >= MASK_IN).groupBy(F.col(image).alias("__i"), F.col("x").alias("__mx"), F.col("y").alias("__my")).agg(F.collect_set("region").alias("regions"))
    size = masks.groupBy(F.col(image).alias("__j")).agg(F.max("width").alias("__mw"), F.max("height").alias("__mh"))
    both = rows.join(size, F.col(image) == F.col("__j"), "left")
    both = both.withColumns({"__cx": mask_cell(F.col("sx"), F.col("sw"), F.col("__mw")), "__cy": mask_cell(F.col("sy"), F.col("sh"), F.col("__mh"))})
    both = both.join(held, (F.col(image) == F.col("__i")) & (F.col("__cx") == F.col("__mx")) & (F.col("__cy") == F.col("__my")), "left")
    return both.select(*rows.columns, F.coalesce("regions", F.array().cast("array<string>")).alias("regions"))


def sums(rows: DataFrame, group: list[str], regions: str | None = None) -> DataFrame:
    """(group, region, bin, w, L, LL, C, CC, a, b) of rows with L, a, b_, C and H, as a table: weighted sums of all regions.

    regions is a column with the names of the masks that hold a pixel.
    """
    zones = colour.zone_weights(F.col("L"))
    bin_ = histogram_bin(F.col("L")).cast("int")
    own = [F.struct(F.lit("global").alias("region"), bin_.alias("bin"), F.lit(1.0).alias("w"))]
    own += [F.struct(F.lit(z).alias("region"), bin_.alias("bin"), F.get(zones, F.lit(i))["w"].alias("w")) for i, z in enumerate(ZONES)]
    hue = F.struct(F.lit(HUES).alias("region"), F.floor("H").cast("int").alias("bin"), F.when(F.col("C") >= CHROMA_FLOOR, 1.0).otherwise(0.0).alias("w"))
    parts = F.array(*own, hue)
    if regions:
        parts = F.concat(parts, F.transform(regions, lambda r: F.struct(r.alias("region"), bin_.alias("bin"), F.lit(1.0).alias("w"))))
    put = rows.select(*group, "L", "C", F.col("a"), F.col("b_").alias("b"), F.explode(parts).alias("p")).where("p.w > 0")
    w = F.col("p.w")
    value = {"w": w, "L": w * F.col("L"), "LL": w * F.col("L") * F.col("L"), "C": w * F.col("C"), "CC": w * F.col("C") * F.col("C"), "a": w * F.col("a"), "b": w * F.col("b")}
    return written(put.groupBy(*group, F.col("p.region").alias("region"), F.col("p.bin").alias("bin")).agg(*[F.sum(value[k]).alias(k) for k in SUMS]), "sums")


def measure(pixels: DataFrame, image: str, masks: DataFrame | None = None, edges=EDGES) -> DataFrame:
    """sums() of pixels (image, x, y, r, g, b, width, height) by image and edge, from one scan of pixels."""
    rows = sampled(with_lab(pixels), edges)
    rows = rows if masks is None else masked(rows, masks, image)
    return sums(rows, [image, "edge"], None if masks is None else "regions")


def coverage(masks: DataFrame, image: str) -> DataFrame:
    """(image, region, coverage): the part of a mask's grid that it holds."""
    held = F.sum(F.when(F.col("level") >= MASK_IN, 1).otherwise(0))
    return masks.groupBy(image, "region").agg((held / F.max(F.col("width") * F.col("height"))).alias("coverage"))


def region_stats(table: DataFrame, group: list[str], covered: DataFrame | None = None) -> DataFrame:
    """(group, region, coverage, sampled, L, L_sd, C, C_sd, hue, strength, a, b, curve) of sums(), one row for each region that has pixels.

    coverage is 1 for the whole and a zone's share of it; covered (some of group, region,
    coverage) tells a mask's, 0 without it. curve has the lightness at 21 shares of the
    region's weight, by bins: the first bin whose running sum reaches the share, the first of all for none.
    """
    rows = table.where(F.col("region") != HUES)
    along = Window.partitionBy(*group, "region").orderBy("bin")
    rows = rows.withColumn("__cum", F.sum("w").over(along)).withColumn("__all", F.sum("w").over(Window.partitionBy(*group, "region")))
    last = float(STEPS - 1)
    reached = [F.min(F.when(F.col("__cum") >= F.lit(k) / last * F.col("__all"), F.col("bin"))).alias(f"__q{k}") for k in range(1, STEPS)]
    made = rows.groupBy(*group, "region").agg(*[F.sum(k).alias(k) for k in SUMS], *reached).where("w >= 1e-6")
    made = made.withColumn("__whole", F.max(F.when(F.col("region") == "global", F.col("w"))).over(Window.partitionBy(*group)))
    share = F.when(F.col("region") == "global", F.lit(1.0)).when(F.col("region").isin(*ZONES), F.col("w") / F.greatest(F.lit(1.0), F.col("__whole")))
    if covered is not None:
        on = [c for c in group if c in covered.columns]
        made = made.join(covered.select(*on, "region", F.col("coverage").alias("__cover")), [*on, "region"], "left")
        share = F.coalesce(share, F.col("__cover"))
    mean = lambda c: F.col(c) / F.col("w")
    spread = lambda c: F.sqrt(F.greatest(F.lit(0.0), mean(c + c) - mean(c) * mean(c)))
    strength = F.when(mean("C") > 1e-6, F.least(F.lit(1.0), F.hypot(mean("a"), mean("b")) / mean("C"))).otherwise(0.0)
    curve = F.array(F.lit(0.0), *[F.coalesce(F.col(f"__q{k}"), F.lit(HIST_BINS - 1)) / F.lit(float(HIST_BINS - 1)) for k in range(1, STEPS)])
    return made.select(
        *group, "region", F.coalesce(share, F.lit(0.0)).alias("coverage"), F.floor(F.col("w") + 0.5).cast("long").alias("sampled"), mean("L").alias("L"), spread("L").alias("L_sd"),
        mean("C").alias("C"), spread("C").alias("C_sd"), colour.hue(mean("a"), mean("b")).alias("hue"), strength.alias("strength"), mean("a").alias("a"), mean("b").alias("b"), curve.alias("curve"),
    )


def band_stats(table: DataFrame, group: list[str]) -> DataFrame:
    """(group, bands) of sums(): share, chroma, L and hue of the eight bands of hue in order; a band without pixels has its own hue and zeros."""
    named = table.where(F.col("region") == HUES).withColumn("band", nearest_band(F.col("bin")))
    made = named.groupBy(*group, "band").agg(*[F.sum(k).alias(k) for k in ("w", "C", "L", "a", "b")])
    mean = lambda c: F.col(c) / F.col("w")
    one = F.struct((F.col("w") / F.sum("w").over(Window.partitionBy(*group))).alias("share"), mean("C").alias("chroma"), mean("L").alias("L"), colour.hue(mean("a"), mean("b")).alias("hue"))
    held = made.withColumn("__one", one).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("band", "__one"))).alias("__m"))
    none = lambda h: F.struct(F.lit(0.0).alias("share"), F.lit(0.0).alias("chroma"), F.lit(0.0).alias("L"), F.lit(float(h)).alias("hue"))
    every = table.where(F.col("region") == "global").select(*group).distinct()
    bands = F.array(*[F.coalesce(F.try_element_at("__m", F.lit(b)), none(h)) for b, h in BANDS])
    return every.join(held, group, "left").select(*group, F.when(F.col("__m").isNull(), F.array(*[none(h) for _, h in BANDS])).otherwise(bands).alias("bands"))


def analysed(table: DataFrame, group: list[str], covered: DataFrame | None = None) -> DataFrame:
    """(group, curve, regions, bands) of sums(): one row for each image, all that a grade is solved from."""
    stats = region_stats(table, group, covered)
    one = F.struct(F.col("region").alias("key"), "coverage", "L", "C", "a", "b", "strength")
    curve = F.max(F.when(F.col("region") == "global", F.col("curve"))).alias("curve")
    return stats.groupBy(*group).agg(curve, F.sort_array(F.collect_list(one)).alias("regions")).join(band_stats(table, group), group)

