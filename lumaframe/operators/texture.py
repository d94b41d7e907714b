"""Texture of image crops: grain, edges, acutance, blockiness, and whether they can be trusted.

A crop is a fixed 192 by 192 pixels, so it is the unit of work: crops spread over the
cluster, and one is measured with array arithmetic. What follows from crops is SQL again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CROP, GRID, INSET = 192, (4, 3), 0.08
LEAST_LONG, LEAST_SHORT, BLOCKY, UPSCALED, TOLERANCE = 900, 500, 1.28, 0.0016, 0.15
NORM_EDGE, LEAST_ACUTANCE, LEAST_PROBES, LEAST_CROPS = 2400, 0.02, 3, 4
#: Places of the grid that a native probe takes: its corners and its middle.
SPREAD = ((0, 0), (GRID[0] - 1, 0), (0, GRID[1] - 1), (GRID[0] - 1, GRID[1] - 1), ((GRID[0] - 1) // 2, (GRID[1] - 1) // 2))
# Why a texture can't be told.
REASONS = {
    "small": "Too small to read grain honestly (%dx%d). Grain, noise and sharpening need roughly 900px on the long edge — below that, what looks like grain is mostly resizing.",
    "probes": "Not enough usable native-resolution samples to measure texture.",
    "compression": "JPEG compression artefacts dominate the fine detail here (blockiness %.2fx). Any grain reading would mostly be measuring the compressor, not the photograph.",
    "crops": "Not enough usable samples to measure texture.",
    "upscaled": "There is almost no genuine high-frequency detail in this image, which means it was enlarged from something smaller. Grain and sharpening cannot be read from it.",
}


def origins(images: DataFrame, crop: int = CROP) -> DataFrame:
    """images (id, width, height) with gx, gy, left, top: a 4 by 3 grid of crops inside an inset, aligned to 8 pixels."""
    spots = F.explode(F.array(*[F.struct(F.lit(x).alias("gx"), F.lit(y).alias("gy")) for y in range(GRID[1]) for x in range(GRID[0])]))
    inset = lambda size: F.floor(F.col(size) * INSET)
    span = lambda size: F.col(size) - 2 * inset(size) - crop
    place = lambda size, g, n: F.shiftleft(F.shiftright((inset(size) + F.floor(span(size) * F.col(g) / (n - 1) + 0.5)).cast("int"), 3), 3)
    rows = images.where((span("width") > 0) & (span("height") > 0)).select("*", spots.alias("s")).select("*", "s.gx", "s.gy").drop("s")
    return rows.withColumns({"left": place("width", "gx", GRID[0]), "top": place("height", "gy", GRID[1])})


def normalised(images: DataFrame) -> DataFrame:
    """images (id, width, height) at the size that textures are compared at: NORM_EDGE on the long edge, never enlarged."""
    factor = F.least(F.lit(1.0), F.lit(float(NORM_EDGE)) / F.greatest("width", "height"))
    size = lambda c: F.floor(F.col(c) * factor + 0.5).cast("int")
    return images.withColumns({"width": size("width"), "height": size("height")})


#: The narrowest crop that is measured.
LEAST_CROP = 8


def box_mean(a: np.ndarray, reach: int) -> np.ndarray:
    """Means over boxes; pixels beyond an edge count as the edge's."""
    for axis in (0, 1):
        padded = np.pad(a, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        size, total = a.shape[axis], 0.0
        for i in range(2 * reach + 1):
            total = total + (padded[i : i + size] if axis == 0 else padded[:, i : i + size])
        a = total / (2 * reach + 1)
    return a


def weighed(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sums over all 3 by 3 boxes inside a, weighed by kernel."""
    high, wide = a.shape[0] - 2, a.shape[1] - 2
    row = lambda r: sum(a[r : r + high, c : c + wide] * kernel[r, c] for c in range(3))
    return row(0) + row(1) + row(2)


def measure_crop(luma: np.ndarray) -> dict[str, float] | None:
    """grain, edge, acutance, blockiness and scale of one crop; null when nothing in it is flat or nothing is an edge."""
    fine, coarse = box_mean(luma, 1), box_mean(luma, 2)
    across, down = np.array([-1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    kernel = np.outer(down, across)
    slope = np.hypot(weighed(fine, kernel), weighed(fine, kernel.T))
    inner = np.s_[1:-1, 1:-1]
    level = np.minimum(255, slope.astype(int))
    cum = np.bincount(level.ravel(), minlength=256).cumsum()
    cut = lambda p: int(np.argmax(cum >= p * level.size))
    low, high = cut(0.35), cut(0.85)
    flat = slope <= low
    edge = ~flat & (slope >= high)
    if not flat.any() or not edge.any():
        return None
    r1, r2 = (luma - fine)[inner], (luma - coarse)[inner]
    rms = lambda r, m: float(np.sqrt((r[m] ** 2).mean()) / 255)
    step = np.abs(np.diff(luma, axis=1))
    on = np.arange(1, luma.shape[1]) % 8 == 0
    off = step[:, ~on].mean()
    grain, wide = rms(r1, flat), rms(r2, flat)
    return {
        "grain": grain, "edge": rms(r1, edge), "acutance": float(slope[edge].mean() / 255),
        "blockiness": 1.0 if off < 0.45 else float(step[:, on].mean() / off), "scale": grain / wide if wide > 1e-9 else 1.0,
    }


def crops(pixels: DataFrame, key: list[str]) -> DataFrame:
    """(key, grain, edge, acutance, blockiness, scale) of crops of (key, x, y, luma).

    A crop that lacks a pixel of its rectangle, is narrower than LEAST_CROP, or can't be
    measured has no row: nothing is made up for a pixel that isn't there. Crops are rows of
    arrays and go to Python many at a time.
    """
    names = ["grain", "edge", "acutance", "blockiness", "scale"]

    def one(x: np.ndarray, y: np.ndarray, luma: np.ndarray) -> dict[str, float] | None:
        grid = np.full((y.max() - y.min() + 1, x.max() - x.min() + 1), np.nan)
        grid[y - y.min(), x - x.min()] = luma
        return measure_crop(grid) if min(grid.shape) >= LEAST_CROP and not np.isnan(grid).any() else None

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def measured(x: pd.Series, y: pd.Series, luma: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(names, None)
        return pd.DataFrame([one(*p) or none for p in zip(x, y, luma, strict=True)], columns=names, dtype=float)

    # three lists of numbers are made at half the cost of one of structs; they would leave out a null, which is no number
    lists = F.col("x").cast("int").alias("__x"), F.col("y").cast("int").alias("__y"), F.coalesce(F.col("luma").cast("double"), F.lit(float("nan"))).alias("__l")
    rows = pixels.select(*key, *lists).groupBy(*key).agg(*[F.collect_list(c).alias(c) for c in ("__x", "__y", "__l")])
    # a filter on what a function gives would be moved below it and measure all crops twice
    rows = rows.withColumn("__m", measured.asNondeterministic()("__x", "__y", "__l"))
    return rows.select(*key, *[F.col(f"__m.{n}").alias(n) for n in names]).where(F.col("grain").isNotNull())


def image_texture(measured: DataFrame, image: str, long_edge: Column, short_edge: Column) -> DataFrame:
    """(image, medians, usable, reason): medians over crops, and why they can't be trusted if they can't."""
    mid = measured.groupBy(image, long_edge.alias("long"), short_edge.alias("short")).agg(*[F.median(c).alias(c) for c in ("grain", "edge", "acutance", "blockiness", "scale")])
    reason = F.when((F.col("long") < LEAST_LONG) | (F.col("short") < LEAST_SHORT), "too small").when(F.col("blockiness") > BLOCKY, "compressed").when(F.col("edge") < UPSCALED, "upscaled")
    return mid.withColumn("reason", reason).withColumn("usable", F.col("reason").isNull())


def gated(images: DataFrame, probes: DataFrame, measured: DataFrame) -> DataFrame:
    """(id, usable, blocked, reason, normalised, grain, grain_size, acutance, flat_to_edge, long) of images (id, width, height).

    probes are crops() of the native pixels at SPREAD places, the only ones that can show a
    compressor's blocks; measured are crops() of the whole grid at the size of normalised(),
    the same as the native one for a small image. blocked names the first gate that an image
    does not pass (resolution, compression, upscaled, none); nothing is told of a blocked one.
    grain_size is an index of how much of the grain outlasts a blur. long is the edge measured at.
    """
    probe = probes.groupBy("id").agg(F.count("*").alias("__probes"), F.median("blockiness").alias("__block"))
    mid = measured.groupBy("id").agg(F.count("*").alias("__crops"), *[F.median(c).alias(c) for c in ("grain", "edge", "acutance", "scale")])
    rows = images.join(probe, "id", "left").join(mid, "id", "left").withColumn("__long", F.greatest("width", "height"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    small = (F.col("__long") < LEAST_LONG) | (F.least("width", "height") < LEAST_SHORT)
    gates = [
        (small, "resolution", F.format_string(REASONS["small"], F.col("width").cast("int"), F.col("height").cast("int"))), (count("__probes") < LEAST_PROBES, "resolution", F.lit(REASONS["probes"])),
        (F.col("__block") > BLOCKY, "compression", F.format_string(REASONS["compression"].replace("%.2f", "%s"), F.format_string("%.2f", "__block"))), (count("__crops") < LEAST_CROPS, "resolution", F.lit(REASONS["crops"])),
        ((F.col("grain") < UPSCALED) & (F.col("acutance") < LEAST_ACUTANCE), "upscaled", F.lit(REASONS["upscaled"])),
    ]
    blocked, reason = F.lit("none"), F.lit(None).cast("string")
    for fails, name, why in reversed(gates):
        blocked, reason = F.when(fails, name).otherwise(blocked), F.when(fails, why).otherwise(reason)
    rows = rows.withColumns({"blocked": blocked, "reason": reason}).withColumn("usable", F.col("blocked") == "none")
    told = lambda v: F.when(F.col("usable"), v).otherwise(0.0)
    size = F.greatest(F.lit(1.0), F.least(F.lit(6.0), 1 + (1 - F.least(F.lit(1.0), F.col("scale"))) * 8))
    scaled = F.col("__long") > NORM_EDGE
    return rows.select(
        "id", "usable", "blocked", "reason", (F.col("usable") & scaled).alias("normalised"), told(F.col("grain")).alias("grain"), told(size).alias("grain_size"), told(F.col("acutance")).alias("acutance"),
        told(F.when(F.col("edge") > 1e-9, F.col("grain") / F.col("edge")).otherwise(0.0)).alias("flat_to_edge"), F.when(F.col("usable") & scaled, NORM_EDGE).otherwise(F.col("__long")).cast("int").alias("long"),
    )


def comparable(long_a: Column, long_b: Column, usable_a: Column, usable_b: Column) -> Column:
    """Whether two textures were measured at sizes within TOLERANCE of each other."""
    return usable_a & usable_b & (F.abs(long_a - long_b) / F.greatest(long_a, long_b) <= TOLERANCE)
