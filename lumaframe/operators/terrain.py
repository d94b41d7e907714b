"""Skylines, cast shadows and terrain shadows.

Rays, bearings and lines are rows: a building meets only the bearings that its edges
cover, and a field's shadow is settled line by line along the sun, each line on its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EFFECTIVE_RADIUS_M = 7 / 6 * 6371008.8


def skyline(edges: DataFrame, key: list[str], step: float = 1.0, radius: float = 1500.0) -> DataFrame:
    """(key, bin, altitude): the highest building angle in each bearing bin that one covers.

    edges has ax, ay, bx, by in metres round the observer (north up) and a height. A ray
    meets an edge where it crosses it; edges beyond radius don't count.
    """
    bearing = lambda x, y: F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0))
    rows = edges.where((F.col("height") > 0) & ((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by"))))
    rows = rows.withColumn("__f", bearing(F.col("ax"), F.col("ay")))
    sweep = F.pmod(bearing(F.col("bx"), F.col("by")) - F.col("__f") + 180, F.lit(360.0)) - 180
    rows = rows.withColumn("__s", sweep).withColumn("__first", F.col("__f") + F.least(F.lit(0.0), F.col("__s")))
    start, bins = F.floor(F.col("__first") / step), round(360 / step)
    end = F.least(F.ceil((F.col("__first") + F.abs("__s")) / step), start + bins - 1)
    rows = rows.withColumn("bin", F.explode(F.sequence(start, F.greatest(start, end)))).withColumn("bin", F.pmod(F.col("bin"), F.lit(bins)))
    ux, uy = F.sin(F.radians(F.col("bin") * step)), F.cos(F.radians(F.col("bin") * step))
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    det = ux * ey - uy * ex
    safe = F.when(F.abs(det) < 1e-12, F.lit(None)).otherwise(det)
    rows = rows.withColumn("__t", (F.col("ax") * ey - F.col("ay") * ex) / safe).withColumn("__k", (F.col("ax") * uy - F.col("ay") * ux) / safe)
    met = rows.where((F.col("__t") > 0) & (F.col("__t") <= radius) & F.col("__k").between(0, 1))
    return met.groupBy(*key, "bin").agg(F.max(F.degrees(F.atan2(F.col("height"), F.col("__t")))).alias("altitude"))


def blocked(profile: Column, azimuth: Column, altitude: Column) -> Column:
    """Whether a body stands below a circular profile (an array, one angle for each bin), linearly between bins."""
    n = F.size(profile)
    at = F.pmod(azimuth, F.lit(360.0)) / 360 * n
    low = F.floor(at).cast("int")
    a, b = F.get(profile, F.pmod(low, n)), F.get(profile, F.pmod(low + 1, n))
    return ~(altitude > a + (b - a) * (at - low))


def shadow_length(height: Column, altitude: Column) -> Column:
    """Metres of a shadow; a low sun's are cut at 300 m plus up to 1200 m more by altitude."""
    full = height / F.tan(F.radians(altitude))
    return F.when(altitude > 0, F.least(full, 300 + 1200 * F.least(F.lit(1.0), altitude / 20)))


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of points, counter-clockwise, without points on its edges."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def side(rows: np.ndarray) -> list[np.ndarray]:
        kept: list[np.ndarray] = []
        for q in rows:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (q[1] - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (q[0] - kept[-2][0]) <= 0:
                kept.pop()
            kept.append(q)
        return kept[:-1]

    return np.array(side(p) + side(p[::-1]))


def hulls(points: np.ndarray) -> list[np.ndarray]:
    """hull() of each row of points (rings by corners by 2), all rings a corner at a time."""
    n, many = points.shape[:2]
    order = np.lexsort((points[..., 1], points[..., 0]), axis=-1)
    sorted_ = np.take_along_axis(points, order[..., None], axis=1)
    every = np.arange(n)

    def side(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept, top = np.zeros((n, many, 2)), np.zeros(n, int)
        for k in range(many):
            q, left = p[:, k], every[top > 1]
            while len(left):
                a, b, c = kept[left, top[left] - 2], kept[left, top[left] - 1], q[left]
                turn = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
                left = left[turn <= 0]
                top[left] -= 1
                left = left[top[left] > 1]
            kept[every, top] = q
            top += 1
        return kept, top - 1  # the last corner begins the other side

    (low, n_low), (high, n_high) = side(sorted_), side(sorted_[:, ::-1])
    # fewer than three distinct corners have no inside; they are left to the plain form
    found = [np.concatenate((low[i, : n_low[i]], high[i, : n_high[i]])) for i in range(n)]
    return [h if len(h) > 2 else hull(points[i]) for i, h in enumerate(found)]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def swept_hull(rings: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
    """Hulls of rings (arrays of [x, y]) and themselves moved by (dx, dy): cast shadows. Rings of one size go together."""
    sizes, move = rings.map(len).to_numpy(), np.stack((dx.to_numpy(float), dy.to_numpy(float)), axis=1)
    out = np.empty(len(rings), object)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        flat = np.fromiter((v for i in rows for p in rings.iat[i] for v in p), float, len(rows) * size * 2).reshape(len(rows), size, 2)
        for i, h in zip(rows, hulls(np.concatenate((flat, flat + move[rows, None]), axis=1)) if size else [flat[0]] * len(rows), strict=True):
            out[i] = h.tolist()
    return pd.Series(out)


def ring_area(ring: Column) -> Column:
    """Area of a ring, an array of [x, y] without its first point again at the end."""
    n = F.size(ring)
    def cross(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        return a[0] * b[1] - b[0] * a[1]

    return F.abs(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), cross), F.lit(0.0), lambda s, v: s + v)) / 2


def cast_shadows(buildings: DataFrame, azimuth: Column, altitude: Column) -> DataFrame:
    """buildings (ring, height) with length and shadow, the footprint swept away from the sun; null below the horizon."""
    rows = buildings.withColumn("length", shadow_length(F.col("height"), altitude)).where("length is not null")
    away = F.radians(azimuth + 180)
    return rows.withColumn("shadow", swept_hull("ring", F.col("length") * F.sin(away), F.col("length") * F.cos(away)))


def shadow_mask(cells: DataFrame, azimuth: float, altitude: float, metres: float) -> DataFrame:
    """(row, col, shaded) of a field of (row, col, height) with cells of a size in metres.

    Lines run along the sun, one cell wide; a cell is shaded when one nearer to the sun
    stands above its ray, with the earth's drop. A line is at most a field's diagonal long.
    """
    if altitude <= 0:
        return cells.select("row", "col", F.lit(True).alias("shaded"))
    dx, dy = math.sin(math.radians(azimuth)), -math.cos(math.radians(azimuth))
    slope = math.tan(math.radians(altitude))
    # the longer step along the sun orders a line, the other coordinate names it
    if abs(dx) >= abs(dy):
        along, line = F.col("col") * (1 if dx > 0 else -1), F.floor(F.col("row") - F.col("col") * (dy / dx) + 0.5)
    else:
        along, line = F.col("row") * (1 if dy > 0 else -1), F.floor(F.col("col") - F.col("row") * (dx / dy) + 0.5)
    step = metres / max(abs(dx), abs(dy))

    def sweep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("along", ascending=False, ignore_index=True)
        x, h = -rows["along"].to_numpy(float) * step, rows["height"].to_numpy(float)
        x = x - x[0]
        # the ray over cell j comes down to h_j - (x - x_j) * slope - (x - x_j)**2 / 2R at x: but for what all
        # share, a line in x of slope x_j / R. The highest line at rising x is found along an upper envelope.
        rise, level = x / EFFECTIVE_RADIUS_M, h - x * x / (2 * EFFECTIVE_RADIUS_M) + x * slope
        shaded, kept, at = np.zeros(len(rows), bool), [0], 0
        for i in range(1, len(rows)):
            at = min(at, len(kept) - 1)
            while at + 1 < len(kept) and level[kept[at + 1]] + rise[kept[at + 1]] * x[i] >= level[kept[at]] + rise[kept[at]] * x[i]:
                at += 1
            j, away = kept[at], x[i] - x[kept[at]]
            shaded[i] = h[j] - away * away / (2 * EFFECTIVE_RADIUS_M) > h[i] + away * slope
            while len(kept) > 1:
                p, q = kept[-2], kept[-1]
                if (level[i] - level[p]) * (rise[q] - rise[p]) < (level[q] - level[p]) * (rise[i] - rise[p]):
                    break
                kept.pop()
            kept.append(i)
        return pd.DataFrame({"row": rows["row"], "col": rows["col"], "shaded": shaded})

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in ("row", "col"))
    return cells.withColumns({"along": along, "line": line}).groupBy("line").applyInPandas(sweep, f"{kinds}, shaded boolean")


def refine(brackets: DataFrame, body, value: str, target: Column, rounds: int = 12) -> DataFrame:
    """brackets (lo, hi in seconds, and what body needs but t) with t, where value crosses target.

    body is a Formula. Each round halves the bracket: four minutes come down to a sixteenth
    of a second in twelve, all in column expressions.
    """
    side = lambda df, at: body.on(df.withColumn("t", at)).withColumn("__v", F.col(value) - target).drop(*body.out)
    rows = side(brackets, F.col("lo")).withColumn("__at_lo", F.signum("__v")).drop("__v", "t")
    for _ in range(rounds):
        rows = side(rows, (F.col("lo") + F.col("hi")) / 2)
        same = F.signum("__v") == F.col("__at_lo")
        rows = rows.withColumns({"lo": F.when(same, F.col("t")).otherwise(F.col("lo")), "hi": F.when(same, F.col("hi")).otherwise(F.col("t"))}).drop("__v", "t")
    return rows.withColumn("t", (F.col("lo") + F.col("hi")) / 2).drop("lo", "hi", "__at_lo")
