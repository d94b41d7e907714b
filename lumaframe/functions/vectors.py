"""Vectors and arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def embedding_distance(a: Column, b: Column) -> Column:
    """1 - a.b; 2 when either is missing or their lengths differ."""
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)), 1 - dot(a, b)).otherwise(F.lit(2.0))


def grid_distance(a: Column, b: Column, parts: tuple[int, ...]) -> Column:
    """Distance of the given components of 16 cells of (L, a, b); 0 when either is missing or lengths differ."""
    squares = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: sum((F.pow(F.get(a, i * 3 + k) - F.get(b, i * 3 + k), F.lit(2)) for k in parts[1:]), F.pow(F.get(a, i * 3 + parts[0]) - F.get(b, i * 3 + parts[0]), F.lit(2))))
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)), F.sqrt(total(squares))).otherwise(F.lit(0.0))


def _or_one(x: Column) -> Column:
    return F.when(x.isNull() | (x == 0), F.lit(1.0)).otherwise(x)


def aspect_distance(h1: Column, w1: Column, h2: Column, w2: Column) -> Column:
    return F.abs(F.ln(_or_one(h2 / _or_one(w2)) / _or_one(h1 / _or_one(w1))))


def rms(a: Column, b: Column) -> Column:
    """Root mean square difference of two curves; null if either is empty or lengths differ."""
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fine, F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)))


def normalised(v: Column, digits: int = 5) -> Column:
    """A vector scaled to unit length; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    scale = 10.0**digits
    return F.transform(v, lambda x: F.floor(x / F.when(length == 0, F.lit(1.0)).otherwise(length) * scale + 0.5) / scale)


def curve(points: Column, steps: int = 256) -> Column:
    """A lookup table of a piecewise linear curve through points (x, y) in rising order of x, over 0..255.

    Each stretch between two points takes the steps that lie in it; the ends are level.
    """
    at = F.array(*[F.lit(i * 255.0 / (steps - 1)) for i in range(steps)])
    known = F.coalesce(F.filter(points, lambda p: p["x"].isNotNull()), F.array().cast("array<struct<x:double,y:double>>"))
    # from and up to which x, and the straight line there; all of a stretch is named once
    line = lambda low, high, y, x, rise, run: F.struct(low.alias("low"), high.alias("high"), y.cast("double").alias("y"), x.cast("double").alias("x"), rise.cast("double").alias("rise"), run.cast("double").alias("run"))
    level = lambda low, high, y: line(low, high, y, F.lit(0.0), F.lit(0.0), F.lit(1.0))

    def lines(p: Column) -> Column:
        pair = lambda i: line(F.get(p, i - 1)["x"], F.get(p, i)["x"], F.get(p, i - 1)["y"], F.get(p, i - 1)["x"], F.get(p, i)["y"] - F.get(p, i - 1)["y"], F.get(p, i)["x"] - F.get(p, i - 1)["x"])
        inner = F.transform(F.slice(F.sequence(F.lit(0), F.size(p)), 2, F.greatest(F.size(p) - 1, F.lit(0))), pair)
        first, last = F.coalesce(F.get(p, F.lit(0))["x"], F.lit(float("inf"))), F.coalesce(F.get(p, F.size(p) - 1)["x"], F.lit(float("inf")))
        return F.concat(F.array(level(F.lit(float("-inf")), first, F.get(points, F.lit(0))["y"])), inner, F.array(level(last, F.lit(float("inf")), F.get(points, F.size(points) - 1)["y"])))

    value = lambda s: lambda x: s["y"] + s["rise"] * (x - s["x"]) / s["run"]
    steps_of = lambda s: F.transform(F.filter(at, lambda x: (x >= s["low"]) & (x < s["high"])), value(s))
    return F.flatten(F.transform(F.flatten(F.transform(F.array(known), lines)), steps_of))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within low and high; null and non-finite values become 0 before that."""
    fine = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)
    return F.greatest(F.lit(low), F.least(F.lit(high), fine))


def lerp_hue(a: Column, b: Column, t: Column) -> Column:
    """Between two hues along the shorter arc."""
    return F.pmod(a + (F.pmod(b - a + 540, F.lit(360.0)) - 180) * t, F.lit(360.0))


def lerp_wheel_hue(a: Column, sat_a: Column, b: Column, sat_b: Column, t: Column) -> Column:
    """The hue of a blended wheel: one without saturation has no hue of its own and takes the other's."""
    return F.when(sat_a < 0.5, b).when(sat_b < 0.5, a).otherwise(lerp_hue(a, b, t))


def mean_pooled(rows: DataFrame, key: list[str], tokens: str) -> DataFrame:
    """(key, v): the mean of each row's token vectors (an array of arrays of one length), scaled to unit length.

    Dimensions are averaged inside the row; a row without tokens has an empty vector.
    """
    n = F.size(tokens)
    first = F.get(tokens, F.lit(0))
    total = F.aggregate(F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    mean = F.when(n > 0, F.transform(total, lambda x: x / n)).otherwise(F.array().cast("array<double>"))
    return rows.select(*key, mean.alias("__m")).select(*key, normalised(F.col("__m")).alias("v"))
