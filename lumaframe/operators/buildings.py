"""Buildings: heights from what tiles carry, footprints, boxes, and shadow sets with their tallies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.sources.scratch import written

from .terrain import cast_shadows, shadow_length

# Metres of a storey and of a degree of latitude.
STOREY_M, DEGREE_M = 3.2, 111_320.0


def _positive(text: Column) -> Column:
    """A text's number if it is finite and above 0."""
    x = text.try_cast("double")
    return F.when((x > 0) & (x < float("inf")), x)


def height(render: Column, measured: Column, levels: Column) -> Column:
    """Metres of a building: what is drawn, else measured, else its storeys; 0 if nothing is usable. All are texts."""
    return F.coalesce(_positive(render), _positive(measured), _positive(levels) * STOREY_M, F.lit(0.0))


def estimated(render: Column, measured: Column) -> Column:
    """Whether a height comes from a count of storeys rather than from a measurement."""
    return _positive(render).isNull() & _positive(measured).isNull()


def ring_meets_box(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether the box round a ring, an array of [lon, lat], overlaps another box; touching counts."""
    end = lambda f, i: f(F.transform(ring, lambda p: p[i]))
    apart = (end(F.array_max, 0) < west) | (end(F.array_min, 0) > east) | (end(F.array_max, 1) < south) | (end(F.array_min, 1) > north)
    return ~apart


def padded(west: Column, south: Column, east: Column, north: Column, metres: Column) -> Column:
    """A box grown by metres on every side, as a struct; a degree of longitude is that of the middle, never less than a twentieth."""
    high = metres / DEGREE_M
    wide = metres / (DEGREE_M * F.greatest(F.lit(0.05), F.cos(F.radians((south + north) / 2))))
    return F.struct((west - wide).alias("west"), (south - high).alias("south"), (east + wide).alias("east"), (north + high).alias("north"))


def disc_inside(lat: Column, lon: Column, metres: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether a whole disc lies inside a box."""
    high = metres / DEGREE_M
    wide = metres / (DEGREE_M * F.greatest(F.lit(0.05), F.cos(F.radians(lat))))
    return (lon - wide >= west) & (lon + wide <= east) & (lat - high >= south) & (lat + high <= north)


def square_courses(bearing: Column) -> Column:
    """Courses from a square's centre to its corners; each is size / sqrt(2) away."""
    return F.transform(F.array(*map(F.lit, (45.0, 135.0, 225.0, 315.0))), lambda c: c + bearing)


def square_reach(size: Column) -> Column:
    return size * (math.sqrt(2) / 2)


def set_signature(rows: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """(key, n, mark): the count and an order-independent hash of each set; equal sets have equal marks."""
    mark = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.pmod(mark, F.lit(2**62).cast("decimal(38,0)")).cast("long").alias("mark"))


def tallest(rows: DataFrame, key: list[str], height: str, tie: str, n: int) -> DataFrame:
    """The n tallest rows of each key; of equals the smallest tie."""
    place = Window.partitionBy(*key).orderBy(F.col(height).desc(), tie)
    return rows.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= n).drop("__n")


def shadow_set(rows: DataFrame, key: list[str], height: str, tie: str, azimuth: Column, altitude: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """((rows with length and shadow), (key, cast, skipped, clipped, longest, omitted)) of each key's tallest limit buildings.

    rows have ring and height. A building without a height is skipped, a shadow cut at the
    length limit is clipped, and buildings beyond the limit are counted as omitted.
    """
    every = rows.groupBy(*key).agg(F.greatest(F.lit(0), F.count("*") - limit).cast("long").alias("omitted"))
    kept = written(tallest(rows, key, height, tie, limit), "tallest")  # ranked once, for shadows and tally
    full = F.col(height) / F.tan(F.radians(altitude))
    made = kept.withColumn("__len", shadow_length(F.col(height), altitude))
    cast = (F.col(height) > 0) & F.col("__len").isNotNull()
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    tally = made.groupBy(*key).agg(
        count(cast).alias("cast"), count(~(F.coalesce(F.col(height), F.lit(0.0)) > 0)).alias("skipped"),
        count(cast & (full > F.col("__len"))).alias("clipped"), F.coalesce(F.max(F.when(cast, F.col("__len"))), F.lit(0.0)).alias("longest"),
    )
    shadows = cast_shadows(kept.where(F.col(height) > 0).withColumn("height", F.col(height)), azimuth, altitude)
    return shadows, tally.join(every, key)


def feature(ring: Column, length: Column, guessed: Column) -> Column:
    """A shadow as a GeoJSON feature; the length tells how far its far end can be trusted."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(guessed.alias("estimated"), F.floor(length + 0.5).cast("long").alias("lengthM")).alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        )
    )
