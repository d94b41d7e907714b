"""A day's light at points, over what stands round each of them: buildings near by and the ground further off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import sky
from lumaframe.sources.scratch import written

from . import ledger, places, terrain
from .timeline import sampled


def surroundings(spots: DataFrame, walls: DataFrame, cells: DataFrame, metres: float, side: int, step: float = 1.0, radius: float = 1500.0, ground_bins: int = 360, most: int = 220) -> DataFrame:
    """(spot, profile): the highest angle at bearings step degrees apart, an array from north on, 0 at least.

    spots (spot, row, col) are places in a field of cells (row, col, height) of a size in
    metres; walls (spot, ax, ay, bx, by, height) are metres round each. The two profiles have
    bearings of their own: the ground's is read between its bearings, and the higher one
    counts. A spot off the field, or on a cell of unknown height, has buildings alone.
    What is read more than once is a table, so no plan holds it several times over.
    """
    bins = round(360 / step)
    cells = written(cells, "cells")
    walls_of = terrain.skyline(walls, ["spot"], step, radius).select("spot", F.col("bin").cast("int").alias("bin"), F.col("altitude").alias("angle"))
    at = spots.select(F.col("spot").alias("id"), "row", "col").join(cells, ["row", "col"]).select("id", "row", "col", "height")
    ground = written(places.terrain_horizon(at, cells, metres, side, ground_bins, most=most).withColumnRenamed("id", "spot"), "ground")
    ground = places.resampled(ground, ["spot"], "angle", ground_bins, bins)
    flat = spots.select("spot", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0.0).alias("angle"))
    rows = flat.unionByName(walls_of).unionByName(ground.select("spot", F.col("bin").cast("int").alias("bin"), "angle"))
    highest = rows.groupBy("spot", "bin").agg(F.max("angle").alias("angle"))
    listed = F.array_sort(F.collect_list(F.struct("bin", "angle")))
    return highest.groupBy("spot").agg(F.transform(listed, lambda x: x["angle"]).alias("profile")).join(spots.select("spot"), "spot", "left_semi")


def light_windows(spots: DataFrame, profiles: DataFrame, step: int = 60) -> DataFrame:
    """(spot, run, lit, below, start, end): runs of minutes from start to end (whole seconds) of spots (spot, lat, lon, start, end) that agree in direct sun and in night."""
    # a spot's profile goes along with its samples, which stay in one task
    rows = written(spots.join(profiles.hint("merge"), "spot"), "profiles")
    track = sampled(rows, sky.SUN, "start", "end", step, ["spot"])
    lit = ~terrain.blocked(F.col("profile"), F.col("sun_azimuth"), F.col("sun_altitude")) & (F.col("sun_altitude") > 0)
    samples = track.select("spot", F.floor((F.col("t") - F.col("start")) / 60).cast("long").alias("minute"), lit.alias("lit"), F.col("sun_altitude").alias("altitude"))
    return written(ledger.lit_windows(samples, ["spot"], "minute"), "windows")
