"""Rise, transit and set by sampling and root finding; nights of the galactic core.

A place and its window are one row; samples, brackets and roots are rows as well, and the
three conditions of a night are intervals that are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import almanac, sky
from lumaframe.sources.scratch import written

from .timeline import intersections, intervals_where, sampled

DARK = -18.0


def _samples(spots: DataFrame, body, value: str, step: int) -> DataFrame:
    """spots with t and value, each step from start to end, as a table: one series for the peak and the crossings."""
    return written(sampled(spots, body, "start", "end", step).select(*spots.columns, "t", value), "samples")


def _peaks(samples: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, peak, peak_at): the highest sample and when; the first of equals."""
    best = F.max_by(F.struct("t", value), F.struct(F.col(value), -F.col("t")))
    return samples.groupBy(*key).agg(best.alias("__b")).select(*key, F.col(f"__b.{value}").alias("peak"), F.col("__b.t").alias("peak_at"))


def moon_times(spots: DataFrame, key: list[str], step: int = 600) -> DataFrame:
    """(key, rise, set, always_up, always_down, peak, peak_at) of the moon between start and end (seconds) of spots (key, lat, lon, start, end).

    rise and set are the first in the window, null where there is none: a moon that is up
    all along rose before it.
    """
    samples = _samples(spots, sky.MOON, "moon_altitude", step)
    up = intervals_where(spots, key, sky.MOON, "moon_altitude", almanac.MOONRISE, True, "start", "end", step, samples)
    every = spots.select(*key, F.col("start").alias("__s"), F.col("end").alias("__e"))
    both = up.join(every, key)
    inside = lambda c: F.when((F.col(c) > F.col("__s")) & (F.col(c) < F.col("__e")), F.col(c))
    whole = F.max((F.col("start") <= F.col("__s")) & (F.col("end") >= F.col("__e")))
    found = both.groupBy(*key).agg(F.min(inside("start")).alias("rise"), F.min(inside("end")).alias("set"), whole.alias("always_up"), F.count("*").alias("__n"))
    made = _peaks(samples, key, "moon_altitude").join(found, key, "left")
    return made.select(*key, "rise", "set", F.coalesce("always_up", F.lit(False)).alias("always_up"), F.col("__n").isNull().alias("always_down"), "peak", "peak_at")


def core_times(spots: DataFrame, key: list[str], step: int = 300) -> DataFrame:
    """(key, rise, transit, set, always_up, always_down, peak, peak_at) of the galactic core; set is the last one in the window."""
    samples = _samples(spots, sky.CORE, "core_altitude", step)
    up = intervals_where(spots, key, sky.CORE, "core_altitude", almanac.CORE_RISE, True, "start", "end", step, samples)
    every = spots.select(*key, F.col("start").alias("__s"), F.col("end").alias("__e"))
    both = up.join(every, key)
    rise = F.min(F.when(F.col("start") > F.col("__s"), F.col("start")))
    down = F.max(F.when(F.col("end") < F.col("__e"), F.col("end")))
    whole = F.max((F.col("start") <= F.col("__s")) & (F.col("end") >= F.col("__e")))
    found = both.groupBy(*key).agg(rise.alias("rise"), down.alias("set"), whole.alias("always_up"), F.count("*").alias("__n"))
    made = _peaks(samples, key, "core_altitude").join(found, key, "left")
    transit = F.when(F.col("peak") > almanac.CORE_RISE, F.col("peak_at"))
    return made.select(*key, "rise", transit.alias("transit"), "set", F.coalesce("always_up", F.lit(False)).alias("always_up"), F.col("__n").isNull().alias("always_down"), "peak", "peak_at")


def core_nights(spots: DataFrame, key: list[str], least: float = almanac.CORE_USABLE, step: int = 300) -> tuple[DataFrame, DataFrame]:
    """((key, start, end) of the stretches in which the core can be seen, (key, best_at, best, refusal) of every night).

    A stretch is dark (sun below 18 degrees), moonless, and has the core least degrees up.
    best is the core's highest sample in a stretch; without one, refusal names the first
    condition that failed, from the most lasting to the most passing.
    """
    # each set of intervals is used more than once, and is a few rows for a night
    find = lambda body, value, level, above: written(intervals_where(spots, key, body, value, level, above, "start", "end", step), "intervals")
    dark = find(sky.SUN, "sun_altitude", DARK, False)
    moonless = find(sky.MOON, "moon_altitude", almanac.MOONRISE, False)
    high = find(sky.CORE, "core_altitude", least, True)
    free = written(intersections(dark, moonless, key, 21_600), "intervals")
    seen = written(intersections(free, high, key, 21_600), "intervals")
    # the core along each stretch, from its own beginning
    stretches = seen.withColumnsRenamed({"start": "s0", "end": "e0"}).join(spots.drop("start", "end"), key)
    walked = stretches.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("e0") - F.col("s0")) / step).cast("int")), lambda i: F.col("s0") + i * step)))
    best = F.max_by(F.struct("t", "core_altitude"), F.struct(F.col("core_altitude"), -F.col("t")))
    best = sky.CORE.on(walked).groupBy(*key).agg(best.alias("__b"))
    some = lambda df, name: df.select(*key, F.lit(True).alias(name)).distinct()
    made = core_times(spots, key, step).select(*key, "always_down", "peak").join(best, key, "left")
    for df, name in ((high, "__high"), (dark, "__dark"), (free, "__free")):
        made = made.join(some(df, name), key, "left")
    refusal = (
        F.when(F.col("__b").isNotNull(), "")
        .when(F.col("always_down"), "The core never rises here.")
        .when(F.col("__high").isNull(), F.format_string(f"The core does not clear {least:g}° here tonight — it peaks at %.0f°.", "peak"))
        .when(F.col("__dark").isNull(), "It never gets astronomically dark tonight — the sun stays above −18°.")
        .when(F.col("__free").isNull(), "The moon is up for the whole of the dark window.")
        .otherwise("The core is up, and the sky is dark, but not at the same time tonight.")
    )
    return seen, made.select(*key, F.col("__b.t").alias("best_at"), F.col("__b.core_altitude").alias("best"), refusal.alias("refusal"))
