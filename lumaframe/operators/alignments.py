"""When a body stands on a bearing, how it passes a horizon there, and why it never does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions import sky
from lumaframe.functions.formulas import Formula, turn
from lumaframe.sources.scratch import written

from .timeline import alike, passes, sampled, secant, told_all

# The sun's radius and the astronomical unit in km.
SUN_KM, UNIT_KM = 695700.0, 149597870.7


def _body(groups: list[dict[str, str]], azimuth: str, altitude: str, disc: str) -> Formula:
    """A body's signed distance from a bearing, its apparent altitude and its disc's radius."""
    return Formula([*groups, {"off": turn(f"{azimuth} - bearing + 180") + " - 180", "altitude": altitude, "disc": disc}], ["off", "altitude", "disc"])


BODIES = {
    "sun": _body(sky.SUN.groups, "sun_azimuth", "sun_apparent", f"degrees(asin({SUN_KM} / (sun_distance * {UNIT_KM})))"),
    "moon": _body(sky.MOON.groups, "moon_azimuth", "moon_apparent", "moon_radius"),
}


def bearing_crossings(spots: DataFrame, key: list[str], body: str, step: int = 240) -> tuple[DataFrame, DataFrame]:
    """((key, t, altitude, disc, descending) of every time a body is on a spot's bearing, (key, gap, gap_at) of how near a sample came to it).

    spots has key, lat, lon, bearing and whole seconds start and end. Samples step apart are
    rows; where the distance changes sign without a jump, the root is found.
    """
    form = BODIES[body]
    along = Window.partitionBy(*key).orderBy("t")
    rows = sampled(spots, form, "start", "end", step)
    seen = rows.withColumns({"p_off": F.lag("off").over(along), "p_t": F.lag("t").over(along)})
    turned = seen.where("p_off IS NOT NULL AND sign(p_off) <> sign(off) AND p_off <> 0 AND abs(p_off) + abs(off) < 180")
    brackets = turned.select(*spots.columns, F.col("p_t").alias("lo"), F.col("t").alias("hi"), F.col("p_off").alias("f_lo"), F.col("off").alias("f_hi"))
    found = secant(brackets, form, "off", 0.0)
    # rising or setting by the altitude a minute later
    later = form.on(found.withColumns({"__at": F.col("t"), "t": F.col("t") + 60})).withColumnRenamed("altitude", "__later").drop("off", "disc").withColumn("t", F.col("__at"))
    found = form.on(later).select(*key, "t", "altitude", "disc", (F.col("__later") < F.col("altitude")).alias("descending"))
    # a few rows for each spot, as a table, so that no later filter is pushed down into the chain of formulas
    found = written(found, "crossings")
    gap = F.min(F.struct(F.abs("off").alias("gap"), F.col("t").alias("gap_at"))).alias("g")
    return found, rows.groupBy(*key).agg(gap).select(*key, "g.gap", "g.gap_at")


def alignments(spots: DataFrame, key: list[str], body: str, step: int = 240, tolerance: float | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, descending, at, clearance, meets, dates, behind, edge) of every pass, (key, crossings, absence, nearest, gap) of every search).

    spots has a horizon in degrees on its bearing as well. A pass is a local minimum of the
    distance from that horizon along the crossings on the way up, or on the way down; dates
    counts the crossings in a row whose disc touches it (or that are within tolerance), behind
    tells whether these and one on either side lie on both sides. absence is null where a disc
    meets the horizon, else no-bearing, always-above, always-below or never-quite. Spots that
    agree in all but their key are searched once.
    """
    every_spot, spots = spots, alike(spots, key)
    found, gaps = bearing_crossings(spots, key, body, step)
    every = found.join(spots.select(*key, "horizon"), key).withColumn("clearance", F.col("altitude") - F.col("horizon"))
    within = F.lit(tolerance) if tolerance is not None else F.col("disc")
    branch = [*key, "descending"]
    marked = passes(every, branch, ["t"], "clearance", within)
    along = Window.partitionBy(*branch).orderBy("t")
    numbered = every.withColumns({"best": F.row_number().over(along), "__n": F.count("*").over(Window.partitionBy(*branch))}).select(*branch, "best", "t", "clearance", "__n")
    edge = F.when(F.col("best") == 1, "start").when(F.col("best") == F.col("__n"), "end")
    events = marked.join(numbered, [*branch, "best"]).select(
        *branch, F.col("t").alias("at"), "clearance", "meets", F.when(F.col("meets"), F.col("to") - F.col("from") + 1).otherwise(0).cast("long").alias("dates"), "behind", edge.alias("edge")
    )
    sums = every.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("clearance").alias("lo"), F.max("clearance").alias("hi"), F.min(F.struct(F.abs("clearance").alias("d"), F.col("clearance").alias("c"))).alias("near"), F.max(F.abs("clearance") <= within).alias("touched")
    )
    both = gaps.join(sums, key, "left")
    absence = F.when(F.col("n").isNull(), "no-bearing").when(F.col("touched"), F.lit(None)).when(F.col("lo") > 0, "always-above").when(F.col("hi") < 0, "always-below").otherwise("never-quite")
    searches = both.select(*key, F.coalesce("n", F.lit(0)).alias("crossings"), absence.alias("absence"), F.col("near.c").alias("nearest"), "gap")
    return told_all(events, every_spot, spots, key), told_all(searches, every_spot, spots, key)


def with_moon_phase(events: DataFrame, at: str = "at") -> DataFrame:
    """events with how much of the moon is lit at each instant, its phase, and whether it is waxing."""
    made = sky.ILLUMINATION.on(events.withColumn("t", F.col(at)))
    return made.select(*events.columns, F.col("lit").alias("fraction"), F.col("moon_phase").alias("phase"), (F.col("age") < 180).alias("waxing"))
