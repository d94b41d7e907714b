"""The sky over a place as it is drawn: labels of distances, domes, frames and what falls into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .colour import signed_delta_low

# Degrees from a frame's edge that count as at it, and in which a body outside still flares.
EDGE_DEG, FLARE_DEG = 1.5, 12.0
DOME_LEAST_M, DOME_MOST_M, DOME_SHARE, DOT_SPACING_DEG = 180.0, 1200.0, 0.06, 4.5


def _sin(x: Column) -> Column:
    return F.sin(F.radians(x))


def _cos(x: Column) -> Column:
    return F.cos(F.radians(x))


def distance_label(metres: Column) -> Column:
    """850 m, 2.4 km, 18 km: one decimal below 9.95 km."""
    km = metres / 1000
    whole = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    known = ~F.isnan(metres) & (F.abs(metres) < float("inf"))
    text = F.when(metres < 1000, F.concat(whole(metres), F.lit(" m"))).when(km < 9.95, F.concat(F.format_string("%.1f", km), F.lit(" km"))).otherwise(F.concat(whole(km), F.lit(" km")))
    return F.when(F.coalesce(known, F.lit(False)), text).otherwise("—")


def dome_radius(scouted: Column) -> Column:
    return F.when(scouted * DOME_SHARE < DOME_LEAST_M, DOME_LEAST_M).when(scouted * DOME_SHARE > DOME_MOST_M, DOME_MOST_M).otherwise(scouted * DOME_SHARE)


def dome_point(altitude: Column, radius: Column) -> Column:
    """Struct (ground, up): metres along the bearing and above the ground of a body on a dome."""
    return F.struct(F.greatest(F.lit(0.0), radius * _cos(altitude)).alias("ground"), (radius * _sin(altitude)).alias("up"))


def dot_stride(samples: Column, spacing: float = DOT_SPACING_DEG) -> Column:
    """Samples from one dot to the next, so that dots stand evenly whatever the sampling."""
    return F.when(samples >= 2, F.greatest(F.lit(1), F.floor(spacing / (360 / samples) + 0.5).cast("int"))).otherwise(1)


def horizon_runs(path: DataFrame, key: list[str], order: str, altitude: str) -> DataFrame:
    """(key, run, above, points): a path cut where it crosses the horizon, each part with the first point of the next.

    points are in order; a part of one point is no line and is dropped. A path is one body's day.
    """
    along = Window.partitionBy(*key).orderBy(order)
    rows = path.withColumn("__up", F.col(altitude) >= 0)
    fresh = F.when(F.col("__up").eqNullSafe(F.lag("__up").over(along)) & (F.row_number().over(along) > 1), 0).otherwise(1)
    rows = rows.withColumn("__new", fresh).withColumn("run", F.sum("__new").over(along).cast("int"))
    # the first point of a run ends the run before it as well
    shared = rows.where("__new = 1 AND run > 1").withColumns({"run": F.col("run") - 1, "__up": ~F.col("__up")})
    both = rows.unionByName(shared).groupBy(*key, "run").agg(F.first("__up").alias("above"), F.array_sort(F.collect_list(order)).alias("points"))
    return both.where(F.size("points") > 1)


def frame_offsets(azimuth: Column, altitude: Column, aim: Column, tilt: Column) -> Column:
    """Struct (across, up, ahead): where a direction falls on the image plane, degrees right of and above the aim."""
    turned = azimuth - aim
    right = _cos(altitude) * _sin(turned)
    forward = _cos(tilt) * _cos(altitude) * _cos(turned) + _sin(tilt) * _sin(altitude)
    up = _cos(tilt) * _sin(altitude) - _sin(tilt) * _cos(altitude) * _cos(turned)
    return F.struct(F.degrees(F.atan2(right, forward)).alias("across"), F.degrees(F.atan2(up, forward)).alias("up"), (forward > 0).alias("ahead"))


def frame_to_sky(across: Column, up: Column, aim: Column, tilt: Column) -> Column:
    """Struct (azimuth, altitude): the direction of a point on the image plane, the inverse of frame_offsets."""
    right, high = F.tan(F.radians(across)), F.tan(F.radians(up))
    north, rise = _cos(tilt) - high * _sin(tilt), _sin(tilt) + high * _cos(tilt)
    return F.struct(F.pmod(aim + F.degrees(F.atan2(right, north)), F.lit(360.0)).alias("azimuth"), F.degrees(F.atan2(rise, F.hypot(right, north))).alias("altitude"))


def placed(rows: DataFrame) -> DataFrame:
    """rows (azimuth, altitude, aim, tilt, wide, high in degrees) with placement, inside, across, up, gap, tilt_to and flare.

    gap is how far the direction is from the nearest edge, negative inside. tilt_to is the
    tilt that just brings it into a frame that it is outside of, rounded further in, and null
    where no tilt does; it is tried before it is offered.
    """
    half_w, half_h = F.col("wide") / 2, F.col("high") / 2
    out = rows.withColumn("__o", frame_offsets(F.col("azimuth"), F.col("altitude"), F.col("aim"), F.col("tilt")))
    over = F.abs("__o.across") - half_w, F.abs("__o.up") - half_h
    out = out.withColumns({"__w": over[0], "__h": over[1], "__upward": F.col("__o.up") >= 0})
    out = out.withColumn("__in", F.col("__o.ahead") & (F.col("__w") <= 0) & (F.col("__h") <= 0))
    turned = F.col("azimuth") - F.col("aim")
    a, b = _cos(F.col("altitude")) * _cos(turned), _sin(F.col("altitude"))
    edge = F.tan(F.radians(F.when(F.col("__upward"), half_h).otherwise(-half_h)))
    out = out.withColumn("__t", F.degrees(F.atan2(b - edge * a, a + edge * b)))
    out = out.withColumn("__t", F.when(F.col("__upward"), F.ceil(F.col("__t") * 10) / 10).otherwise(F.floor(F.col("__t") * 10) / 10))
    out = out.withColumn("__l", frame_offsets(F.col("azimuth"), F.col("altitude"), F.col("aim"), F.col("__t")))
    fits = F.col("__l.ahead") & (F.abs("__l.across") <= half_w) & (F.abs("__l.up") <= half_h)
    gap = F.greatest("__w", "__h")
    kind = F.when(F.col("__in"), F.when(gap > -EDGE_DEG, "edge").otherwise("in-frame")).when(~F.col("__o.ahead"), "behind").when(gap <= FLARE_DEG, "just-outside").otherwise("outside")
    tenth = lambda x: F.floor(x * 10 + 0.5) / 10
    return out.select(
        *rows.columns, kind.alias("placement"), F.col("__in").alias("inside"), tenth(F.col("__o.across")).alias("across"), tenth(F.col("__o.up")).alias("up"), tenth(gap).alias("gap"),
        F.when(~F.col("__in") & fits, F.col("__t").cast("double")).alias("tilt_to"), kind.isin("just-outside", "edge").alias("flare"),
    )


def wedge_courses(bearing: Column, wide: Column, steps: int = 48) -> Column:
    """Courses from a camera to the points of the arc that its frame spans."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: bearing - wide / 2 + i / F.lit(float(steps)) * wide)


def axis_feature(lon: Column, lat: Column, far_lon: Column, far_lat: Column, bearing: Column) -> Column:
    """The centre line of a frame as a GeoJSON feature: from the camera to where the lens points."""
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array(lon, lat), F.array(far_lon, far_lat)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.pmod(bearing, F.lit(360.0)).alias("bearing")).alias("properties"), line.alias("geometry")))


def forecast_days(cells: Column, days: Column, columns: Column) -> Column:
    """About how many days at the start of a month a forecast reaches, from how many of its cells it covers; none for no month."""
    return F.when((days > 0) & (columns > 0), F.floor(cells / (days * columns) * days + 0.5).cast("long")).otherwise(0)


#: Numbers of a vertex of a line.
LINE_STRIDE = 8


def merged_geometry(day: Column, minute: Column, stride: int = LINE_STRIDE) -> Column:
    """Struct (lines, runs, points) of a day's and a minute's: the minute's runs begin behind the day's vertices."""
    base = (F.size(day["lines"]) / stride).cast("int")
    moved = F.transform(minute["runs"], lambda r: F.struct((r["offset"] + base).alias("offset"), r["count"].alias("count")))
    return F.struct(F.concat(day["lines"], minute["lines"]).alias("lines"), F.concat(day["runs"], moved).alias("runs"), F.concat(day["points"], minute["points"]).alias("points"))


# Degrees off the aim that are back- and front-lit, and the sun's altitude up to which back light is a rim.
BACK_DEG, FRONT_DEG, RIM_ALTITUDE_DEG = 45.0, 135.0, 10.0


def lighting(aim: Column, azimuth: Column, altitude: Column, lit: Column) -> Column:
    """Struct (direction, absence, offset, side, note): from where the sun falls on what a camera looks at, or why not.

    The offset stands even where there is no light; absences are told in the order of how badly they bite.
    """
    offset = signed_delta_low(azimuth, aim)
    side = F.when(offset > 0, "right").when(offset < 0, "left")
    off, whole = F.abs(offset), lambda x: F.floor(x + 0.5).cast("long").cast("string")
    absence = F.when(~F.coalesce(altitude > 0, F.lit(False)), "sun-down").when(~lit, "in-shadow").when(offset.isNull(), "aim-unknown")
    rim = altitude <= RIM_ALTITUDE_DEG
    told = F.when(off <= BACK_DEG, F.when(rim, "rim").otherwise("back")).when(off >= FRONT_DEG, "front").otherwise("side")
    hand = F.coalesce(F.concat(F.lit(" from the "), side), F.lit(""))
    note = (
        F.when(absence == "sun-down", "the sun is down")
        .when(absence == "in-shadow", "in shadow")
        .when(absence == "aim-unknown", "lit, but the aim was never recorded")
        .when(told == "rim", F.concat(F.lit("rim-lit · sun "), whole(off), F.lit("° off aim, "), whole(altitude), F.lit("° up")))
        .when(told == "side", F.concat(F.lit("side-lit"), hand, F.lit(" · sun "), whole(off), F.lit("° off aim")))
        .otherwise(F.concat(told, F.lit("-lit · sun "), whole(off), F.lit("° off aim")))
    )
    return F.struct(F.when(absence.isNull(), told).alias("direction"), absence.alias("absence"), offset.alias("offset"), side.alias("side"), note.alias("note"))


def cloud_note(low: Column, mid: Column, high: Column, blocking: Column) -> Column:
    """Struct (dominant, note): the decks from the thickest on, and what they mean for the light; empty when nothing is known.

    A deck dominates when it has a tenth of the sky and a tenth more than the next. blocking
    is low and mid cloud together.
    """
    deck = lambda name, word, rank, v: F.struct((-v).alias("c"), F.lit(rank).alias("i"), F.lit(name).alias("name"), F.lit(word).alias("word"))
    every = F.array(deck("low", "low cloud", 0, low), deck("mid", "mid-level cloud", 1, mid), deck("high", "high cloud", 2, high))
    decks = F.array_sort(F.filter(every, lambda d: d["c"].isNotNull()))
    first, second = F.get(decks, F.lit(0)), F.get(decks, F.lit(1))
    dominant = F.when((first["c"] <= -10) & (second["c"].isNull() | (second["c"] - first["c"] >= 10)), first["name"])
    parts = F.array_join(F.transform(decks, lambda d: F.concat(d["word"], F.lit(" "), F.floor(-d["c"] + 0.5).cast("long").cast("string"), F.lit("%"))), ", ")
    means = (
        F.when((dominant == "high") & (F.coalesce(blocking, F.lit(0.0)) < 30), " Cirrus over a clear sun — shadows keep their edge, and there is something up there to take colour.")
        .when(dominant == "low", " The sun is behind the lowest deck. Flat light, whatever the total says.")
        .when(F.coalesce(blocking, F.lit(0.0)) >= 70, " Enough low and mid cloud to take the direct sun out.")
        .when(F.coalesce(blocking, F.lit(100.0)) < 20, " Nothing much between the sun and the ground.")
        .otherwise("")
    )
    note = F.when(F.size(decks) == 0, "").otherwise(F.concat(F.upper(F.left(parts, F.lit(1))), F.substring(parts, 2, 1000), F.lit("."), means))
    return F.struct(dominant.alias("dominant"), note.alias("note"))


def hour_summary(temperature: Column, cloud: Column, rain: Column) -> Column:
    """18°C · 42% cloud · 30% rain; rain from a fifth on, unknown parts left out."""
    whole = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    return F.concat_ws(" · ", F.concat(whole(temperature), F.lit("°C")), F.concat(whole(cloud), F.lit("% cloud")), F.when(rain >= 20, F.concat(whole(rain), F.lit("% rain"))))


def staleness(fetched: Column, now: Column) -> Column:
    """How old a forecast is in words, empty for the first hour and a half; both in seconds."""
    minutes = F.floor((now - fetched) / 60)
    old = lambda n, unit: F.concat(F.lit("forecast "), F.floor(minutes / n + 0.5).cast("long").cast("string"), F.lit(f" {unit} old"))
    return F.when(minutes < 90, "").when(minutes < 1440, old(60, "h")).otherwise(old(1440, "d"))
