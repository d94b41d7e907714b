"""What of the sky a camera's frame holds: round regions, and times at which a body is inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions.colour import half_up
from lumaframe.functions.field import FRAME
from lumaframe.functions.formulas import Formula, cosd, sind

from . import timeline

#: Points round the rim of a region.
RIM = 36


def _on_frame(az: Column, alt: Column, aim: Column, tilt: Column) -> Column:
    """(across, up, ahead) of a direction in a frame; angles in degrees."""
    turned, height = F.radians(az - aim), F.radians(alt)
    lean = F.radians(tilt)
    right = F.cos(height) * F.sin(turned)
    ahead = F.cos(lean) * F.cos(height) * F.cos(turned) + F.sin(lean) * F.sin(height)
    up = F.cos(lean) * F.sin(height) - F.sin(lean) * F.cos(height) * F.cos(turned)
    return F.struct(half_up(F.degrees(F.atan2(right, ahead)), 6).alias("across"), half_up(F.degrees(F.atan2(up, ahead)), 6).alias("up"), (ahead > 0).alias("ahead"))


def region(df: DataFrame, radius: Column) -> DataFrame:
    """df with whole, partly, span_w, span_h, over, over_edge, short, short_edge of a region round each target.

    df has az, alt, aim, tilt, across and upward (angles of view). over is how far the region
    reaches past an edge, short how far it is from coming in; edges are empty where there is
    nothing of that. A region of which some lies beside or behind the camera has no spans.
    The rim stays in the row, so nothing is shuffled.
    """
    away, alt, az = F.radians(radius), F.radians(F.col("alt")), F.col("az")

    def rim(k: Column) -> Column:
        turn = F.radians(k * (360.0 / RIM))
        high = F.asin(F.sin(alt) * F.cos(away) + F.cos(alt) * F.sin(away) * F.cos(turn))
        side = F.atan2(F.sin(turn) * F.sin(away) * F.cos(alt), F.cos(away) - F.sin(alt) * F.sin(high))
        return _on_frame(az + F.degrees(side), F.degrees(high), F.col("aim"), F.col("tilt"))

    half_w, half_h = F.col("across") / 2, F.col("upward") / 2
    inside = lambda p: p["ahead"] & (F.abs(p["across"]) <= half_w) & (F.abs(p["up"]) <= half_h)
    # a small file would be one task
    rows = timeline.dealt_out(df).withColumn("__c", _on_frame(az, F.col("alt"), F.col("aim"), F.col("tilt"))).withColumn("__r", F.transform(F.sequence(F.lit(0), F.lit(RIM - 1)), rim))
    rows = rows.withColumns({
        "__all": F.col("__c.ahead") & F.forall("__r", lambda p: p["ahead"]), "partly": inside(F.col("__c")) | F.exists("__r", inside),
        "__w": F.array_min("__r.across"), "__e": F.array_max("__r.across"), "__s": F.array_min("__r.up"), "__n": F.array_max("__r.up"),
    })

    def worst(left: Column, right: Column, bottom: Column, top: Column) -> Column:
        """The largest of four distances with its edge; of equals the first."""
        by = [(left, "left"), (right, "right"), (bottom, "bottom"), (top, "top")]
        return F.array_max(F.array(*[F.struct(v.alias("by"), F.lit(-i).alias("order"), F.lit(e).alias("edge")) for i, (v, e) in enumerate(by)]))

    w, e, s, n = (F.col(c) for c in ("__w", "__e", "__s", "__n"))
    rows = rows.withColumn("__o", worst(-half_w - w, e - half_w, -half_h - s, n - half_h)).withColumn("__m", worst(-half_w - e, w - half_w, -half_h - n, s - half_h))
    some = lambda edge, value, none: F.when(F.col("__all") & (F.col(f"{edge}.by") > 0), value).otherwise(none)
    return rows.select(
        *df.columns, (F.col("__all") & (F.col("__o.by") <= 0)).alias("whole"), "partly",
        F.when(F.col("__all"), (e - w) / F.col("across")).otherwise(0.0).alias("span_w"), F.when(F.col("__all"), (n - s) / F.col("upward")).otherwise(0.0).alias("span_h"),
        some("__o", half_up(F.col("__o.by"), 1), 0.0).alias("over"), some("__o", F.col("__o.edge"), "").alias("over_edge"),
        some("__m", half_up(F.col("__m.by"), 1), 0.0).alias("short"), some("__m", F.col("__m.edge"), "").alias("short_edge"),
    )


def inside_edge(az: str, alt: str) -> list[dict[str, str]]:
    """Groups of a formula: inside, how far a direction is on the frame's side of edge 0 to 3 (right, left, top, bottom); aim, tilt, across and upward are columns.

    An edge is a plane through the camera, so inside is a smooth function of the direction and
    has one sign on either side of the edge, behind the camera too; a direction on the inner
    side of all four is in front of the camera and in the frame.
    """
    a = f"({az} - aim)"
    return [
        {"right_": f"{cosd(alt)} * {sind(a)}", "ahead_": f"{cosd('tilt')} * {cosd(alt)} * {cosd(a)} + {sind('tilt')} * {sind(alt)}", "up_": f"{cosd('tilt')} * {sind(alt)} - {sind('tilt')} * {cosd(alt)} * {cosd(a)}"},
        {"inside": "CASE edge WHEN 0 THEN ahead_ * tan(radians(across / 2)) - right_ WHEN 1 THEN ahead_ * tan(radians(across / 2)) + right_"
                   " WHEN 2 THEN ahead_ * tan(radians(upward / 2)) - up_ ELSE ahead_ * tan(radians(upward / 2)) + up_ END"},
    ]


def in_frame(spots: DataFrame, key: list[str], body: Formula, az: str, alt: str, step: int = 300) -> DataFrame:
    """(key, start, end): when a body is inside the frame between start and end of spots, ends to a fraction of a second.

    spots has a row for each key with whole seconds start and end, aim, tilt, across, upward
    (angles of view under 180 degrees) and what body needs to give az and alt. Whichever edge
    is nearest, the body crosses each edge by itself: roots are found for each of the four,
    and the frame is where all four have the body on their inner side. So the nearest edge
    may change between two samples, and a window may be shorter than a step, as long as no
    edge is crossed twice in one.
    """
    side = Formula([*body.groups, *inside_edge(az, alt)], ["inside"])
    each = spots.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(3))))
    found = timeline.intervals_where(each, [*key, "edge"], side, "inside", 0.0, True, "start", "end", step)
    ends = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("sign"))))
    along = Window.partitionBy(*key).orderBy("t", "sign")
    rows = found.select(*key, ends.alias("e")).select(*key, "e.t", "e.sign")
    rows = rows.withColumns({"__open": F.sum("sign").over(along.rowsBetween(Window.unboundedPreceding, 0)), "__next": F.lead("t").over(along)})
    return rows.where("__open = 4 AND __next > t").select(*key, F.col("t").alias("start"), F.col("__next").alias("end"))


def frame_windows(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """(key, start, end): when a body of which only samples are known is inside the frame, ends by linear interpolation of the distance to the nearest edge.

    df has az, alt, aim, tilt, across and upward beside key and at.
    """
    placed = FRAME.on(df)
    edge = F.least(F.col("across") / 2 - F.abs("offset_across"), F.col("upward") / 2 - F.abs("offset_up"))
    return timeline.positive_intervals(placed.withColumn("__edge_gap", F.when(F.col("ahead"), edge).otherwise(-1.0)), key, at, "__edge_gap")
