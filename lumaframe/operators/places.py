"""Places: radius and box joins, horizons, sight lines, skylines.

Points are joined by the cells of a grid whose size is the reach: a point meets its own
cell and the eight round it, never all points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import timeline

FLAT_EARTH_M, EARTH_M = 6371000.0, 6371008.8


def flat_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat-earth metres, the short way round."""
    apart = lon2 - lon1
    apart = F.when(F.abs(apart) > 180, apart - 360 * F.signum(apart)).otherwise(apart)
    return F.hypot(F.radians(lat2 - lat1), F.radians(apart) * F.cos(F.radians((lat1 + lat2) / 2))) * FLAT_EARTH_M


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians((lat2 - lat1) / 2)), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians((lon2 - lon1) / 2)), F.lit(2))
    return 2 * EARTH_M * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))  # null stays null


def within(a: DataFrame, b: DataFrame, metres: float, distance=flat_metres, digits: int | None = None) -> DataFrame:
    """(a_id, b_id, distance): pairs of (id, lat, lon) rows at most metres apart, all over the globe.

    Pairs are found between distinct places (see places_within); rows of one place, however
    many, are joined to those pairs at the end. The distance is rounded to digits, if given,
    for each pair of places and not for each pair of rows.
    """
    near = places_within(a, b, metres, distance)
    near = near if digits is None else near.withColumn("distance", F.round("distance", digits))
    row = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "lat", "lon")])
    # merges at every size: rows are never sent to the driver, and a place of many rows is split
    half = near.join(row(a, "a").hint("merge"), ["a_lat", "a_lon"])
    return half.join(row(b, "b").hint("merge"), ["b_lat", "b_lon"]).select("a_id", "b_id", "distance")


def places_within(a: DataFrame, b: DataFrame, metres: float, distance=flat_metres) -> DataFrame:
    """(a_lat, a_lon, b_lat, b_lon, distance): pairs of distinct places of (lat, lon) rows at most metres apart, all over the globe.

    Latitudes are cut into bands a reach high, and each band into as many cells of longitude
    as have a reach at its end nearer to a pole; at the poles that is one. A row of b is laid
    out over the cells of three bands that its reach meets, round the 180th meridian too, and
    meets the rows of a in them. distance is any function of two places that flat_metres or
    great_circle bounds from below.
    """
    step = math.degrees(metres / FLAT_EARTH_M) * 1.000001
    band = lambda lat: F.floor((lat + 90) / step).cast("int")
    # the cosine of a band's end nearer to a pole, and how many cells it is cut into
    end = lambda y: F.least(F.lit(90.0), F.greatest(F.abs(y * step - 90), F.abs((y + 1) * step - 90)))
    cells = lambda y: F.greatest(F.lit(1), F.floor(360 / step * F.cos(F.radians(end(y)))).cast("int"))
    turn = lambda lon: F.pmod(lon + 180, F.lit(360.0))
    place = lambda rows, p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in ("lat", "lon")]).distinct()
    left = place(a, "a").withColumn("y", band(F.col("a_lat")))
    left = left.withColumn("x", F.least(cells(F.col("y")) - 1, F.floor(turn(F.col("a_lon")) / 360 * cells(F.col("y"))).cast("int")))
    right = place(b, "b").withColumn("y0", band(F.col("b_lat")))
    right = right.withColumn("y", F.explode(F.array(*[F.col("y0") + k for k in (-1, 0, 1)])))
    # how far apart in longitude a pair can be: sin(d / 2) of a reach over the smaller cosine of the bands
    least_cos = F.least(F.cos(F.radians(end(F.col("y")))), F.cos(F.radians(end(F.col("y0")))))
    wide = F.when(least_cos * 90 > step, F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(math.radians(step / 2)) / least_cos))) * 1.001).otherwise(180.0)
    n, lon = cells(F.col("y")), turn(F.col("b_lon"))
    low, high = F.floor((lon - wide) / 360 * n).cast("int"), F.floor((lon + wide) / 360 * n).cast("int")
    high = F.least(high, low + n - 1)
    right = right.withColumn("x", F.explode(F.transform(F.sequence(low, high), lambda x: F.pmod(x, n))))
    d = distance(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return left.join(right, ["y", "x"]).withColumn("distance", d).where(F.col("distance") <= metres).select("a_lat", "a_lon", "b_lat", "b_lon", "distance")


def horizon(samples: DataFrame, key: list[str], eye: Column, height: Column, metres: Column, radius: float = 7 / 6 * EARTH_M) -> DataFrame:
    """(key, bearing, angle): the highest angle along each bearing, with the earth's drop."""
    drop = metres * metres / (2 * radius)
    angle = F.degrees(F.atan2(height - drop - eye, metres))
    return samples.groupBy(*key, "bearing").agg(F.max(angle).alias("angle"))


def merge_profiles(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """The larger of two profiles in each bin; a bin of one side alone keeps its value."""
    both = a.join(b.withColumnRenamed(value, "__v"), [*key, "bin"], "full_outer")
    return both.select(*key, "bin", F.greatest(F.col(value), F.col("__v")).alias(value))


def sight_line(samples: DataFrame, key: list[str], at: Column, ground: Column, start: Column, end: Column, length: Column, radius: float = 7 / 6 * EARTH_M) -> DataFrame:
    """(key, clearance, at, visible): where the straight line from start to end comes closest to the ground.

    at is the distance along a line of length; the earth bulges between its ends.
    """
    bulge = at * (length - at) / (2 * radius)
    line = start + (end - start) * at / length
    rows = samples.withColumn("__c", line - ground - bulge).withColumn("__at", at)
    best = F.min_by(F.struct("__c", "__at"), F.struct("__c", "__at"))
    return rows.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.__c").alias("clearance"), F.col("b.__at").alias("at"), (F.col("b.__c") >= 0).alias("visible"))


def block_max(cells: DataFrame, key: list[str], factor: int) -> DataFrame:
    """(key, row, col, height) coarsened to the highest of each block of factor by factor cells."""
    r, c = F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")
    return cells.groupBy(*key, r, c).agg(F.max("height").alias("height"))


def bilinear(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (id, row, col as fractions) with the height between their four cells; null outside."""
    r0, c0 = F.floor("row"), F.floor("col")
    corners = F.explode(F.array(*[F.struct((r0 + i).alias("r"), (c0 + j).alias("c"), (F.abs(1 - i - (F.col("row") - r0)) * F.abs(1 - j - (F.col("col") - c0))).alias("w")) for i in (0, 1) for j in (0, 1)]))
    around = points.select("id", corners.alias("k")).select("id", "k.r", "k.c", "k.w").where("w > 0")
    ground = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), "height")
    made = around.join(ground, ["r", "c"], "left").groupBy("id").agg(F.when(F.count("*") == F.count("height"), F.sum(F.col("w") * F.col("height"))).alias("height"))
    return points.join(made, "id", "left")


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring, an array of structs (x, y), by the parity of crossings."""
    n = F.size(ring)
    def edge(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), edge), F.lit(0), lambda s, v: s + v) % 2 == 1


def profile_path(samples: DataFrame, key: list[str], at: str, ground: str, line: str, length: Column, width: int, height: int, padding: float = 0.08) -> DataFrame:
    """(key, terrain, sight, top, bottom): a profile drawn to scale as two path strings.

    ground holds the height with the earth's bulge, null where unknown, line the straight
    line's height, at the distance along it; unknown ground isn't drawn. A key is one chart,
    whose points make one string; a flat one is given a metre of range.
    """
    two = lambda v: F.format_string("%.2f", F.floor(v * 100 + 0.5) / 100)
    known = F.when(F.col(ground).isNotNull(), F.col(line))
    made = samples.groupBy(*key).agg(
        F.least(F.min(ground), F.min(known)).alias("lo"), F.greatest(F.max(ground), F.max(known)).alias("hi"), F.any_value(length).alias("length"),
        F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("d"), F.col(ground).cast("double").alias("g"), F.col(line).cast("double").alias("l")))).alias("p"),
    )
    flat, middle = F.col("hi") - F.col("lo") < 1, (F.col("hi") + F.col("lo")) / 2
    made = made.where("lo IS NOT NULL AND length > 0").withColumns({"lo": F.when(flat, middle - 0.5).otherwise(F.col("lo")), "hi": F.when(flat, middle + 0.5).otherwise(F.col("hi"))})
    pad = (F.col("hi") - F.col("lo")) * padding
    made = made.withColumns({"top": F.col("hi") + pad, "bottom": F.col("lo") - pad, "q": F.filter("p", lambda s: s["g"].isNotNull())})
    x = lambda d: two(d / F.col("length") * width)
    y = lambda m: two(height - (m - F.col("bottom")) / (F.col("top") - F.col("bottom")) * height)
    dot = lambda d, m: F.concat(x(d), F.lit(" "), y(m))
    end = lambda s, i: F.element_at(s, i)
    ground_path = F.concat(
        F.lit("M"), F.array_join(F.transform("q", lambda s: dot(s["d"], s["g"])), "L"), F.lit("L"), x(end(F.col("q"), -1)["d"]), F.lit(f" {height}L"), x(end(F.col("q"), 1)["d"]), F.lit(f" {height}Z")
    )
    sight = F.concat(F.lit("M"), dot(end(F.col("p"), 1)["d"], end(F.col("p"), 1)["l"]), F.lit("L"), dot(end(F.col("p"), -1)["d"], end(F.col("p"), -1)["l"]))
    return made.select(*key, ground_path.alias("terrain"), sight.alias("sight"), "top", "bottom")


def tile_row(lat: Column, zoom: Column) -> Column:
    """Row of the tile that holds a latitude, of the square map."""
    inside = F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat))
    return F.floor((1 - F.ln(F.tan(F.radians(inside)) + 1 / F.cos(F.radians(inside))) / math.pi) / 2 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_column(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + 180) / 360 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_count(zoom: Column) -> Column:
    """How many tiles a box (west, south, east, north) covers, without making any."""
    across = tile_column(F.col("east"), zoom) - tile_column(F.col("west"), zoom) + 1
    down = tile_row(F.col("south"), zoom) - tile_row(F.col("north"), zoom) + 1
    return F.greatest(F.lit(0), across) * F.greatest(F.lit(0), down)


def fitting_zoom(boxes: DataFrame, most: int = 16, lowest: int = 7, highest: int = 13) -> DataFrame:
    """boxes with zoom, tiles and fits: the closest zoom whose tiles are at most most; the lowest, which may not fit, if none is."""
    zooms = F.transform(F.sequence(F.lit(highest), F.lit(lowest)), lambda z: F.struct(z.alias("zoom"), tile_count(z).alias("tiles")))
    first = F.get(F.filter(zooms, lambda z: z["tiles"] <= most), F.lit(0))
    rows = boxes.withColumns({"__first": first, "__last": F.element_at(zooms, -1)})
    pick = lambda f: F.coalesce(F.col(f"__first.{f}"), F.col(f"__last.{f}")).alias(f)
    return rows.select(*boxes.columns, pick("zoom"), pick("tiles"), F.col("__first").isNotNull().alias("fits"))


def tiles(boxes: DataFrame, zoom: str = "zoom") -> DataFrame:
    """boxes with x and y, one row for each tile that a box touches; columns go round the map, rows end at its edges."""
    z, scale = F.col(zoom), F.pow(F.lit(2.0), F.col(zoom)).cast("long")
    rows = boxes.withColumn("y", F.explode(F.sequence(F.greatest(F.lit(0), tile_row(F.col("north"), z)), F.least(scale - 1, tile_row(F.col("south"), z)))))
    rows = rows.withColumn("x", F.explode(F.sequence(tile_column(F.col("west"), z), tile_column(F.col("east"), z))))
    return rows.withColumn("x", F.pmod("x", scale)).select(*boxes.columns, "x", "y")


def horizon_reach(above: Column, radius: float = 7 / 6 * EARTH_M) -> Column:
    """Metres from which a peak so much higher than the observer just clears the horizon."""
    return F.when(above > 0, F.sqrt(2 * radius * above)).otherwise(0.0)


def shaded_at(points: DataFrame, cells: DataFrame, azimuth: Column, altitude: Column, metres: float, side: int) -> DataFrame:
    """points (id, row, col as fractions, height) with shaded: whether ground nearer to the sun stands above the ray.

    A ray steps one cell along its longer axis to the edge of a field of side cells; its
    steps are rows that meet their cells, and ground off the field is clear. Below the horizon all is shaded.
    Points that agree in place, height and ray are walked once.
    """
    dx, dy = F.sin(F.radians(azimuth)), -F.cos(F.radians(azimuth))
    step = 1 / F.greatest(F.abs(dx), F.abs(dy))
    rays = points.withColumns({"__dx": dx, "__dy": dy, "__step": step, "__tan": F.tan(F.radians(altitude)), "__up": altitude > 0})
    alike = ["row", "col", "height", "__dx", "__dy", "__step", "__tan"]
    once = timeline.alike(rays.where("__up").select("id", *alike), ["id"])
    walk = once.withColumn("__s", F.explode(F.sequence(F.lit(1), F.lit(side)))).withColumn("__away", F.col("__s") * F.col("__step"))
    walk = walk.select("id", "height", "__tan", (F.col("__away") * metres).alias("__m"), F.floor(F.col("row") + F.col("__dy") * F.col("__away") + 0.5).alias("r"), F.floor(F.col("col") + F.col("__dx") * F.col("__away") + 0.5).alias("c"))
    ground = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("height").alias("__h"))
    drop = F.col("__m") * F.col("__m") / (2 * 7 / 6 * EARTH_M)
    hit = walk.join(ground, ["r", "c"]).where(F.col("__h") - drop > F.col("height") + F.col("__m") * F.col("__tan")).select("id").distinct().withColumn("__hit", F.lit(True))
    hit = once.join(hit, "id").drop("id")  # a point whose place is unknown meets nothing
    return rays.join(hit, alike, "left").select(*[F.col(c) for c in points.columns], (~F.col("__up") | F.coalesce("__hit", F.lit(False))).alias("shaded"))


def facets(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, row, col, half, a, b, c): two triangles for each square of neighbouring cells (row, col, height) that are all known."""
    at = lambda r, c, name: cells.select(*key, (F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), F.col("height").alias(name))
    both = at(0, 0, "nw").join(at(0, 1, "ne"), [*key, "row", "col"]).join(at(1, 0, "sw"), [*key, "row", "col"]).join(at(1, 1, "se"), [*key, "row", "col"])
    corner = lambda *names: F.struct(*[F.col(n).alias(x) for n, x in zip(names, "abc", strict=True)])
    return both.select(*key, "row", "col", F.posexplode(F.array(corner("nw", "sw", "ne"), corner("ne", "sw", "se"))).alias("half", "t")).select(*key, "row", "col", "half", "t.*")


def mosaic(tiles_of: DataFrame, size: int, stride: int = 1) -> DataFrame:
    """(row, col, height) of a field put together from tiles (x, y, row, col, height) of size samples, every stride-th sample kept.

    Rows and columns count from the least tile; tiles are rows like any other, so a field may be of any size.
    """
    first = tiles_of.agg(F.min("x").alias("__x"), F.min("y").alias("__y"))
    rows = tiles_of.join(F.broadcast(first))  # one row
    rows = rows.select(((F.col("y") - F.col("__y")) * size + F.col("row")).alias("row"), ((F.col("x") - F.col("__x")) * size + F.col("col")).alias("col"), "height")
    kept = rows.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0))
    return kept.select((F.col("row") / stride).cast("long").alias("row"), (F.col("col") / stride).cast("long").alias("col"), "height")


def first_covering(points: DataFrame, uploads: DataFrame, world: DataFrame) -> DataFrame:
    """points (id, row, col) with height: of the first upload (rank, row, col, height) that has the cell, else of the world's field, else null."""
    best = uploads.groupBy("row", "col").agg(F.min_by("height", "rank").alias("__own"))
    both = points.join(best, ["row", "col"], "left").join(world.select("row", "col", F.col("height").alias("__world")), ["row", "col"], "left")
    return both.select("id", "row", "col", F.coalesce("__own", "__world").alias("height"))


def resampled(profile: DataFrame, key: list[str], value: str, bins: int, to: int) -> DataFrame:
    """(key, bin, value): a circular profile of bins read at to bearings, straight between its bins; a bin next to a gap stays unknown."""
    want = profile.select(*key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(to - 1))))
    want = want.withColumn("__at", F.col("bin") * (bins / to)).withColumn("__low", F.floor("__at").cast("int") % bins)
    side = lambda name, shift: profile.select(*key, F.pmod(F.col("bin") - shift, F.lit(bins)).cast("int").alias("__low"), F.col(value).alias(name))
    # merges: profiles grow with their keys and are never sent to the driver
    both = want.join(side("__a", 0).hint("merge"), [*key, "__low"], "left").join(side("__b", 1).hint("merge"), [*key, "__low"], "left")
    part = F.col("__at") - F.floor("__at")
    return both.select(*key, "bin", F.when(part == 0, F.col("__a")).otherwise(F.col("__a") + (F.col("__b") - F.col("__a")) * part).alias(value))


def growing_steps(most: int = 220, growth: float = 1.03) -> list[float]:
    """Cells from an observer to the samples of a ray: every step is growth times as long as the one before."""
    cells, step, out = 1.0, 1.0, []
    for _ in range(most):
        out.append(cells)
        step *= growth
        cells += step
    return out


def terrain_horizon(points: DataFrame, cells: DataFrame, metres: float, side: int, bins: int = 720, radius: float = 149_000.0, most: int = 220, growth: float = 1.03) -> DataFrame:
    """(id, bin, angle) round points (id, row, col, height): the highest angle of the ground along each bearing, 0 at least.

    Samples stand further apart the further they are, to the field's edge or radius, and the
    earth drops away below them. Points, bearings and samples are rows that meet their cells;
    points that agree in place and height are looked from once.
    """
    every_point = points.select("id", "row", "col", "height")
    points = timeline.alike(every_point, ["id"])
    # beyond the field's diagonal no sample meets a cell
    away = F.explode(F.array(*[F.lit(c) for c in growing_steps(most, growth) if c * metres <= radius and c <= math.hypot(side, side)]))
    rays = points.select("id", "row", "col", F.col("height").alias("__eye"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    rays = rays.withColumn("__k", away).withColumn("__b", F.radians(F.col("bin") * (360.0 / bins)))
    rays = rays.select("id", "bin", "__eye", (F.col("__k") * metres).alias("__m"), F.floor(F.col("row") - F.cos("__b") * F.col("__k") + 0.5).alias("r"), F.floor(F.col("col") + F.sin("__b") * F.col("__k") + 0.5).alias("c"))
    ground = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("height").alias("__h"))
    met = rays.where(F.col("r").between(0, side - 1) & F.col("c").between(0, side - 1)).join(ground, ["r", "c"])
    rise = F.col("__h") - F.col("__m") * F.col("__m") / (2 * 7 / 6 * EARTH_M) - F.col("__eye")
    found = met.groupBy("id", "bin").agg(F.max(F.degrees(F.atan2(rise, F.col("__m")))).alias("a"))
    every = points.select("id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    every = every.join(found, ["id", "bin"], "left").select("id", "bin", F.greatest(F.lit(0.0), F.coalesce("a", F.lit(0.0))).alias("angle"))
    return timeline.told_all(every, every_point, points, ["id"])


def between(lat1: Column, lon1: Column, lat2: Column, lon2: Column, part: Column) -> Column:
    """Struct (lat, lon) at part of the great circle; antipodes have no one great circle and raise an error."""
    d = great_circle(lat1, lon1, lat2, lon2) / EARTH_M
    apart = F.when(math.pi - d < 1e-9, F.raise_error(F.lit("no great circle between antipodes")).cast("double")).otherwise(d)

    def point(d: Column) -> Column:
        p, q = F.sin((1 - part) * d) / F.sin(d), F.sin(part * d) / F.sin(d)
        rad = lambda f, x: f(F.radians(x))
        x = p * rad(F.cos, lat1) * rad(F.cos, lon1) + q * rad(F.cos, lat2) * rad(F.cos, lon2)
        y = p * rad(F.cos, lat1) * rad(F.sin, lon1) + q * rad(F.cos, lat2) * rad(F.sin, lon2)
        z = p * rad(F.sin, lat1) + q * rad(F.sin, lat2)
        same = F.struct(lat1.cast("double").alias("lat"), lon1.cast("double").alias("lon"))
        return F.when(d == 0, same).otherwise(F.struct(F.degrees(F.atan2(z, F.hypot(x, y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon")))

    return F.get(F.transform(F.array(apart), point), F.lit(0))
