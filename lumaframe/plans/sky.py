"""Queries over seasons, moon and core, and the look of the scene, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaframe.functions import almanac, appearance, sky
from lumaframe.operators import framing, nights

from .archive import query, table
from .light import instants


def nights_of(spark, sf_dir):
    """(spot, lat, lon, start, end): for each supplier the night that follows noon of a day of its own, half a day each way from midnight at its longitude."""
    s = F.col("s_suppkey")
    lon = s * 7 % 360 - 180.0
    noon = F.floor(1_767_268_800 + s * 37 % 365 * 86_400 - lon * 240).cast("long")
    return table(spark, sf_dir, "supplier").select(s.alias("spot"), (s * 13 % 140 - 70.0).alias("lat"), lon.alias("lon"), noon.alias("start"), (noon + 86_400).alias("end"))


@query()
def moon_times(spark, sf_dir):
    """Rise, set and peak of the moon in each supplier's night."""
    return nights.moon_times(nights_of(spark, sf_dir), ["spot"])


@query()
def core_times(spark, sf_dir):
    """Rise, transit and set of the galactic core in each supplier's night."""
    return nights.core_times(nights_of(spark, sf_dir), ["spot"])


@query()
def core_nights(spark, sf_dir):
    """For each supplier's night when the core stands best in a dark sky without moon, or why it doesn't."""
    return nights.core_nights(nights_of(spark, sf_dir), ["spot"])[1]


@query()
def core_stretches(spark, sf_dir):
    """The stretches of each supplier's night that are dark, moonless and have the core up."""
    return nights.core_nights(nights_of(spark, sf_dir), ["spot"])[0]


def frames_of(spark, sf_dir):
    """nights_of with a camera for each: its aim, tilt and angles of view."""
    rows = nights_of(spark, sf_dir)
    return rows.selectExpr("*", "120e0 + spot * 31 % 120 AS aim", "spot * 7 % 40 - 10e0 AS tilt", "20e0 + spot * 11 % 70 AS across", "15e0 + spot * 5 % 50 AS upward")


_TEN = f"""WITH n AS (SELECT s_suppkey AS spot, s_suppkey*13%140 - 70e0 AS lat, s_suppkey*7%360 - 180e0 AS lon, floor(1767268800 + s_suppkey*37%365*86400 - (s_suppkey*7%360 - 180e0)*240)::BIGINT AS a,
120e0 + s_suppkey*31%120 AS aim, s_suppkey*7%40 - 10e0 AS tilt, 20e0 + s_suppkey*11%70 AS across, 15e0 + s_suppkey*5%50 AS upward FROM supplier),
g AS (SELECT *, unnest(range((a + 9)//10*10, a + 86401, 10))::DOUBLE AS t FROM n),
p AS (SELECT spot, t, core_azimuth - aim AS az, core_altitude AS alt, tilt, across, upward FROM {sky.CORE.sql('g')} x),
v AS (SELECT *, cos(radians(alt))*sin(radians(az)) AS rt, cos(radians(tilt))*cos(radians(alt))*cos(radians(az)) + sin(radians(tilt))*sin(radians(alt)) AS ah, cos(radians(tilt))*sin(radians(alt)) - sin(radians(tilt))*cos(radians(alt))*cos(radians(az)) AS u FROM p),
i AS (SELECT spot, t, row_number() OVER (PARTITION BY spot ORDER BY t) AS k FROM v WHERE ah > 0 AND abs(degrees(atan2(rt, ah))) < across/2 AND abs(degrees(atan2(u, ah))) < upward/2)
SELECT spot, min(t)::BIGINT AS "start", max(t)::BIGINT AS "end" FROM i GROUP BY spot, t - 10*k"""


@query(_TEN)
def core_in_frame(spark, sf_dir):
    """When the galactic core crosses a camera's frame in each supplier's night, to whole tens of seconds inside; the SQL looks at every ten seconds."""
    found = framing.in_frame(frames_of(spark, sf_dir), ["spot"], sky.CORE, "core_azimuth", "core_altitude")
    ten = lambda c: (c * 10).cast("long")
    return found.select("spot", ten(F.ceil(F.col("start") / 10)).alias("start"), ten(F.floor(F.col("end") / 10)).alias("end")).where(F.col("start") <= F.col("end"))


@query()
def season_events(spark, sf_dir):
    """Equinoxes and solstices of the years of all orders, by their names in the north and in the south."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    named = lambda lat: almanac.season_name(F.col("season"), F.lit(lat))
    return almanac.season_events(years).select("year", "season", F.round("at", 1).alias("at"), named(1).alias("north"), named(-1).alias("south"))


@query()
def next_season(spark, sf_dir):
    """The equinox or solstice that follows each order, and the solstices nearest to it."""
    rows = instants(spark, sf_dir).select("id", "t")
    both = almanac.nearest_solstices(almanac.next_season(rows))
    return both.select("id", "season", F.round("in_days", 4).alias("in_days"), *[F.round(c, 1).alias(c) for c in ("june", "december")])


@query("""SELECT event_id AS id, CASE WHEN a <= -0.833e0 THEN 'below the horizon' WHEN f < 0.15e0 THEN 'a sliver — a subject, not a light' WHEN a < 10 THEN 'low — behind anything on the skyline'
WHEN f > 0.85e0 THEN 'bright enough to light a landscape' WHEN f > 0.5e0 THEN 'usable fill on a long exposure' ELSE 'faint — expect to expose for the sky' END AS note FROM (SELECT event_id, event_id*7%90 - 10e0 AS a, event_id%101/100e0 AS f FROM events)""")
def moonlight_notes(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("id"), almanac.moonlight(e * 7 % 90 - 10.0, e % 101 / 100.0).alias("note"))


def _between(stops, channel: int | None) -> str:
    """Interpolation over a table of stops: the stop below and the one above, by joins instead of cases."""
    rows = ", ".join(f"({a}e0, {float(v if channel is None else v[channel])}e0)" for a, v in stops)
    return f"""(SELECT p.id, coalesce(any_value(CASE WHEN p.a < lo THEN v0 WHEN p.a > hi THEN v1 WHEN p.a BETWEEN x AND nx THEN v + (nv - v)*(p.a - x)/(nx - x) END), 0) AS v FROM p,
(SELECT x, v, lead(x) OVER (ORDER BY x) AS nx, lead(v) OVER (ORDER BY x) AS nv, min(x) OVER () AS lo, max(x) OVER () AS hi, first_value(v) OVER (ORDER BY x) AS v0, last_value(v) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v1 FROM (VALUES {rows}) s(x, v)) GROUP BY p.id)"""


def _hex_sql(stops) -> str:
    byte = lambda c: f"lpad(lower(hex(floor(c{c}.v + 0.5)::UTINYINT)), 2, '0')"
    return f"(SELECT c0.id, '#' || {byte(0)} || {byte(1)} || {byte(2)} AS v FROM {_between(stops, 0)} c0 JOIN {_between(stops, 1)} c1 ON c0.id = c1.id JOIN {_between(stops, 2)} c2 ON c0.id = c2.id)"


@query(f"""WITH p AS (SELECT p_partkey AS id, p_partkey*7%90 - 22e0 AS a FROM part)
SELECT p.id, l.v AS light, m.v AS ambient, k.v AS sky, s.v AS shadow, w.v AS wash, round(o.v, 6) AS wash_opacity, round(CASE WHEN a <= 0 THEN 0 ELSE least(1, sin(least(a, 60)/60*pi()/2)*0.62e0 + 0.06e0) END, 6) AS strength,
round(CASE WHEN a > 0 THEN 0.24e0 + 0.22e0*least(1, a/18) ELSE 0 END, 6) AS opacity, round(CASE WHEN a <= 0 THEN 0.08e0 ELSE 0.42e0 + 0.36e0*greatest(0, 1 - a/25) END, 6) AS directional, greatest(0, least(180, 90 - a)) AS polar
FROM p JOIN {_hex_sql(appearance.LIGHT)} l ON p.id = l.id JOIN {_hex_sql(appearance.AMBIENT)} m ON p.id = m.id JOIN {_hex_sql(appearance.SKY)} k ON p.id = k.id JOIN {_hex_sql(appearance.SHADOW)} s ON p.id = s.id
JOIN {_hex_sql(appearance.WASH)} w ON p.id = w.id JOIN {_between(appearance.WASH_OPACITY, None)} o ON p.id = o.id""")
def scene_ramps(spark, sf_dir):
    """Colours and strengths of a scene by the sun's altitude."""
    a = F.col("a")
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey*7%90 - 22e0 AS a")
    return rows.select(
        "id", *[appearance.colour_at(s, a).alias(n) for n, s in (("light", appearance.LIGHT), ("ambient", appearance.AMBIENT), ("sky", appearance.SKY), ("shadow", appearance.SHADOW), ("wash", appearance.WASH))],
        F.round(appearance.ramp(appearance.WASH_OPACITY, a), 6).alias("wash_opacity"), F.round(appearance.sunlight_strength(a), 6).alias("strength"), F.round(appearance.shadow_opacity(a), 6).alias("opacity"),
        F.round(appearance.directional_strength(a), 6).alias("directional"), appearance.light_position(F.lit(0.0), a)["polar"].alias("polar"),
    )


@query()
def building_ramps(spark, sf_dir):
    """Colours of low and tall buildings by the sun's altitude, in both themes, and of the light on them."""
    a = F.col("a")
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey*7%90 - 22e0 AS a")
    themes = F.explode(F.array(*[F.struct(F.lit(t).alias("theme"), appearance.building_colours(a, t).alias("stops")) for t in appearance.BUILDING_ENDS]))
    return rows.select("id", appearance.extrusion_light(a).alias("light"), themes.alias("x")).select("id", "light", "x.theme", F.inline("x.stops"))
