"""Queries over time, places, sky, weather and cameras, with their SQL.

Events stand in for samples and forecasts, customers and suppliers for places, orders
for instants; derived numbers are integer arithmetic on keys.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumaframe.functions import colour, field, geodesy, sky, spectrum
from lumaframe.functions.formulas import Formula, turn
from lumaframe.operators import areas, clusters, places, terrain, timeline

from .archive import images, query, table

SECOND = "cast(floor(epoch(ts)) as bigint)"


def samples(spark, sf_dir):
    """(user_id, event_id, at, value, event_type) of events; at in whole seconds."""
    rows = table(spark, sf_dir, "events")
    return rows.select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), "value", "event_type")


E_SQL = f"e AS (SELECT user_id, event_id, {SECOND} AS sec, value, event_type FROM events)"


def _asof_sql(feed_where: str, tol: int) -> str:
    return f"""WITH {E_SQL}, f AS (SELECT sec AS fat, min(value) AS reading FROM e WHERE event_id%3 = 0 {feed_where} GROUP BY 1), p AS (SELECT event_id, sec FROM e WHERE event_id%3 <> 0),
j AS (SELECT event_id, abs(sec - fat) AS gap, reading, row_number() OVER (PARTITION BY event_id ORDER BY abs(sec - fat), fat) AS n FROM p JOIN f ON abs(sec - fat) <= {tol})
SELECT p.event_id, j.gap, j.reading FROM p LEFT JOIN j ON p.event_id = j.event_id AND n = 1"""


def _asof(spark, sf_dir, tolerance, skip):
    rows = samples(spark, sf_dir)
    reading = F.min("value") if not skip else F.min(F.when(F.col("event_id") % 2 == 0, F.col("value")))
    feed = rows.where("event_id % 3 = 0").groupBy("at").agg(reading.alias("reading"))
    probes = rows.where("event_id % 3 <> 0").select("event_id", "at")
    return timeline.nearest_in_time(probes, feed, "at", tolerance, ["reading"], "reading" if skip else None).drop("at")


@query(_asof_sql("", 3600))
def asof_hour(spark, sf_dir):
    """The nearest reading within an hour on either side."""
    return _asof(spark, sf_dir, 3600, False)


@query(_asof_sql("AND event_id%2 = 0", 5400))
def asof_skip_null(spark, sf_dir):
    """The nearest reading that is not null within ninety minutes."""
    return _asof(spark, sf_dir, 5400, True)


RUN_SQL = f"""{E_SQL}, s AS (SELECT *, value > 50 AS lit, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS k FROM e),
b AS (SELECT *, sum(CASE WHEN k > 1 AND lit = plit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY k) AS run FROM (SELECT *, lag(lit) OVER (PARTITION BY user_id ORDER BY k) AS plit FROM s)),
w0 AS (SELECT user_id, run::BIGINT AS run, any_value(lit) AS lit, min(sec) AS start_, max(sec) AS last_, count(*) AS n FROM b GROUP BY user_id, run),
w AS (SELECT user_id, run, lit, start_ AS "start", coalesce(lead(start_) OVER (PARTITION BY user_id ORDER BY run), last_) AS "end", n FROM w0)"""


def _windows(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("lit", F.col("value") > 50)
    return timeline.run_windows(rows, ["user_id"], ["at", "event_id"], "lit", "at")


@query(f"WITH {RUN_SQL} SELECT * FROM w")
def runs_rle(spark, sf_dir):
    return _windows(spark, sf_dir)


@query(f"WITH {RUN_SQL} SELECT user_id, run, lead(\"start\") OVER (PARTITION BY user_id ORDER BY run) AS next_at, lead(lit) OVER (PARTITION BY user_id ORDER BY run) AS next_state FROM w")
def next_change(spark, sf_dir):
    return timeline.next_change(_windows(spark, sf_dir), ["user_id"], "lit").select("user_id", "run", "next_at", "next_state")


@query(f"""WITH {RUN_SQL}, l AS (SELECT *, "end" - "start" AS len FROM w WHERE lit), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY len DESC, run) AS k, sum(len) OVER (PARTITION BY user_id) AS total FROM l)
SELECT user_id, total::BIGINT AS total, run, len AS length FROM r WHERE k = 1""")
def longest_run(spark, sf_dir):
    return timeline.longest(_windows(spark, sf_dir).where("lit"), ["user_id"], F.col("end") - F.col("start"))


@query(f"""WITH {RUN_SQL} SELECT user_id, sum(greatest(0, "end" - greatest("start", 1704100000)))::BIGINT AS ahead FROM w WHERE lit GROUP BY 1""")
def lit_ahead(spark, sf_dir):
    """Seconds of light left after an instant."""
    left = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.lit(1704100000)))
    return _windows(spark, sf_dir).where("lit").groupBy("user_id").agg(F.sum(left).cast("long").alias("ahead"))


@query(f"""WITH {E_SQL}, a AS (SELECT sec AS s, sec + floor(value*3)::BIGINT AS t FROM e WHERE event_id%2 = 0), b AS (SELECT sec + 30 AS s, sec + 30 + floor(value*5)::BIGINT AS t FROM e WHERE event_id%2 <> 0)
SELECT greatest(a.s, b.s) AS "start", least(a.t, b.t) AS "end" FROM a JOIN b ON greatest(a.s, b.s) < least(a.t, b.t)""")
def interval_intersect(spark, sf_dir):
    """Overlaps of the events' intervals; an event is on one side or the other by the parity of its id."""
    rows = samples(spark, sf_dir).withColumn("k", F.lit(0))
    a = rows.where("event_id % 2 = 0").select("k", F.col("at").alias("start"), (F.col("at") + F.floor(F.col("value") * 3)).alias("end"))
    b = rows.where("event_id % 2 <> 0").select("k", (F.col("at") + 30).alias("start"), (F.col("at") + 30 + F.floor(F.col("value") * 5)).alias("end"))
    return timeline.intersections(a, b, ["k"], 600).drop("k")


GAP_SQL = f"{E_SQL}, g AS (SELECT *, value - 50 AS gap, lag(value - 50) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS before FROM e)"


@query(f"WITH {GAP_SQL} SELECT user_id, event_id, gap > before AS rising FROM g WHERE before IS NOT NULL AND sign(before) <> sign(gap) AND abs(before) + abs(gap) < 180")
def crossing_brackets(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("gap", F.col("value") - 50)
    return timeline.crossings(rows, ["user_id"], ["at", "event_id"], "gap", wrap=True).select("user_id", "event_id", "rising")


@query(f"""WITH {E_SQL}, m AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS p, lead(value) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS n FROM e)
SELECT user_id, event_id, value FROM m WHERE (p IS NULL OR value < p) AND (n IS NULL OR value <= n)""")
def local_minima(spark, sf_dir):
    return timeline.local_minima(samples(spark, sf_dir), ["user_id"], ["at", "event_id"], "value").select("user_id", "event_id", "value")


@query(f"""WITH {E_SQL}, h AS (SELECT *, sec//3600 AS hour, lag(sec//3600) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS p FROM e) SELECT user_id, event_id FROM h WHERE p IS NULL OR p <> hour""")
def hour_beads(spark, sf_dir):
    """The first sample of each hour."""
    rows = samples(spark, sf_dir)
    return timeline.first_of_change(rows, ["user_id"], ["at", "event_id"], F.floor(F.col("at") / 3600)).select("user_id", "event_id")


@query(f"""WITH {E_SQL}, p AS (SELECT user_id, event_id, sec, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, sec, event_id) AS n FROM e) SELECT user_id, event_id, value FROM p WHERE n = 1""")
def peak(spark, sf_dir):
    """The highest sample of each series; the first of equals."""
    best = F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("at"), -F.col("event_id")))
    return samples(spark, sf_dir).groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", "b.value")


@query(f"""WITH {E_SQL}, g AS (SELECT user_id, sec, max(value) - 50 AS v FROM e GROUP BY ALL),
l AS (SELECT *, lag(v) OVER w AS pv, lag(sec) OVER w AS ps, lead(v) OVER w AS nv, lead(sec) OVER w AS ns FROM g WINDOW w AS (PARTITION BY user_id ORDER BY sec)),
s AS (SELECT user_id, coalesce(ps + (sec - ps)*pv/(pv - v), sec) AS s, row_number() OVER (PARTITION BY user_id ORDER BY sec) AS k FROM l WHERE v > 0 AND (pv IS NULL OR pv <= 0)),
t AS (SELECT user_id, coalesce(sec + (ns - sec)*v/(v - nv), sec) AS t, row_number() OVER (PARTITION BY user_id ORDER BY sec) AS k FROM l WHERE v > 0 AND (nv IS NULL OR nv <= 0))
SELECT user_id, round(s, 2) AS "start", round(t, 2) AS "end" FROM s JOIN t USING (user_id, k) WHERE t > s""")
def positive_intervals(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy("user_id", "at").agg((F.max("value") - 50).alias("gap"))
    found = timeline.positive_intervals(rows, ["user_id"], "at", "gap")
    return found.select("user_id", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"))


SPOT = "c_custkey%160 - 80 + (c_custkey*37%1000)/1000e0"
PAIR_SQL = f"""(SELECT l_orderkey AS id, l_linenumber AS line, {SPOT} AS lat1, c_custkey*7%360 - 180e0 AS lon1, l_suppkey AS sid, l_suppkey*13%140 - 70e0 AS lat2, l_suppkey*29%360 - 180e0 AS lon2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def pairs(spark, sf_dir):
    """(id, line, lat1, lon1, sid, lat2, lon2): for each line item its customer's place and its supplier's."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{SPOT} AS lat1", "c_custkey*7%360 - 180e0 AS lon1")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.selectExpr("l_orderkey AS id", "l_linenumber AS line", "lat1", "lon1", "l_suppkey AS sid", "l_suppkey*13%140 - 70e0 AS lat2", "l_suppkey*29%360 - 180e0 AS lon2")


PLACE_SQL = f"""c AS (SELECT c_custkey AS id, {SPOT} AS lat, c_custkey*7%360 - 180e0 AS lon FROM customer), s AS (SELECT s_suppkey AS id, s_suppkey*13%140 - 70e0 AS lat, s_suppkey*29%360 - 180e0 AS lon FROM supplier)"""


@query(f"""WITH v AS (SELECT *, cos(radians(lat1))*cos(radians(lon1)) AS x1, cos(radians(lat1))*sin(radians(lon1)) AS y1, sin(radians(lat1)) AS z1, cos(radians(lat2))*cos(radians(lon2)) AS x2, cos(radians(lat2))*sin(radians(lon2)) AS y2, sin(radians(lat2)) AS z2 FROM {PAIR_SQL}),
d AS (SELECT *, 6371008.8e0*atan2(sqrt(pow(y1*z2 - z1*y2, 2) + pow(z1*x2 - x1*z2, 2) + pow(x1*y2 - y1*x2, 2)), x1*x2 + y1*y2 + z1*z2) AS distance,
  atan2(x1*y2 - y1*x2, z2*(x1*x1 + y1*y1) - z1*(x1*x2 + y1*y2)) AS course FROM v),
b AS (SELECT *, CASE WHEN course < 0 THEN degrees(course) + 360 ELSE degrees(course) END AS bearing FROM d)
SELECT id, line, sid, round(distance, 2) AS distance, CASE WHEN round(bearing, 6) = 360 THEN 0 ELSE round(bearing, 6) END AS bearing, ['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW', 'N'][round(bearing/22.5e0)::INT + 1] AS compass,
['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW', 'N'][round(bearing/45e0)::INT + 1] AS eighth, round(6371000e0*pi()/180*sqrt(pow(lat2 - lat1, 2) + pow((lon2 - lon1)*cos(radians((lat1 + lat2)/2)), 2)), 2) AS flat FROM b""")
def haversine_bearing(spark, sf_dir):
    """Distances and courses of every line item; the SQL takes them from vectors in space."""
    found = geodesy.INVERSE.on(pairs(spark, sf_dir))
    return found.selectExpr("id", "line", "sid", "round(distance, 2) AS distance", "CASE WHEN round(bearing, 6) = 360 THEN 0 ELSE round(bearing, 6) END AS bearing", "compass", "eighth", "round(flat, 2) AS flat")


@query(f"""WITH {PLACE_SQL} SELECT c.id AS a_id, s.id AS b_id, round(d, 2) AS distance FROM (SELECT c.id AS ci, s.id AS si,
2*6371008.8e0*asin(least(1, sqrt(pow(sin(radians(s.lat - c.lat)/2), 2) + cos(radians(c.lat))*cos(radians(s.lat))*pow(sin(radians(s.lon - c.lon)/2), 2)))) AS d FROM c, s) q JOIN c ON c.id = ci JOIN s ON s.id = si WHERE d <= 900000""")
def radius_filter(spark, sf_dir):
    """Suppliers within 900 km of each customer on the sphere, by grid cells; the SQL tries all pairs."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{SPOT} AS lat", "c_custkey*7%360 - 180e0 AS lon")
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_suppkey*13%140 - 70e0 AS lat", "s_suppkey*29%360 - 180e0 AS lon")
    return places.within(c, s, 900_000.0, places.great_circle, 2)


DIRECT_SQL = f"(SELECT c_custkey AS id, {SPOT} AS lat1, c_custkey*7%360 - 180e0 AS lon1, c_custkey*11%360 + 0e0 AS course, 1000e0*(c_custkey%3000 + 1) AS metres FROM customer)"


def along_sql(source: str) -> str:
    """source with the end of its course: a vector in the plane of its own meridian, turned by the arc."""
    arc, lat, course = "metres/6371008.8e0", "radians(lat1)", "radians(course)"
    vector = f"cos({arc})*cos({lat}) - sin({arc})*cos({course})*sin({lat}) AS x_, sin({arc})*sin({course}) AS y_, cos({arc})*sin({lat}) + sin({arc})*cos({course})*cos({lat}) AS z_"
    return f"(SELECT *, degrees(atan2(z_, sqrt(x_*x_ + y_*y_))) AS lat, lon1 + degrees(atan2(y_, x_)) AS lon FROM (SELECT *, {vector} FROM {source}))"


@query(f"SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(CASE WHEN lon < -180 THEN lon + 360 WHEN lon >= 180 THEN lon - 360 ELSE lon END, 6) AS wrapped FROM {along_sql(DIRECT_SQL)}")
def destination(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{SPOT} AS lat1", "c_custkey*7%360 - 180e0 AS lon1", "c_custkey*11%360 + 0e0 AS course", "1000e0*(c_custkey%3000 + 1) AS metres")
    return geodesy.DIRECT.on(rows).selectExpr("id", "round(lat, 6) AS lat", "round(lon, 6) AS lon", "round(wrapped, 6) AS wrapped")


@query(f"""WITH v AS (SELECT *, cos(radians(lat1))*cos(radians(lon1)) AS x1, cos(radians(lat1))*sin(radians(lon1)) AS y1, sin(radians(lat1)) AS z1, cos(radians(lat2))*cos(radians(lon2)) AS x2, cos(radians(lat2))*sin(radians(lon2)) AS y2, sin(radians(lat2)) AS z2 FROM {PAIR_SQL}),
w AS (SELECT *, acos(greatest(-1, least(1, x1*x2 + y1*y2 + z1*z2))) AS a FROM v), m AS (SELECT *, sin(0.7e0*a)/sin(a) AS p, sin(0.3e0*a)/sin(a) AS q FROM w WHERE a BETWEEN 1e-6 AND pi() - 1e-6)
SELECT id, line, round(degrees(asin(greatest(-1, least(1, p*z1 + q*z2)))), 4) AS lat, round(degrees(atan2(p*y1 + q*y2, p*x1 + q*x2)), 4) AS lon FROM m""")
def great_circle_point(spark, sf_dir):
    """The point three tenths along each line item's great circle; none between antipodes or for one place."""
    found = geodesy.BETWEEN.on(pairs(spark, sf_dir).withColumn("part", F.lit(0.3)))
    found = found.where("lat IS NOT NULL AND NOT (lat1 = lat2 AND lon1 = lon2)")
    return found.selectExpr("id", "line", "round(lat, 4) AS lat", "round(lon, 4) AS lon")


TILE_SQL = f"(SELECT c_custkey AS id, {SPOT} AS lat, c_custkey*7%360 - 180e0 AS lon, 7 + c_custkey%7 AS zoom FROM customer)"


@query(f"""WITH m AS (SELECT *, greatest(-85.05112878e0, least(85.05112878e0, lat)) AS la, pow(2e0, zoom) AS n FROM {TILE_SQL}), t AS (SELECT *, floor((lon + 180)*n/360)::BIGINT AS x, floor(n/2*(1 - 0.5e0*ln((1 + sin(radians(la)))/(1 - sin(radians(la))))/pi()))::BIGINT AS y FROM m)
SELECT id, x, y, round(360*x/n - 180, 6) AS west, round(90 - 2*degrees(atan(exp(-pi()*(1 - 2*y/n)))), 6) AS north, round(40075016.686e0*cos(radians(lat))/256/n, 4) AS metres FROM t""")
def slippy_tiles(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{SPOT} AS lat", "c_custkey*7%360 - 180e0 AS lon", "7 + c_custkey%7 AS zoom")
    return geodesy.TILE.on(rows).selectExpr("id", "cast(floor(tile_x) as bigint) AS x", "cast(floor(tile_y) as bigint) AS y", "round(west, 6) AS west", "round(north, 6) AS north", "round(metres, 4) AS metres")


@query("SELECT p_partkey AS id, (p_partkey*37%256)*256e0 + p_partkey*91%256 + (p_partkey*53%256)/256e0 - 32768 AS height FROM part")
def elevation_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey*37%256 AS r", "p_partkey*91%256 AS g", "p_partkey*53%256 AS b")
    return geodesy.ELEVATION.on(rows).select("id", "height")


TOWN = "SELECT c_custkey AS id, 55.95e0 + (c_custkey*7919%4001 - 2000)/400000e0 AS lat, -3.19e0 + (c_custkey*104729%4001 - 2000)/250000e0 AS lon FROM customer"


def town(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(*TOWN.removeprefix("SELECT ").removesuffix(" FROM customer").split(", "))


@query(f"""WITH p AS ({TOWN}), d AS (SELECT a.id AS a_id, b.id AS b_id, sqrt(pow(radians(b.lat-a.lat), 2) + pow(radians(b.lon-a.lon)*cos(radians((a.lat+b.lat)/2)), 2))*6371000e0 AS distance FROM p a JOIN p b ON abs(a.lat-b.lat) < 0.01)
SELECT a_id, b_id, round(distance, 4) AS distance FROM d WHERE distance <= 60""")
def spatial_self_join(spark, sf_dir):
    rows = town(spark, sf_dir)
    return places.within(rows, rows, 60.0, digits=4)


@query()
def hotspots(spark, sf_dir):
    return clusters.hotspots(town(spark, sf_dir))


TIMES_SQL = f"""(SELECT o_orderkey AS id, {SPOT} AS lat, c_custkey*7%360 - 180e0 AS lon, epoch(o_orderdate) + o_orderkey%1440*60e0 AS t FROM orders JOIN customer ON o_custkey = c_custkey)"""


def instants(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("s"))
    both = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.selectExpr("o_orderkey AS id", f"{SPOT} AS lat", "c_custkey*7%360 - 180e0 AS lon", "s + o_orderkey%1440*60e0 AS t")


SUN_OUT = ["id", "round(sun_azimuth, 4) AS azimuth", "round(sun_altitude, 4) AS altitude", "round(sun_declination, 5) AS declination", "round(equation_of_time, 4) AS eot", "round(sun_distance, 6) AS au", "phase", "round(shadow_bearing, 4) AS shadow_bearing"]


@query(f"SELECT {', '.join(SUN_OUT)} FROM {sky.SUN.sql(TIMES_SQL)}")
def sun_position(spark, sf_dir):
    return sky.SUN.on(instants(spark, sf_dir)).selectExpr(*SUN_OUT)


MOON_OUT = ["id", "round(moon_azimuth, 4) AS azimuth", "round(moon_altitude, 4) AS altitude", "round(moon_apparent, 3) AS apparent", "round(moon_declination, 4) AS declination", "round(moon_km, 1) AS km", "round(moon_radius, 6) AS radius"]


@query(f"SELECT {', '.join(MOON_OUT)} FROM {sky.MOON.sql(TIMES_SQL)}")
def moon_position(spark, sf_dir):
    return sky.MOON.on(instants(spark, sf_dir)).selectExpr(*MOON_OUT)


PHASE_OUT = ["id", "round(age, 4) AS age", "round(lit, 5) AS lit", "round(age_days, 4) AS age_days", "moon_phase"]


@query(f"SELECT {', '.join(PHASE_OUT)} FROM {sky.ILLUMINATION.sql(TIMES_SQL)}")
def moon_phase(spark, sf_dir):
    return sky.ILLUMINATION.on(instants(spark, sf_dir)).selectExpr(*PHASE_OUT)


CORE_OUT = ["id", "round(core_azimuth, 4) AS azimuth", "round(core_altitude, 4) AS altitude"]


@query(f"SELECT {', '.join(CORE_OUT)} FROM {sky.CORE.sql(TIMES_SQL)}")
def core_position(spark, sf_dir):
    return sky.CORE.on(instants(spark, sf_dir)).selectExpr(*CORE_OUT)


DAY_OUT = ["id", "round(solar_noon, 1) AS noon", "round(sunrise, 1) AS sunrise", "round(sunset, 1) AS sunset", "polar"]

@query(f"SELECT {', '.join(DAY_OUT)} FROM {sky.DAY.sql(TIMES_SQL)}")
def sun_times(spark, sf_dir):
    """Noon, rise and set for every order."""
    return sky.DAY.on(instants(spark, sf_dir)).selectExpr(*DAY_OUT)


CLOUD_SQL = """(SELECT event_id AS id, CASE WHEN event_id%17 = 0 THEN NULL ELSE (event_id*7%100)::INT END AS code, CASE WHEN event_id%13 = 0 THEN NULL ELSE value END AS cloud, CASE WHEN event_id%5 = 0 THEN NULL ELSE event_id*3%101 + 0e0 END AS low,
CASE WHEN event_id%7 = 0 THEN NULL ELSE event_id*11%101 + 0e0 END AS mid, CASE WHEN event_id%11 = 0 THEN NULL ELSE event_id*17%101 + 0e0 END AS high, event_id%70 - 20e0 AS sun FROM events)"""
CLOUD_OUT = ["id", "condition", "round(blocking, 6) AS blocking", "quality", "round(direct, 6) AS direct", "dominant"]


_CODES = "[" + ", ".join(f"{{'k': {k}, 'v': '{v}'}}" for k, v in field.CODES.items()) + "]"


@query(f"""WITH c AS (SELECT *, CASE WHEN low IS NULL AND mid IS NULL THEN NULL ELSE 100 - (100 - coalesce(low, 0))*(100 - coalesce(mid, 0))/100e0 END AS blocking, list_sort(list_filter([low, mid, high], lambda x: x IS NOT NULL)) AS decks FROM {CLOUD_SQL}),
n AS (SELECT c.*, t.x.v AS told FROM c LEFT JOIN (SELECT unnest({_CODES}) AS x) t ON t.x.k = c.code)
SELECT id, CASE WHEN code IS NULL THEN 'Not known' ELSE coalesce(told, 'Code ' || code) END AS condition, round(blocking, 6) AS blocking,
CASE WHEN sun <= -0.833 THEN 'none' WHEN cloud IS NULL THEN 'unknown' WHEN cloud >= 88 THEN 'flat' WHEN cloud >= 65 THEN 'mostly cloud' WHEN cloud >= 35 THEN 'broken' WHEN cloud >= 12 THEN 'mostly sun' ELSE 'hard' END AS quality,
round(CASE WHEN coalesce(blocking, cloud) IS NULL THEN 1 ELSE 1 - pow(least(100, greatest(0, coalesce(blocking, cloud)))/100e0, 2.2e0) END, 6) AS direct,
CASE WHEN len(decks) > 0 AND decks[-1] >= 10 AND (len(decks) = 1 OR decks[-1] - decks[-2] >= 10) THEN CASE decks[-1] WHEN low THEN 'low' WHEN mid THEN 'mid' ELSE 'high' END END AS dominant FROM n""")
def weather_scalars(spark, sf_dir):
    e = "event_id"
    rows = table(spark, sf_dir, "events").selectExpr(
        f"{e} AS id", f"CASE WHEN {e}%17 = 0 THEN NULL ELSE cast({e}*7%100 as int) END AS code", f"CASE WHEN {e}%13 = 0 THEN NULL ELSE value END AS cloud", f"CASE WHEN {e}%5 = 0 THEN NULL ELSE {e}*3%101 + 0e0 END AS low",
        f"CASE WHEN {e}%7 = 0 THEN NULL ELSE {e}*11%101 + 0e0 END AS mid", f"CASE WHEN {e}%11 = 0 THEN NULL ELSE {e}*17%101 + 0e0 END AS high", f"{e}%70 - 20e0 AS sun",
    )
    return field.CLOUD.on(rows).selectExpr(*CLOUD_OUT)


HORIZON_SQL = "(SELECT event_id AS id, CASE WHEN event_id%9 = 0 THEN NULL ELSE event_id*3%101 + 0e0 END AS low, CASE WHEN event_id%9 = 0 THEN NULL ELSE event_id*5%60 + 0e0 END AS mid, event_id*7%40 + 0e0 AS mid2, event_id*11%30 + 0e0 AS high2, event_id*13%360 + 0e0 AS bearing FROM events)"
HORIZON_OUT = ["id", "round(gate, 6) AS gate", "round(canvas, 6) AS canvas", "round(metres, 2) AS metres", "verdict", "side"]


@query(f"""WITH h AS (SELECT *, CASE WHEN low IS NULL THEN NULL ELSE 100 - (100 - low)*(100 - mid)/100e0 END AS gate, 100 - (100 - mid2)*(100 - high2)/100e0 AS canvas FROM {HORIZON_SQL})
SELECT id, round(gate, 6) AS gate, round(canvas, 6) AS canvas, round(sqrt(2*7*6371008.8e0*6000/6e0), 2) AS metres, CASE WHEN gate IS NULL THEN 'unknown' WHEN gate >= 65 THEN 'blocked' WHEN canvas < 12 THEN 'bare' ELSE 'lit' END AS verdict,
['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][((bearing::INT*2 + 45)//90)%8 + 1] AS side FROM h""")
def horizon_verdict(spark, sf_dir):
    e = "event_id"
    rows = table(spark, sf_dir, "events").selectExpr(f"{e} AS id", f"CASE WHEN {e}%9 = 0 THEN NULL ELSE {e}*3%101 + 0e0 END AS low", f"CASE WHEN {e}%9 = 0 THEN NULL ELSE {e}*5%60 + 0e0 END AS mid", f"{e}*7%40 + 0e0 AS mid2", f"{e}*11%30 + 0e0 AS high2", f"{e}*13%360 + 0e0 AS bearing")
    return field.HORIZON.on(rows).selectExpr(*HORIZON_OUT)


AIR_SQL = "(SELECT event_id AS id, event_id%100 - 5e0 AS altitude, event_id%3000 + 0e0 AS elevation, CASE WHEN event_id%7 = 0 THEN NULL ELSE event_id%40 - 10e0 END AS dew, CASE WHEN event_id%3 = 0 THEN NULL ELSE event_id%50/100e0 END AS aod, CASE WHEN event_id%4 = 0 THEN NULL ELSE event_id%11/10e0 END AS sea FROM events)"
AIR_OUT = ["id", "round(air_mass, 5) AS air_mass", "round(pressure_ratio, 6) AS pressure", "round(water, 5) AS water", "round(alpha, 6) AS alpha", "round(beta, 6) AS beta", "basis"]


@query(f"""WITH a AS (SELECT *, least(1, coalesce(sea, 0)) AS s FROM {AIR_SQL}), b AS (SELECT *, 1.3e0 - 0.9e0*s AS alpha FROM a)
SELECT id, round(CASE WHEN altitude > -1 THEN pow(sin(radians(greatest(altitude, -0.9e0))) + 0.50572e0/pow(greatest(altitude, -0.9e0) + 6.07995e0, 1.6364e0), -1) END, 5) AS air_mass, round(1/exp(elevation/8434.5e0), 6) AS pressure,
round(CASE WHEN dew IS NULL THEN 1.5e0 ELSE greatest(0.1e0, least(6, exp(0.1102e0)*exp(0.0614e0*dew))) END, 5) AS water, round(alpha, 6) AS alpha, round(coalesce(aod*exp(alpha*ln(0.55e0)), 0.05e0 + 0.07e0*s), 6) AS beta, CASE WHEN aod IS NULL THEN 'assumed' ELSE 'measured' END AS basis FROM b""")
def air_state(spark, sf_dir):
    e = "event_id"
    rows = table(spark, sf_dir, "events").selectExpr(f"{e} AS id", f"{e}%100 - 5e0 AS altitude", f"{e}%3000 + 0e0 AS elevation", f"CASE WHEN {e}%7 = 0 THEN NULL ELSE {e}%40 - 10e0 END AS dew", f"CASE WHEN {e}%3 = 0 THEN NULL ELSE {e}%50/100e0 END AS aod", f"CASE WHEN {e}%4 = 0 THEN NULL ELSE {e}%11/10e0 END AS sea")
    return field.AIR.on(rows).selectExpr(*AIR_OUT)


LENS_SQL = "(SELECT p_partkey AS id, 36e0 - p_partkey%3*8 AS sensor_w, 24e0 - p_partkey%3*5 AS sensor_h, 12e0 + p_partkey%390 AS focal, 1.4e0 + p_partkey%20 AS aperture, 0.03e0 AS coc, 1e0 + p_partkey%500 AS focus FROM part)"
LENS_OUT = ["id", *[f"round({c}, 3) AS {c}" for c in field.LENS.out]]


@query(f"""WITH l AS (SELECT *, sqrt(sensor_w*sensor_w + sensor_h*sensor_h) AS d, focal*focal/(aperture*coc) AS g, focus*1000 AS s FROM {LENS_SQL}), t AS (SELECT *, 2*degrees(atan2(sensor_w/2, focal)) AS a_, 2*degrees(atan2(sensor_h/2, focal)) AS u_, 2*degrees(atan2(d/2, focal)) AS d_ FROM l)
SELECT id, round(a_, 3) AS across, round(u_, 3) AS upward, round(d_, 3) AS diagonal, round(focal*sqrt(1872e0)/d, 3) AS equivalent, round((g + focal)/1000, 3) AS hyperfocal, round(s*g/(g + s - focal)/1000, 3) AS near,
round(CASE WHEN 1 - (s - focal)/g > 1e-9 THEN s*g/(g - s + focal)/1000 END, 3) AS far, round(focus*sensor_w/focal, 3) AS width FROM t""")
def lens_geometry(spark, sf_dir):
    p = "p_partkey"
    rows = table(spark, sf_dir, "part").selectExpr(f"{p} AS id", f"36e0 - {p}%3*8 AS sensor_w", f"24e0 - {p}%3*5 AS sensor_h", f"12e0 + {p}%390 AS focal", f"1.4e0 + {p}%20 AS aperture", "0.03e0 AS coc", f"1e0 + {p}%500 AS focus")
    return field.LENS.on(rows).selectExpr(*LENS_OUT)


EXPOSURE_SQL = "(SELECT p_partkey AS id, 1e0/(p_partkey%250 + 1) AS shutter, p_partkey%17 + 0e0 AS stops, 5e0 + p_partkey%30 AS clip, 24e0 AS fps, p_partkey%60 + 1e0 AS every, 25e0 AS mb FROM part)"
EXPOSURE_OUT = ["id", "round(long, 5) AS long_s", "cast(photos as bigint) AS photos", "shoot", "storage", "speed", "label"]


@query(f"""WITH e AS (SELECT *, shutter*(1 << stops::INT) AS long_, ceil(clip*fps)::BIGINT AS photos FROM {EXPOSURE_SQL}), w AS (SELECT *, floor(long_ + 0.5)::BIGINT AS n FROM e)
SELECT id, round(long_, 5) AS long_s, photos, photos*every AS shoot, photos*mb AS storage, fps*every AS speed, CASE WHEN long_ < 1 THEN '1/' || floor(1/long_ + 0.5)::BIGINT || ' s' WHEN n < 60 THEN n || ' s' WHEN n < 3600 THEN n//60 || ' min' || CASE WHEN n%60 > 0 THEN ' ' || n%60 || ' s' ELSE '' END
ELSE n//3600 || ' h ' || lpad((n%3600//60)::VARCHAR, 2, '0') || ' min' END AS label FROM w""")
def exposure_plan(spark, sf_dir):
    p = "p_partkey"
    rows = table(spark, sf_dir, "part").selectExpr(f"{p} AS id", f"1e0/({p}%250 + 1) AS shutter", f"{p}%17 + 0e0 AS stops", f"5e0 + {p}%30 AS clip", "24e0 AS fps", f"{p}%60 + 1e0 AS every", "25e0 AS mb")
    return field.EXPOSURE.on(rows).selectExpr(*EXPOSURE_OUT)


FRAME_SQL = "(SELECT p_partkey AS id, p_partkey*7%360 + 0e0 AS az, p_partkey*11%90 + 0e0 AS alt, p_partkey*13%360 + 0e0 AS aim, p_partkey%30 - 10e0 AS tilt FROM part)"
FRAME_OUT = ["id", "offset_across", "offset_up", "ahead"]


@query(f"SELECT {', '.join(FRAME_OUT)} FROM {field.FRAME.sql(FRAME_SQL)}")
def frame_offsets(spark, sf_dir):
    p = "p_partkey"
    rows = table(spark, sf_dir, "part").selectExpr(f"{p} AS id", f"{p}*7%360 + 0e0 AS az", f"{p}*11%90 + 0e0 AS alt", f"{p}*13%360 + 0e0 AS aim", f"{p}%30 - 10e0 AS tilt")
    return field.FRAME.on(rows).selectExpr(*FRAME_OUT)


def heights(spark, sf_dir):
    """(row, col, height) of a 256 by 256 field from line items."""
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 256).alias("row"), (F.col("l_partkey") % 256).alias("col")).agg(F.max(F.col("l_quantity") * 10).alias("height"))


H_SQL = "h AS (SELECT l_orderkey%256 AS \"row\", l_partkey%256 AS col, max(l_quantity*10) AS height FROM lineitem GROUP BY ALL)"


@query(f"""WITH {H_SQL} SELECT bearing, round(max(degrees(atan2(height - pow(30*sqrt(pow(col-128, 2)+pow("row"-128, 2)), 2)/(2*7/6e0*6371008.8) - 20, 30*sqrt(pow(col-128, 2)+pow("row"-128, 2))))), 6) AS angle
FROM (SELECT *, floor((degrees(atan2(col-128, 128-"row")) + 360)/5)::BIGINT%72 AS bearing FROM h WHERE NOT (col = 128 AND "row" = 128)) GROUP BY bearing""")
def terrain_horizon(spark, sf_dir):
    """The highest angle in each of 72 bearings round the middle of the field."""
    away = F.sqrt(F.pow(F.col("col") - 128, F.lit(2)) + F.pow(F.col("row") - 128, F.lit(2)))
    rows = heights(spark, sf_dir).where("NOT (col = 128 AND row = 128)").withColumn("bearing", F.floor((F.degrees(F.atan2(F.col("col") - 128, 128 - F.col("row"))) + 360) / 5) % 72)
    return places.horizon(rows, [], F.lit(20.0), F.col("height"), 30 * away).select("bearing", F.round("angle", 6).alias("angle"))


@query(f"""WITH {H_SQL}, s AS (SELECT "row" AS line, 30e0*col AS sec, height FROM h WHERE col BETWEEN 1 AND 254),
c AS (SELECT line, 600 + (200 - 600)*sec/7650 - height - sec*(7650 - sec)/(2*7/6e0*6371008.8) AS c, sec FROM s)
SELECT line, round(min(c), 6) AS clearance, arg_min(sec, c) AS "at", min(c) >= 0 AS visible FROM c GROUP BY line""")
def line_of_sight(spark, sf_dir):
    rows = heights(spark, sf_dir).where("col BETWEEN 1 AND 254").withColumn("line", F.col("row"))
    found = places.sight_line(rows, ["line"], F.col("col") * 30.0, F.col("height"), F.lit(600.0), F.lit(200.0), F.lit(7650.0))
    return found.select("line", F.round("clearance", 6).alias("clearance"), "at", "visible")


@query(f"""WITH {H_SQL} SELECT "row"//4 AS "row", col//4 AS col, max(height) AS height FROM h GROUP BY ALL""")
def block_max(spark, sf_dir):
    return places.block_max(heights(spark, sf_dir), [], 4)


@query(f"""WITH {H_SQL}, p AS (SELECT c_custkey AS id, c_custkey*7%250 + 0.25e0 AS r, c_custkey*13%250 + 0.5e0 AS c FROM customer),
k AS (SELECT id, (0.75e0*0.5*a.height + 0.75e0*0.5*b.height + 0.25e0*0.5*d.height + 0.25e0*0.5*e.height) AS height FROM p LEFT JOIN h a ON a."row" = floor(r) AND a.col = floor(c) LEFT JOIN h b ON b."row" = floor(r) AND b.col = floor(c)+1
LEFT JOIN h d ON d."row" = floor(r)+1 AND d.col = floor(c) LEFT JOIN h e ON e."row" = floor(r)+1 AND e.col = floor(c)+1) SELECT id, round(height, 6) AS height FROM k""")
def bilinear_height(spark, sf_dir):
    at = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey*7%250 + 0.25e0 AS row", "c_custkey*13%250 + 0.5e0 AS col")
    return places.bilinear(at, heights(spark, sf_dir)).select("id", F.round("height", 6).alias("height"))


@query("""WITH a AS (SELECT p_partkey%360 AS bin, max(p_size)*1e0 AS v FROM part WHERE p_partkey%2 = 0 GROUP BY 1), b AS (SELECT p_partkey%360 AS bin, max(p_retailprice)/50 AS w FROM part WHERE p_partkey%3 = 0 GROUP BY 1)
SELECT coalesce(a.bin, b.bin) AS bin, round(greatest(v, w), 6) AS v FROM a FULL JOIN b ON a.bin = b.bin""")
def profile_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("bin", F.col("p_partkey") % 360)
    a = part.where("p_partkey % 2 = 0").groupBy("bin").agg((F.max("p_size") * 1.0).alias("v"))
    b = part.where("p_partkey % 3 = 0").groupBy("bin").agg((F.max("p_retailprice") / 50).alias("v"))
    return places.merge_profiles(a, b, [], "v").select("bin", F.round("v", 6).alias("v"))


def edges(spark, sf_dir):
    """(spot, ax, ay, bx, by, height): walls of square buildings round each supplier."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    x, y = (p * 37 % 1600 - 800 + 0.5), (F.col("l_orderkey") * 53 % 1600 - 800 + 0.25)
    rows = table(spark, sf_dir, "lineitem").select(s.alias("spot"), x.alias("x"), y.alias("y"), (F.col("l_quantity") + 3).alias("height")).where("abs(x) > 12 OR abs(y) > 12")
    wall = lambda a, b, c, d: F.struct((F.col("x") + a).alias("ax"), (F.col("y") + b).alias("ay"), (F.col("x") + c).alias("bx"), (F.col("y") + d).alias("by"))
    walls = F.array(wall(-8, -8, 8, -8), wall(8, -8, 8, 8), wall(8, 8, -8, 8), wall(-8, 8, -8, -8))
    return rows.select("spot", "height", F.explode(walls).alias("w")).select("spot", "height", "w.*")


EDGE_SQL = """b AS (SELECT l_suppkey AS spot, l_partkey*37%1600 - 800 + 0.5e0 AS x, l_orderkey*53%1600 - 800 + 0.25e0 AS y, l_quantity + 3 AS height FROM lineitem),
e AS (SELECT spot, height, x+k[1] AS ax, y+k[2] AS ay, x+k[3] AS bx, y+k[4] AS by_ FROM b, (VALUES ([-8,-8,8,-8]), ([8,-8,8,8]), ([8,8,-8,8]), ([-8,8,-8,-8])) v(k) WHERE abs(x) > 12 OR abs(y) > 12),
r AS (SELECT e.*, bin, sin(radians(bin*2e0)) AS ux, cos(radians(bin*2e0)) AS uy FROM e, range(180) q(bin)),
m AS (SELECT spot, bin, height, (ax*(by_-ay) - ay*(bx-ax))/(ux*(by_-ay) - uy*(bx-ax)) AS t, (ax*uy - ay*ux)/(ux*(by_-ay) - uy*(bx-ax)) AS k FROM r WHERE abs(ux*(by_-ay) - uy*(bx-ax)) >= 1e-12)"""


@query(f"WITH {EDGE_SQL} SELECT spot, bin, round(max(degrees(atan2(height, t))), 6) AS altitude FROM m WHERE t > 0 AND t <= 900 AND k BETWEEN 0 AND 1 GROUP BY ALL")
def skyline(spark, sf_dir):
    """The highest building angle in each of 180 bearings round each supplier; the SQL tries every ray on every wall."""
    found = terrain.skyline(edges(spark, sf_dir), ["spot"], 2.0, 900.0)
    return found.select("spot", F.col("bin").cast("long").alias("bin"), F.round("altitude", 6).alias("altitude"))


@query(f"""WITH {H_SQL}, s AS (SELECT a."row", a.col, bool_or(b.height - pow(30e0*(b.col-a.col), 2)/(2*7/6e0*6371008.8) > a.height + 30e0*(b.col-a.col)*tan(radians(12e0))) AS shaded FROM h a LEFT JOIN h b ON a."row" = b."row" AND b.col > a.col GROUP BY ALL)
SELECT "row", col, coalesce(shaded, FALSE) AS shaded FROM s""")
def terrain_shadow(spark, sf_dir):
    """Shadows of a low sun due east: each row of the field is one line."""
    return terrain.shadow_mask(heights(spark, sf_dir), 90.0, 12.0, 30.0)


_SLANT = math.sin(math.radians(200.0)) / -math.cos(math.radians(200.0))


_AWAY = f'30e0*(b."row" - a."row")/{math.cos(math.radians(20.0))!r}'


@query(f"""WITH {H_SQL}, l AS (SELECT *, floor(col - "row"*({_SLANT!r}) + 0.5) AS line FROM h),
s AS (SELECT a."row", a.col, bool_or(b.height - pow({_AWAY}, 2)/(2*7/6e0*6371008.8) > a.height + {_AWAY}*tan(radians(9e0))) AS shaded FROM l a LEFT JOIN l b ON a.line = b.line AND b."row" > a."row" GROUP BY ALL)
SELECT "row", col, coalesce(shaded, FALSE) AS shaded FROM s""")
def terrain_shadow_slanted(spark, sf_dir):
    """Shadows of a sun that stands between the field's axes: lines run across rows and columns."""
    return terrain.shadow_mask(heights(spark, sf_dir), 200.0, 9.0, 30.0)


def _coverage_sql(reach: int, opacity: float) -> str:
    box = f"""(SELECT "row" - dr AS "row", col - dc AS col, avg(v) AS coverage FROM m, range(-{reach}, {reach + 1}) y(dr), range(-{reach}, {reach + 1}) x(dc) GROUP BY ALL)"""
    return f"""SELECT {reach} AS softness, m."row", m.col, coverage, floor(floor({opacity}::DOUBLE*255 + 0.5)*coverage + 0.5)::INT AS alpha FROM m JOIN {box} b ON m."row" = b."row" AND m.col = b.col"""


@query(f"""WITH {H_SQL}, s AS (SELECT a."row", a.col, bool_or(b.height - pow(30e0*(b.col-a.col), 2)/(2*7/6e0*6371008.8) > a.height + 30e0*(b.col-a.col)*tan(radians(12e0))) AS shaded FROM h a LEFT JOIN h b ON a."row" = b."row" AND b.col > a.col GROUP BY ALL),
m AS (SELECT "row", col, coalesce(shaded, FALSE)::INT AS v FROM s) {_coverage_sql(1, 0.42)} UNION ALL {_coverage_sql(3, 0.42)}""")
def mask_coverage(spark, sf_dir):
    """The paint of a terrain shadow's mask at two softnesses: how much of the box round a cell is shaded."""
    mask = terrain.shadow_mask(heights(spark, sf_dir), 90.0, 12.0, 30.0)
    return areas.mask_coverage(mask, [], "shaded", 0.42, [1, 3])


@query(f"""WITH p AS (SELECT l_orderkey%200 AS image, (l_partkey + l_linenumber)%48 AS "row", l_orderkey%64 AS col, max(2126*r + 7152*g + 722*b) AS luma FROM (SELECT *, l_partkey*7%256 AS r, l_suppkey*29%256 AS g, (l_partkey + l_suppkey*3 + l_linenumber*40)%256 AS b FROM lineitem) GROUP BY ALL),
n AS (SELECT image, "row" - dr AS "row", col - dc AS col, avg(luma) AS mean, count(*) AS n FROM p, range(-2, 3) y(dr), range(-2, 3) x(dc) GROUP BY ALL)
SELECT p.image, p."row", p.col, mean, n.n FROM p JOIN n ON p.image = n.image AND p."row" = n."row" AND p.col = n.col""")
def image_blur(spark, sf_dir):
    """The mean luma (in ten thousandths) of the box two pixels round each pixel of each image, over the pixels that are there."""
    luma = F.floor(colour.luma(F.col("r"), F.col("g"), F.col("b")) * 10_000 + 0.5)  # a whole number, so sums are exact
    rows = images(spark, sf_dir).groupBy("image", F.col("y").alias("row"), F.col("x").alias("col")).agg(F.max(luma).alias("luma"))
    return areas.box_means(rows, ["image"], "luma", [2]).select("image", "row", "col", "mean", "n")


@query("""WITH l AS (SELECT p_partkey AS id, least((p_size + 2)/tan(radians(p_partkey%40 + 1e0)), 300 + 1200*least(1, (p_partkey%40 + 1)/20e0)) AS length, radians(p_partkey%4*90 + 213e0) AS away FROM part),
d AS (SELECT id, length, length*sin(away) AS dx, length*cos(away) AS dy FROM l)
SELECT id, round(length, 6) AS length, 6 AS corners, round(64 + 8*(abs(dx) + abs(dy)), 4) AS area, round(least(0, dx), 4) AS west, round(8 + greatest(0, dx), 4) AS east, round(least(0, dy), 4) AS south, round(8 + greatest(0, dy), 4) AS north FROM d""")
def cast_shadow(spark, sf_dir):
    """Shadows of square footprints under a sun that is off their diagonals: corners, area and box.

    The SQL has the area of a square swept along a line in closed form.
    """
    p = F.col("p_partkey")
    corner = lambda x, y: F.array(F.lit(float(x)), F.lit(float(y)))
    rows = table(spark, sf_dir, "part").select(p.alias("id"), F.array(corner(0, 0), corner(8, 0), corner(8, 8), corner(0, 8)).alias("ring"), (F.col("p_size") + 2).cast("double").alias("height"))
    found = terrain.cast_shadows(rows, F.col("id") % 4 * 90.0 + 33, (F.col("id") % 40 + 1).cast("double"))
    side = lambda f, i: F.round(f(F.transform("shadow", lambda q: q[i])), 4)
    return found.select(
        "id", F.round("length", 6).alias("length"), F.size("shadow").alias("corners"), F.round(terrain.ring_area(F.col("shadow")), 4).alias("area"),
        side(F.array_min, 0).alias("west"), side(F.array_max, 0).alias("east"), side(F.array_min, 1).alias("south"), side(F.array_max, 1).alias("north"),
    )


@query()
def sun_alignments(spark, sf_dir):
    """When the sun stands in a given bearing from each supplier over a year, to a sixteenth of a second."""
    s = F.col("s_suppkey")
    spots = table(spark, sf_dir, "supplier").select(s.alias("spot"), (s % 100 - 50.0).alias("lat"), (s * 7 % 360 - 180.0).alias("lon"), (s * 31 % 360).cast("double").alias("bearing"))
    start = 1_772_323_200
    every_spot, spots = spots, timeline.alike(spots, ["spot"])
    tracked = timeline.dealt_out(spots).withColumn("t", F.explode(F.sequence(F.lit(start), F.lit(start + 365 * 86_400), F.lit(240))))
    sampled = sky.SUN.on(tracked).select("spot", "lat", "lon", "bearing", "t", colour.signed_delta(F.col("sun_azimuth"), F.col("bearing")).alias("gap"))
    found = timeline.crossings(sampled, ["spot"], ["t"], "gap", wrap=True)
    brackets = found.select("spot", "lat", "lon", "bearing", (F.col("t") - 240.0).alias("lo"), F.col("t").cast("double").alias("hi"), "rising")
    # the difference from the bearing is taken without a jump inside a bracket
    turned = terrain.refine(brackets.withColumn("goal", F.lit(0.0)), _OffBearing(), "off", F.col("goal"))
    found = sky.SUN.on(turned).select("spot", "rising", F.round("t", 1).alias("t"), F.round("sun_altitude", 4).alias("altitude"))
    return timeline.told_all(found, every_spot, spots, ["spot"])


class _OffBearing(Formula):
    """The sun's signed distance from a bearing."""

    def __init__(self):
        super().__init__([*sky.SUN.groups, {"off": turn("sun_azimuth - bearing + 180") + " - 180"}], ["off"])


SPECTRAL_SQL = f"""a AS (SELECT * FROM {field.AIR.sql(AIR_SQL)}), c AS (SELECT * FROM (VALUES {', '.join(f'({n}::DOUBLE, {x:.6f}::DOUBLE, {y:.6f}::DOUBLE, {z:.6f}::DOUBLE, {o:.6f}::DOUBLE)' for n, x, y, z, o in spectrum.BANDS)}) v(nm, x, y, z, o)),
p AS (SELECT *, 2*{spectrum.PLANCK}*{spectrum.LIGHT}*{spectrum.LIGHT}/(pow(nm*1e-9, 5)*(exp({spectrum.PLANCK}*{spectrum.LIGHT}/(nm*1e-9*{spectrum.BOLTZMANN}*5772e0)) - 1)) AS pw, 0.008569e0*pow(nm/1000, -4)*(1 + 0.0113e0*pow(nm/1000, -2) + 0.00013e0*pow(nm/1000, -4)) AS ray FROM c),
t AS (SELECT id, x, y, z, pw, coalesce(pw*exp(-(ray*pressure_ratio + beta*pow(nm/1000, -alpha) + o*0.3e0)*air_mass*pressure_ratio), 0) AS beam FROM a, p),
s AS (SELECT id, sum(beam*x) AS bx, sum(beam*y) AS by_, sum(beam*z) AS bz, sum(pw*y) AS tot FROM t GROUP BY id),
k AS (SELECT id, CASE WHEN bx+by_+bz > 0 THEN bx/(bx+by_+bz) END AS sx, CASE WHEN bx+by_+bz > 0 THEN by_/(bx+by_+bz) END AS sy, 133100e0*by_/tot AS lux FROM s),
n AS (SELECT *, (sx - 0.332e0)/(0.1858e0 - sy) AS n FROM k)"""


def air_rows(spark, sf_dir):
    e = "event_id"
    rows = table(spark, sf_dir, "events").selectExpr(f"{e} AS id", f"{e}%100 - 5e0 AS altitude", f"{e}%3000 + 0e0 AS elevation", f"CASE WHEN {e}%7 = 0 THEN NULL ELSE {e}%40 - 10e0 END AS dew", f"CASE WHEN {e}%3 = 0 THEN NULL ELSE {e}%50/100e0 END AS aod", f"CASE WHEN {e}%4 = 0 THEN NULL ELSE {e}%11/10e0 END AS sea")
    return field.AIR.on(rows)


@query(f"WITH {SPECTRAL_SQL} SELECT id, round(coalesce(sx, 0.3333), 5) AS sun_x, round(coalesce(sy, 0.3333), 5) AS sun_y, round(coalesce(437*n*n*n + 3601*n*n + 6861*n + 5517, 0), 1) AS sun_cct, round(lux, 2) AS lux FROM n")
def spectral_light(spark, sf_dir):
    """Colour, colour temperature and light of the direct sun from 41 bands."""
    made = spectrum.spectral(F.col("air_mass"), F.col("pressure_ratio"), F.col("alpha"), F.col("beta"))
    rows = air_rows(spark, sf_dir).select("id", made.alias("s"))
    return rows.select("id", F.round("s.sun_x", 5).alias("sun_x"), F.round("s.sun_y", 5).alias("sun_y"), F.round("s.sun_cct", 1).alias("sun_cct"), F.round("s.lux", 2).alias("lux"))


CLEAR_OUT = ["id", *[f"round({c}, 3) AS {c}" for c in spectrum.CLEAR_SKY.out]]


@query(f"SELECT {', '.join(CLEAR_OUT)} FROM {spectrum.CLEAR_SKY.sql('(SELECT * FROM ' + field.AIR.sql(AIR_SQL) + ')')}")
def clear_sky(spark, sf_dir):
    return spectrum.CLEAR_SKY.on(air_rows(spark, sf_dir)).selectExpr(*CLEAR_OUT)


TRAIL_SQL = "(SELECT p_partkey AS id, 36e0 - p_partkey%3*8 AS sensor_w, 24e0 - p_partkey%3*5 AS sensor_h, 12e0 + p_partkey%50 AS megapixels, 12e0 + p_partkey%390 AS focal, p_partkey%181 - 90e0 AS declination, p_partkey%600 + 0e0 AS seconds FROM part)"
TRAIL_OUT = ["id", *[f"round({c}, 5) AS {c}" for c in spectrum.TRAILS.out]]


@query(f"""WITH t AS (SELECT *, sqrt(sensor_w*sensor_h/(megapixels*1e6)) AS p, CASE WHEN abs(declination) = 90 THEN 0 ELSE cos(radians(declination))*360/86164.0905e0 END AS r FROM {TRAIL_SQL})
SELECT id, round(p, 5) AS pitch, round(CASE WHEN r*seconds < 90 THEN focal/p*tan(radians(r*seconds)) END, 5) AS trail, round(CASE WHEN r > 0 THEN degrees(atan2(p, focal))/r END, 5) AS sharp, round(CASE WHEN r > 0 THEN degrees(atan2(3*p, focal))/r END, 5) AS tolerable, round(r*3600, 5) AS drift FROM t""")
def star_trails(spark, sf_dir):
    p = "p_partkey"
    rows = table(spark, sf_dir, "part").selectExpr(f"{p} AS id", f"36e0 - {p}%3*8 AS sensor_w", f"24e0 - {p}%3*5 AS sensor_h", f"12e0 + {p}%50 AS megapixels", f"12e0 + {p}%390 AS focal", f"{p}%181 - 90e0 AS declination", f"{p}%600 + 0e0 AS seconds")
    return spectrum.TRAILS.on(rows).selectExpr(*TRAIL_OUT)


BAND_OUT = ["id", "round(r_lo, 1) AS low_rise", "round(s_lo, 1) AS low_set", "round(r_hi, 1) AS high_rise", "round(s_hi, 1) AS high_set", "kind"]


@query(f"SELECT {', '.join(BAND_OUT)} FROM {sky.GOLDEN.sql(TIMES_SQL)}")
def golden_hours(spark, sf_dir):
    """Where golden light begins and ends, morning and evening, with the polar cases named."""
    return sky.GOLDEN.on(instants(spark, sf_dir)).selectExpr(*BAND_OUT)


@query("""WITH s AS (SELECT c_custkey%50 AS spot, c_custkey AS visit, (c_custkey*37%900)/10e0 AS altitude, c_custkey*13%360 AS azimuth FROM customer), p AS (SELECT s_suppkey AS id, s_suppkey%50 AS spot, (s_suppkey*53%900)/10e0 AS altitude, s_suppkey*29%360 AS azimuth FROM supplier)
SELECT id, visit, round(abs(s.altitude - p.altitude), 6) AS off, least(abs(s.azimuth - p.azimuth), 360 - abs(s.azimuth - p.azimuth))::DOUBLE AS round_ FROM p JOIN s USING (spot) QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(s.altitude - p.altitude), visit) = 1""")
def closest_visit(spark, sf_dir):
    """The visit of the same spot whose sun stood nearest to a given altitude, and how far round it was."""
    visits = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("spot"), F.col("c_custkey").alias("visit"), (F.col("c_custkey") * 37 % 900 / 10.0).alias("altitude"), (F.col("c_custkey") * 13 % 360).cast("double").alias("azimuth"))
    probes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 50).alias("spot"), (F.col("s_suppkey") * 53 % 900 / 10.0).alias("altitude"), (F.col("s_suppkey") * 29 % 360).cast("double").alias("aim"))
    found = timeline.nearest_value(probes, visits, ["spot"], "altitude", "visit", ["visit", "azimuth"]).where("visit IS NOT NULL")
    return found.select("id", "visit", F.round("off", 6).alias("off"), colour.circular_distance(F.col("azimuth"), F.col("aim")).alias("round_"))


@query(f"""WITH p AS ({TOWN}), n AS (SELECT id, lat, lon FROM p WHERE id%3 = 0), o AS (SELECT id, lat, lon FROM p WHERE id%3 <> 0),
d AS (SELECT o.id, n.id AS spot, sqrt(pow(radians(n.lat-o.lat), 2) + pow(radians(n.lon-o.lon)*cos(radians((o.lat+n.lat)/2)), 2))*6371000e0 AS m FROM o JOIN n ON abs(o.lat-n.lat) < 0.01),
b AS (SELECT id, min(spot) AS spot FROM d WHERE m <= 50 GROUP BY id) SELECT o.id, coalesce(b.spot, o.id) AS spot, b.spot IS NULL AS fresh FROM o LEFT JOIN b ON o.id = b.id""")
def spot_upsert(spark, sf_dir):
    """New places matched to the first saved spot within 50 m, or kept as new ones."""
    rows = town(spark, sf_dir)
    saved, new = rows.where("id % 3 = 0"), rows.where("id % 3 <> 0")
    first = saved.groupBy(F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).agg(F.min("id").alias("__first"))
    near = places.places_within(new, saved, 50.0).join(first, ["b_lat", "b_lon"])
    near = near.groupBy(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")).agg(F.min("__first").alias("spot"))
    return new.join(near, ["lat", "lon"], "left").select("id", F.coalesce("spot", "id").alias("spot"), F.col("spot").isNull().alias("fresh"))
