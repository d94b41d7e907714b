"""Queries over grades, frames, profiles and sentences, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumaframe.functions import wording
from lumaframe.operators import framing, grade, pixels, places, ranking
from lumaframe.sources import sinks

from .archive import GRADE_SQL, HSL_SQL, IMAGE_SQL, hue, images, query, table
from .light import E_SQL, heights, samples

BYTE_SQL = "floor(255*(CASE WHEN {0}^3 <= 0.0031308 THEN {0}^3*12.92 ELSE 1.055*pow({0}^3, 1/2.4::DOUBLE) - 0.055 END) + 0.5)"
CURVE_SQL = f"""{GRADE_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, taps AS (SELECT c.image, row_number() OVER (PARTITION BY c.image ORDER BY c.step) AS k, {BYTE_SQL.format("c.level")} AS x, {BYTE_SQL.format("r.level")} AS y
  FROM pc c JOIN pc r ON c.step = r.step AND r.image = 1 WHERE c.image <> 1 AND c.step IN (1, 3, 6, 10, 14, 17, 19)),
walk AS (SELECT DISTINCT image, 0::BIGINT AS k, 0::DOUBLE AS x, 0::DOUBLE AS y, 0::DOUBLE AS high, true AS kept FROM taps
  UNION ALL SELECT image, k, CASE WHEN ok THEN nx ELSE x END, CASE WHEN ok THEN least(greatest(high, ny), y + 3*(nx - x)) ELSE y END, CASE WHEN ok THEN greatest(high, ny) ELSE high END, ok
  FROM (SELECT w.image, t.k, w.x, w.y, w.high, t.x AS nx, t.y AS ny, t.x > 2 AND t.x - w.x >= 14 AND t.x <= 241 AS ok FROM walk w JOIN taps t ON t.image = w.image AND t.k = w.k + 1)),
points AS (SELECT image, x, y FROM walk WHERE kept UNION ALL SELECT DISTINCT image, 255, 255 FROM taps)"""


def curves(spark, sf_dir):
    """(image, points) of the tone curve from each image to the first."""
    looks = ranking.looks(pixels.with_lab(images(spark, sf_dir)), "image").select(F.col("id").alias("image"), "curve")
    told = looks.where("image = 1").select(F.col("curve").alias("told"))
    return looks.where("image <> 1").join(F.broadcast(told)).select("image", grade.tone_curve(F.col("curve"), F.col("told")).alias("points"))


@query(f"{CURVE_SQL} SELECT image, row_number() OVER (PARTITION BY image ORDER BY x) - 1 AS pos, x, y FROM points")
def tone_curves(spark, sf_dir):
    """The points of each image's tone curve to the first image."""
    return curves(spark, sf_dir).select("image", F.posexplode("points").alias("pos", "p")).select("image", F.col("pos").cast("long").alias("pos"), "p.x", "p.y")


@query(f"""{CURVE_SQL}, q AS (SELECT image, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM points WINDOW w AS (PARTITION BY image ORDER BY x)),
v AS (SELECT image, pt, y + (ny - y)*(pt - x)/(nx - x) AS v FROM q, (VALUES (16), (56), (76), (180), (200), (240)) s(pt) WHERE pt > x AND pt <= nx), p AS (PIVOT v ON pt IN (16, 56, 76, 180, 200, 240) USING any_value(v) GROUP BY image)
SELECT image, floor((("180" - "76")/104 - 1)*100 + 0.5) AS contrast, floor(("200" - 200)/2.55::DOUBLE*1.6::DOUBLE + 0.5) AS highlights, floor(("56" - 56)/2.55::DOUBLE*1.6::DOUBLE + 0.5) AS shadows, floor(("240" - 240)/2.55::DOUBLE*1.6::DOUBLE + 0.5) AS whites, floor(("16" - 16)/2.55::DOUBLE*1.6::DOUBLE + 0.5) AS blacks FROM p""")
def curve_sliders(spark, sf_dir):
    """What each tone curve amounts to on five sliders."""
    return curves(spark, sf_dir).select("image", *[v.alias(n) for n, v in grade.curve_words(F.col("points")).items()])


MIX_SQL = f"""{IMAGE_SQL}, b0 AS (SELECT *, {HSL_SQL} AS band FROM lab WHERE C >= 0.02), b1 AS (SELECT image, band, avg(C) AS c, avg(L) AS l, {hue('avg(a)', 'avg(b_)')} AS h, count(*)/sum(count(*)) OVER (PARTITION BY image) AS s FROM b0 GROUP BY image, band),
j AS (SELECT m.image, m.band, m.s, coalesce(r.s >= 0.02, false) AS known, CASE WHEN m.c > 1e-5 THEN r.c/m.c ELSE 1 END AS ratio, r.l - m.l AS dl, r.h - m.h - 360*floor((r.h - m.h)/360) AS dh FROM b1 m LEFT JOIN b1 r ON r.image = 1 AND r.band = m.band WHERE m.image <> 1 AND m.s >= 0.02)"""


@query(f"""{MIX_SQL}, k AS (SELECT * FROM (VALUES ('faithful', 1.0::DOUBLE, 100, 100, 100), ('restrained', 0.62::DOUBLE, 32, 26, 20)) x(kind, damp, ms, ml, mh))
SELECT kind, image, band, round(greatest(-ms, least(ms, damp*CASE WHEN known THEN (ratio - 1)*100 ELSE -60*least(1, s/0.25::DOUBLE) END)), 3) AS sat,
round(greatest(-ml, least(ml, CASE WHEN known THEN damp*dl*320 ELSE 0 END)), 3) AS lum, round(greatest(-mh, least(mh, CASE WHEN known THEN damp*(CASE WHEN dh > 180 THEN dh - 360 ELSE dh END)/22*100 ELSE 0 END)), 3) AS hue FROM j, k""")
def colour_mixer(spark, sf_dir):
    """Both strengths of the move of each colour band to the first image's."""
    bands = pixels.bands(pixels.with_lab(images(spark, sf_dir)), ["image"])
    kind = lambda name, r: grade.mixer(bands, "image", 1, r).select(F.lit(name).alias("kind"), "image", "band", *[F.round(c, 3).alias(c) for c in ("sat", "lum", "hue")])
    return kind("faithful", False).union(kind("restrained", True))


@query(f"""{GRADE_SQL}, d AS (SELECT c.image, c.zone, ra - c.a AS da, rb - c.b AS db, sqrt((ra - c.a)^2 + (rb - c.b)^2) AS far FROM zc c JOIN rf USING (zone) WHERE c.image <> 1),
s AS (SELECT *, CASE WHEN far < 0.004 THEN 0 ELSE least(100, far/0.06::DOUBLE*100) END AS sat FROM d)
SELECT image, zone, round(CASE WHEN far > 0 THEN da*least(1, sat/100*0.06::DOUBLE/far) ELSE 0 END, 4) AS da, round(CASE WHEN far > 0 THEN db*least(1, sat/100*0.06::DOUBLE/far) ELSE 0 END, 4) AS db, round(sat, 2) AS sat FROM s""")
def zone_tints(spark, sf_dir):
    """The tint that each tonal zone takes from the first image's."""
    own = pixels.zones(pixels.with_lab(images(spark, sf_dir))).where("w > 0")
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    found = grade.zone_tints(own.groupBy("image", "zone").agg(mean("a").alias("a"), mean("b_").alias("b")), "image", 1)
    return found.select("image", "zone", F.round("da", 4).alias("da"), F.round("db", 4).alias("db"), F.round("sat", 2).alias("sat"))


@query("""SELECT p_partkey AS id, round(greatest(0, least(1, 1 - (abs(p_size - 25)/500.0::DOUBLE/0.1::DOUBLE + sqrt((p_partkey%7/100.0::DOUBLE)^2 + (p_partkey%5/100.0::DOUBLE)^2)/0.06::DOUBLE)/2)), 6) AS reach,
round(greatest(0, least(1, least(1, CASE p_partkey%4 WHEN 0 THEN 1 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.55 END)*(0.65 + 0.35*least(1, p_size%9/6.0::DOUBLE))*CASE WHEN p_size%2 = 0 THEN 1 ELSE 0.9 END)), 6) AS confidence,
concat_ws(',', CASE WHEN abs(p_partkey%201 - 100) >= 85 THEN 'Saturation' END, CASE WHEN abs(p_partkey*7%201 - 100) >= 85 THEN 'Temp' END, CASE WHEN p_partkey*3%101 >= 80 THEN 'Colour Grading Global' END) AS extremes FROM part""")
def grade_scores(spark, sf_dir):
    """How far a grade got, how far to trust it, and which controls it pins."""
    k, s, zero = F.col("p_partkey"), F.col("p_size"), F.lit(0.0)
    kinds = F.element_at(F.array(*[F.lit(x) for x in grade.FIDELITY]), (k % 4 + 1).cast("int"))
    pinned = grade.extremes([("Saturation", k % 201 - 100, 85), ("Temp", k * 7 % 201 - 100, 85), ("Colour Grading Global", k * 3 % 101, 80)])
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.round(grade.reachability(s / 500, k % 7 / 100, k % 5 / 100, F.lit(0.05), zero, zero), 6).alias("reach"),
        F.round(grade.confidence(F.lit("export"), kinds, s % 9, s % 2 == 0), 6).alias("confidence"), F.array_join(pinned, ",").alias("extremes"),
    )


TARGET = ["p_partkey AS id", "p_partkey*7%360 + 0e0 AS az", "p_partkey*11%80 + 0e0 AS alt", "(p_partkey*7 + p_size*3 - 75)%360 + 0e0 AS aim", "p_partkey*11%80 + p_size%20 - 10e0 AS tilt", "60e0 + p_size%30 AS across", "40e0 + p_size%20 AS upward"]
REGION_SQL = f"""WITH t AS (SELECT {', '.join(TARGET)} FROM part), k AS (SELECT t.*, radians(k*10e0) AS turn, k FROM t, range(37) r(k)),
h AS (SELECT *, CASE WHEN k = 36 THEN radians(alt) ELSE asin(sin(radians(alt))*cos(radians(10)) + cos(radians(alt))*sin(radians(10))*cos(turn)) END AS high FROM k),
z AS (SELECT *, CASE WHEN k = 36 THEN radians(az - aim) ELSE radians(az - aim) + atan2(sin(turn)*sin(radians(10))*cos(radians(alt)), cos(radians(10)) - sin(radians(alt))*sin(high)) END AS side, radians(tilt) AS lean FROM h),
f AS (SELECT *, cos(high)*sin(side) AS rt, cos(lean)*cos(high)*cos(side) + sin(lean)*sin(high) AS ah, cos(lean)*sin(high) - sin(lean)*cos(high)*cos(side) AS u FROM z),
g AS (SELECT *, floor(degrees(atan2(rt, ah))*1e6 + 0.5)/1e6 AS x, floor(degrees(atan2(u, ah))*1e6 + 0.5)/1e6 AS y FROM f),
a AS (SELECT id, any_value(across) AS across, any_value(upward) AS upward, bool_and(ah > 0) AS ahead, bool_or(ah > 0 AND abs(x) <= across/2 AND abs(y) <= upward/2) AS partly, min(x) FILTER (k < 36) AS w, max(x) FILTER (k < 36) AS e, min(y) FILTER (k < 36) AS s, max(y) FILTER (k < 36) AS n FROM g GROUP BY id),
o AS (SELECT *, greatest(-across/2 - w, e - across/2, -upward/2 - s, n - upward/2) AS over, greatest(-across/2 - e, w - across/2, -upward/2 - n, s - upward/2) AS short FROM a)"""


@query(f"""{REGION_SQL} SELECT id, ahead AND over <= 0 AS whole, partly, round(CASE WHEN ahead THEN (e - w)/across ELSE 0 END, 4) AS span_w, round(CASE WHEN ahead THEN (n - s)/upward ELSE 0 END, 4) AS span_h,
CASE WHEN ahead AND over > 0 THEN floor(over*10 + 0.5)/10 ELSE 0 END AS over, CASE WHEN NOT ahead OR over <= 0 THEN '' WHEN over = -across/2 - w THEN 'left' WHEN over = e - across/2 THEN 'right' WHEN over = -upward/2 - s THEN 'bottom' ELSE 'top' END AS over_edge,
CASE WHEN ahead AND short > 0 THEN floor(short*10 + 0.5)/10 ELSE 0 END AS short, CASE WHEN NOT ahead OR short <= 0 THEN '' WHEN short = -across/2 - e THEN 'left' WHEN short = w - across/2 THEN 'right' WHEN short = -upward/2 - n THEN 'bottom' ELSE 'top' END AS short_edge FROM o""")
def frame_regions(spark, sf_dir):
    """How a region of ten degrees round each target sits in a frame."""
    found = framing.region(table(spark, sf_dir, "part").selectExpr(*TARGET), F.lit(10.0))
    return found.select("id", "whole", "partly", F.round("span_w", 4).alias("span_w"), F.round("span_h", 4).alias("span_h"), "over", "over_edge", "short", "short_edge")


BODY = ["90 + value*1.8e0 AS az", "value*0.6e0 AS alt", "180e0 AS aim", "20e0 AS tilt", "74e0 AS across", "53e0 AS upward"]


@query(f"""WITH {E_SQL}, v AS (SELECT user_id, sec, max(value) AS value FROM e GROUP BY ALL), b AS (SELECT user_id, sec, {', '.join(BODY)} FROM v),
f AS (SELECT *, cos(radians(alt))*sin(radians(az - aim)) AS rt, cos(radians(tilt))*cos(radians(alt))*cos(radians(az - aim)) + sin(radians(tilt))*sin(radians(alt)) AS ah, cos(radians(tilt))*sin(radians(alt)) - sin(radians(tilt))*cos(radians(alt))*cos(radians(az - aim)) AS u FROM b),
g AS (SELECT user_id, sec, CASE WHEN ah > 0 THEN least(across/2 - abs(floor(degrees(atan2(rt, ah))*1e6 + 0.5)/1e6), upward/2 - abs(floor(degrees(atan2(u, ah))*1e6 + 0.5)/1e6)) ELSE -1 END AS v FROM f),
l AS (SELECT *, lag(v) OVER w AS pv, lag(sec) OVER w AS ps, lead(v) OVER w AS nv, lead(sec) OVER w AS ns FROM g WINDOW w AS (PARTITION BY user_id ORDER BY sec)),
s AS (SELECT user_id, coalesce(ps + (sec - ps)*pv/(pv - v), sec) AS s, row_number() OVER (PARTITION BY user_id ORDER BY sec) AS k FROM l WHERE v > 0 AND (pv IS NULL OR pv <= 0)),
t AS (SELECT user_id, coalesce(sec + (ns - sec)*v/(v - nv), sec) AS t, row_number() OVER (PARTITION BY user_id ORDER BY sec) AS k FROM l WHERE v > 0 AND (nv IS NULL OR nv <= 0))
SELECT user_id, round(s, 2) AS "start", round(t, 2) AS "end" FROM s JOIN t USING (user_id, k) WHERE t > s""")
def frame_windows(spark, sf_dir):
    """When the body of each series is inside a frame."""
    rows = samples(spark, sf_dir).groupBy("user_id", "at").agg(F.max("value").alias("value")).selectExpr("user_id", "at", *BODY)
    return framing.frame_windows(rows, ["user_id"], "at").select("user_id", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"))


@query("""WITH s AS (SELECT l_orderkey%256 AS line, (l_partkey%256)*30e0 AS d, max(CASE WHEN l_partkey%17 = 0 THEN NULL ELSE l_quantity*10 END) AS h FROM lineitem GROUP BY 1, 2),
p AS (SELECT line, d, h + d*(7650 - d)/(2*7/6e0*6371008.8) AS g, 600 - 400*d/7650 AS l FROM s),
r AS (SELECT line, min(least(g, CASE WHEN g IS NOT NULL THEN l END)) AS a, max(greatest(g, CASE WHEN g IS NOT NULL THEN l END)) AS z FROM p GROUP BY 1),
b AS (SELECT line, CASE WHEN z - a < 1 THEN (z + a)/2 - 0.5 ELSE a END AS a, CASE WHEN z - a < 1 THEN (z + a)/2 + 0.5 ELSE z END AS z FROM r WHERE a IS NOT NULL),
e AS (SELECT line, a - (z - a)*0.08::DOUBLE AS bottom, z + (z - a)*0.08::DOUBLE AS top FROM b),
t AS (SELECT line, d, g, top, bottom, printf('%.2f', floor(d/7650*600*100 + 0.5)/100) AS x, printf('%.2f', floor((160 - (g - bottom)/(top - bottom)*160)*100 + 0.5)/100) AS yg, printf('%.2f', floor((160 - (l - bottom)/(top - bottom)*160)*100 + 0.5)/100) AS yl FROM p JOIN e USING (line))
SELECT line, 'M' || string_agg(x || ' ' || yg, 'L' ORDER BY d) FILTER (g IS NOT NULL) || 'L' || arg_max(x, d) FILTER (g IS NOT NULL) || ' 160L' || arg_min(x, d) FILTER (g IS NOT NULL) || ' 160Z' AS terrain,
'M' || arg_min(x || ' ' || yl, d) || 'L' || arg_max(x || ' ' || yl, d) AS sight, round(any_value(top), 3) AS top, round(any_value(bottom), 3) AS bottom FROM t GROUP BY line""")
def profile_paths(spark, sf_dir):
    """Each line of a height field drawn as a chart with a sight line; some heights are unknown."""
    d = (F.col("l_partkey") % 256) * 30.0
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 256).alias("line"), d.alias("d")).agg(F.max(F.when(F.col("l_partkey") % 17 != 0, F.col("l_quantity") * 10)).alias("h"))
    rows = rows.select("line", "d", (F.col("h") + F.col("d") * (7650 - F.col("d")) / (2 * 7 / 6 * 6371008.8)).alias("g"), (600 - 400 * F.col("d") / 7650).alias("l"))
    found = places.profile_path(rows, ["line"], "d", "g", "l", F.lit(7650.0), 600, 160)
    return found.select("line", "terrain", "sight", F.round("top", 3).alias("top"), F.round("bottom", 3).alias("bottom"))


def _duration_sql(m: str) -> str:
    return f"(CASE WHEN {m} < 60 THEN {m} || ' m' WHEN {m}%60 = 0 THEN {m}//60 || ' h' ELSE {m}//60 || ' h ' || {m}%60 || ' m' END)"


CLOCK_SQL = "printf('%02d:%02d', ({0})//60, ({0})%60)"
_listed = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
RATIO_SQL = "1/tan(radians(p_partkey%90))"


@query(f"""SELECT p_partkey AS id, {_duration_sql('(p_partkey*7%900)')} AS lasts, CASE WHEN p_partkey%90 = 0 THEN '—' WHEN p_partkey%10 = 3 THEN '—' ELSE '1 : ' || CASE WHEN {RATIO_SQL} < 10 THEN printf('%.2f', floor({RATIO_SQL}*100 + 0.5)/100) ELSE printf('%.1f', floor({RATIO_SQL}*10 + 0.5)/10) END END AS shadow,
{CLOCK_SQL.format('p_partkey*15%1440')} AS col, (10 + p_size) || 'mm' || CASE WHEN p_partkey%2 = 0 THEN '' ELSE ' (' || floor((10 + p_size)*1.5::DOUBLE + 0.5)::BIGINT || 'mm equiv.)' END || ' · ' || p_partkey%90 || '° × ' || p_partkey%60 || '°' AS lens,
CASE p_partkey%3 WHEN 0 THEN 23.5 WHEN 1 THEN 35.9 END::DOUBLE AS sensor_w, (10 + p_size) || ' mm' || CASE WHEN p_size%3 = 0 THEN ' · portrait' ELSE '' END || ' · ' || p_partkey%360 || '°' || CASE WHEN p_partkey%9 = 4 THEN '' WHEN p_partkey%9 > 4 THEN ' · +' || (p_partkey%9 - 4) || '° tilt' ELSE ' · ' || (p_partkey%9 - 4) || '° tilt' END AS frame,
CASE WHEN p_size <= 25 THEN 'No direct sun — everything here is skylight.' ELSE floor((2000 + p_partkey%4000)/50 + 0.5)::BIGINT*50 || ' K · ' || CASE WHEN p_partkey%60 >= 45 THEN 'hard' WHEN p_partkey%60 >= 30 THEN 'firm' WHEN p_partkey%60 >= 18 THEN 'soft' ELSE 'flat' END || ', ' || p_partkey%60//10 || '.' || p_partkey%10 || ' stops key to fill' END AS light,
coalesce({_listed(wording.SEEING)}[p_size%10] || ' seeing', '') || ', ' || coalesce({_listed(wording.TRANSPARENCY)}[p_partkey%10] || ' mag/airmass transparency', '') || ' (7Timer, ~10 km grid).' AS seeing FROM part""")
def labels(spark, sf_dir):
    """Labels of durations, shadows, columns, lenses, frames, light and seeing."""
    k, s = F.col("p_partkey"), F.col("p_size")
    focal, ff = 10 + s, F.when(k % 2 == 0, "ff").otherwise("apsc")
    altitude = F.when((k % 10 != 3) & (k % 90 != 0), k % 90)
    return table(spark, sf_dir, "part").select(
        k.alias("id"), wording.duration(k * 7 % 900).alias("lasts"), wording.shadow_ratio(altitude).alias("shadow"), wording.column_label(k * 15).alias("col"),
        wording.lens_label(ff, focal, focal * 1.5, k % 90, k % 60).alias("lens"), wording.sensor(F.when(k % 3 == 0, "apsc").when(k % 3 == 1, "ff").otherwise("none"), 1).alias("sensor_w"),
        wording.frame_label(focal, s % 3 == 0, k % 360, k % 9 - 4).alias("frame"), wording.light_label(s * 2, 2000 + k % 4000, k % 60 / 10).alias("light"), wording.seeing_label(s % 10, k % 10).alias("seeing"),
    )


# places have from one window to some dozen, as the divisor makes places of one order or of several
PLACE = "o_orderkey//(1 + o_custkey%5)"
WINDOW_SQL = f"SELECT {PLACE} AS id, o_orderkey*37%1380 AS s, o_orderkey*37%1380 + 5 + o_orderkey%50 AS t, o_orderkey AS o, row_number() OVER (PARTITION BY {PLACE} ORDER BY o_orderkey*37%1380, o_orderkey) AS k FROM orders"


@query(f"""WITH w AS ({WINDOW_SQL}), c AS (SELECT c_custkey AS id FROM customer UNION SELECT id FROM w), a AS (SELECT id, count(*) AS n, sum(t - s)::BIGINT AS total, min(s) AS first_, arg_max(t, k) AS last_, list({CLOCK_SQL.format('s')} || '–' || {CLOCK_SQL.format('t')} ORDER BY k) AS spans FROM w GROUP BY id)
SELECT c.id, CASE WHEN n IS NULL THEN 'No direct sun here today.' WHEN n > 3 THEN 'Sun in ' || n || ' spells, ' || {_duration_sql('total')} || ' in all — first ' || {CLOCK_SQL.format('first_')} || ', last ends ' || {CLOCK_SQL.format('last_')} || '.'
ELSE 'Direct sun ' || CASE WHEN n = 1 THEN spans[1] WHEN n = 2 THEN spans[1] || ' and ' || spans[2] ELSE spans[1] || ', ' || spans[2] || ' and ' || spans[3] END || ' · ' || {_duration_sql('total')} || ' in all.' END AS sentence FROM c LEFT JOIN a ON a.id = c.id""")
def sun_sentences(spark, sf_dir):
    """One sentence about the sunlit windows of each place: all orders are windows, and customers without any have none."""
    o, start = F.col("o_orderkey"), F.col("o_orderkey") * 37 % 1380
    place = F.floor(o / (F.col("o_custkey") % 5 + 1)).alias("id")
    rows = table(spark, sf_dir, "orders").select(place, start.alias("start"), (start + 5 + o % 50).alias("end"), o)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("start", "o_orderkey")))
    days = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("windows"))
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).union(rows.select("id")).distinct()
    return every.join(days, "id", "left").select("id", wording.sun_windows(F.col("windows")).alias("sentence"))


@query(f"""SELECT o_orderkey AS id, strftime(o_orderdate, '%-d %b %Y') AS visited, CASE WHEN o_orderkey%200 = 0 THEN '' ELSE CASE WHEN o_orderkey%2 = 0 THEN 'Lit' ELSE 'In shadow' END || ' in ' || {_duration_sql('(o_orderkey%200)')} || ', at ' || {CLOCK_SQL.format('o_orderkey%1200 + o_orderkey%200')} || '.' END AS next_ FROM orders""")
def visit_sentences(spark, sf_dir):
    """Dates of visits and the next change of light."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(o.alias("id"), wording.visit_date(F.col("o_orderdate")).alias("visited"), wording.change_label(o % 2 == 0, o % 1200 + o % 200, o % 200).alias("next_"))


@query("""WITH r AS (SELECT c_nationkey AS archive, c_name, row_number() OVER w AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_name))
SELECT archive, 'Would add ' || any_value(n) || ' photograph' || CASE WHEN any_value(n) = 1 THEN '' ELSE 's' END || ':' || chr(10) || string_agg('  ' || c_name, chr(10) ORDER BY i) FILTER (i <= 12) || CASE WHEN any_value(n) > 12 THEN chr(10) || '  …and ' || (any_value(n) - 12) || ' more' ELSE '' END AS report FROM r GROUP BY archive""")
def drift_report(spark, sf_dir):
    """What publishing would add to each archive: the count, twelve names and how many more."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("archive"), "c_name")
    return sinks.listed(rows, "archive", "c_name", "Would add", "photograph")
