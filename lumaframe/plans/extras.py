"""Queries over alignments, bands of light, horizons, calibrations, records and their controls, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import clock, colour, geodesy, sky, spectrum, text, vectors
from lumaframe.operators import alignments, archive, buildings, daylight, grade, ledger, measure, pixels, places, ranking, solver, terrain
from lumaframe.operators.timeline import sampled
from lumaframe.sources import feeds

from .archive import image_masks, images, query, table, textures
from .light import EDGE_SQL, H_SQL, SPOT, TIMES_SQL, edges, heights, instants
from .ledger import OWNED_SQL, audited
from .records import MONTH_SQL, bodies, places_months

YEAR = 1_772_323_200


def aims(spark, sf_dir) -> DataFrame:
    """(spot, lat, lon, bearing, horizon, start, end): for each supplier a bearing with something on the horizon, for a year."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        s.alias("spot"), (s * 13 % 110 - 55.0).alias("lat"), (s * 7 % 360 - 180.0).alias("lon"), (s * 31 % 360).cast("double").alias("bearing"), (s % 12 / 2.0).alias("horizon"), F.lit(YEAR).cast("long").alias("start"), F.lit(YEAR + 365 * 86_400).cast("long").alias("end")
    )


@query()
def sun_passes(spark, sf_dir):
    """The sun's passes of what stands on each supplier's bearing over a year."""
    return alignments.alignments(aims(spark, sf_dir), ["spot"], "sun", 600)[0]


@query()
def sun_searches(spark, sf_dir):
    """What a year's search found on each supplier's bearing, or why nothing."""
    return alignments.alignments(aims(spark, sf_dir), ["spot"], "sun", 600)[1]


@query()
def moon_passes(spark, sf_dir):
    """The moon's passes of the year with how much of it is lit."""
    return alignments.with_moon_phase(alignments.alignments(aims(spark, sf_dir), ["spot"], "moon", 600)[0])


BLUE_SQL = f"(SELECT *, r_lo AS a, s_lo AS b, r_hi AS c, s_hi AS d FROM {sky.BLUE.sql(TIMES_SQL)})"


@query(f"""WITH w AS (SELECT id, CASE kind WHEN 'all day long' THEN [{{'s': a, 'e': b}}] WHEN 'twice' THEN [{{'s': a, 'e': c}}, {{'s': d, 'e': b}}] WHEN 'through midnight' THEN [{{'s': solar_noon - 43200, 'e': c}}, {{'s': d, 'e': solar_noon + 43200}}] WHEN 'whole day' THEN [{{'s': solar_noon - 43200, 'e': solar_noon + 43200}}] ELSE [] END AS w FROM {BLUE_SQL})
SELECT id, len(w) AS n, round(w[1].s, 1) AS first_, round(w[-1].e, 1) AS last_ FROM w""")
def blue_hours(spark, sf_dir):
    """Windows of blue light of every order's day, none, one or two."""
    rows = sky.BLUE.on(instants(spark, sf_dir)).withColumn("w", sky.band_windows())
    return rows.select("id", F.size("w").cast("long").alias("n"), F.round(F.get("w", F.lit(0))["start"], 1).alias("first_"), F.round(F.try_element_at("w", F.lit(-1))["end"], 1).alias("last_"))


LIFT_SQL = "CASE WHEN a > 85 THEN 0 WHEN a > 5 THEN (58.1e0/tan(radians(a)) - 0.07e0/pow(tan(radians(a)), 3) + 0.000086e0/pow(tan(radians(a)), 5))/3600 WHEN a > -0.575e0 THEN (1735 - 518.2e0*a + 103.4e0*a*a - 12.79e0*a*a*a + 0.711e0*a*a*a*a)/3600 ELSE -20.772e0/tan(radians(a))/3600 END"


@query(f"SELECT event_id AS id, round(a + {LIFT_SQL}, 6) AS apparent, CASE WHEN a <= 0 THEN 'Infinity'::DOUBLE ELSE round(1/tan(radians(a)), 5) END AS ratio FROM (SELECT event_id, event_id*7%1000/10e0 - 9.95e0 AS a FROM events)")
def apparent_altitudes(spark, sf_dir):
    """Altitudes as air lifts them, and how long a shadow a metre throws: endless for a sun that isn't up."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_id*7%1000/10e0 - 9.95e0 AS a")
    ratio = F.when(F.col("a") <= 0, float("inf")).otherwise(F.round(1 / F.tan(F.radians("a")), 5))
    return rows.select("id", F.round(F.col("a") + F.expr(sky.refraction("a")), 6).alias("apparent"), ratio.alias("ratio"))


STEPS = places.growing_steps(60)


@query(f"""WITH {H_SQL}, p AS (SELECT s_suppkey AS id, s_suppkey*37%256 AS r, s_suppkey*53%256 AS c FROM supplier), o AS (SELECT p.*, coalesce(h.height, 0) AS eye FROM p LEFT JOIN h ON h."row" = p.r AND h.col = p.c),
k AS (SELECT unnest([{', '.join(repr(x) for x in STEPS)}]::DOUBLE[]) AS k), s AS (SELECT id, eye, bin, k*30 AS m, floor(r - cos(radians(bin*5e0))*k + 0.5) AS rr, floor(c + sin(radians(bin*5e0))*k + 0.5) AS cc FROM o, range(72) q(bin), k),
a AS (SELECT id, bin, max(degrees(atan2(height - m*m/(2*7/6e0*6371008.8e0) - eye, m))) AS a FROM s JOIN h ON h."row" = rr AND h.col = cc GROUP BY ALL)
SELECT p.id, b.bin::INT AS bin, round(greatest(0, coalesce(a, 0)), 6) AS angle FROM p CROSS JOIN range(72) b(bin) LEFT JOIN a ON a.id = p.id AND a.bin = b.bin""")
def point_horizons(spark, sf_dir):
    """The ground's highest angle in 72 bearings round each supplier, by samples that stand further and further apart."""
    at = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_suppkey*37%256 AS row", "s_suppkey*53%256 AS col")
    eye = at.join(heights(spark, sf_dir), ["row", "col"], "left").select("id", "row", "col", F.coalesce("height", F.lit(0.0)).alias("height"))
    found = places.terrain_horizon(eye, heights(spark, sf_dir), 30.0, 256, 72, most=60)
    return found.select("id", "bin", F.round("angle", 6).alias("angle"))


# every sample to the field's edge and every wall that the tables place, at the bearings that the operators name
DAY_SQL = f"""WITH {H_SQL}, {EDGE_SQL.replace("bin*2e0", "bin/2e0").replace("range(180)", "range(720)")}, sk AS (SELECT spot, bin, max(degrees(atan2(height, t))) AS altitude FROM m WHERE t > 0 AND t <= 1500 AND k BETWEEN 0 AND 1 GROUP BY ALL),
p AS (SELECT s_suppkey AS id, s_suppkey*37%256 AS r, s_suppkey*53%256 AS c FROM supplier), o AS (SELECT p.*, h.height AS eye FROM p JOIN h ON h."row" = p.r AND h.col = p.c),
st AS (SELECT unnest([{', '.join(repr(x) for x in places.growing_steps())}]::DOUBLE[]) AS k), s AS (SELECT id, eye, bin, k*30 AS m, floor(r - cos(radians(bin*1e0))*k + 0.5) AS rr, floor(c + sin(radians(bin*1e0))*k + 0.5) AS cc FROM o, range(360) q(bin), st),
hz AS (SELECT id, bin, greatest(0, coalesce(max(degrees(atan2(height - m*m/(2*7/6e0*6371008.8e0) - eye, m))), 0)) AS angle FROM s LEFT JOIN h ON h."row" = rr AND h.col = cc GROUP BY ALL),
gr AS (SELECT a.id, q.bin, a.angle*(1 - (q.bin%2)/2e0) + b.angle*(q.bin%2)/2e0 AS angle FROM range(720) q(bin) JOIN hz a ON a.bin = q.bin//2 JOIN hz b ON b.id = a.id AND b.bin = (q.bin//2 + 1)%360),
pf AS (SELECT p.id, q.bin, greatest(0, coalesce(sk.altitude, 0), coalesce(gr.angle, 0)) AS angle FROM p JOIN range(720) q(bin) ON TRUE LEFT JOIN sk ON sk.spot = p.id AND sk.bin = q.bin LEFT JOIN gr ON gr.id = p.id AND gr.bin = q.bin),
tk AS (SELECT s_suppkey AS id, s_suppkey*13%110 - 55e0 AS lat, s_suppkey*7%360 - 180e0 AS lon, unnest(generate_series({YEAR}, {YEAR} + 86340, 60))::DOUBLE AS t FROM supplier),
sn AS (SELECT id, ((t - {YEAR})/60)::BIGINT AS minute, sun_azimuth*2 AS place, sun_altitude AS alt FROM {sky.SUN.sql('tk')} x),
li AS (SELECT sn.id, minute, alt > 0 AS up, alt > 0 AND alt > a.angle + (b.angle - a.angle)*(place - floor(place)) AS lit FROM sn JOIN pf a ON a.id = sn.id AND a.bin = floor(place)::INT%720 JOIN pf b ON b.id = sn.id AND b.bin = (floor(place)::INT + 1)%720),
ch AS (SELECT *, CASE WHEN lag(lit) OVER w = lit AND lag(up) OVER w = up THEN 0 ELSE 1 END AS fresh FROM li WINDOW w AS (PARTITION BY id ORDER BY minute)),
rn AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY minute) AS run FROM ch),
wn AS (SELECT id, run, min(minute) AS a, max(minute) + 1 AS b FROM rn WHERE lit GROUP BY id, run)
"""


def light_spots(spark, sf_dir):
    """(spot, row, col, lat, lon, start, end): each supplier's place in the field and on the globe, and a day."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        s.alias("spot"), (s * 37 % 256).alias("row"), (s * 53 % 256).alias("col"), (s * 13 % 110 - 55.0).alias("lat"), (s * 7 % 360 - 180.0).alias("lon"),
        F.lit(YEAR).cast("long").alias("start"), F.lit(YEAR + 86_340).cast("long").alias("end"),
    )


@query(f"""{DAY_SQL} SELECT p.id AS spot, min(a) AS first, max(b) - 1 AS "last", coalesce(sum(b - a), 0)::BIGINT AS total, max(b - a) AS longest FROM p LEFT JOIN wn ON wn.id = p.id GROUP BY p.id""")
def day_light(spark, sf_dir):
    """First and last lit minute, all of them and the longest run of each supplier's day, behind its buildings and the field's ground."""
    spots = light_spots(spark, sf_dir)
    profiles = daylight.surroundings(spots.select("spot", "row", "col"), edges(spark, sf_dir), heights(spark, sf_dir), 30.0, 256, 0.5)
    windows = daylight.light_windows(spots.drop("row", "col"), profiles)
    return ledger.light_summary(windows, ["spot"]).withColumn("longest", F.col("longest.end") - F.col("longest.start"))


@query("""SELECT l_returnflag AS flag, round(100*sum(l_quantity*l_discount)/sum(l_quantity*l_quantity), 8) AS unit, round(sum(l_quantity*l_discount)/sum(l_discount*l_discount)/100, 6) AS gain100, round(sum(l_quantity*l_discount)/sum(l_discount*l_discount), 4) AS gain_raw FROM lineitem GROUP BY 1""")
def calibration_constants(spark, sf_dir):
    """Constants of controls from what was applied and what was measured, in the three ways they are written."""
    x, y = F.col("l_quantity"), F.col("l_discount")
    made = [F.round(pixels.calibration_constant(k, x, y), d).alias(n) for k, d, n in (("unit", 8, "unit"), ("gain100", 6, "gain100"), ("gainRaw", 4, "gain_raw"))]
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(*made)


@query(f"""WITH {H_SQL}, t AS (SELECT "row"//2 AS y, col//2 AS x FROM h GROUP BY ALL HAVING count(*) = 4) SELECT count(*) AS tiles, sum(y)::BIGINT AS y, sum(x)::BIGINT AS x FROM t""")
def whole_tiles(spark, sf_dir):
    """Tiles of two by two samples that are complete."""
    cut = heights(spark, sf_dir).select(F.floor(F.col("col") / 2).alias("x"), F.floor(F.col("row") / 2).alias("y"), (F.col("row") % 2).alias("row"), (F.col("col") % 2).alias("col"), "height")
    kept = pixels.complete_tiles(cut, ["x", "y"], 2).select("x", "y").distinct()
    return kept.agg(F.count("*").alias("tiles"), F.sum("y").alias("y"), F.sum("x").alias("x"))


@query("""WITH p AS (SELECT p_partkey AS id, [p_partkey%7 + 1e0, p_partkey%5 + 0e0, p_partkey%3 + 0e0] AS a, [p_partkey%11 + 0e0, p_partkey%13 + 0e0, p_partkey%2 + 0e0] AS b FROM part), m AS (SELECT id, list_transform(range(1, 4), lambda i: (a[i] + b[i])/2) AS m FROM p)
SELECT id, list_transform(m, lambda x: floor(x/sqrt(list_dot_product(m, m))*100000 + 0.5)/100000) AS v FROM m""")
def pooled_vectors(spark, sf_dir):
    """Token vectors averaged and scaled to unit length."""
    p = F.col("p_partkey")
    row = lambda *ks: F.array(*[(p % k + (1.0 if i == 0 and k == 7 else 0.0)).cast("double") for i, k in enumerate(ks)])
    return vectors.mean_pooled(table(spark, sf_dir, "part").select(p.alias("id"), F.array(row(7, 5, 3), row(11, 13, 2)).alias("t")), ["id"], "t")


@query(f"""WITH c AS (SELECT c_custkey AS id, {SPOT} AS lat, c_custkey*7%360 - 180e0 AS lon, c_custkey%90 AS turn, (10 + c_custkey%50)*sqrt(2e0)/2/6371008.8e0 AS d FROM customer), k AS (SELECT *, i, radians(45 + 90*i + turn) AS b FROM c, range(4) r(i))
SELECT id, i, round((degrees(asin(sin(radians(lat))*cos(d) + cos(radians(lat))*sin(d)*cos(b))) - lat)*111195, 2) AS north, round(degrees(atan2(sin(b)*sin(d)*cos(radians(lat)), cos(d) - sin(radians(lat))*(sin(radians(lat))*cos(d) + cos(radians(lat))*sin(d)*cos(b))))*111195, 2) AS east FROM k""")
def square_footprints(spark, sf_dir):
    """Corners of turned squares, in metres of a degree from their centres."""
    k = "c_custkey"
    rows = table(spark, sf_dir, "customer").selectExpr(f"{k} AS id", f"{SPOT} AS lat1", f"{k}*7%360 - 180e0 AS lon1", f"cast({k}%90 AS double) AS turn", f"10e0 + {k}%50 AS size")
    corners = rows.select("id", "lat1", "lon1", buildings.square_reach(F.col("size")).alias("metres"), F.posexplode(buildings.square_courses(F.col("turn"))).alias("i", "course"))
    made = geodesy.DIRECT.on(corners)
    return made.select("id", F.col("i").cast("long").alias("i"), F.round((F.col("lat") - F.col("lat1")) * 111195, 2).alias("north"), F.round((F.col("lon") - F.col("lon1")) * 111195, 2).alias("east"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey%7 = 0 OR o_orderkey%5 = 0 THEN 0 ELSE o_orderkey%180 - 90 + 0.25e0 END AS latitude, CASE WHEN o_orderkey%7 = 0 OR o_orderkey%4 = 0 THEN 0 ELSE o_orderkey%360 - 180 + 0.5e0 END AS longitude,
CASE WHEN o_orderkey%7 <> 0 AND o_orderkey%3 <> 0 AND o_orderkey%11 <> 0 THEN epoch(make_timestamp(2026, 3, o_orderkey%28 + 1, o_orderkey%24, 15, 0.0)) END AS "time", CASE WHEN o_orderkey%7 <> 0 AND o_orderkey%3 <> 0 AND o_orderkey%6 <> 1 THEN o_orderkey%100 + 0e0 END AS cloud FROM orders""")
def forecast_heads(spark, sf_dir):
    """What forecasts say of their place and of now: places, times and values may be missing, and a body may be no forecast."""
    k = F.col("o_orderkey")
    part = lambda when, form, *a: F.when(when, F.format_string(form, *a))
    when = F.when(k % 11 == 0, "soon").otherwise(F.format_string("2026-03-%02dT%02d:15", (k % 28 + 1).cast("int"), (k % 24).cast("int")))
    now = F.concat(F.lit('"current":{'), F.concat_ws(",", F.concat(F.lit('"time":"'), when, F.lit('"')), part(k % 6 != 1, '"cloud_cover":%d', (k % 100).cast("int"))), F.lit("}"))
    body = F.concat(F.lit("{"), F.concat_ws(",", part(k % 5 != 0, '"latitude":%s', (k % 180 - 90 + 0.25).cast("string")), part(k % 4 != 0, '"longitude":%s', (k % 360 - 180 + 0.5).cast("string")), F.when(k % 3 != 0, now)), F.lit("}"))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 14 == 0, "{}").when(k % 7 == 0, "not json").otherwise(body).alias("json"))
    found = feeds.forecast_heads(rows, "id", "json")
    return found.select("id", "latitude", "longitude", "time", "cloud")


@query("SELECT o_orderkey AS id, 'photo' AS what FROM orders WHERE o_orderkey%7 <> 0 UNION ALL SELECT o_orderkey, 'override' FROM orders WHERE o_orderkey%5 = 0 AND o_orderkey%7 <> 0")
def removed_with_overrides(spark, sf_dir):
    """Photos removed, and their overrides with them."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    store, told = archive.remove_photos(rows, rows.where("id % 5 = 0"), rows.where("id % 7 = 0"), "id")
    return store.withColumn("what", F.lit("photo")).unionByName(told.withColumn("what", F.lit("override")))


@query("""WITH f AS (SELECT DISTINCT substr(sha256(event_type || event_id%50), 1, 16) AS id, event_type || event_id%50 AS content FROM events) SELECT id, regexp_replace(content, '[^a-zA-Z0-9_-]+', '-', 'g') || '.' || id || '.jpg' AS filename, CASE WHEN length(content)%2 = 0 THEN 'digital' ELSE 'film' END AS medium, CASE WHEN length(content) >= 10 THEN 2 ELSE 1 END AS tags FROM f""")
def ingested_files(spark, sf_dir):
    """Files as records: one for each content, with the name it is kept under, its medium and its sizes."""
    content = F.concat("event_type", F.col("event_id") % 50)
    n = F.length(content)
    rows = table(spark, sf_dir, "events").select(F.concat(content, F.lit(".jpg")).alias("filename"), content.cast("binary").alias("content"), F.when(n >= 10, 1300).otherwise(700).alias("width"), F.lit("Maker").alias("camera"), F.lit("x").alias("software"), (n % 2 == 0).alias("exposed"))
    return archive.ingested(rows).select("id", "filename", "medium", F.size("tags").alias("tags"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey%5 = 0 THEN NULL ELSE ['640', '1280', 'full'][p_partkey%3 + 1] END AS tag, CASE WHEN p_partkey%4 = 0 THEN (p_partkey%7 + 1) || '.0s' ELSE '1/' || (p_partkey%500 + 2) || 's' END AS shutter,
floor(CASE WHEN p_partkey%2 = 0 THEN -1 ELSE 1 END*(p_partkey%90 + p_partkey%60/60e0 + p_partkey%59/3600e0)*1000000 + 0.5)/1000000 AS degrees FROM part""")
def file_facts(spark, sf_dir):
    """Sizes off the addresses of files, and shutters and coordinates as records write them."""
    p = F.col("p_partkey")
    tag = F.get(F.array(F.lit("640"), F.lit("1280"), F.lit("full")), (p % 3).cast("int"))
    url = F.concat(F.lit("/img/"), F.when(p % 5 == 0, F.lit("cover.png")).otherwise(F.concat(F.lit("d62b2154e7fee842-"), tag, F.lit(".avif"))))
    seconds = F.when(p % 4 == 0, (p % 7 + 1).cast("double")).otherwise(1.0 / (p % 500 + 2))
    return table(spark, sf_dir, "part").select(p.alias("id"), archive.tag_of(archive.file_of(url)).alias("tag"), text.shutter(seconds).alias("shutter"), text.degrees_of(p % 90, p % 60, p % 59, F.when(p % 2 == 0, "S").otherwise("N")).alias("degrees"))


@query("""WITH c AS (SELECT p_partkey AS id, p_partkey*37%256/255e0 AS r, p_partkey*91%256/255e0 AS g, p_partkey*53%256/255e0 AS b FROM part), n AS (SELECT id, r/greatest(r, g, b) AS r, g/greatest(r, g, b) AS g, b/greatest(r, g, b) AS b FROM c WHERE greatest(r, g, b) > 0),
e AS (SELECT id, list_transform([r, g, b], lambda x: floor((CASE WHEN x <= 0.0031308 THEN x*12.92 ELSE 1.055*pow(x, 1/2.4e0) - 0.055 END)*255 + 0.5)::INT) AS v FROM n) SELECT id, printf('#%02x%02x%02x', v[1], v[2], v[3]) AS hex FROM e""")
def light_colours(spark, sf_dir):
    """Light of any strength as a colour: its peak is full."""
    p = F.col("p_partkey")
    rgb = [(p * k % 256) / 255.0 for k in (37, 91, 53)]
    return table(spark, sf_dir, "part").where(F.greatest(*rgb) > 0).select(p.alias("id"), colour.hex_colour(*rgb).alias("hex"))


CONTROL_SQL = "CASE WHEN t <= 0.5e0 THEN n + (r - n)*t*2 ELSE r + (f - r)*(t*2 - 1) END"


@query(f"""WITH k AS (SELECT p_partkey AS id, p_partkey%11/10e0 AS t FROM part), c AS (SELECT id, name, t, lo, hi, n, (id%31 - 15e0)*w AS r, (id%41 - 20e0)*w AS f FROM k, (VALUES ('exposure', -5, 5, 0, 0.5e0), ('saturation', -100, 100, 0, 8e0), ('grain_size', 0, 100, 25, 8e0), ('sharpen_radius', 0.5e0, 3, 1, 0.2e0)) v(name, lo, hi, n, w))
SELECT id, name, round(greatest(lo, least(hi, {CONTROL_SQL})), 6) AS value FROM c""")
def strength_records(spark, sf_dir):
    """Records of controls at a strength between nothing, restrained and faithful, inside their ranges."""
    p = F.col("p_partkey")
    weight = {"exposure": 0.5, "saturation": 8.0, "grain_size": 8.0, "sharpen_radius": 0.2}
    record = lambda x: F.struct(*[(x * weight.get(k, 0.0)).cast("double").alias(k) for k in grade.RANGES])
    rows = table(spark, sf_dir, "part").select(p.alias("id"), grade.at_strength(record(p % 31 - 15), record(p % 41 - 20), p % 11 / 10.0).alias("r"))
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.round(F.col(f"r.{k}"), 6).alias("value")) for k in weight]))
    return rows.select("id", listed.alias("x")).select("id", "x.name", "x.value")


@query("""WITH a AS (SELECT s_suppkey AS id, 'sky' AS region, s_suppkey%9 - 4.5e0 AS e, s_suppkey%50 + 0e0 AS t FROM supplier WHERE s_suppkey%3 <> 0), b AS (SELECT s_suppkey AS id, 'sky' AS region, s_suppkey%7 - 3e0 AS e, s_suppkey%90 + 0e0 AS t FROM supplier WHERE s_suppkey%4 <> 0)
SELECT id, region, round(greatest(-4, least(4, coalesce(a.e, 0)*0.75 + coalesce(b.e, 0)*0.25)), 6) AS exposure, round(coalesce(a.t, 0)*0.75 + coalesce(b.t, 0)*0.25, 6) AS temp FROM a FULL JOIN b USING (id, region)""")
def blended_masks(spark, sf_dir):
    """Masks of two records a quarter of the way: one-sided ones fade."""
    s = F.col("s_suppkey")
    def side(m: int, e: int, off: float, t: int) -> DataFrame:
        zero = [F.lit(0.0).alias(c) for c in ("tint", "saturation", "contrast")]
        return table(spark, sf_dir, "supplier").where(s % m != 0).select(s.alias("id"), F.lit("sky").alias("region"), (s % e - off).alias("exposure"), (s % t + 0.0).alias("temp"), *zero)

    made = grade.blended_masks(side(3, 9, 4.5, 50), side(4, 7, 3.0, 90), F.lit(0.25))
    return made.select("id", "region", F.round("exposure", 6).alias("exposure"), F.round("temp", 6).alias("temp"))


@query("""SELECT p_partkey AS id, round(greatest(0, 1 + (p_partkey%400 - 200)/100e0 + p_partkey%50/160e0), 6) AS chroma, round(p_partkey%100/100e0*0.055e0, 6) AS grain, round(CASE WHEN p_partkey%3 > 0 THEN p_partkey%9 - 4e0 ELSE 0 END, 6) AS mask0, round(CASE WHEN p_partkey%3 > 1 THEN 0.045e0*(p_partkey%60)/100 ELSE 0 END, 6) AS mask1,
round((p_partkey%200 - 100)/100e0*22, 6) AS degrees, round(greatest(0, 1 + (p_partkey%300 - 200)/100e0), 6) AS band, round((p_partkey%90 - 45)/320e0, 6) AS lightness FROM part""")
def render_specs(spark, sf_dir):
    """What a renderer makes of a record: linear factors, mask channels and bands."""
    p = F.col("p_partkey")
    own = {"saturation": p % 400 - 200, "vibrance": p % 50, "grain": p % 100}
    record = F.struct(*[own.get(k, F.lit(0.0)).cast("double").alias(k) for k in grade.RANGES])
    mask = F.struct((p % 9 - 4.0).alias("exposure"), F.lit(0.0).alias("temp"), (p % 60 + 0.0).alias("tint"), F.lit(0.0).alias("saturation"))
    spec = grade.render_values(record, F.slice(F.array(mask, mask), 1, (p % 3).cast("int")))
    band = grade.render_bands(p % 200 - 100.0, p % 300 - 200.0, p % 90 - 45.0)
    rows = table(spark, sf_dir, "part").select(p.alias("id"), spec.alias("s"), band.alias("b"))
    six = lambda c, n: F.round(c, 6).alias(n)
    return rows.select("id", six(F.col("s.chroma"), "chroma"), six(F.col("s.grain"), "grain"), six(F.get("s.mask_exposure", F.lit(0)), "mask0"), six(F.get("s.mask_a", F.lit(1)), "mask1"), six(F.col("b.degrees"), "degrees"), six(F.col("b.chroma"), "band"), six(F.col("b.lightness"), "lightness"))


@query("""WITH k AS (SELECT p_partkey AS id, [p_partkey%10 + 0e0, p_partkey%7 + 0.5e0, p_partkey%3 + 0.3e0] AS d FROM part), u AS (SELECT id, n, v FROM k, (SELECT unnest([1, 2, 3]) AS i, unnest(['tone curve', 'colour cast', 'contrast']) AS n) p, LATERAL (SELECT d[i] AS v) q)
SELECT id, string_agg(n || ' ' || printf('%.1f', v), ' · ' ORDER BY v, n = 'contrast', n = 'colour cast') AS parts FROM u GROUP BY id""")
def resemblance_parts(spark, sf_dir):
    """The parts of a resemblance from the nearest on, in words."""
    p = F.col("p_partkey")
    parts = F.create_map(F.lit("tone"), p % 10 + 0.0, F.lit("cast"), p % 7 + 0.5, F.lit("contrast"), p % 3 + 0.3)
    return table(spark, sf_dir, "part").select(p.alias("id"), ranking.parts_text(parts).alias("parts"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey%3 = 0 THEN 'edited' ELSE s_name END AS name FROM supplier WHERE s_suppkey%5 <> 0 UNION ALL SELECT 100000 + s_suppkey, 'new' FROM supplier WHERE s_suppkey%4 = 0""")
def board_edits(spark, sf_dir):
    """A second collection takes the same appends, edits and removals as the first, without overrides."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    edited = archive.update_by_key(rows, rows.where("id % 3 = 0").select("id", F.lit("edited").alias("name")), "id", ["name"])
    kept = archive.delete_by_key(edited, rows.where("id % 5 = 0"), "id")
    return archive.append_new(kept, rows.where("id % 4 = 0").select((F.col("id") + 100000).alias("id"), F.lit("new").alias("name")), "id", [F.col("name")])


def graded(spark, sf_dir) -> DataFrame:
    analyses = solver.analysed(pixels.with_lab(images(spark, sf_dir)), "image")
    return solver.solution(solver.pairs(analyses, 1))


@query()
def grade_solution(spark, sf_dir):
    """The whole grade of every image to the first one, at full strength and restrained, and how far it gets."""
    made = graded(spark, sf_dir)
    return made.select("id", "faithful", "restrained", "faithful_curve", "restrained_curve", "reachability", "residual")


def masked_analyses(spark, sf_dir) -> DataFrame:
    """What a grade is solved from, for each image, with its masks; one scan of the pixels."""
    masks = image_masks(spark, sf_dir)
    rows = images(spark, sf_dir).withColumns({"width": F.lit(64), "height": F.lit(48)})
    table_ = measure.measure(rows.withColumnRenamed("image", "id"), "id", masks.withColumnRenamed("image", "id"), (64,))
    return measure.analysed(table_, ["id", "edge"], measure.coverage(masks, "image").withColumnRenamed("image", "id")).drop("edge")


def image_details(spark, sf_dir) -> DataFrame:
    """(textures, vignettes) of images: the texture is that of a supplier's photo, whose number follows the image's."""
    every = images(spark, sf_dir)
    n = F.lit(10)  # suppliers that each scale has
    of = every.select(F.col("image").alias("id")).distinct().withColumn("photo", F.col("id") % n)
    textures_ = textures(spark, sf_dir, of.select("photo")).withColumnRenamed("id", "photo")
    told = of.join(textures_, "photo").drop("photo")
    return told, pixels.vignette(every.withColumnRenamed("image", "id"), ["id"], F.lit(64), F.lit(48)).select("id", "falloff", "usable")


@query()
def grade_masked(spark, sf_dir):
    """The masks, and the moves of texture and corners, that bring each image to the first one, at full strength and restrained."""
    made = solver.solution(solver.pairs(masked_analyses(spark, sf_dir), 1)).select("id", "faithful_masks", "restrained_masks", "reachability")
    return made.join(solver.details(*image_details(spark, sf_dir), 1), "id", "left")


TRACK_SQL = "(SELECT s_suppkey AS spot, s_suppkey*13%110 - 55e0 AS lat, s_suppkey*7%360 - 180e0 AS lon, unnest(generate_series(1772323200, 1772409600, 3600))::DOUBLE AS t FROM supplier)"


@query(f"SELECT spot, count(*) AS n, round(max(sun_altitude), 4) AS sun, round(max(moon_altitude), 4) AS moon, round(max(core_altitude), 4) AS core FROM (SELECT spot, t, sun_altitude, NULL::DOUBLE AS moon_altitude, NULL::DOUBLE AS core_altitude FROM {sky.SUN.sql(TRACK_SQL)} UNION ALL SELECT spot, t, NULL, moon_altitude, NULL FROM {sky.MOON.sql(TRACK_SQL)} UNION ALL SELECT spot, t, NULL, NULL, core_altitude FROM {sky.CORE.sql(TRACK_SQL)}) GROUP BY spot")
def day_tracks(spark, sf_dir):
    """Hourly tracks of sun, moon and core over each supplier: how many points, and how high each gets."""
    s = F.col("s_suppkey")
    spots = table(spark, sf_dir, "supplier").select(s.alias("spot"), (s * 13 % 110 - 55.0).alias("lat"), (s * 7 % 360 - 180.0).alias("lon"), F.lit(YEAR).cast("long").alias("start"), F.lit(YEAR + 86_400).cast("long").alias("end"))
    tracks = clock.track(spots, "start", "end", 3600).withColumn("t", F.col("t").cast("double"))
    made = sky.CORE.on(sky.MOON.on(sky.SUN.on(tracks)))
    return made.groupBy("spot").agg((F.count("*") * 3).alias("n"), *[F.round(F.max(f"{b}_altitude"), 4).alias(b) for b in ("sun", "moon", "core")])


@query(f"""WITH {MONTH_SQL}, u AS (SELECT place, day, minute, lat, lon, epoch(instant)::DOUBLE AS t FROM g WHERE instant IS NOT NULL), c AS (SELECT place, day, minute, sun_altitude, phase FROM {sky.SUN.sql('u')} x),
n2 AS (SELECT *, lead(minute) OVER (PARTITION BY place, day ORDER BY minute) AS next, row_number() OVER (PARTITION BY place, day ORDER BY minute) - row_number() OVER (PARTITION BY place, day, phase = 'golden' ORDER BY minute) AS isle FROM c),
p AS (SELECT place, day, max(sun_altitude) AS peak FROM c GROUP BY ALL)
SELECT r.place, r.day, r.start_ AS "start", r.end_ AS "end", round(p.peak, 5) AS peak FROM (SELECT place, day, isle, min(minute)::BIGINT AS start_, max(coalesce(next, 1440))::BIGINT AS end_ FROM n2 WHERE phase = 'golden' GROUP BY place, day, isle) r JOIN p ON p.place = r.place AND p.day = r.day""")
def month_sun(spark, sf_dir):
    """Golden runs of each day of each nation's month, by the half hour on its own clock, and how high the sun gets."""
    grid = clock.month_grid(places_months(spark, sf_dir), list(range(0, 1440, 30))).where("at IS NOT NULL")
    cells = sky.SUN.on(grid.select("place", "day", "minute", "lat", "lon", (F.unix_micros("at") / 1e6).alias("t")))
    runs = ledger.golden_runs(cells.select("place", "day", F.col("minute").cast("long").alias("minute"), "phase"), ["place", "day"])
    return runs.join(cells.groupBy("place", "day").agg(F.round(F.max("sun_altitude"), 5).alias("peak")), ["place", "day"])


@query(f"""WITH g AS (SELECT g.id, d.solar_noon AS noon, d.sunrise, d.sunset, g.kind, g.r_lo, g.s_lo, g.r_hi, g.s_hi FROM {sky.GOLDEN.sql(TIMES_SQL)} g JOIN {sky.DAY.sql(TIMES_SQL)} d ON g.id = d.id)
SELECT id, round(sunrise, 0) AS sunrise, round(CASE kind WHEN 'twice' THEN r_lo WHEN 'all day long' THEN r_lo WHEN 'through midnight' THEN noon - 43200 WHEN 'whole day' THEN noon - 43200 END, 0) AS morning, round(CASE kind WHEN 'twice' THEN s_lo WHEN 'through midnight' THEN noon + 43200 END, 0) AS evening FROM g""")
def light_events(spark, sf_dir):
    """The rows of a day's light: golden light before and after noon, and sunrise, whatever the day has."""
    times = instants(spark, sf_dir)
    windows = lambda form, name: form.on(times).withColumn(name, sky.band_windows()).select("id", name)
    days = sky.DAY.on(times).select("id", "solar_noon", "sunrise", "sunset").join(windows(sky.GOLDEN, "golden"), "id").join(windows(sky.BLUE, "blue"), "id")
    rows = ledger.event_rows(days, ["id"])
    at = lambda event, c: F.round(F.max(F.when(F.col("event") == event, F.col(c))), 0)
    return rows.groupBy("id").agg(at("sunrise", "start").alias("sunrise"), at("goldenMorning", "start").alias("morning"), at("goldenEvening", "end").alias("evening"))


@query(f"""WITH {OWNED_SQL}, n AS (SELECT fault, coalesce(file, id || ' ' || tag) AS name, CASE fault WHEN 'missing' THEN 0 WHEN 'undeclared' THEN 1000 ELSE 2000 END AS o FROM au), r AS (SELECT *, row_number() OVER (PARTITION BY fault ORDER BY name) AS n, count(*) OVER (PARTITION BY fault) AS all_ FROM n)
SELECT DISTINCT o AS place, CASE fault WHEN 'missing' THEN 'Listed but not on disk' WHEN 'undeclared' THEN 'Large enough for a width no derivative records' ELSE 'On disk, owned by no entry' END || ': ' || all_ AS line FROM r UNION ALL SELECT o + n, '  ' || name FROM r WHERE n <= 8 UNION ALL SELECT DISTINCT o + 9, '  …and ' || (all_ - 8) || ' more' FROM r WHERE all_ > 8""")
def audit_lines(spark, sf_dir):
    """An audit as lines: counts, the first of each kind, and how many more."""
    return ledger.audit_report(audited(spark, sf_dir))


@query("""SELECT p_partkey AS id, CASE WHEN d <= 0.75 THEN 'Measures like the same treatment — closest on tone curve, furthest apart on contrast.' || gap || ' Alike in the numbers; not a claim about how either was edited.' WHEN d <= 2.5 THEN 'In the same territory. Agrees on tone curve, parts company on contrast.' || gap ELSE 'Different photographs. The nearest they come is tone curve.' || gap END AS note
FROM (SELECT p_partkey, p_partkey%40/10e0 AS d, CASE p_partkey%3 WHEN 0 THEN '' WHEN 1 THEN ' split tone could not be compared, so this rests on the other 4.' ELSE ' saturation and split tone could not be compared, so this rests on one measurement.' END AS gap FROM part)""")
def resemblance_notes(spark, sf_dir):
    """What a resemblance says in words."""
    p = F.col("p_partkey")
    missing = F.when(p % 3 == 0, F.array().cast("array<string>")).when(p % 3 == 1, F.array(F.lit("split"))).otherwise(F.array(F.lit("saturation"), F.lit("split")))
    told = ranking.note(p % 40 / 10.0, F.lit("tone"), F.lit("contrast"), missing, F.when(p % 3 == 1, 4).otherwise(1))
    return table(spark, sf_dir, "part").select(p.alias("id"), told.alias("note"))


@query("""WITH e AS (SELECT event_id AS id, event_id%1000 + 0e0 AS lux, event_id%70 + 0e0 AS direct, event_id%90 + 0e0 AS diffuse, event_id%90 + 0e0 AS a, CASE WHEN event_id%3 > 0 THEN event_id%50/100e0 END AS aod, CASE WHEN event_id%4 > 0 THEN event_id%11/10e0 END AS sea FROM events),
s AS (SELECT *, CASE WHEN direct > 1 THEN lux*diffuse/direct ELSE diffuse*110 END AS sky FROM e)
SELECT id, round(sky, 6) AS diffuse_lux, round(log2(greatest(lux + sky, 1e-6)/2.5), 6) AS ev, round(CASE WHEN lux*greatest(0, sin(radians(a))) + sky > greatest(sky, 1e-6) THEN log2((lux*greatest(0, sin(radians(a))) + sky)/greatest(sky, 1e-6)) ELSE 0 END, 6) AS stops,
CASE WHEN aod IS NULL THEN 'turbidity from a table, ' ELSE 'aerosol depth ' || printf('%.2f', aod) || ' at 550 nm, measured; ' END || CASE WHEN sea IS NULL THEN 'particle size assumed continental' ELSE 'particle size inferred from ' || floor(sea*100 + 0.5)::INT || '% sea around the pin' END AS note FROM s""")
def light_readings(spark, sf_dir):
    """The sky's light, exposure and contrast of clear days, and where the air's turbidity comes from."""
    e = F.col("event_id")
    read = spectrum.light_reading(e % 1000 + 0.0, e % 70 + 0.0, e % 90 + 0.0, e % 90 + 0.0)
    note = spectrum.aerosol_note(F.when(e % 3 > 0, e % 50 / 100.0), F.when(e % 4 > 0, e % 11 / 10.0))
    rows = table(spark, sf_dir, "events").select(e.alias("id"), read.alias("r"), note.alias("note"))
    return rows.select("id", *[F.round(f"r.{c}", 6).alias(c) for c in ("diffuse_lux", "ev", "stops")], "note")
