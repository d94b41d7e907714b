"""Queries over saved spots, searches, buildings, tiles, frames and labels, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions import geodesy, text, view, wording
from lumaframe.operators import buildings, places, spots, timeline
from lumaframe.sources import feeds
from lumaframe.sources.scratch import written

from .archive import query, table
from .light import H_SQL, SPOT, heights


#: Keys of customers whose entries share a body.
PART = 2000


def spot_lists(spark, sf_dir) -> DataFrame:
    """(list, part, body): the customers of each nation as a saved list, in bodies of at most PART keys; some entries and some fields are not valid."""
    k = F.col("c_custkey")
    bad = lambda n, value, other: F.when(k % n == 0, other).otherwise(value)
    frame = F.struct(F.lit("ff").alias("sensor"), (k % 90 + 10).alias("focalLengthMm"), bad(11, F.lit("landscape"), F.lit("sideways")).alias("orientation"), (k % 700).alias("bearing"), (k % 40 - 20).alias("tiltDeg"))
    visit = lambda i: F.struct((k * 10 + i * (k % 3)).alias("at"), (k * i % 120 - 30).alias("sunAltitude"), (k % 500 - 60).alias("sunAzimuth"), (k % 13 / 10.0).alias("moonFraction"), F.lit(" soft ").alias("cloud"))
    photo = lambda i: F.struct(F.concat(F.when((k + i) % 4 == 0, "ftp").otherwise("https"), F.lit("://host.example/"), k).alias("url"), F.lit("  by one ").alias("credit"))
    entry = F.struct(
        bad(17, F.concat(F.lit("  "), "c_name", F.lit(" ")), F.lit("   ")).alias("name"), (k % 90 - 2.5).alias("lat"), (k * 7 % 400 - 190.0).alias("lon"), (k % 60).alias("radiusKm"), (k * 37 % 1000).alias("savedAt"),
        bad(5, F.concat(F.lit(" note "), k), F.lit(None)).alias("note"), frame.alias("frame"), (k % 1200 - 50.6).alias("slabHeightM"), F.array(*[photo(i) for i in range(8)]).alias("photos"), F.array(*[visit(i) for i in range(1, 15)]).alias("visits"),
    )
    # entries are made where their body is, in tasks whose number grows with the customers, though a small file is one
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("list"), F.floor(k / PART).alias("part"), k, "c_name")
    rows = timeline.dealt_out(rows, ["list", "part"]).groupBy("list", "part").agg(F.array_sort(F.collect_list(F.struct(k, entry.alias("e")))).alias("rows"))
    return rows.select("list", "part", F.to_json(F.transform("rows", lambda r: r["e"])).alias("body"))


def saved(spark, sf_dir) -> DataFrame:
    return feeds.saved_spots(spot_lists(spark, sf_dir), "list", "body", "part")


SPOTS_SQL = """s AS (SELECT c_nationkey AS list, c_custkey AS k, trim(c_name) AS name, c_custkey%90 - 2.5e0 AS lat, c_custkey*7%400 - 190e0 AS lon, CASE WHEN c_custkey%60 BETWEEN 1 AND 50 THEN (c_custkey%60)::INT END AS radius,
c_custkey*37%1000 + 0e0 AS saved_at, CASE WHEN c_custkey%5 <> 0 THEN 'note ' || c_custkey END AS note, CASE WHEN c_custkey%11 <> 0 THEN c_custkey%700%360 + 0e0 END AS bearing,
CASE WHEN c_custkey%1200 - 50.6e0 BETWEEN 0 AND 1000 THEN floor(c_custkey%1200 - 50.1e0)::INT END AS height, list_count(list_filter(range(1, 15), lambda i: abs(c_custkey*i%120 - 30) <= 90 AND c_custkey > 0 OR abs(c_custkey*i%120 - 30) <= 90 AND c_custkey*10 + i*(c_custkey%3) > 0)) AS v,
list_count(list_filter(range(8), lambda i: (c_custkey + i)%4 <> 0)) AS p FROM customer WHERE c_custkey%17 <> 0),
l AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY saved_at DESC, k) - 1 AS pos FROM s WHERE abs(lat) <= 85 AND abs(lon) <= 180),
saved AS (SELECT list, pos, name, lat, lon, radius, saved_at, note, bearing, height, CASE WHEN v > 0 THEN least(v, 12) END AS visits, least(p, 6) AS photos FROM l WHERE pos < 24)"""


def shown(rows: DataFrame) -> DataFrame:
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).alias(c)
    return rows.select("list", "pos", "name", "lat", "lon", "radius", "saved_at", "note", F.col("frame.bearing").alias("bearing"), "height", count("visits"), count("photos"))


@query(f"WITH {SPOTS_SQL} SELECT * FROM saved")
def saved_spots(spark, sf_dir):
    """Saved lists read and checked: what survives, in order, with the size of its log and strip."""
    return shown(saved(spark, sf_dir))


def new_of(spots_: DataFrame) -> DataFrame:
    """One new spot for each list, opened from a kept one: at its place for every second list, at a place of its own for the others."""
    old = spots_.where("pos = 3")
    new = old.withColumns({"name": F.concat(F.lit("new "), "name"), "lat": F.col("lat") + F.when(F.col("list") % 2 == 0, 0.0003).otherwise(0.01), "note": F.lit(None).cast("string"), "saved_at": F.lit(5000.0), "height": F.lit(7)})
    return new.withColumnRenamed("pos", "opened")


@query(f"""WITH {SPOTS_SQL}, hit AS (SELECT list FROM saved WHERE pos = 3 AND list%2 = 0), n AS (SELECT list, -1 AS pos, 'new ' || name AS name, lat + CASE WHEN list%2 = 0 THEN 0.0003e0 ELSE 0.01e0 END AS lat, lon, radius, 5000e0 AS saved_at, CASE WHEN list%2 = 0 THEN note END AS note, bearing, 7 AS height, visits, photos FROM saved WHERE pos = 3),
u AS (SELECT * FROM saved WHERE NOT (pos = 3 AND list IN (FROM hit)) UNION ALL SELECT * FROM n), r AS (SELECT * REPLACE (row_number() OVER (PARTITION BY list ORDER BY pos) - 1 AS pos) FROM u) SELECT * REPLACE (round(lat, 6) AS lat) FROM r WHERE pos < 24""")
def spots_saved_over(spark, sf_dir):
    """Saving a spot again moves it to the front and keeps what its notebook said."""
    rows = written(saved(spark, sf_dir), "saved")
    made = spots.save(rows, new_of(rows), ["list"])
    return shown(made).withColumn("lat", F.round("lat", 6))


@query(f"""WITH {SPOTS_SQL}, v AS (SELECT * REPLACE (CASE WHEN pos = 3 AND list%2 = 0 THEN least(coalesce(visits, 0) + 1, 12) ELSE visits END AS visits) FROM saved),
g AS (SELECT * FROM v WHERE pos <> 0) SELECT list, row_number() OVER (PARTITION BY list ORDER BY pos) - 1 AS pos, name, visits FROM g""")
def spots_logged_and_removed(spark, sf_dir):
    """A visit logged at a place, and the first spot of every list removed by its place."""
    rows = written(saved(spark, sf_dir), "saved")
    visit = F.struct(F.lit(1e9).alias("at"), F.lit(5.0).alias("altitude"), F.lit(9.0).alias("azimuth"), *[F.lit(None).cast(t).alias(c) for c, t in (("moon", "double"), ("cloud", "string"), ("weather", "string"), ("outcome", "string"))])
    at = new_of(rows).select("list", "lat", "lon", "opened", visit.alias("visit"))
    logged = spots.add_visit(rows, at, ["list"])
    left = spots.remove(logged, rows.where("pos = 0").select("list", "lat", "lon"), ["list"])
    return left.select("list", "pos", "name", F.when(F.col("visits").isNotNull(), F.size("visits")).alias("visits"))


@query("""SELECT p_partkey AS id, 'Closest logged visit: 3 Jun 2025, sun ' || CASE WHEN p_size < 3 THEN 'nearly the same height' WHEN p_size < 10 THEN p_size || '° different in height' ELSE p_size || '° off in height — not that close a match' END || ', ' || p_partkey%180 || '° round in bearing.'
|| CASE WHEN p_partkey%3 = 0 THEN '' WHEN p_partkey%3 = 1 THEN ' Rain.' ELSE ' Rain, low.' END || CASE WHEN p_partkey%2 = 0 THEN ' "good"' ELSE ' No outcome was logged.' END AS note FROM part""")
def visit_notes(spark, sf_dir):
    p = F.col("p_partkey")
    day = wording.visit_date(F.to_timestamp(F.lit("2025-06-03 10:00:00")))
    note = spots.match_note(F.col("p_size").cast("double"), (p % 180).cast("double"), day, F.when(p % 3 > 0, "Rain"), F.when(p % 3 == 2, "low"), F.when(p % 2 == 0, "good"))
    return table(spark, sf_dir, "part").select(p.alias("id"), note.alias("note"))


@query("""WITH o AS (SELECT event_id//24 AS body, event_id, value, row_number() OVER (PARTITION BY event_id//24 ORDER BY event_id) AS place FROM events)
SELECT body, CASE WHEN body%3 = 0 THEN 0 ELSE body%90 END::DOUBLE AS latitude, epoch(make_timestamp(2026, 3, event_id%28 + 1, event_id%24, 0, 0.0)) AS time, CASE WHEN event_id%5 <> 0 THEN value/100 END AS aod FROM o WHERE event_id%7 <> 0 AND body%11 <> 0""")
def air_feed(spark, sf_dir):
    """Hours of air forecasts; times that can't be read are dropped, values that are missing are null."""
    e = table(spark, sf_dir, "events").withColumn("body", F.floor(F.col("event_id") / 24))
    hour = F.struct("event_id", F.when(F.col("event_id") % 7 == 0, "soon").otherwise(F.format_string("2026-03-%02dT%02d:00", (F.col("event_id") % 28 + 1).cast("int"), (F.col("event_id") % 24).cast("int"))).alias("t"), F.when(F.col("event_id") % 5 != 0, F.col("value") / 100).alias("v"))
    packed = e.groupBy("body").agg(F.array_sort(F.collect_list(hour)).alias("h"))
    hourly = F.struct(F.transform("h", lambda x: x["t"]).alias("time"), F.transform("h", lambda x: x["v"]).alias("aerosol_optical_depth"))
    good = F.to_json(F.struct(F.when(F.col("body") % 3 != 0, F.col("body") % 90).alias("latitude"), hourly.alias("hourly")), {"ignoreNullFields": "false"})
    rows = packed.select("body", F.when(F.col("body") % 11 == 0, F.lit("[]")).otherwise(good).alias("json"))
    return feeds.air_quality(rows, "body", "json").select("body", "latitude", "time", "aod")


def photo_bodies(spark, sf_dir) -> DataFrame:
    """(body, search, details): parts in tens as a photo search; some lack what a photograph needs."""
    k = F.col("p_partkey")
    value = lambda v: F.when(v.isNotNull(), F.struct(v.alias("value")))
    meta = F.struct(value(F.when(k % 5 != 0, F.concat(F.lit("<a href='x'>Ann &amp; "), k, F.lit("</a>")))).alias("Artist"), value(F.when(k % 7 != 0, F.lit("CC BY 4.0"))).alias("LicenseShortName"), value(F.when(k % 3 == 0, F.lit("own"))).alias("License"), value(F.concat((k % 500 + 1700).cast("string"), F.lit("-05-06 07:08:09"))).alias("DateTimeOriginal"))
    info = F.struct(F.when(k % 11 == 0, "application/pdf").otherwise("image/jpeg").alias("mime"), F.lit("https://t").alias("thumburl"), F.when(k % 13 != 0, F.lit("https://o")).alias("descriptionurl"), (k % 9000).alias("width"), (k % 6000).alias("height"), meta.alias("extmetadata"))
    page = F.struct(k.alias("pageid"), F.concat(F.lit("File:"), "p_name").alias("title"), F.array(F.struct((k % 200 - 100.0).alias("lat"), (k % 300 - 150.0).alias("lon"))).alias("coordinates"), F.array(info).alias("imageinfo"))
    title = F.struct(F.when(k % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit("File:"), "p_name")).alias("title"))
    rows = table(spark, sf_dir, "part").groupBy(F.floor(k / 10).alias("body")).agg(F.array_sort(F.collect_list(F.struct(k, page.alias("p"), title.alias("t")))).alias("r"))
    wrap = lambda name, f: F.to_json(F.struct(F.struct(F.transform("r", lambda x: x[f]).alias(name)).alias("query")))
    return rows.select("body", wrap("search", "t").alias("search"), wrap("pages", "p").alias("details"))


@query("""SELECT p_partkey//10 AS body, p_partkey::VARCHAR AS id, p_name AS title, p_partkey%200 - 100e0 AS lat, p_partkey%300 - 150e0 AS lon, 'Ann & ' || p_partkey AS author, CASE WHEN p_partkey%7 <> 0 THEN 'CC BY 4.0' ELSE 'own' END AS licence,
CASE WHEN p_partkey%500 + 1700 BETWEEN 1826 AND 2200 THEN (p_partkey%500 + 1700)::INT END AS year, CASE WHEN p_partkey%9000 > 0 AND p_partkey%6000 > 0 THEN floor((p_partkey%9000)*(p_partkey%6000)/100000e0 + 0.5)/10 END AS megapixels FROM part
WHERE p_partkey%5 <> 0 AND (p_partkey%7 <> 0 OR p_partkey%3 = 0) AND p_partkey%11 <> 0 AND p_partkey%13 <> 0 AND abs(p_partkey%200 - 100) <= 90""")
def photo_search(spark, sf_dir):
    """Photographs of a details response; those without author, licence, place or links are dropped."""
    found = feeds.photo_details(photo_bodies(spark, sf_dir), "body", "details")
    return found.select("body", "id", "title", "lat", "lon", "author", "licence", F.year("taken").alias("year"), "megapixels")


@query("SELECT p_partkey//10 AS body, 'File:' || p_name AS title FROM part WHERE p_partkey%4 <> 0")
def photo_titles(spark, sf_dir):
    return feeds.search_titles(photo_bodies(spark, sf_dir), "body", "search").select("body", "title")


@query("""SELECT * FROM (SELECT p_partkey AS id, p_name AS title, p_partkey%4 AS accolade, p_size AS megapixels, row_number() OVER (ORDER BY p_partkey%4 DESC, p_size DESC, p_partkey) AS place FROM part) WHERE place <= 200""")
def standing_order(spark, sf_dir):
    """The two hundred photographs of the best standing: by accolade, then by size."""
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(p.alias("id"), F.col("p_name").alias("title"), (p % 4).alias("accolade"), F.col("p_size").alias("megapixels"))
    return spots_in_order(rows, 200)


def spots_in_order(rows: DataFrame, n: int) -> DataFrame:
    """rows (id, accolade, megapixels) of the best standing with their place; a row without either counts as 0."""
    order = [F.coalesce("accolade", F.lit(0)).desc(), F.coalesce("megapixels", F.lit(0)).desc(), F.col("id")]
    top = rows.orderBy(*order).limit(n).agg(F.collect_list(F.struct(*rows.columns)).alias("r"))  # n rows
    return top.select(F.posexplode("r").alias("place", "x")).select("x.*", (F.col("place") + 1).cast("long").alias("place"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey%3 = 0 THEN trim(c_name) ELSE 'Castle ' || c_custkey END AS name, CASE WHEN c_custkey%3 = 0 THEN 'Castle ' || c_custkey || ', Hill, Town' ELSE 'Hill, Town, Land' END AS detail, c_custkey%90 + 0e0 AS lat,
CASE WHEN c_custkey%400 - 100 < 180 THEN c_custkey%400 - 100 ELSE c_custkey%400 - 460 END::DOUBLE AS lon, CASE WHEN c_custkey%2 = 0 THEN 'castle' ELSE 'place' END AS kind, CASE WHEN c_custkey%5 <> 0 THEN [3e0, 1e0, 4e0, 2e0] END AS bounds FROM customer WHERE c_custkey%7 <> 0""")
def place_search(spark, sf_dir):
    """Places of a search: their names, what tells them apart, and boxes in the order used elsewhere."""
    k = F.col("c_custkey")
    box = F.when(k % 5 == 0, F.array(F.lit("1"), F.lit("x"), F.lit("3"), F.lit("4"))).otherwise(F.array(F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4")))
    place = F.struct(F.when(k % 7 == 0, "north").otherwise((k % 90).cast("string")).alias("lat"), (k % 400 - 100).cast("string").alias("lon"), F.when(k % 3 == 0, F.concat(F.col("c_name"), F.lit(" "))).alias("name"), F.concat(F.lit("Castle "), k, F.lit(", Hill , Town,Land, 12345")).alias("display_name"), F.when(k % 2 == 0, F.lit("castle")).alias("type"), box.alias("boundingbox"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.to_json(F.array(place)).alias("json"))
    return feeds.places_found(rows, "id", "json").drop("pos")


HEIGHT_SQL = "CASE WHEN p_partkey%3 = 0 AND p_size > 0 THEN p_size WHEN p_partkey%5 = 0 THEN p_partkey%40 + 1 WHEN p_partkey%7 <> 0 AND p_partkey%12 > 0 THEN (p_partkey%12)*3.2e0 ELSE 0 END::DOUBLE"


def building_rows(spark, sf_dir) -> DataFrame:
    """(id, render, measured, levels) of parts as texts of a tile's properties."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("id"), F.when(p % 3 == 0, F.col("p_size").cast("string")).otherwise("none").alias("render"), F.when(p % 5 == 0, (p % 40 + 1).cast("string")).alias("measured"), F.when(p % 7 == 0, "many").otherwise((p % 12).cast("string")).alias("levels")
    )


@query(f"SELECT p_partkey AS id, round({HEIGHT_SQL}, 6) AS height, NOT (p_partkey%3 = 0 AND p_size > 0 OR p_partkey%5 = 0) AS estimated FROM part")
def building_heights(spark, sf_dir):
    """Heights of buildings from what a tile carries, and whether they are guesses."""
    c = F.col
    return building_rows(spark, sf_dir).select("id", F.round(buildings.height(c("render"), c("measured"), c("levels")), 6).alias("height"), buildings.estimated(c("render"), c("measured")).alias("estimated"))


@query("""WITH b AS (SELECT c_custkey AS id, c_custkey%50/10e0 AS x, c_custkey%70/10e0 AS y, c_custkey%30*1000e0 AS m FROM customer), d AS (SELECT *, m/111320e0 AS dy, m/(111320e0*greatest(0.05e0, cos(radians(y)))) AS dx FROM b)
SELECT id, NOT (x + 0.5e0 < 2 OR x > 3 OR y + 0.2e0 < 1 OR y > 4) AS meets, x - dx >= 0 AND x + dx <= 5 AND y - dy >= 0 AND y + dy <= 7 AS holds, round(2 - m/(111320e0*cos(radians(2.5e0))), 6) AS west, round(4 + dy, 6) AS north FROM d""")
def box_predicates(spark, sf_dir):
    """Whether a footprint's box meets another, whether a disc lies inside one, and a box grown by metres."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey%50/10e0 AS x", "c_custkey%70/10e0 AS y", "c_custkey%30*1000e0 AS m")
    x, y, m = F.col("x"), F.col("y"), F.col("m")
    ring = F.array(F.array(x, y), F.array(x + 0.5, y), F.array(x + 0.3, y + 0.2))
    one = lambda *v: [F.lit(float(a)) for a in v]
    grown = buildings.padded(*one(2, 1, 3, 4), m)
    return rows.select("id", buildings.ring_meets_box(ring, *one(2, 1, 3, 4)).alias("meets"), buildings.disc_inside(y, x, m, *one(0, 0, 5, 7)).alias("holds"), F.round(grown["west"], 6).alias("west"), F.round(grown["north"], 6).alias("north"))


@query("""WITH b AS (SELECT l_suppkey AS spot, l_orderkey*10 + l_linenumber AS id, CASE WHEN l_partkey%9 = 0 THEN 0 ELSE l_quantity END AS h FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY h DESC, id) AS n, count(*) OVER (PARTITION BY spot) AS total FROM b),
s AS (SELECT *, h/tan(radians(spot%12 + 1e0)) AS raw, 300 + 1200*least(1, (spot%12 + 1)/20e0) AS cap FROM r WHERE n <= 120)
SELECT spot, count(*) FILTER (h > 0) AS cast_, count(*) FILTER (h <= 0) AS skipped, count(*) FILTER (h > 0 AND raw > cap) AS clipped, round(coalesce(max(least(raw, cap)) FILTER (h > 0), 0), 6) AS longest, greatest(0, any_value(total) - 120) AS omitted, count(*) FILTER (h > 0) AS features FROM s GROUP BY spot""")
def shadow_tally(spark, sf_dir):
    """Shadows of each spot's tallest buildings: how many are cast, skipped, clipped and left out, and the longest."""
    corner = lambda x, y: F.array(F.lit(float(x)), F.lit(float(y)))
    height = F.when(F.col("l_partkey") % 9 == 0, 0.0).otherwise(F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("spot"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), height.alias("height"), F.array(corner(0, 0), corner(8, 0), corner(8, 8), corner(0, 8)).alias("ring"))
    altitude = (F.col("spot") % 12 + 1).cast("double")
    cast, tally = buildings.shadow_set(rows, ["spot"], "height", "id", F.lit(123.0), altitude, 120)
    made = cast.select("spot", buildings.feature(F.col("shadow"), F.col("length"), F.lit(False)).alias("f")).groupBy("spot").agg(F.count("f").alias("features"))
    tally = tally.join(made, "spot", "left")
    return tally.select("spot", F.col("cast").alias("cast_"), "skipped", "clipped", F.round("longest", 6).alias("longest"), "omitted", F.coalesce("features", F.lit(0)).alias("features"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey%17 = 0 THEN '—' WHEN m < 1000 THEN floor(m + 0.5)::BIGINT || ' m' WHEN m < 9950 THEN printf('%.1f km', m/1000) ELSE floor(m/1000 + 0.5)::BIGINT || ' km' END AS label FROM (SELECT c_custkey, c_custkey*37%20000 + 0.25e0 AS m FROM customer)""")
def distance_labels(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), view.distance_label(F.when(k % 17 == 0, float("inf")).otherwise(k * 37 % 20000 + 0.25)).alias("label"))


BOX_SQL = "b AS (SELECT c_custkey AS id, c_custkey%340 - 170e0 AS west, c_custkey%340 - 170 + c_custkey%9*0.7e0 AS east, c_custkey%130 - 65e0 AS south, c_custkey%130 - 65 + c_custkey%7*0.5e0 AS north FROM customer)"
ROW_SQL = "floor((1 - asinh(tan(radians({0})))/pi())/2*pow(2, z))::BIGINT"
COLUMN_SQL = "floor(({0} + 180)/360*pow(2, z))::BIGINT"


def boxes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey%340 - 170e0 AS west", "c_custkey%340 - 170 + c_custkey%9*0.7e0 AS east", "c_custkey%130 - 65e0 AS south", "c_custkey%130 - 65 + c_custkey%7*0.5e0 AS north")


ZOOM_SQL = f"""c AS (SELECT id, z, ({COLUMN_SQL.format('east')} - {COLUMN_SQL.format('west')} + 1)*({ROW_SQL.format('south')} - {ROW_SQL.format('north')} + 1) AS tiles FROM b, range(7, 14) r(z)),
f AS (SELECT id, coalesce(max(z) FILTER (tiles <= 16), 7)::INT AS zoom, max(z) FILTER (tiles <= 16) IS NOT NULL AS fits FROM c GROUP BY id)"""


@query(f"WITH {BOX_SQL}, {ZOOM_SQL} SELECT f.id, zoom, tiles, fits FROM f JOIN c ON c.id = f.id AND c.z = f.zoom")
def tile_zooms(spark, sf_dir):
    """The closest zoom at which a box needs no more than sixteen tiles, and whether there is one."""
    return places.fitting_zoom(boxes(spark, sf_dir)).select("id", "zoom", "tiles", "fits")


@query(f"""WITH {BOX_SQL}, {ZOOM_SQL}, g AS (SELECT b.*, zoom AS z FROM b JOIN f USING (id)), y AS (SELECT *, unnest(range(greatest(0, {ROW_SQL.format('north')}), least(pow(2, z)::BIGINT - 1, {ROW_SQL.format('south')}) + 1)) AS y FROM g)
SELECT id, z AS zoom, unnest(range({COLUMN_SQL.format('west')}, {COLUMN_SQL.format('east')} + 1))%pow(2, z)::BIGINT AS x, y FROM y""")
def tile_cover(spark, sf_dir):
    """Every tile that a box touches at its zoom."""
    return places.tiles(places.fitting_zoom(boxes(spark, sf_dir))).select("id", "zoom", "x", "y")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey*7%180 - 90e0 AS a, p_partkey*100e0 AS scouted FROM part), r AS (SELECT *, least(1200, greatest(180, scouted*0.06e0)) AS radius FROM p)
SELECT id, radius, round(greatest(0, radius*cos(radians(a))), 6) AS ground, round(radius*sin(radians(a)), 6) AS up, CASE WHEN id < 2 THEN 1 ELSE greatest(1, floor(4.5e0/(360e0/id) + 0.5)) END::INT AS stride FROM r""")
def dome_points(spark, sf_dir):
    """Bodies on a dome over a place: its radius, the points, and how far dots stand apart."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey*7%180 - 90e0 AS a", "p_partkey*100e0 AS scouted").withColumn("radius", view.dome_radius(F.col("scouted")))
    point = view.dome_point(F.col("a"), F.col("radius"))
    return rows.select("id", "radius", F.round(point["ground"], 6).alias("ground"), F.round(point["up"], 6).alias("up"), view.dot_stride(F.col("id")).alias("stride"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value >= 50 AS up FROM events), m AS (SELECT *, lag(up) OVER (PARTITION BY user_id ORDER BY i) AS before FROM e),
n AS (SELECT *, sum(CASE WHEN before = up THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS run FROM m), g AS (SELECT user_id, run, any_value(up) AS above, min(i) AS f, max(i) AS t FROM n GROUP BY ALL),
h AS (SELECT *, lead(f) OVER (PARTITION BY user_id ORDER BY run) AS nf FROM g) SELECT user_id, run::INT AS run, above, f AS first_, coalesce(nf, t) AS last_ FROM h WHERE coalesce(nf, t) > f""")
def horizon_paths(spark, sf_dir):
    """A body's path cut at the horizon, each part with the first point of the next."""
    rows = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")).select("user_id", "i", (F.col("value") - 50).alias("altitude"))
    made = view.horizon_runs(rows, ["user_id"], "i", "altitude")
    return made.select("user_id", "run", "above", F.element_at("points", 1).alias("first_"), F.element_at("points", -1).alias("last_"))


FRAME_SQL = """f AS (SELECT p_partkey AS id, p_partkey*7%360 + 0.3e0 AS az, p_partkey*11%90 + 0.2e0 AS alt, p_partkey*13%360 + 0e0 AS aim, p_partkey%30 - 10e0 AS tilt, 20e0 + p_partkey%70 AS wide, 15e0 + p_partkey%50 AS high FROM part),
v AS (SELECT *, cos(radians(alt))*sin(radians(az - aim)) AS x, cos(radians(alt))*cos(radians(az - aim)) AS y, sin(radians(alt)) AS z FROM f), c AS (SELECT *, y*cos(radians(tilt)) + z*sin(radians(tilt)) AS ahead, z*cos(radians(tilt)) - y*sin(radians(tilt)) AS upward FROM v),
o AS (SELECT *, degrees(atan2(x, ahead)) AS across, degrees(atan2(upward, ahead)) AS up, ahead > 0 AS front FROM c), g AS (SELECT *, greatest(abs(across) - wide/2, abs(up) - high/2) AS gap FROM o),
t AS (SELECT *, CASE WHEN up >= 0 THEN ceil(degrees(atan2(z - tan(radians(high/2))*y, y + tan(radians(high/2))*z))*10)/10 ELSE floor(degrees(atan2(z + tan(radians(high/2))*y, y - tan(radians(high/2))*z))*10)/10 END AS tt FROM g),
u AS (SELECT *, y*cos(radians(tt)) + z*sin(radians(tt)) AS a2, z*cos(radians(tt)) - y*sin(radians(tt)) AS u2 FROM t)"""


@query(f"""WITH {FRAME_SQL} SELECT id, CASE WHEN front AND gap <= 0 THEN CASE WHEN gap > -1.5 THEN 'edge' ELSE 'in-frame' END WHEN NOT front THEN 'behind' WHEN gap <= 12 THEN 'just-outside' ELSE 'outside' END AS placement, front AND gap <= 0 AS inside,
floor(across*10 + 0.5)/10 AS across, floor(up*10 + 0.5)/10 AS up, floor(gap*10 + 0.5)/10 AS gap, CASE WHEN NOT (front AND gap <= 0) AND a2 > 0 AND abs(degrees(atan2(x, a2))) <= wide/2 AND abs(degrees(atan2(u2, a2))) <= high/2 THEN tt END AS tilt_to,
front AND gap <= 12 AND gap > -1.5 AS flare FROM u""")
def frame_placements(spark, sf_dir):
    """Where a body falls relative to a frame, how far from its edge, and the tilt that would bring it in."""
    p = "p_partkey"
    rows = table(spark, sf_dir, "part").selectExpr(f"{p} AS id", f"{p}*7%360 + 0.3e0 AS azimuth", f"{p}*11%90 + 0.2e0 AS altitude", f"{p}*13%360 + 0e0 AS aim", f"{p}%30 - 10e0 AS tilt", f"20e0 + {p}%70 AS wide", f"15e0 + {p}%50 AS high")
    return view.placed(rows).select("id", "placement", "inside", "across", "up", "gap", "tilt_to", "flare")


@query("SELECT p_partkey AS id, round(p_partkey*7%360 + 0e0, 5) AS azimuth, round(p_partkey*11%80 + 0e0, 5) AS altitude FROM part WHERE cos(radians(p_partkey%30 - 10e0))*cos(radians(p_partkey*11%80))*cos(radians(p_partkey*7%360 - p_partkey*13%360)) + sin(radians(p_partkey%30 - 10e0))*sin(radians(p_partkey*11%80)) > 1e-6")
def frame_inverse(spark, sf_dir):
    """Directions found again from where they fall on the image plane, for all that are ahead."""
    p = "p_partkey"
    rows = table(spark, sf_dir, "part").selectExpr(f"{p} AS id", f"{p}*7%360 + 0e0 AS az", f"{p}*11%80 + 0e0 AS alt", f"{p}*13%360 + 0e0 AS aim", f"{p}%30 - 10e0 AS tilt").withColumn("o", view.frame_offsets(F.col("az"), F.col("alt"), F.col("aim"), F.col("tilt")))
    back = view.frame_to_sky(F.col("o.across"), F.col("o.up"), F.col("aim"), F.col("tilt"))
    ahead = rows.where(F.cos(F.radians("tilt")) * F.cos(F.radians("alt")) * F.cos(F.radians(F.col("az") - F.col("aim"))) + F.sin(F.radians("tilt")) * F.sin(F.radians("alt")) > 1e-6)
    return ahead.select("id", F.pmod(F.round(back["azimuth"], 5), F.lit(360.0)).alias("azimuth"), F.round(back["altitude"], 5).alias("altitude"))


@query(f"""WITH c AS (SELECT c_custkey AS id, {SPOT} AS lat, c_custkey*7%360 - 180e0 AS lon, c_custkey*11%360 AS bearing, 20e0 + c_custkey%60 AS wide FROM customer), a AS (SELECT *, i, radians(bearing - wide/2 + i/12e0*wide) AS b, 9000/6371008.8e0 AS d FROM c, range(13) r(i))
SELECT id, i, round(degrees(asin(sin(radians(lat))*cos(d) + cos(radians(lat))*sin(d)*cos(b))), 6) AS lat, round(lon + degrees(atan2(sin(b)*sin(d)*cos(radians(lat)), cos(d) - sin(radians(lat))*(sin(radians(lat))*cos(d) + cos(radians(lat))*sin(d)*cos(b)))), 6) AS lon FROM a""")
def frame_wedges(spark, sf_dir):
    """Points of the arc that a frame spans nine kilometres out."""
    k = "c_custkey"
    rows = table(spark, sf_dir, "customer").selectExpr(f"{k} AS id", f"{SPOT} AS lat1", f"{k}*7%360 - 180e0 AS lon1", f"{k}*11%360 AS bearing", f"20e0 + {k}%60 AS wide")
    arcs = rows.select("id", "lat1", "lon1", F.posexplode(view.wedge_courses(F.col("bearing"), F.col("wide"), 12)).alias("i", "course"), F.lit(9000.0).alias("metres"))
    return geodesy.DIRECT.on(arcs).select("id", F.col("i").cast("long").alias("i"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"""WITH c AS (SELECT c_custkey AS id, {SPOT} AS lat, c_custkey*7%360 - 180e0 AS lon, c_custkey*11%720 - 360e0 AS bearing, (2000 + c_custkey%9000)/6371008.8e0 AS d FROM customer)
SELECT id, (bearing + 360)%360 AS bearing, 'LineString' AS kind, lat AS from_lat, round(degrees(asin(sin(radians(lat))*cos(d) + cos(radians(lat))*sin(d)*cos(radians(bearing)))), 6) AS lat, round(lon + degrees(atan2(sin(radians(bearing))*sin(d)*cos(radians(lat)), cos(d) - sin(radians(lat))*(sin(radians(lat))*cos(d) + cos(radians(lat))*sin(d)*cos(radians(bearing))))), 6) AS lon FROM c""")
def frame_axes(spark, sf_dir):
    """The line from each camera to where its lens points, read back from its feature."""
    k = "c_custkey"
    rows = table(spark, sf_dir, "customer").selectExpr(f"{k} AS id", f"{SPOT} AS lat1", f"{k}*7%360 - 180e0 AS lon1", f"{k}*11%720 - 360e0 AS course", f"2000e0 + {k}%9000 AS metres")
    made = geodesy.DIRECT.on(rows).withColumn("json", view.axis_feature(F.col("lon1"), F.col("lat1"), F.col("lon"), F.col("lat"), F.col("course")))
    read = F.from_json("json", "struct<type: string, properties: struct<bearing: double>, geometry: struct<type: string, coordinates: array<array<double>>>>")
    at = lambda i, j: F.get(F.get("j.geometry.coordinates", F.lit(i)), F.lit(j))
    return made.select("id", read.alias("j")).select("id", "j.properties.bearing", F.col("j.geometry.type").alias("kind"), at(0, 1).alias("from_lat"), F.round(at(1, 1), 6).alias("lat"), F.round(at(1, 0), 6).alias("lon"))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey%101/100e0 AS k, p_partkey%2 = 0 AS waxing, p_partkey*13%1500 AS cells, 28 + p_partkey%4 AS days, p_partkey%3*24 AS cols, p_partkey%5 AS n, p_partkey%4 AS m FROM part)
SELECT id, CASE WHEN cols > 0 THEN floor(cells/(days*cols)::DOUBLE*days + 0.5)::BIGINT ELSE 0 END AS days, 8*n + 8*m AS numbers, list_concat(list_transform(range(n), lambda i: i), list_transform(range(m), lambda i: i + n)) AS offsets, n + 2*m AS points,
'M 0 -12 A 12 12 0 0 ' || CASE WHEN waxing THEN 1 ELSE 0 END || ' 0 12 A ' || CASE WHEN k = 0.5 THEN '0.0' ELSE regexp_replace(regexp_replace(printf('%.4f', floor(12*abs(1 - 2*k)*10000 + 0.5)/10000), '0+$', ''), '[.]$', '.0') END || ' 12 0 0 ' || CASE WHEN waxing = (k > 0.5) THEN 1 ELSE 0 END || ' 0 -12' AS disc FROM p""")
def view_pieces(spark, sf_dir):
    """How far a forecast reaches into a month, a day's drawing joined to a minute's, and the moon's disc."""
    p = F.col("p_partkey")
    lines = lambda n: F.array_repeat(F.lit(0.5), (n * view.LINE_STRIDE).cast("int"))
    runs = lambda n: F.transform(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("offset"), F.lit(1).alias("count")))
    drawing = lambda n, points: F.struct(lines(n).alias("lines"), runs(n).alias("runs"), F.array_repeat(F.lit(1.0), points.cast("int")).alias("points"))
    rows = table(spark, sf_dir, "part").select(p.alias("id"), view.merged_geometry(drawing(p % 5, p % 5), drawing(p % 4, p % 4 * 2)).alias("g"), view.forecast_days(p * 13 % 1500, 28 + p % 4, p % 3 * 24).alias("days"), text.moon_disc(p % 101 / 100.0, p % 2 == 0).alias("disc"))
    return rows.select("id", "days", F.size("g.lines").alias("numbers"), F.transform("g.runs", lambda r: r["offset"]).alias("offsets"), F.size("g.points").alias("points"), "disc")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey%90 - 30 AS a, p_partkey%2 <> 0 AS lit, CASE WHEN p_partkey%7 <> 0 THEN (p_partkey*13%360 - p_partkey*5%360 + 540)%360 - 180 END AS o FROM part),
d AS (SELECT *, CASE WHEN o > 0 THEN 'right' WHEN o < 0 THEN 'left' END AS side, CASE WHEN a <= 0 THEN 'sun-down' WHEN NOT lit THEN 'in-shadow' WHEN o IS NULL THEN 'aim-unknown' END AS absence FROM p),
e AS (SELECT *, CASE WHEN absence IS NULL THEN CASE WHEN abs(o) <= 45 THEN CASE WHEN a <= 10 THEN 'rim' ELSE 'back' END WHEN abs(o) >= 135 THEN 'front' ELSE 'side' END END AS direction FROM d)
SELECT id, direction, absence, side, CASE absence WHEN 'sun-down' THEN 'the sun is down' WHEN 'in-shadow' THEN 'in shadow' WHEN 'aim-unknown' THEN 'lit, but the aim was never recorded' ELSE CASE direction WHEN 'side' THEN 'side-lit' || coalesce(' from the ' || side, '') ELSE direction || '-lit' END || ' · sun ' || abs(o) || '° off aim' || CASE WHEN direction = 'rim' THEN ', ' || a || '° up' ELSE '' END END AS note FROM e""")
def lighting(spark, sf_dir):
    """From where the sun falls on what a camera looks at, on which side, in words, or why that can't be told."""
    p = F.col("p_partkey")
    told = view.lighting(F.when(p % 7 != 0, (p * 5 % 360).cast("double")), (p * 13 % 360).cast("double"), (p % 90 - 30).cast("double"), p % 2 != 0)
    return table(spark, sf_dir, "part").select(p.alias("id"), told.alias("l")).select("id", "l.direction", "l.absence", "l.side", "l.note")


@query("""WITH e AS (SELECT event_id AS id, CASE WHEN event_id%5 > 0 THEN event_id*3%101 END AS low, CASE WHEN event_id%7 > 0 THEN event_id*11%101 END AS mid, CASE WHEN event_id%11 > 0 THEN event_id*17%101 END AS high, event_id%2000 AS minutes FROM events),
b AS (SELECT *, CASE WHEN low IS NULL AND mid IS NULL THEN NULL ELSE (1 - (1 - coalesce(low, 0)/100e0)*(1 - coalesce(mid, 0)/100e0))*100 END AS blocking FROM e),
u AS (SELECT id, deck, i, v FROM (SELECT id, 'low' AS deck, 0 AS i, low AS v FROM b UNION ALL SELECT id, 'mid', 1, mid FROM b UNION ALL SELECT id, 'high', 2, high FROM b) WHERE v IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, i) AS n FROM u), t AS (SELECT a.id, CASE WHEN a.v >= 10 AND (z.v IS NULL OR a.v - z.v >= 10) THEN a.deck END AS dominant FROM r a LEFT JOIN r z ON a.id = z.id AND z.n = 2 WHERE a.n = 1),
s AS (SELECT id, string_agg(CASE deck WHEN 'low' THEN 'low cloud ' WHEN 'mid' THEN 'mid-level cloud ' ELSE 'high cloud ' END || v || '%', ', ' ORDER BY n) AS parts FROM r GROUP BY id)
SELECT b.id, dominant, CASE WHEN parts IS NULL THEN '' ELSE upper(parts[1]) || substr(parts, 2) || '.' || CASE WHEN dominant = 'high' AND coalesce(blocking, 0) < 30 THEN ' Cirrus over a clear sun — shadows keep their edge, and there is something up there to take colour.'
WHEN dominant = 'low' THEN ' The sun is behind the lowest deck. Flat light, whatever the total says.' WHEN coalesce(blocking, 0) >= 70 THEN ' Enough low and mid cloud to take the direct sun out.' WHEN coalesce(blocking, 100) < 20 THEN ' Nothing much between the sun and the ground.' ELSE '' END END AS note,
concat_ws(' · ', (low - 20) || '°C', mid || '% cloud', CASE WHEN high >= 20 THEN high || '% rain' END) AS summary, CASE WHEN minutes < 90 THEN '' WHEN minutes < 1440 THEN 'forecast ' || floor(minutes/60e0 + 0.5)::BIGINT || ' h old' ELSE 'forecast ' || floor(minutes/1440e0 + 0.5)::BIGINT || ' d old' END AS age
FROM b LEFT JOIN t ON b.id = t.id LEFT JOIN s ON b.id = s.id""")
def weather_notes(spark, sf_dir):
    """The sky deck by deck in a sentence, an hour in one line, and how old a forecast is."""
    e = F.col("event_id")
    deck = lambda n, k: F.when(e % n > 0, (e * k % 101).cast("double"))
    rows = table(spark, sf_dir, "events").select(e.alias("id"), deck(5, 3).alias("low"), deck(7, 11).alias("mid"), deck(11, 17).alias("high"), (e % 2000).alias("minutes"))
    part = lambda c: 1 - F.coalesce(F.col(c), F.lit(0.0)) / 100
    blocking = F.when(F.col("low").isNotNull() | F.col("mid").isNotNull(), (1 - part("low") * part("mid")) * 100)
    made = view.cloud_note(F.col("low"), F.col("mid"), F.col("high"), blocking)
    return rows.select("id", made["dominant"].alias("dominant"), made["note"].alias("note"), view.hour_summary(F.col("low") - 20, F.col("mid"), F.col("high")).alias("summary"), view.staleness(F.lit(0), F.col("minutes") * 60).alias("age"))


@query(f"""WITH {H_SQL}, q AS (SELECT a."row", a.col, a.height AS nw, b.height AS ne, c.height AS sw, d.height AS se FROM h a JOIN h b ON b."row" = a."row" AND b.col = a.col + 1 JOIN h c ON c."row" = a."row" + 1 AND c.col = a.col JOIN h d ON d."row" = a."row" + 1 AND d.col = a.col + 1)
SELECT "row", col, 0 AS half, nw AS a, sw AS b, ne AS c FROM q UNION ALL SELECT "row", col, 1, ne, sw, se FROM q""")
def terrain_facets(spark, sf_dir):
    """Two triangles for each square of four known cells."""
    return places.facets(heights(spark, sf_dir), [])


@query(f"""WITH {H_SQL}, t AS (SELECT "row"//64*64 + "row"%64 AS r, col//64*64 + col%64 AS c, height FROM h) SELECT (r - r0)//2 AS "row", (c - c0)//2 AS col, height FROM t, (SELECT min("row"//64)*64 AS r0, min(col//64)*64 AS c0 FROM h) m WHERE (r - r0)%2 = 0 AND (c - c0)%2 = 0""")
def terrain_mosaic(spark, sf_dir):
    """A field put together from tiles of 64 samples, every second one kept."""
    cut = heights(spark, sf_dir).select(F.floor(F.col("col") / 64).alias("x"), F.floor(F.col("row") / 64).alias("y"), (F.col("row") % 64).alias("row"), (F.col("col") % 64).alias("col"), "height")
    return places.mosaic(cut, 64, 2)


@query(f"""WITH {H_SQL}, p AS (SELECT c_custkey AS id, c_custkey*7%256 AS r, c_custkey*13%256 AS c FROM customer), u AS (SELECT c_custkey*7%256 AS r, c_custkey*13%256 AS c, min(c_custkey) AS k FROM customer WHERE c_custkey%4 = 0 GROUP BY ALL)
SELECT id, coalesce(u.k + 0.5e0, h.height) AS height FROM p LEFT JOIN u ON p.r = u.r AND p.c = u.c LEFT JOIN h ON h."row" = p.r AND h.col = p.c""")
def raster_override(spark, sf_dir):
    """Heights from the first upload that covers a point, else from the world's field."""
    at = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey*7%256 AS row", "c_custkey*13%256 AS col")
    uploads = at.where("id % 4 = 0").select("row", "col", F.col("id").alias("rank"), (F.col("id") + 0.5).alias("height"))
    return places.first_covering(at, uploads, heights(spark, sf_dir)).select("id", "height")


@query(f"""WITH {H_SQL}, p AS (SELECT c_custkey AS id, c_custkey*7%256 AS r, c_custkey*13%256 AS c FROM customer), s AS (SELECT id, r, c, s AS k, floor(r - 0.4137e0*s + 0.5) AS rr, c + s AS cc FROM p, range(1, 257) q(s)),
a AS (SELECT id, 30e0*sqrt(1 + 0.4137e0*0.4137e0)*k AS m, height FROM s JOIN h ON h."row" = rr AND h.col = cc), b AS (SELECT p.id, coalesce(h.height, 0) AS own FROM p LEFT JOIN h ON h."row" = r AND h.col = c)
SELECT b.id, coalesce(bool_or(a.height - m*m/(2*7/6e0*6371008.8) > own + m*tan(radians(9e0))), FALSE) AS shaded FROM b LEFT JOIN a ON a.id = b.id GROUP BY b.id""")
def point_shadow(spark, sf_dir):
    """Whether ground nearer to the sun shades a point; one ray for each point."""
    at = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey*7%256 AS row", "c_custkey*13%256 AS col")
    own = at.join(heights(spark, sf_dir), ["row", "col"], "left").select("id", F.col("row").cast("double").alias("row"), F.col("col").cast("double").alias("col"), F.coalesce("height", F.lit(0.0)).alias("height"))
    azimuth = math.degrees(math.atan2(1.0, 0.4137))
    return places.shaded_at(own, heights(spark, sf_dir), F.lit(azimuth), F.lit(9.0), 30.0, 256).select("id", "shaded")


@query("""WITH a AS (SELECT p_partkey%3 AS spot, p_partkey%90 AS bin, max(p_size)*1e0 AS v FROM part GROUP BY ALL), w AS (SELECT spot, b AS bin, b/4e0 AS x FROM (SELECT DISTINCT spot FROM a), range(360) r(b))
SELECT w.spot, w.bin::INT AS bin, round(CASE WHEN x = floor(x) THEN l.v ELSE l.v + (h.v - l.v)*(x - floor(x)) END, 6) AS v FROM w LEFT JOIN a l ON l.spot = w.spot AND l.bin = floor(x) LEFT JOIN a h ON h.spot = w.spot AND h.bin = (floor(x)::INT + 1)%90""")
def profile_resample(spark, sf_dir):
    """A circular profile of 90 bins read at 360 bearings."""
    rows = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 3).alias("spot"), (F.col("p_partkey") % 90).cast("int").alias("bin")).agg((F.max("p_size") * 1.0).alias("v"))
    return places.resampled(rows, ["spot"], "v", 90, 360).select("spot", "bin", F.round("v", 6).alias("v"))
