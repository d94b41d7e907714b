"""Further queries: composed manifests, facets, rings and boxes, tiles, passes, tallies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumaframe.functions import colour, geodesy
from lumaframe.operators import archive, timeline

from .archive import photos, query, table
from .light import along_sql, E_SQL, SPOT, samples


@query()
def manifest(spark, sf_dir):
    """The whole build: chapters, small ones folded, paths through colour, chapters chained."""
    chapters = archive.split_chapters(photos(spark, sf_dir), "base").select("chapter", "id", "L", "a", F.col("b_").alias("b"))
    rows = chapters.join(archive.folded_chapters(chapters), "chapter").select(F.col("folded").alias("chapter"), "id", "L", "a", "b")
    ordered = rows.join(archive.path_order(rows, "chapter", "id"), ["chapter", "id"]).withColumn("rank", colour.chapter_rank(F.col("chapter")))
    return archive.chained(ordered, "chapter", "rank").select("rank", "chapter", "pos", "id")


@query("""SELECT facet, value, n FROM (SELECT 'camera' AS facet, CASE WHEN p_size%5 = 0 THEN 'Film' ELSE p_brand END AS value, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 2
UNION ALL SELECT 'lens', p_type, count(*), min(p_partkey) FROM part WHERE p_size%5 <> 0 GROUP BY 2 UNION ALL SELECT 'size', p_size::VARCHAR, count(*), min(p_partkey) FROM part WHERE p_size%5 <> 0 GROUP BY 2)
QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, f) <= 6""")
def insight_facets(spark, sf_dir):
    """The six most frequent values of several facets, film apart, in one pass over the rows."""
    film = F.col("p_size") % 5 == 0
    value = lambda name, v: F.struct(F.lit(name).alias("facet"), v.alias("value"))
    pairs = F.array(value("camera", F.when(film, "Film").otherwise(F.col("p_brand"))), value("lens", F.when(~film, F.col("p_type"))), value("size", F.when(~film, F.col("p_size").cast("string"))))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.inline(pairs)).where("value IS NOT NULL")
    counts = rows.groupBy("facet", "value").agg(F.count("*").alias("n"), F.min("p_partkey").alias("f"))
    return archive.latest_n(counts, ["facet"], [F.desc("n"), F.col("f")], 6).select("facet", "value", "n")


RING_SQL = f"(SELECT c_custkey AS id, {SPOT} AS lat1, c_custkey*7%360 - 180e0 AS lon1, k*22.5e0 AS course, 500e0*(c_custkey%900 + 1) AS metres, k FROM customer, range(16) r(k))"


def rings(spark, sf_dir):
    k = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")
    rows = table(spark, sf_dir, "customer").select("c_custkey", k).selectExpr("c_custkey AS id", f"{SPOT} AS lat1", "c_custkey*7%360 - 180e0 AS lon1", "k*22.5e0 AS course", "500e0*(c_custkey%900 + 1) AS metres", "k")
    return geodesy.DIRECT.on(rows)


@query(f"SELECT id, k, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {along_sql(RING_SQL)}")
def circle_rings(spark, sf_dir):
    """Sixteen points of a circle round each place; longitudes run on past 180."""
    return rings(spark, sf_dir).selectExpr("id", "cast(k as bigint) AS k", "round(lat, 6) AS lat", "round(lon, 6) AS lon")


@query(f"""WITH b AS (SELECT id, any_value(lat1) AS lat1, any_value(metres) AS metres, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM {along_sql(RING_SQL)} GROUP BY id),
p AS (SELECT *, radians(90 - lat1)*6371008.8e0 <= metres AS np, radians(90 + lat1)*6371008.8e0 <= metres AS sp FROM b)
SELECT id, round(CASE WHEN np OR sp THEN -180 ELSE west END, 6) AS west, round(CASE WHEN sp THEN -90 ELSE south END, 6) AS south, round(CASE WHEN np OR sp THEN 180 ELSE east END, 6) AS east, round(CASE WHEN np THEN 90 ELSE north END, 6) AS north FROM p""")
def bounding_boxes(spark, sf_dir):
    """Boxes round circles; one that holds a pole goes all the way round."""
    box = rings(spark, sf_dir).groupBy("id").agg(F.first("lat1").alias("lat1"), F.first("metres").alias("metres"), F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    box = box.withColumns({"np": F.radians(90 - F.col("lat1")) * geodesy.EARTH_M <= F.col("metres"), "sp": F.radians(90 + F.col("lat1")) * geodesy.EARTH_M <= F.col("metres")})
    pole = F.col("np") | F.col("sp")
    side = lambda cond, to, c, name: F.round(F.when(cond, F.lit(float(to))).otherwise(F.col(c)), 6).alias(name)
    return box.select("id", side(pole, -180, "w", "west"), side(F.col("sp"), -90, "s", "south"), side(pole, 180, "e", "east"), side(F.col("np"), 90, "n", "north"))


@query("""WITH b AS (SELECT c_custkey AS id, c_custkey%300 - 150e0 AS west, c_custkey%300 - 149.2e0 AS east FROM customer) SELECT id, unnest(range(floor((west+180)/360*512)::BIGINT, floor((east+180)/360*512)::BIGINT + 1))%512 AS x FROM b""")
def tile_columns(spark, sf_dir):
    """Columns of tiles at zoom 9 that boxes cover."""
    c = F.col("c_custkey")
    at = lambda lon: F.floor((lon + 180) / 360 * 512)
    return table(spark, sf_dir, "customer").select(c.alias("id"), F.explode(F.sequence(at(c % 300 - 150.0), at(c % 300 - 149.2))).alias("x")).select("id", (F.col("x") % 512).alias("x"))


@query(f"""WITH {E_SQL}, r AS (SELECT user_id, event_id, value - 50 AS off, abs(value - 50) <= 20 AS near, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS i FROM e),
m AS (SELECT *, lag(abs(off)) OVER w AS p, lead(abs(off)) OVER w AS n, i - row_number() OVER (PARTITION BY user_id, near ORDER BY i) AS isle FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i)),
s AS (SELECT user_id, isle, min(i) AS f, max(i) AS t FROM m WHERE near GROUP BY ALL),
b AS (SELECT m.user_id, m.i AS best, m.near AS meets, coalesce(s.f, m.i) AS f, coalesce(s.t, m.i) AS t FROM m LEFT JOIN s ON m.near AND m.user_id = s.user_id AND m.isle = s.isle WHERE (p IS NULL OR abs(off) < p) AND (n IS NULL OR abs(off) <= n))
SELECT b.user_id, best, meets, f AS "from", t AS "to", bool_or(r.off > 0) AND bool_or(r.off < 0) AS behind FROM b JOIN r ON r.user_id = b.user_id AND r.i BETWEEN f - 1 AND t + 1 GROUP BY ALL""")
def alignment_passes(spark, sf_dir):
    """Closest approaches of each series to a level, the window in which it touches, and whether it goes behind."""
    rows = samples(spark, sf_dir).withColumn("off", F.col("value") - 50)
    found = timeline.passes(rows, ["user_id"], ["at", "event_id"], "off", 20.0)
    return found.select("user_id", *[F.col(c).cast("long").alias(c) for c in ("best", "from", "to")], "meets", "behind")


@query("""SELECT n AS nation, c_custkey AS id, place FROM (SELECT c_nationkey AS n, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey%2 DESC, c_custkey%3 = 0 DESC, round(c_acctbal/1000) DESC, c_custkey) AS place FROM customer) WHERE place <= 8""")
def multi_key_rank(spark, sf_dir):
    """The eight best of each group by four keys."""
    rows = table(spark, sf_dir, "customer")
    order = [(F.col("c_custkey") % 2).desc(), (F.col("c_custkey") % 3 == 0).desc(), F.round(F.col("c_acctbal") / 1000).desc(), F.col("c_custkey")]
    return archive.latest_n(rows, ["c_nationkey"], order, 8).select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("place").cast("long").alias("place"))


@query("SELECT count(*) AS shared FROM (SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier))")
def shared_keys(spark, sf_dir):
    """Keys that two sides have in common."""
    a, b = table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")
    return a.intersect(b).agg(F.count("*").alias("shared"))


@query("SELECT user_id, event_id, round(value - min(value) OVER w, 6) AS above, round((value - min(value) OVER w)/coalesce(nullif(max(value) OVER w - min(value) OVER w, 0), 1), 6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)")
def min_max_scale(spark, sf_dir):
    """Values scaled to the range of their series; a constant series is 0."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    ends = Window.partitionBy("user_id")
    low, high = F.min("value").over(ends), F.max("value").over(ends)
    return rows.select("user_id", "event_id", F.round(F.col("value") - low, 6).alias("above"), F.round((F.col("value") - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0)), 6).alias("scaled"))
