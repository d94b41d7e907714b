"""Queries over feeds, texts, calendars, day plans and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaframe.functions import clock, colour, sky, text
from lumaframe.functions.formulas import keep_compiled
from lumaframe.operators import archive, itinerary, places, reports, timeline
from lumaframe.sources import feeds, presets, raws, sinks

from .archive import query, table

ENTITY_SQL = "html"
for _e, _c in (("&amp;", "&"), ("&quot;", '"'), ("&#039;", "''"), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">")):
    ENTITY_SQL = f"replace({ENTITY_SQL}, '{_e}', '{_c}')"
ENTITY_SQL = ENTITY_SQL.replace("html", "regexp_replace(html, '<[^>]*>', ' ', 'g')")


@query(f"SELECT page_id, trim(regexp_replace({ENTITY_SQL}, '\\s+', ' ', 'g')) AS plain FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.plain_text(F.col("html")).alias("plain"))


@query("SELECT c_custkey AS id, left(regexp_replace(c_name || ' / ' || c_mktsegment || '.x', '[^a-zA-Z0-9_-]+', '-', 'g'), 60) AS slug, lower(trim(regexp_replace(c_name || '   ' || c_mktsegment, '\\s+', ' ', 'g'))) AS key FROM customer")
def slugs(spark, sf_dir):
    name = lambda sep, end: F.concat("c_name", F.lit(sep), "c_mktsegment", F.lit(end))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.slug(name(" / ", ".x")).alias("slug"), text.query_key(name("   ", "")).alias("key"))


@query("""WITH d AS (SELECT o_orderkey AS id, '20' || lpad((o_orderkey%30)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey%14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey%33)::VARCHAR, 2, '0') AS day FROM orders)
SELECT id, day, try_cast(day AS DATE) IS NOT NULL AS valid FROM d""")
def calendar_dates(spark, sf_dir):
    part = lambda n: F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0")
    day = F.concat(F.lit("20"), part(30), F.lit("-"), part(14), F.lit("-"), part(33))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), day.alias("day"), text.is_calendar_date(day).alias("valid"))


@query("""SELECT p_partkey AS id, CASE WHEN p_brand = 'Brand#1' OR p_partkey%9 = 0 THEN 'film' WHEN p_partkey%4 = 0 THEN 'film' WHEN p_partkey%5 <> 0 THEN 'digital' ELSE 'film' END AS medium FROM part""")
def medium_guess(spark, sf_dir):
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        p.alias("id"), F.when(p % 4 != 0, "Maker 5").alias("camera"), F.when((F.col("p_brand") == "Brand#1") | (p % 9 == 0), "SilverFast 8").otherwise("Editor").alias("software"), (p % 5 != 0).alias("exposed")
    )
    return rows.select("id", text.medium(F.col("camera"), F.col("software"), F.col("exposed")).alias("medium"))


def bodies(spark, sf_dir):
    """(body, json): events in groups of 24 as a columnar forecast; every seventh time can't be read, every fifth value is missing."""
    e = table(spark, sf_dir, "events").withColumn("body", F.floor(F.col("event_id") / 24))
    hour = F.struct((F.col("event_id") % 24).alias("i"), F.when(F.col("event_id") % 7 == 0, "soon").otherwise(F.format_string("2026-03-%02dT%02d:00", (F.col("event_id") % 28 + 1).cast("int"), (F.col("event_id") % 24).cast("int"))).alias("t"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    packed = e.groupBy("body").agg(F.array_sort(F.collect_list(hour)).alias("h"))
    pick = lambda f: F.transform("h", lambda x: x[f])
    hourly = F.struct(pick("t").alias("time"), pick("v").alias("cloud_cover"), F.slice(pick("v"), 1, 3).alias("cloud_cover_low"))
    good = F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"})
    return packed.select("body", F.when(F.col("body") % 11 == 0, F.lit("{}")).when(F.col("body") % 13 == 0, F.lit("not json")).otherwise(good).alias("json"))


@query("""WITH o AS (SELECT event_id//24 AS body, event_id, value, row_number() OVER (PARTITION BY event_id//24 ORDER BY event_id%24) AS place FROM events)
SELECT body, event_id, epoch(make_timestamp(2026, 3, event_id%28 + 1, event_id%24, 0, 0.0)) AS time, CASE WHEN event_id%5 <> 0 THEN value END AS cloud, CASE WHEN place <= 3 AND event_id%5 <> 0 THEN value END AS low
FROM o WHERE event_id%7 <> 0 AND body%11 <> 0 AND body%13 <> 0""".replace("body, event_id, epoch", "body, epoch"))
def json_columnar_forecast(spark, sf_dir):
    return feeds.forecast(bodies(spark, sf_dir), "body", "json").select("body", "time", "cloud", "low")


@query("""SELECT p_partkey AS id, epoch(TIMESTAMP '2026-08-16 18:00:00') + 3600*k AS time, (p_partkey%9)::INT AS seeing, (p_partkey*k%10)::INT AS transparency FROM part, (VALUES (3), (6), (9)) v(k)
WHERE p_partkey%9 BETWEEN 1 AND 8 AND p_partkey*k%10 BETWEEN 1 AND 8""")
def seeing_feed(spark, sf_dir):
    p = F.col("p_partkey")
    series = F.transform(F.array(F.lit(3), F.lit(6), F.lit(9)), lambda k: F.struct(k.alias("timepoint"), (p % 9).alias("seeing"), (p * k % 10).alias("transparency")))
    rows = table(spark, sf_dir, "part").select(p.alias("id"), F.to_json(F.struct(F.lit("2026081618").alias("init"), series.alias("dataseries"))).alias("json"))
    return feeds.seeing(rows, "id", "json")


@query("""SELECT c_custkey AS id, CASE WHEN abs(c_custkey%120 - 20) <= 85 THEN c_custkey%120 - 20 END::DOUBLE AS lat, CASE WHEN abs(c_custkey%120 - 20) <= 85 AND c_custkey%60 BETWEEN 1 AND 50 THEN c_custkey%60 END::BIGINT AS radius,
CASE WHEN abs(c_custkey%120 - 20) <= 85 THEN trim(c_name) END AS name, CASE WHEN abs(c_custkey%120 - 20) <= 85 AND c_custkey%1500 <= 1440 THEN c_custkey%1500 END::BIGINT AS minute, CASE WHEN abs(c_custkey%120 - 20) <= 85 AND c_custkey%3 = 0 THEN 'Europe/London' END AS zone, CASE WHEN abs(c_custkey%120 - 20) <= 85 AND c_custkey%4 = 0 THEN '2026-03-01' END AS day FROM customer""")
def link_codec(spark, sf_dir):
    """Links written and read again."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), feeds.to_link((k % 120 - 20).cast("double"), (k % 360 - 180).cast("double"), k % 60, F.when(k % 4 == 0, "2026-03-01").otherwise("2026-02-30"), k % 1500, F.when(k % 3 == 0, "Europe/London").otherwise("Mars/Base"), F.col("c_name")).alias("q"))
    return rows.select("id", feeds.link(F.col("q")).alias("l")).select("id", "l.lat", F.col("l.radius").cast("long").alias("radius"), "l.name", F.col("l.minute").cast("long").alias("minute"), F.col("l.time_zone").alias("zone"), F.col("l.date").alias("day"))


def places_months(spark, sf_dir):
    """(place, lat, lon, zone, month): for each nation a month of 2026 and a zone; some months are none."""
    k = F.col("n_nationkey")
    zone = F.when(k % 2 == 0, "Europe/London").when(k % 3 == 0, "Asia/Kolkata").otherwise("UTC")
    month = F.concat(F.lit("2026-"), F.lpad((k * 5 % 14 + 1).cast("string"), 2, "0"))
    return table(spark, sf_dir, "nation").select(k.alias("place"), (k * 13 % 110 - 55.0).alias("lat"), (k * 7 % 360 - 180.0).alias("lon"), zone.alias("zone"), month.alias("month"))


#: The year's two changes of the clocks are written out; other zones of places_months keep one offset.
MONTH_SQL = """n AS (SELECT n_nationkey AS place, n_nationkey*13%110 - 55e0 AS lat, n_nationkey*7%360 - 180e0 AS lon, n_nationkey*5%14 + 1 AS month, n_nationkey%2 = 0 AS london, CASE WHEN n_nationkey%2 <> 0 AND n_nationkey%3 = 0 THEN 330 ELSE 0 END AS ahead FROM nation),
d AS (SELECT n.*, unnest(generate_series(make_date(2026, month, 1), (make_date(2026, month, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE, INTERVAL 1 DAY))::DATE AS day FROM n WHERE month <= 12),
g AS (SELECT d.*, minute, CASE WHEN london AND day = DATE '2026-03-29' AND minute BETWEEN 60 AND 119 THEN NULL ELSE day::TIMESTAMP + to_minutes(minute - ahead
  - CASE WHEN london AND ((day > DATE '2026-03-29' AND day < DATE '2026-10-25') OR (day = DATE '2026-03-29' AND minute >= 120) OR (day = DATE '2026-10-25' AND minute < 120)) THEN 60 ELSE 0 END) END AS instant FROM d, range(0, 1440, 30) v(minute))"""


@query(f"""WITH {MONTH_SQL} SELECT place, day, minute::INT AS minute, instant AS "at" FROM g""")
def month_grid(spark, sf_dir):
    """Each nation's month by the half hour on its own clock, through changes of the clocks."""
    grid = clock.month_grid(places_months(spark, sf_dir), list(range(0, 1440, 30)))
    return grid.select("place", "day", "minute", F.col("at").cast("timestamp_ntz").alias("at"))


def plan_spots(spark, sf_dir):
    """(plan, pos, lat, lon, best, windows): all customers of a nation as spots of a day."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("plan"), k.cast("int").alias("pos"), (F.lit(55.9) + k % 13 / 100).alias("lat"), (F.lit(-3.2) + k % 17 / 100).alias("lon"), (F.lit(400) + k * 37 % 500).cast("int").alias("best"),
        F.array(F.struct((F.lit(380) + k * 31 % 300).cast("int").alias("start"), (F.lit(380) + k * 31 % 300 + k * 7 % 90).cast("int").alias("end")), F.struct((F.lit(800) + k % 100).cast("int").alias("start"), (F.lit(860) + k % 200).cast("int").alias("end"))).alias("windows"),
    )
    return rows


def day_spots(spark, sf_dir):
    """plan_spots in plans of MOST customers with consecutive keys, so that none is left out."""
    return plan_spots(spark, sf_dir).withColumn("plan", F.floor(F.col("pos") / itinerary.MOST))


@query()
def day_plan(spark, sf_dir):
    """The best day of every plan."""
    return itinerary.day_plans(day_spots(spark, sf_dir)).select("plan", F.transform("stops", lambda s: F.struct(s["pos"].alias("pos"), s["start"].alias("start"))).alias("stops"), "scheduled", "off_best", "metres")


@query("""WITH s AS (SELECT c_nationkey AS plan, c_custkey::INT AS pos, (400 + c_custkey*37%500)::INT AS best FROM customer)
SELECT a.plan, a.pos AS a, b.pos AS b FROM s a JOIN s b ON a.plan = b.plan AND a.pos < b.pos AND abs(a.best - b.best) < 20""")
def plan_conflicts(spark, sf_dir):
    """Stops of a nation whose best minutes are too close for a visit to both; every customer is a stop."""
    return itinerary.clashes(plan_spots(spark, sf_dir))


@query()
def itinerary_report(spark, sf_dir):
    """The best day of every plan as text, with all that is left out and all clashes."""
    spots = day_spots(spark, sf_dir)
    named = spots.select("plan", "pos", "lat", "lon", F.concat(F.lit("Customer "), F.col("pos").cast("string")).alias("name"))
    return reports.itinerary_reports(itinerary.day_plans(spots), named, itinerary.conflicts(spots), F.lit("Sun 1 Mar"), 1_772_323_200, "UTC")


@query(f"""WITH s AS (SELECT s_suppkey AS id, s_suppkey*13%110 - 55e0 AS lat, s_suppkey*7%360 - 180e0 AS lon, 1772366400e0 AS t FROM supplier), d AS (SELECT id, lat, lon, solar_noon, sunrise, sunset FROM {sky.DAY.sql('s')} x),
m AS (SELECT *, floor((sunrise - 1772323200)/60)::BIGINT%1440 AS a, floor((sunset - 1772323200)/60)::BIGINT%1440 AS b, floor((solar_noon - 1772323200)/60)::BIGINT%1440 AS n FROM d),
w AS (SELECT *, lpad((((a + 1440)%1440)//60)::VARCHAR, 2, '0') || ':' || lpad((((a + 1440)%1440)%60)::VARCHAR, 2, '0') AS ra, lpad((((b + 1440)%1440)//60)::VARCHAR, 2, '0') || ':' || lpad((((b + 1440)%1440)%60)::VARCHAR, 2, '0') AS rb, lpad((((n + 1440)%1440)//60)::VARCHAR, 2, '0') || ':' || lpad((((n + 1440)%1440)%60)::VARCHAR, 2, '0') AS rn FROM m)
SELECT id, 'Supplier ' || id || ' — Sun 1 Mar' || chr(10) || printf('%.5f, %.5f', lat, lon) || chr(10) || chr(10) || 'Sunrise     ' || coalesce(ra, '—') || chr(10) || 'Solar noon  ' || rn || chr(10) || 'Sunset      ' || coalesce(rb, '—') || chr(10) || 'Daylight    ' || coalesce(ra || '–' || rb, '—') || chr(10) || chr(10)
  || CASE WHEN id%3 = 0 THEN 'A note of its own.' || chr(10) || chr(10) ELSE '' END || 'Times are local to UTC.' || chr(10) || 'Sun and moon are computed; shadows are modelled' || CASE WHEN id%4 = 0 THEN ' — guessed.' ELSE ', not measured.' END AS report FROM w""")
def shoot_plans(spark, sf_dir):
    """The day of each supplier as text: its events, a note if there is one, and how far it can be trusted."""
    s = F.col("s_suppkey")
    spots = table(spark, sf_dir, "supplier").select(s.alias("id"), (s * 13 % 110 - 55.0).alias("lat"), (s * 7 % 360 - 180.0).alias("lon"), F.lit(1_772_366_400.0).alias("t"))
    minute = lambda c: F.pmod(F.floor((F.col(c) - 1_772_323_200) / 60), F.lit(1440))
    row = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    rise, set_ = minute("sunrise"), minute("sunset")
    events = F.array(row("Sunrise", reports.span(rise)), row("Solar noon", reports.span(minute("solar_noon"))), row("Sunset", reports.span(set_)), row("Daylight", reports.span(rise, set_)))
    k = F.col("id")
    notes, caveat = F.array(F.when(k % 3 == 0, "A note of its own.")), F.when(k % 4 == 0, "guessed.")
    made = reports.shoot_plan(F.concat(F.lit("Supplier "), k.cast("string")), F.lit("Sun 1 Mar"), F.col("lat"), F.col("lon"), events, notes, F.lit("UTC"), caveat)
    return sky.DAY.on(spots).select("id", made.alias("report"))


@query("""SELECT p_brand AS brand, '[' || string_agg('{"p_partkey":' || p_partkey || ',"p_size":' || p_size || '}', ',' ORDER BY p_partkey) || ']' AS body FROM part GROUP BY 1""")
def sequence_export(spark, sf_dir):
    """Every part in its brand's sequence."""
    rows = table(spark, sf_dir, "part").withColumn("brand", F.col("p_brand")).withColumn("pos", F.col("p_partkey"))
    return sinks.sequence_json(rows, "brand", "p_brand", "pos", ["p_partkey", "p_size"]).select("brand", "body")


@query("""WITH w AS (SELECT n_regionkey AS region, n_name, n_nationkey, max(length(n_name)) OVER (PARTITION BY n_regionkey) AS w FROM nation)
SELECT region, string_agg(rpad(n_name, w + 2, ' ') || 'nation ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS report FROM w GROUP BY 1""".replace("w + 2", "(w + 2)::INT"))
def aligned_report(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), "n_nationkey", "n_name", F.concat(F.lit("nation "), "n_nationkey").alias("note"))
    return sinks.aligned(rows, "region", "n_nationkey", "n_name", "note")


@query("""SELECT p_partkey AS id, '<rdf:Description' || chr(10) || '  crs:Exposure="' || p_size || '"' || CASE WHEN p_partkey%3 = 0 THEN '' ELSE chr(10) || '  crs:Name="&lt;' || p_brand || ' &amp; &quot;' || p_type || '&quot;&gt;"' END || '/>' AS preset FROM part""")
def preset_text(spark, sf_dir):
    fields = {"Exposure": F.col("p_size"), "Name": F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("<"), "p_brand", F.lit(' & "'), "p_type", F.lit('">')))}
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), sinks.preset(fields).alias("preset"))


def part_grades(spark, sf_dir):
    """(id, name, and the fields of a grade) of parts, by arithmetic on their keys."""
    p = F.col("p_partkey")
    wheel = lambda a, b: F.struct((p * a % 360).alias("hue"), F.greatest(F.lit(0), p * b % 70 - 30).alias("sat"), (p % 5 - 2).alias("lum"))
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), y.cast("double").alias("y"))
    mask = lambda kind, label: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), (p % 9 / 8.0 - 0.5).alias("exposure"), (p % 41 - 20.0).alias("temp"), (p % 23 - 11.0).alias("tint"), (p % 31 - 15.0).alias("saturation"), F.lit(0.0).alias("contrast"))
    masks = F.when(p % 3 == 0, F.array(mask("sky", "Sky & <sun>"), mask("manual", "Skin"), mask("subject", "Subject"))).when(p % 3 == 1, F.array(mask("manual", "Hair"))).otherwise(F.array(mask("manual", "")).cast("array<struct<kind:string,label:string,exposure:double,temp:double,tint:double,saturation:double,contrast:double>>"))
    mix = F.array(*[F.struct(*[F.when(p % 4 == 0, 0.0).otherwise((p * k + n) % 60 - 30.0).alias(c) for n, c in enumerate(("hue", "sat", "lum"))]) for k in range(3, 11)])
    name = F.concat("p_name", F.when(p % 5 == 0, F.lit(" 🌅 \"dusk\"")).when(p % 5 == 1, F.lit(" <é>")).otherwise(""))
    return table(spark, sf_dir, "part").select(
        p.alias("id"), name.alias("name"), (p % 13 / 4.0 - 1.5).alias("exposure"), (p % 3 - 1.0).alias("texture"), (p % 7 - 3.0).alias("vibrance"), (p % 11 - 5.5).alias("saturation"), mix.alias("mix"),
        F.when(p % 2 == 0, wheel(7, 11)).otherwise(wheel(0, 0)).alias("shadow"), F.when(p % 2 == 0, wheel(5, 3)).otherwise(wheel(0, 0)).alias("midtone"), wheel(0, 0).alias("highlight"), wheel(0, 0).alias("global"), (p % 21 - 10.0).alias("balance"), F.lit(50.0).alias("blending"),
        F.greatest(F.lit(0), p % 50 - 25).alias("grain"), F.lit(25.0).alias("grain_size"), F.lit(50.0).alias("roughness"), F.greatest(F.lit(0), p % 40 - 30).alias("noise"), (p % 4 * 10.0).alias("vignette"),
        F.array(point(0, F.lit(0)), point(100, F.when(p % 5 < 2, F.lit(100.4)).otherwise(100 + p % 30)), point(255, F.lit(255))).alias("curve"), masks.alias("masks"),
    )


@query()
def preset_files(spark, sf_dir):
    """The preset of each part's grade with the masks that can be made again, and one without masks that always loads."""
    rows = timeline.dealt_out(part_grades(spark, sf_dir))  # a small file would be one task
    keep_compiled(spark)
    grade = {c: F.col(c) for c in rows.columns if c not in ("id", "name")}
    rows = rows.withColumn("mark", text.identity_of(F.concat("name", F.lit("#"), F.col("id").cast("string"))))
    made = [presets.xmp(grade, F.col("name"), F.lit("Parts"), F.col("mark"), masks) for masks in (True, False)]
    return rows.select("id", F.when(F.size(presets.usable_masks(F.col("masks"))) > 0, made[0]).alias("full"), made[1].alias("safe"))


@query("""WITH n AS (SELECT p_partkey AS id, p_name || CASE p_partkey%5 WHEN 0 THEN ' 🌅 "dusk"' WHEN 1 THEN ' <é>' ELSE '' END || '#' || p_partkey AS name FROM part),
u AS (SELECT id, flatten(list_transform(range(1, length(name) + 1), lambda i: CASE WHEN unicode(substr(name, i, 1)) > 65535 THEN [55296 + ((unicode(substr(name, i, 1)) - 65536) >> 10), 56320 + ((unicode(substr(name, i, 1)) - 65536) & 1023)] ELSE [unicode(substr(name, i, 1))] END)) AS units FROM n),
h AS (SELECT id, salt, list_reduce(list_prepend(CASE salt WHEN 0 THEN 2166136261 WHEN 1 THEN 522970236 WHEN 2 THEN 3178393271 ELSE 1538978030 END, list_transform(units, lambda x: x::BIGINT)), lambda a, b: xor(a, b)*16777619 % 4294967296) AS h FROM u, range(4) r(salt))
SELECT id, string_agg(upper(lpad(printf('%x', h), 8, '0')), '' ORDER BY salt) AS mark FROM h GROUP BY id""")
def preset_marks(spark, sf_dir):
    """The stable identity of each preset, also of names beyond the basic plane."""
    rows = part_grades(spark, sf_dir).select("id", F.concat("name", F.lit("#"), F.col("id").cast("string")).alias("seed"))
    return rows.select("id", text.identity_of(F.col("seed")).alias("mark"))


def containers(spark, sf_dir):
    """(id, payload): a container of each supplier, with a thumbnail, false beginnings, and a preview or two of its own size or none."""
    s = F.col("s_suppkey")
    kind = s % 6
    fill = lambda n: F.repeat(F.lit("raw."), n.cast("int")).cast("binary")
    image = lambda n: F.concat(F.unhex(F.lit("FFD8FFE0")), F.repeat(F.lit("jpeg"), n.cast("int")).cast("binary"), F.unhex(F.lit("FFD9")))
    none, large = F.lit("").cast("binary"), F.lit(51_200) + s * 7 % 9000
    thumb = F.concat(fill(s % 300), image(F.lit(500) + s % 40), fill(F.lit(100)))
    preview = F.when(kind == 0, none).when(kind == 1, image(large)).when(kind == 2, F.concat(image(large), fill(s % 50), image(large))).when(kind == 3, F.concat(image(large), image(large + 1000))).when(kind == 4, image(F.lit(51_198)))
    preview = F.coalesce(preview, F.concat(F.unhex(F.lit("FFD8FF")), fill(F.lit(30)), image(large)))  # a beginning inside which another stands
    return table(spark, sf_dir, "supplier").select(s.alias("id"), F.concat(thumb, preview, F.unhex(F.lit("FFD8FFDB")), fill(F.lit(200))).alias("payload"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_suppkey%6 AS kind, 51200 + s_suppkey*7%9000 AS large, 4*(s_suppkey%300) + 4*(500 + s_suppkey%40) + 6 + 400 AS begin FROM supplier),
f AS (SELECT id, CASE WHEN kind IN (1, 2, 5) THEN begin WHEN kind = 3 THEN begin + 4*large + 6 END AS "offset", CASE WHEN kind IN (1, 2) THEN 4*large + 6 WHEN kind = 3 THEN 4*(large + 1000) + 6 WHEN kind = 5 THEN 4*large + 6 + 123 END AS n FROM s)
SELECT id, "offset"::BIGINT AS "offset", n::BIGINT AS length FROM f""")
def raw_previews(spark, sf_dir):
    """Where the preview of each container is; thumbnails and images just under the least size are none."""
    return raws.embedded_previews(containers(spark, sf_dir), "id", "payload", piece=1 << 16)


@query("""WITH b AS (SELECT p_partkey AS id, p_partkey%100 - 50 + 0e0 AS x, p_partkey*7%100 - 50 + 0e0 AS y FROM part), e AS (SELECT * FROM (VALUES (40e0, 0e0, 0e0, 40e0), (0e0, 40e0, -40e0, 0e0), (-40e0, 0e0, 0e0, -40e0), (0e0, -40e0, 40e0, 0e0)) v(ax, ay, bx, by_))
SELECT id, count(*) FILTER (ay <= y AND y < by_ AND (x - ax)*(by_ - ay) < (y - ay)*(bx - ax) OR by_ <= y AND y < ay AND (x - ax)*(by_ - ay) > (y - ay)*(bx - ax))%2 = 1 AS inside, any_value(abs(x) <= 25 AND abs(y) <= 25) AS boxed FROM b, e GROUP BY id""")
def ring_and_box(spark, sf_dir):
    """Points inside a diamond, by crossings, and inside a box."""
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(corner(40, 0), corner(0, 40), corner(-40, 0), corner(0, -40))
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey%100 - 50 + 0e0 AS x", "p_partkey*7%100 - 50 + 0e0 AS y")
    return rows.select("id", places.in_ring(ring, F.col("x"), F.col("y")).alias("inside"), ((F.abs("x") <= 25) & (F.abs("y") <= 25)).alias("boxed"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey%90 - 30 <= 0 THEN 'sun-down' WHEN p_partkey%2 = 0 THEN 'in-shadow' WHEN p_partkey%7 = 0 THEN 'aim-unknown' WHEN d <= 45 THEN CASE WHEN p_partkey%90 - 30 <= 10 THEN 'rim' ELSE 'back' END WHEN d >= 135 THEN 'front' ELSE 'side' END AS direction
FROM (SELECT p_partkey, abs(((p_partkey*13%360 - p_partkey*5%360) + 540)%360 - 180) AS d FROM part)""")
def light_direction(spark, sf_dir):
    """From where the sun falls on what the camera looks at, or why that can't be told."""
    p = F.col("p_partkey")
    off = F.abs(colour.signed_delta_low((p * 13 % 360).cast("double"), (p * 5 % 360).cast("double")))
    up = p % 90 - 30
    told = F.when(off <= 45, F.when(up <= 10, "rim").otherwise("back")).when(off >= 135, "front").otherwise("side")
    made = F.when(up <= 0, "sun-down").when(p % 2 == 0, "in-shadow").when(p % 7 == 0, "aim-unknown").otherwise(told)
    return table(spark, sf_dir, "part").select(p.alias("id"), made.alias("direction"))


@query("""SELECT p_partkey AS id, round(CASE WHEN a <= -6 THEN 0.1 WHEN a <= 0 THEN 0.1 + 0.4*(a+6)/6 WHEN a <= 20 THEN 0.5 + 0.5*a/20 ELSE 1 END, 6) AS light, round((greatest(y1, y2)+0.05)/(least(y1, y2)+0.05), 6) AS contrast
FROM (SELECT p_partkey, p_partkey%60 - 20e0 AS a, p_partkey%10/10e0 AS y1, p_partkey%7/7e0 AS y2 FROM part)""")
def ramps_and_contrast(spark, sf_dir):
    p = F.col("p_partkey")
    light = colour.ramp((p % 60 - 20).cast("double"), [(-6, 0.1), (0, 0.5), (20, 1.0)])
    ratio = colour.contrast_ratio(p % 10 / 10.0, p % 7 / 7.0)
    return table(spark, sf_dir, "part").select(p.alias("id"), F.round(light, 6).alias("light"), F.round(ratio, 6).alias("contrast"))


@query("""SELECT k, any_value(h) AS h, min(id) AS id FROM (SELECT c_custkey AS id, round(c_custkey%50/7e0, 6) || '/' || c_custkey%3 AS k, c_custkey%3 AS h FROM customer) GROUP BY k""".replace("round(c_custkey%50/7e0, 6) ||", "printf('%.6f', c_custkey%50/7e0) ||"))
def rounded_key_distinct(spark, sf_dir):
    """One record for each rounded position and height."""
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(c.alias("id"), F.concat(F.format_string("%.6f", c % 50 / 7.0), F.lit("/"), c % 3).alias("k"), (c % 3).alias("h"))
    return archive.keep_first(rows, ["k"], [F.col("id")]).select("k", "h", "id")
