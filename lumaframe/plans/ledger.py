"""Queries over audits and repairs, records and caches, comparisons, names and small functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions import clock, colour, text, vectors
from lumaframe.operators import archive, buildings, grade, ledger, pixels, places, terrain, texture, timeline

from .archive import query, table
from .light import E_SQL, TOWN, samples, town


def store_of(spark, sf_dir, shift: int, board: bool) -> DataFrame:
    """(id, width, derivatives) of parts; some declare files of a stale format, some lack sizes."""
    p = F.col("p_partkey")
    file = lambda tag, fmt: F.struct(F.lit(tag).alias("tag"), F.concat(F.lit("f"), p, F.lit(f"-{tag}.{fmt}")).alias("file"), F.lit(fmt).alias("format"))
    listed = F.array_compact(F.array(F.when(p % 3 != 0, file("640", "avif")), F.when(p % 4 != 0, file("1280", "avif")), F.when(p % 5 == 0, file("640", "webp")), F.when(p % 7 == 0, file("2000", "avif"))))
    rows = table(spark, sf_dir, "part").where(f"p_partkey % 2 = {int(board)}")
    return rows.select(p.alias("id"), ((p * 13 + shift) % 2600).alias("width"), listed.alias("derivatives"))


def files_of(spark, sf_dir) -> DataFrame:
    """Files that are present: two of three that parts may have, some that nobody owns, and a hidden one."""
    p = F.col("p_partkey")
    names = F.array(F.concat(F.lit("f"), p, F.lit("-640.avif")), F.concat(F.lit("f"), p, F.lit("-1280.avif")), F.when(p % 50 == 0, F.concat(F.lit("."), p)))
    return table(spark, sf_dir, "part").where("p_partkey % 11 <> 0").select(F.explode(F.array_compact(names)).alias("file"))


OWNED_SQL = """st AS (SELECT CASE WHEN p_partkey%2 = 0 THEN 'archive' ELSE 'board' END AS owner, p_partkey AS id, (p_partkey*13 + CASE WHEN p_partkey%2 = 0 THEN 0 ELSE 100 END)%2600 AS width FROM part),
dv AS (SELECT id, tag, 'f' || id || '-' || tag || '.' || fmt AS file, fmt AS format FROM st, (VALUES ('640', 'avif', 1), ('1280', 'avif', 2), ('640', 'webp', 3), ('2000', 'avif', 4)) v(tag, fmt, k) WHERE k = 1 AND id%3 <> 0 OR k = 2 AND id%4 <> 0 OR k = 3 AND id%5 = 0 OR k = 4 AND id%7 = 0),
th AS (SELECT 'f' || p_partkey || '-' || t || '.avif' AS file FROM part, (VALUES ('640'), ('1280')) v(t) WHERE p_partkey%11 <> 0),
ex AS (SELECT id, t AS tag FROM st, (VALUES (640), (1280), (2000)) v(t) WHERE width = 0 OR width >= t UNION ALL SELECT id, NULL FROM st WHERE width BETWEEN 1 AND 639),
au AS (SELECT 'missing' AS fault, id, file, tag, format FROM dv WHERE file NOT IN (SELECT file FROM th) UNION ALL SELECT 'undeclared', id, NULL, coalesce(tag::VARCHAR, 'full'), NULL FROM ex WHERE NOT EXISTS (SELECT 1 FROM dv WHERE dv.id = ex.id AND dv.format = 'avif' AND dv.tag = coalesce(ex.tag::VARCHAR, 'full'))
UNION ALL SELECT 'orphan', NULL, file, NULL, NULL FROM th WHERE file NOT IN (SELECT file FROM dv))"""


def audited(spark, sf_dir) -> DataFrame:
    owned = ledger.union_of_owners(("archive", store_of(spark, sf_dir, 0, False)), ("board", store_of(spark, sf_dir, 100, True)))
    return ledger.full_audit(owned, files_of(spark, sf_dir))


@query(f"WITH {OWNED_SQL} SELECT * FROM au")
def full_audit(spark, sf_dir):
    """Files of two stores against those present: missing, undeclared and orphaned."""
    return audited(spark, sf_dir)


@query(f"WITH {OWNED_SQL} SELECT fault, count(*) AS n FROM au WHERE fault = 'orphan' OR id%2 = 0 GROUP BY 1")
def rendered_audit(spark, sf_dir):
    """How many faults the published store alone has; orphans are everybody's."""
    kept = ledger.only_rendered(audited(spark, sf_dir), store_of(spark, sf_dir, 0, False))
    return kept.groupBy("fault").agg(F.count("*").alias("n"))


@query(f"WITH {OWNED_SQL}, r AS (SELECT DISTINCT id FROM au WHERE fault = 'undeclared' OR fault = 'missing' AND format = 'avif') SELECT id, 'render' AS action FROM r UNION ALL SELECT DISTINCT id, 'rewrite' FROM au WHERE fault = 'missing' AND format <> 'avif' AND id NOT IN (FROM r)")
def repair_plan(spark, sf_dir):
    """What to render again and what only to write down anew."""
    return ledger.repair_plan(audited(spark, sf_dir))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey%5 = 0 OR c_custkey%7 = 0 THEN NULL ELSE c_custkey END AS count, CASE WHEN c_custkey%5 = 0 OR c_custkey%7 = 0 THEN NULL WHEN c_custkey%3 = 0 THEN 4 ELSE 0 END::BIGINT AS chapters, CASE WHEN c_custkey%5 = 0 OR c_custkey%7 = 0 THEN NULL ELSE 2 END AS photos FROM customer""")
def stamps_read(spark, sf_dir):
    """Stamps read back; what has no date or no number is none."""
    k = F.col("c_custkey")
    body = F.struct(F.when(k % 5 == 0, "someday").otherwise("2026-05-06T07:08:09Z").alias("builtAt"), F.when(k % 7 != 0, k).alias("count"), F.when(k % 3 == 0, 4).alias("chapters"), F.array(F.lit("a"), F.lit("b")).alias("photos"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), ledger.stamp_of(F.to_json(body)).alias("s"))
    return rows.select("id", "s.count", "s.chapters", F.when(F.col("s").isNotNull(), F.size("s.photos")).alias("photos"))


@query("""WITH m AS (SELECT substr(sha256('r' || o_custkey%50 || ':m' || o_orderkey%40 || ':native'), 1, 16) AS id, min(epoch(o_orderdate)::BIGINT) AS created, min_by(o_orderkey%9 = 0, epoch(o_orderdate)::BIGINT*10000000 + o_orderkey) AS kept FROM orders GROUP BY 1)
SELECT * FROM m WHERE kept UNION ALL (SELECT * FROM m WHERE NOT kept ORDER BY created DESC, id DESC LIMIT 12)""")
def match_records(spark, sf_dir):
    """Matches by the id of both files, the first of each, without the oldest that nobody keeps."""
    created = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000)
    rows = table(spark, sf_dir, "orders").select(
        ledger.match_id(F.concat(F.lit("r"), F.col("o_custkey") % 50), F.concat(F.lit("m"), F.col("o_orderkey") % 40), F.lit("native")).alias("id"), created.alias("created"), (F.col("o_orderkey") % 9 == 0).alias("kept"), "o_orderkey"
    )
    first = archive.keep_first(rows, ["id"], [F.col("created"), F.col("o_orderkey")]).drop("o_orderkey")
    return ledger.add_matches(first.limit(0), first)


@query("""WITH f AS (SELECT event_id AS id, substr(sha256(event_type), 1, 16) || ':' || (event_id%3) AS key FROM events), o AS (SELECT DISTINCT key FROM f WHERE id%4 = 0)
SELECT key, min(id) AS seen, bool_or(FALSE) AS failed FROM f WHERE id%4 = 0 GROUP BY key UNION ALL SELECT key, min(id), min(id)%2 = 0 FROM f WHERE id%4 <> 0 AND key NOT IN (FROM o) GROUP BY key""")
def analysis_cache(spark, sf_dir):
    """Results by content and baseline: only what is not known yet is measured, and failures are told apart."""
    key = ledger.cache_key(F.col("event_type").cast("binary"), (F.col("event_id") % 3).cast("string"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seen"), key.alias("key"))
    known = rows.where("seen % 4 = 0").groupBy("key").agg(F.min("seen").alias("seen")).withColumn("failed", F.lit(False))
    found = ledger.measured(rows.where("seen % 4 <> 0"), known, "key", lambda new: new.withColumn("failed", F.col("seen") % 2 == 0))
    return ledger.bounded_cache(found, "key", "seen", 10_000)


SIDE_SQL = "SELECT n_name AS region, count(*)/100e0 AS coverage, avg({k}%100)/100e0 AS L, avg({k}%30)/100e0 AS C, sum({k})%360 + 0e0 AS hue, count(*)%10/10e0 AS strength FROM {t} JOIN nation ON {n} = n_nationkey WHERE {k}%{m} <> 0 GROUP BY 1"


def _side(spark, sf_dir, name: str, key: str, nation: str, m: int) -> DataFrame:
    k = F.col(key)
    rows = table(spark, sf_dir, name).where(k % m != 0).join(table(spark, sf_dir, "nation"), F.col(nation) == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("region")).agg((F.count("*") / 100.0).alias("coverage"), (F.avg(k % 100) / 100.0).alias("L"), (F.avg(k % 30) / 100.0).alias("C"), (F.sum(k) % 360 + 0.0).alias("hue"), (F.count("*") % 10 / 10.0).alias("strength"))


@query(f"""WITH r AS ({SIDE_SQL.format(k='c_custkey', t='customer', n='c_nationkey', m=3)}), m AS ({SIDE_SQL.format(k='s_suppkey', t='supplier', n='s_nationkey', m=4)})
SELECT region, r.L IS NOT NULL AND m.L IS NOT NULL AS comparable, CASE WHEN r.L IS NOT NULL AND m.L IS NOT NULL THEN 'both' WHEN r.L IS NOT NULL THEN 'reference only' ELSE 'yours only' END AS cover, round(r.L - m.L, 6) AS dL, round(r.C - m.C, 6) AS dC,
CASE WHEN r.strength >= 0.3 AND m.strength >= 0.3 THEN round((r.hue - m.hue + 540) - 360*floor((r.hue - m.hue + 540)/360) - 180, 4) END AS dH FROM r FULL JOIN m USING (region)""")
def comparison_report(spark, sf_dir):
    """Two sides by region with what one must change by; one-sided regions stay and are marked, weak hues are not told."""
    a, b = _side(spark, sf_dir, "customer", "c_custkey", "c_nationkey", 3), _side(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", 4)
    found = ledger.compared_regions(a, b)
    return found.select("region", "comparable", "cover", F.round("dL", 6).alias("dL"), F.round("dC", 6).alias("dC"), F.round("dH", 4).alias("dH"))


@query("""WITH r AS (SELECT 'b' || l_linenumber AS band, count(*)/60000e0 AS share, avg(l_discount) AS chroma, avg(l_tax) AS L FROM lineitem WHERE l_quantity < 5*l_linenumber GROUP BY 1), m AS (SELECT 'b' || l_linenumber + 1 AS band, count(*)/90000e0 AS share, avg(l_discount) AS chroma, avg(l_tax) AS L FROM lineitem WHERE l_quantity > 30 GROUP BY 1),
j AS (SELECT band, coalesce(r.share, 0) AS rs, coalesce(m.share, 0) AS ms, r.chroma - m.chroma AS dc, r.L - m.L AS dl FROM r FULL JOIN m USING (band))
SELECT band, CASE WHEN rs < 0.02 OR ms < 0.02 THEN 'sparse' ELSE 'both' END AS presence, CASE WHEN rs >= 0.02 AND ms >= 0.02 THEN round(dc, 6) END AS dC, CASE WHEN rs >= 0.02 AND ms >= 0.02 THEN round(dl, 6) END AS dL FROM j WHERE rs >= 0.01 OR ms >= 0.01""".replace("'b' || l_linenumber + 1", "'b' || (l_linenumber + 1)"))
def band_report(spark, sf_dir):
    """Colour bands of two sides: absent in both are left out, sparse ones have no differences."""
    rows = table(spark, sf_dir, "lineitem")
    side = lambda df, n, total: df.groupBy(F.concat(F.lit("b"), n).alias("band")).agg((F.count("*") / total).alias("share"), F.avg("l_discount").alias("chroma"), F.avg("l_tax").alias("L"))
    a = side(rows.where(F.col("l_quantity") < 5 * F.col("l_linenumber")), F.col("l_linenumber"), 60000.0)
    b = side(rows.where("l_quantity > 30"), F.col("l_linenumber") + 1, 90000.0)
    found = ledger.compared_bands(a, b)
    return found.select("band", "presence", F.round("dC", 6).alias("dC"), F.round("dL", 6).alias("dL"))


@query("SELECT p_brand AS chapter, 'Chapter ' || p_brand AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_partkey AS id, p_size AS size FROM part")
def flattened_chapters(spark, sf_dir):
    """Nested chapters as rows, each photo with its chapter's name; columns that no page shows are dropped."""
    rows = ledger.light_columns(table(spark, sf_dir, "part").withColumn("embedding", F.array(F.lit(0.0))))
    nested = rows.groupBy(F.col("p_brand").alias("chapter")).agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")))).alias("photos"))
    flat = ledger.photos_of(nested.withColumn("name", F.concat(F.lit("Chapter "), "chapter")), ["id", "size"])
    return flat.withColumn("pos", F.col("pos").cast("long"))


@query("""WITH f AS (SELECT event_id%97 AS cell, avg(value) AS v FROM events GROUP BY 1) SELECT c_custkey AS id, c_custkey*7%120 AS cell, (c_custkey*7 + 31)%120 AS gate, round(a.v, 6) AS here, round(b.v, 6) AS there FROM customer LEFT JOIN f a ON a.cell = c_custkey*7%120 LEFT JOIN f b ON b.cell = (c_custkey*7 + 31)%120""")
def gate_forecasts(spark, sf_dir):
    """Each place's forecast beside that of where its light comes through; either may be missing."""
    f = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 97).alias("cell")).agg(F.avg("value").alias("value"))
    pins = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 120).alias("cell"))
    found = ledger.gate_forecasts(pins, f, (F.col("id") * 7 + 31) % 120)
    return found.select("id", "cell", "gate", F.round("here", 6).alias("here"), F.round("there", 6).alias("there"))


@query(f"""WITH p AS ({TOWN}), h AS (SELECT * FROM p WHERE id%5 = 0), b AS (SELECT * FROM p WHERE id%5 <> 0), d AS (SELECT h.id AS spot, b.id, sqrt(pow(radians(b.lat - h.lat), 2) + pow(radians(b.lon - h.lon)*cos(radians((h.lat + b.lat)/2)), 2))*6371000e0 AS m FROM h, b)
SELECT spot, count(*) AS n, round(max(m), 3) AS furthest FROM d WHERE m <= 1500 GROUP BY spot""")
def buildings_near(spark, sf_dir):
    """Buildings within a kilometre and a half of each hotspot, by grid cells; buildings of one place are counted first."""
    rows = town(spark, sf_dir)
    spots, others = rows.where("id % 5 = 0"), rows.where("id % 5 <> 0")
    counts = others.groupBy(F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).agg(F.count("*").alias("__n"))
    near = places.places_within(spots, others, 1500.0).join(counts, ["b_lat", "b_lon"])
    found = near.groupBy(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")).agg(F.sum("__n").alias("n"), F.round(F.max("distance"), 3).alias("furthest"))
    return spots.join(found, ["lat", "lon"]).select(F.col("id").alias("spot"), "n", "furthest")


@query(f"""WITH {E_SQL}, f AS (SELECT sec AS fat, min(value) AS reading FROM e WHERE event_id%3 = 0 GROUP BY 1), p AS (SELECT event_id, sec FROM e WHERE event_id%3 <> 0), j AS (SELECT event_id, abs(sec - fat) AS gap, reading, row_number() OVER (PARTITION BY event_id ORDER BY abs(sec - fat), fat) AS n FROM p JOIN f ON abs(sec - fat) <= 5400)
SELECT p.event_id, j.gap, j.reading FROM p LEFT JOIN j ON p.event_id = j.event_id AND n = 1""")
def asof_seeing(spark, sf_dir):
    """The nearest reading within an hour and a half."""
    rows = samples(spark, sf_dir)
    feed = rows.where("event_id % 3 = 0").groupBy("at").agg(F.min("value").alias("reading"))
    return timeline.nearest_in_time(rows.where("event_id % 3 <> 0").select("event_id", "at"), feed, "at", 5400, ["reading"]).drop("at")


@query(f"WITH {E_SQL}, g AS (SELECT *, value - 30 AS gap, lag(value - 30) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS before FROM e) SELECT user_id, event_id, gap > before AS rising FROM g WHERE before IS NOT NULL AND sign(before) <> sign(gap)")
def altitude_crossings(spark, sf_dir):
    """Samples after which a series stands on the other side of a level; no jump is left out."""
    rows = samples(spark, sf_dir).withColumn("gap", F.col("value") - 30)
    return timeline.crossings(rows, ["user_id"], ["at", "event_id"], "gap").select("user_id", "event_id", "rising")


MINUTE_SQL = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS minute, value > 60 AS lit, value - 25 AS altitude FROM events)"
WINDOW_SQL = f"""{MINUTE_SQL}, t AS (SELECT *, lit::INT*2 + (altitude <= 0)::INT AS state FROM s), m AS (SELECT *, minute - row_number() OVER (PARTITION BY user_id, state ORDER BY minute) AS isle FROM t),
w0 AS (SELECT user_id, state, isle, any_value(lit) AS lit, any_value(altitude <= 0) AS below, min(minute) AS s, max(minute) + 1 AS e FROM m GROUP BY ALL), w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s)::INT AS run, lit, below, s AS "start", e AS "end" FROM w0)"""


def minutes(spark, sf_dir) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return table(spark, sf_dir, "events").select("user_id", place.alias("minute"), (F.col("value") > 60).alias("lit"), (F.col("value") - 25).alias("altitude"))


@query(f"WITH {WINDOW_SQL} SELECT * FROM w")
def lit_windows(spark, sf_dir):
    """Runs of minutes that agree in being lit and in the sun's being down."""
    return ledger.lit_windows(minutes(spark, sf_dir), ["user_id"], "minute")


@query(f"""WITH {WINDOW_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "end" - "start" DESC, "start") AS k FROM w WHERE lit), g AS (SELECT user_id, min("start") AS first_, max("end") - 1 AS last_, sum("end" - "start")::BIGINT AS total, min("start") FILTER (k = 1) AS longest_start, min("end") FILTER (k = 1) AS longest_end FROM r GROUP BY 1)
SELECT u.user_id, first_, last_, coalesce(total, 0) AS total, longest_start, longest_end FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN g ON u.user_id = g.user_id""")
def light_summary(spark, sf_dir):
    """First and last lit minute, all of them, and the longest run."""
    found = ledger.light_summary(ledger.lit_windows(minutes(spark, sf_dir), ["user_id"], "minute"), ["user_id"])
    return found.select("user_id", F.col("first").alias("first_"), F.col("last").alias("last_"), "total", F.col("longest.start").alias("longest_start"), F.col("longest.end").alias("longest_end"))


@query("""WITH c AS (SELECT c_custkey AS day, i*30 AS minute, (c_custkey*i)%7 IN (0, 1) AS golden FROM customer, range(48) r(i)), m AS (SELECT *, lead(minute) OVER (PARTITION BY day ORDER BY minute) AS nx, minute//30 - row_number() OVER (PARTITION BY day, golden ORDER BY minute) AS isle FROM c)
SELECT day, min(minute) AS "start", max(coalesce(nx, 1440)) AS "end" FROM m WHERE golden GROUP BY day, isle""")
def golden_runs(spark, sf_dir):
    """Runs of golden cells of a day; one that is open ends with the day."""
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("day"), F.explode(F.sequence(F.lit(0), F.lit(47))).alias("i"))
    cells = cells.select("day", (F.col("i") * 30).cast("long").alias("minute"), F.when((F.col("day") * F.col("i") % 7).isin(0, 1), "golden").otherwise("day").alias("phase"))
    return ledger.golden_runs(cells, ["day"])


@query("""WITH w AS (SELECT c_custkey AS id, i AS k, c_custkey*17%300 + i*400 AS s, c_custkey*17%300 + i*400 + c_custkey%500 AS t FROM customer, range(3) r(i) WHERE i < c_custkey%4),
m AS (SELECT id, arg_min(s, CASE WHEN t <= 720 THEN k WHEN s < 720 THEN 10 + k END) AS morning FROM w GROUP BY id), e AS (SELECT id, arg_min(s, CASE WHEN s >= 720 THEN k WHEN t > 720 THEN 20 - k END) AS evening FROM w GROUP BY id)
SELECT c_custkey AS id, morning, CASE WHEN evening IS DISTINCT FROM morning THEN evening END AS evening FROM customer LEFT JOIN m ON m.id = c_custkey LEFT JOIN e ON e.id = c_custkey""")
def noon_windows(spark, sf_dir):
    """The window before noon and the one after it; one window alone is not told twice."""
    k = F.col("c_custkey")
    windows = F.filter(F.array(*[F.struct(F.lit(i).alias("k"), (k * 17 % 300 + i * 400).alias("start"), (k * 17 % 300 + i * 400 + k % 500).alias("end")) for i in range(3)]), lambda w: w["k"] < k % 4)
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), ledger.sides_of_noon(windows, F.lit(720)).alias("s"))
    return rows.select("id", F.col("s.morning.start").alias("morning"), F.col("s.evening.start").alias("evening"))


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderdate + to_minutes((o_orderkey*37%1440)::BIGINT) AS t FROM orders), z AS (SELECT *, (t AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Sydney' AS there FROM t)
SELECT id, (epoch(there) - epoch(t))::INT//60 AS offset_, there::DATE AS day, ((there::DATE + INTERVAL 12 HOUR) AT TIME ZONE 'Australia/Sydney') AT TIME ZONE 'UTC' AS noon, strftime(there, '%a %-d %b') AS label, (there::DATE + INTERVAL 40 DAY)::DATE AS later FROM z""")
def zone_days(spark, sf_dir):
    """How far a zone is ahead, its date, that date's noon, its label and a later date."""
    t = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000 + F.col("o_orderkey") * 37 % 1440 * 60).cast("timestamp")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), t.alias("t"))
    day = clock.local_date(F.col("t"), "Australia/Sydney")
    return rows.select("id", clock.offset_minutes(F.col("t"), "Australia/Sydney").alias("offset_"), day.alias("day"), clock.zoned_noon(day, "Australia/Sydney").cast("timestamp_ntz").alias("noon"), clock.day_label(day).alias("label"), F.date_add(day, 40).alias("later"))


@query("""SELECT p_partkey AS id, substr(sha1('v2 ' || lower(trim(regexp_replace(p_name || '  ' || p_type, '\\s+', ' ', 'g'))) || ' ' || p_size), 1, 20) AS digest, CASE WHEN p_partkey%3 = 0 THEN p_partkey END AS covers, lower(split_part(p_name || CASE WHEN p_partkey%2 = 0 THEN '.NEF' ELSE '.jpg' END, '.', -1)) IN ('nef', 'arw', 'cr3') AS raw,
'pic' || p_partkey || ' as Sea' AS preset, CASE WHEN p_partkey%4 = 0 THEN ['a-b.xmp', 'a-b-safe.xmp'] ELSE ['a-b.xmp'] END AS files, CASE WHEN p_partkey%4 = 0 AND p_partkey%2 = 0 THEN 'a-b-safe.xmp' ELSE 'a-b.xmp' END AS chosen,
printf('%.4f°', abs(p_partkey%90 - 30.5e0)) || CASE WHEN p_partkey%90 >= 31 THEN 'N' ELSE 'S' END || ' ' || printf('%.4f°', p_partkey%180 + 0.25e0) || 'W' AS place, CASE WHEN p_size = 0 OR p_partkey%5 = 0 THEN NULL WHEN p_partkey%6 = 0 THEN p_size || ' buildings, all from recorded heights.' ELSE p_partkey%6 || ' of ' || p_size || ' building heights are storey-count estimates.' END AS caveat FROM part""")
def names_and_labels(spark, sf_dir):
    """Digests of searches, counts off a cover, raw names, presets and their files, places and caveats."""
    p = F.col("p_partkey")
    html = F.when(p % 3 == 0, F.concat(F.lit('<p class="cover-kicker" x>  '), p, F.lit(" · 12 chapters</p>"))).otherwise("<p>none</p>")
    files = text.preset_files(F.lit("a  b!"), F.when(p % 4 == 0, 1).otherwise(0), p % 2 == 0)
    return table(spark, sf_dir, "part").select(
        p.alias("id"), text.query_digest(F.concat(F.lit(" "), "p_name", F.lit("  "), "p_type"), F.col("p_size")).alias("digest"), text.cover_count(html)["count"].alias("covers"),
        text.is_raw(F.concat("p_name", F.when(p % 2 == 0, ".NEF").otherwise(".jpg"))).alias("raw"), text.match_name(F.concat(F.lit("pic"), p, F.lit(".0123456789abcdef.jpg")), F.lit("Sea.png")).alias("preset"),
        files["files"].alias("files"), files["chosen"].alias("chosen"), text.place_label((p % 90 - 30.5), -(p % 180 + 0.25)).alias("place"), text.shadow_caveat(p % 5 != 0, F.col("p_size"), p % 6).alias("caveat"),
    )


@query("""WITH c AS (SELECT p_partkey AS id, printf('#%02x%02x%02x', p_partkey*37%256, p_partkey*91%256, p_partkey*53%256) AS hex, p_partkey*37%256/255e0 AS r, p_partkey*91%256/255e0 AS g, p_partkey*53%256/255e0 AS b, p_partkey*7%360 AS h1, p_partkey*13%360 AS h2 FROM part),
l AS (SELECT *, 0.2126e0*CASE WHEN r <= 0.03928 THEN r/12.92e0 ELSE pow((r + 0.055e0)/1.055e0, 2.4e0) END + 0.7152e0*CASE WHEN g <= 0.03928 THEN g/12.92e0 ELSE pow((g + 0.055e0)/1.055e0, 2.4e0) END + 0.0722e0*CASE WHEN b <= 0.03928 THEN b/12.92e0 ELSE pow((b + 0.055e0)/1.055e0, 2.4e0) END AS y FROM c)
SELECT id, round(1.05e0/(y + 0.05e0), 5) AS on_white, least(abs(h1 - h2), 360 - abs(h1 - h2))::DOUBLE AS apart, printf('oklch(%.3f %.3f %.1f)', id%100/100e0, id%40/100e0, h1 + 0e0) AS css, printf('%.2f_%.2f', id%90 + 0.126e0, -(id%180 + 0.374e0)) AS cell, round(CASE WHEN id%10 < 3 THEN h2 WHEN id%9 < 3 THEN h1 ELSE (h1 + (((h2 - h1)%360 + 540)%360 - 180)*0.25e0 + 360)%360 END, 6) AS wheel FROM l""")
def colour_helpers(spark, sf_dir):
    """Contrast of hex colours, distances and blends of hues, colours as CSS, coarse cells."""
    p = F.col("p_partkey")
    byte = lambda k: F.lpad(F.lower(F.hex(p * k % 256)), 2, "0")
    h1, h2 = (p * 7 % 360).cast("double"), (p * 13 % 360).cast("double")
    wheel = vectors.lerp_wheel_hue(h1, F.when(p % 10 < 3, 0.0).otherwise(5.0), h2, F.when(p % 9 < 3, 0.0).otherwise(5.0), F.lit(0.25))
    return table(spark, sf_dir, "part").select(
        p.alias("id"), F.round(colour.contrast_of(F.concat(F.lit("#"), byte(37), byte(91), byte(53)), F.lit("#ffffff")), 5).alias("on_white"), colour.circular_distance(h1, h2).alias("apart"),
        colour.css(p % 100 / 100.0, p % 40 / 100.0, h1).alias("css"), text.coarse_key(p % 90 + 0.126, -(p % 180 + 0.374)).alias("cell"), F.round(wheel, 6).alias("wheel"),
    )


@query("""SELECT p_brand AS spot, count(*) AS n, round(avg(CASE WHEN p_size <= 1 THEN 1.0 ELSE 0.0 END) FILTER (p_partkey%16 = 0), 6) AS sea, count(*) FILTER (p_partkey%3 <> 0 AND greatest(p_size, p_partkey%50) > 0 AND abs(p_size - p_partkey%50)*100 <= 15*greatest(p_size, p_partkey%50)) AS comparable FROM part GROUP BY 1""")
def shares(spark, sf_dir):
    """Share of the sea in a field's samples, and images whose sizes are near enough to compare textures."""
    rows = table(spark, sf_dir, "part")
    sea = pixels.sea_fraction(F.col("p_size").cast("double"), F.col("p_partkey"))
    like = texture.comparable(F.col("p_size"), F.col("p_partkey") % 50, F.col("p_partkey") % 3 != 0, F.lit(True))
    return rows.groupBy(F.col("p_brand").alias("spot")).agg(F.count("*").alias("n"), F.round(sea, 6).alias("sea"), F.coalesce(F.sum(F.when(like, 1)), F.lit(0)).cast("long").alias("comparable"))


@query("""WITH s AS (SELECT l_orderkey AS spot, count(*) AS n, string_agg(l_linenumber || ':' || l_suppkey%2, ',' ORDER BY l_linenumber, l_suppkey%2) AS held FROM lineitem GROUP BY 1) SELECT spot, n, min(spot) OVER (PARTITION BY held) AS like_ FROM s""".replace("like_", '"like"'))
def building_sets(spark, sf_dir):
    """Sets of buildings by an order-independent signature: each order with the smallest one that has the same set."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("spot"), "l_linenumber", (F.col("l_suppkey") % 2).alias("side"))
    marks = buildings.set_signature(rows, ["spot"], "l_linenumber", "side")
    first = marks.groupBy(F.col("n").alias("m"), F.col("mark").alias("own")).agg(F.min("spot").alias("like"))
    return marks.join(first, (F.col("n") == F.col("m")) & (F.col("mark") == F.col("own"))).select("spot", "n", "like")


@query("""SELECT p_partkey AS id, CASE WHEN p_size <= 0 THEN 0 ELSE round(sqrt(2*7/6e0*6371008.8e0*p_size), 4) END AS reach, p_partkey*7%360 AS azimuth, p_partkey%40 - 10 > CASE WHEN p_partkey*7%360%90 = 0 THEN [0, 10, 20, 10][p_partkey*7%360//90 + 1]
ELSE [0, 10, 20, 10, 0][p_partkey*7%360//90 + 1] + ([0, 10, 20, 10, 0][p_partkey*7%360//90 + 2] - [0, 10, 20, 10, 0][p_partkey*7%360//90 + 1])*(p_partkey*7%360%90)/90e0 END AS sunlit FROM part""")
def sunlit_tests(spark, sf_dir):
    """Whether a sun stands above a circular profile, and how far a peak of a height is seen."""
    p = F.col("p_partkey")
    profile = F.array(*[F.lit(float(x)) for x in (0, 10, 20, 10)])
    return table(spark, sf_dir, "part").select(p.alias("id"), F.round(places.horizon_reach(F.col("p_size")), 4).alias("reach"), (p * 7 % 360).alias("azimuth"), (~terrain.blocked(profile, (p * 7 % 360).cast("double"), (p % 40 - 10).cast("double"))).alias("sunlit"))


@query("""SELECT p_partkey AS id, round(CASE WHEN t <= 0.5 THEN (p_size)*t*2 ELSE p_size + (p_partkey%100 - p_size)*(t*2 - 1) END, 6) AS blended, CASE WHEN p_partkey%13 = 0 THEN 0e0 ELSE greatest(-5, least(5, p_partkey%20 - 10)) END::DOUBLE AS clamped, p_partkey%5 = 0 AS shipped FROM (SELECT *, p_partkey%11/10e0 AS t FROM part)""")
def control_helpers(spark, sf_dir):
    """A control at a strength, within its range, and whether a calibration is still the shipped one."""
    p = F.col("p_partkey")
    value = F.when(p % 13 == 0, float("nan")).otherwise((p % 20 - 10).cast("double"))
    record = F.struct(F.lit(0.045).alias("unit"), F.when(p % 5 == 0, 1.0).otherwise(1.1).alias("gain"))
    return table(spark, sf_dir, "part").select(
        p.alias("id"), F.round(grade.blend(F.lit(0.0), F.col("p_size"), p % 100, p % 11 / 10.0), 6).alias("blended"), vectors.clamp(value, -5.0, 5.0).alias("clamped"), ledger.all_default(record, {"unit": 0.045, "gain": 1.0}).alias("shipped")
    )
