"""Queries over record sets, rankings and pixels, with their SQL.

The driver's tables hold no photographs: parts stand in for photos (colour by integer
arithmetic on the key), line items for pixels, events for sampled series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaframe.functions import colour, vectors
from lumaframe.operators import archive, grade, measure, pixels, ranking, texture, timeline

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, r, g, b, L, a, b_, C, H, base, width, height) of parts."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), (k * 37 % 256).alias("r"), (k * 91 % 256).alias("g"), (k * 53 % 256).alias("b"), (k % 2300 + 1).alias("width"), (k % 1700 + 1).alias("height"))
    return pixels.with_lab(rows).withColumn("base", colour.classify(F.col("C"), F.col("H")))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, x, y, r, g, b) pixels of line items; 200 images at most."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 200).alias("image"), (F.col("l_orderkey") % 64).alias("x"), ((p + n) % 48).alias("y"),
        (p * 7 % 256).alias("r"), (s * 29 % 256).alias("g"), ((p + s * 3 + n * 40) % 256).alias("b"),
    )


def lin(c: str) -> str:
    return f"(CASE WHEN {c}/255.0::DOUBLE <= 0.04045 THEN {c}/255.0::DOUBLE/12.92::DOUBLE ELSE pow(({c}/255.0::DOUBLE + 0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) END)"


def lab_cte(source: str, out: str) -> str:
    """CTEs that add L, a, b_, C and H to a relation with r, g and b."""
    cone = [f"cbrt({m[0]}::DOUBLE*lr + {m[1]}::DOUBLE*lg + {m[2]}::DOUBLE*lb)" for m in colour.TO_CONE]
    lab = [f"{m[0]}::DOUBLE*c0 + {m[1]}::DOUBLE*c1 + ({m[2]}::DOUBLE)*c2" for m in colour.TO_LAB]
    return f"""{out}_1 AS (SELECT *, {lin('r')} AS lr, {lin('g')} AS lg, {lin('b')} AS lb FROM {source}),
{out}_2 AS (SELECT *, {cone[0]} AS c0, {cone[1]} AS c1, {cone[2]} AS c2 FROM {out}_1),
{out}_3 AS (SELECT *, {lab[0]} AS L, {lab[1]} AS a, {lab[2]} AS b_ FROM {out}_2),
{out} AS (SELECT *, sqrt(a*a + b_*b_) AS C, {hue('a', 'b_')} AS H FROM {out}_3)"""


def hue(a: str, b: str) -> str:
    return f"(CASE WHEN atan2({b}, {a}) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END)"


def circ(a: str, b: str) -> str:
    return f"least(abs({a} - {b}), 360 - abs({a} - {b}))"


ANCHOR_SQL = "(CASE WHEN C < 0.035 THEN 'achromatic' ELSE (list_sort([{" + "}, {".join(f"'d': {circ('H', str(h))}, 'i': {i}, 's': '{s}'" for i, (s, h) in enumerate(colour.ANCHORS)) + "}]))[1].s END)"
PART = "part_px AS (SELECT p_partkey AS id, p_partkey*37%256 AS r, p_partkey*91%256 AS g, p_partkey*53%256 AS b, p_partkey%2300+1 AS width, p_partkey%1700+1 AS height FROM part)"
PHOTO_SQL = f"WITH {PART}, {lab_cte('part_px', 'lab')}, photo AS (SELECT *, {ANCHOR_SQL} AS base FROM lab)"
IMAGE = """image_px AS (SELECT l_orderkey%200 AS image, l_orderkey%64 AS x, (l_partkey + l_linenumber)%48 AS y, l_partkey*7%256 AS r, l_suppkey*29%256 AS g,
  (l_partkey + l_suppkey*3 + l_linenumber*40)%256 AS b FROM lineitem)"""
IMAGE_SQL = f"WITH {IMAGE}, {lab_cte('image_px', 'lab')}"
BAND_SQL = "CASE WHEN L < 0.45 THEN 'deep' WHEN L >= 0.72 THEN 'pale' ELSE 'mid' END"
RANK_SQL = "(CASE regexp_replace(chapter, '-(deep|pale)$', '') WHEN 'achromatic' THEN -1000 " + " ".join(f"WHEN '{s}' THEN {h}" for s, h in colour.ANCHORS) + " ELSE -1 END * 10 + CASE WHEN chapter LIKE '%-deep' THEN 0 WHEN chapter LIKE '%-pale' THEN 2 ELSE 1 END)"
CHAPTER_SQL = f"""{PHOTO_SQL}, banded AS (SELECT *, {BAND_SQL} AS band FROM photo),
counted AS (SELECT *, count(*) OVER (PARTITION BY base, band) AS nb FROM banded),
chap AS (SELECT *, CASE WHEN band <> 'mid' AND nb > 5 THEN base || '-' || band ELSE base END AS chapter FROM counted)"""
UP3, UP1 = "floor({0}*1000+0.5)/1000", "floor({0}*10+0.5)/10"
NAME_SQL = """CASE WHEN chapter LIKE 'achromatic%' THEN CASE WHEN chapter LIKE '%-deep' THEN 'Charcoal' WHEN chapter LIKE '%-pale' THEN 'Silver' ELSE 'Ash' END
  ELSE CASE WHEN chapter LIKE '%-deep' THEN 'Deep ' WHEN chapter LIKE '%-pale' THEN 'Pale ' ELSE '' END || upper(chapter[1]) || substr(regexp_replace(chapter, '-(deep|pale)$', ''), 2) END"""


@query(f"""{CHAPTER_SQL} SELECT chapter, {NAME_SQL} AS name, {RANK_SQL} AS rank, count(*) AS n,
{UP3.format('avg(L)')} AS mean_L, {UP3.format('sqrt(avg(a)*avg(a)+avg(b_)*avg(b_))')} AS mean_C, {UP1.format(hue('avg(a)', 'avg(b_)'))} AS mean_H
FROM chap GROUP BY chapter""")
def chapter_summary(spark, sf_dir):
    """Flagship: photos to hue chapters, busy bands split off, with mean colours in wheel order."""
    chapters = archive.split_chapters(photos(spark, sf_dir), "base")
    sums = chapters.groupBy("chapter").agg(F.count("*").alias("n"), *archive.mean_colour("a", "b_"))
    return sums.select("chapter", colour.chapter_name(F.col("chapter")).alias("name"), colour.chapter_rank(F.col("chapter")).alias("rank"), "n", "mean_L", "mean_C", "mean_H").orderBy("rank")


@query()
def chapter_fold(spark, sf_dir):
    """Where chapters end up once those of one or two photos have joined a neighbour."""
    chapters = archive.split_chapters(photos(spark, sf_dir), "base").select("chapter", "L", "a", F.col("b_").alias("b"))
    return archive.folded_chapters(chapters)


@query()
def gradient_order(spark, sf_dir):
    """Each chapter's photos along a short path through colour."""
    chapters = archive.split_chapters(photos(spark, sf_dir), "base").select("chapter", "id", "L", "a", F.col("b_").alias("b"))
    return archive.path_order(chapters, "chapter", "id")


@query(f"""{PHOTO_SQL} SELECT id, r, g, b, {UP3.format('L')} AS L, {UP3.format('C')} AS C, {UP1.format('H')} AS H, base, {BAND_SQL} AS band FROM photo""")
def colour_classes(spark, sf_dir):
    rounded = [colour.half_up(F.col(c), d).alias(c) for c, d in (("L", 3), ("C", 3), ("H", 1))]
    return photos(spark, sf_dir).select("id", "r", "g", "b", *rounded, "base", colour.lightness_band(F.col("L")).alias("band"))


@query(f"""{PHOTO_SQL} SELECT id, r AS red, g AS green, b AS blue FROM photo""")
def colour_round_trip(spark, sf_dir):
    """sRGB to OKLab and back gives all three bytes again."""
    back = colour.linear_rgb(F.col("L"), F.col("a"), F.col("b_"))
    byte = lambda c: F.floor(colour.encode(back[c]) * 255 + 0.5).cast("long")
    return photos(spark, sf_dir).select("id", byte("r").alias("red"), byte("g").alias("green"), byte("b").alias("blue"))


@query("""WITH o AS (SELECT DISTINCT o_custkey%97 AS key, 'override-' || (o_custkey%97)%5 AS status FROM orders WHERE o_custkey%97 < 40)
SELECT o_orderkey, coalesce(o.status, nullif(o_orderstatus, 'P'), 'unknown') AS status FROM orders LEFT JOIN o ON o_custkey%97 = o.key""")
def override_resolution(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey") % 97).withColumn("auto", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    told = orders.where("key < 40").select("key", F.concat(F.lit("override-"), F.col("key") % 5).alias("status")).distinct()
    return archive.resolve_overrides(orders.withColumn("fallback", F.lit("unknown")), told, "key", {"status": ("auto", "fallback")}).select("o_orderkey", "status")


@query("""SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type
UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY p_size""")
def facet_counts(spark, sf_dir):
    return archive.facet_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, min(event_id), 1 LIMIT 6")
def top_counts(spark, sf_dir):
    return archive.top_counts(table(spark, sf_dir, "events"), "event_type", 6, F.col("event_id"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def facet_filter(spark, sf_dir):
    """A filter on two facets of which one is set to all."""
    wanted = {"o_orderstatus": "F", "o_orderpriority": "all"}
    rows = table(spark, sf_dir, "orders")
    for c, v in wanted.items():
        rows = rows.where((F.lit(v) == "all") | (F.col(c) == v))
    return rows.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT substr(sha256(coalesce(text, '')), 1, 16) AS id, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def content_dedupe(spark, sf_dir):
    """Content-addressed ids; the smallest key of each content stays."""
    rows = table(spark, sf_dir, "documents").withColumn("id", F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 16))
    return rows.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey%3 = 0 UNION ALL
SELECT o_orderkey, max_by(o_totalprice, -o_custkey) FROM orders WHERE o_orderkey%2 = 0 AND o_orderkey%3 <> 0 GROUP BY 1""")
def append_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return archive.append_new(rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 2 = 0"), "o_orderkey", [F.col("o_custkey")]).drop("o_custkey")


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey%5 = 0 THEN 'patched' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey%7 <> 0")
def keyed_edits(spark, sf_dir):
    """Update by key from a patch, then delete by key."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    patch = rows.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("patched").alias("o_orderpriority"))
    return archive.delete_by_key(archive.update_by_key(rows, patch, "o_orderkey", ["o_orderpriority"]), rows.where("o_orderkey % 7 = 0"), "o_orderkey")


@query("""WITH owned AS (SELECT DISTINCT 'f' || o_orderkey AS file FROM orders WHERE o_orderkey%4 <> 0),
present AS (SELECT DISTINCT CASE WHEN l_orderkey%50 = 0 THEN '.' ELSE '' END || 'f' || l_orderkey AS file FROM lineitem WHERE l_orderkey%3 <> 0),
there AS (SELECT * FROM present WHERE file NOT LIKE '.%')
SELECT 'missing' AS fault, file FROM owned WHERE file NOT IN (FROM there) UNION ALL SELECT 'orphan', file FROM there WHERE file NOT IN (FROM owned)""")
def audit_files(spark, sf_dir):
    owned = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.concat(F.lit("f"), "o_orderkey").alias("file"))
    dot = F.when(F.col("l_orderkey") % 50 == 0, ".").otherwise("")
    present = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").select(F.concat(dot, F.lit("f"), "l_orderkey").alias("file"))
    return archive.audit(owned, present)


@query(f"""WITH {PART} SELECT id, unnest(CASE WHEN width >= 640 THEN list_filter([640, 1280, 2000], lambda w: w <= width)::VARCHAR[] ELSE ['full'] END) AS tag FROM part_px""")
def derivative_tags(spark, sf_dir):
    return photos(spark, sf_dir).select("id", F.explode(archive.expected_tags(F.col("width"))).alias("tag"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'added' WHEN d.doc_id IS NULL THEN 'removed' ELSE 'same' END AS state
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id%3 <> 0) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def drift_diff(spark, sf_dir):
    return archive.differences(table(spark, sf_dir, "documents").where("doc_id % 3 <> 0"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT lang, label, total::BIGINT AS total FROM (SELECT lang, label, sum(score) AS total, row_number() OVER (PARTITION BY lang ORDER BY sum(score) DESC, min(o)) AS n FROM
(SELECT lang, 'quality' AS label, quality AS score, 0 AS o FROM documents JOIN labels USING (doc_id) UNION ALL SELECT lang, 'toxic', toxic, 1 FROM documents JOIN labels USING (doc_id))
GROUP BY lang, label) WHERE n = 1""")
def label_argmax(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    scored = rows.select("lang", F.inline(F.array(F.struct(F.lit("quality").alias("label"), F.col("quality").alias("score"), F.lit(0).alias("o")), F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("score"), F.lit(1).alias("o")))))
    return archive.arg_max_label(scored, ["lang"], "label", F.col("score"), F.col("o"))


@query("""SELECT user_id, event_type, tier FROM (SELECT user_id, event_type, t AS tier, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM
(SELECT *, length(event_type)::INT AS t FROM events)) WHERE n = 1""")
def priority_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("tier", F.length("event_type"))
    return archive.keep_first(rows, ["user_id"], [F.col("tier"), F.col("event_id")]).select("user_id", "event_type", "tier")


@query("""SELECT k, name, tier FROM (SELECT k, name, tier, row_number() OVER (PARTITION BY k ORDER BY tier) AS n FROM (SELECT s_suppkey AS k, s_name AS name, 0 AS tier FROM supplier
UNION ALL SELECT c_custkey, c_name, 1 FROM customer)) WHERE n = 1 AND k IN (SELECT o_custkey FROM orders)""")
def priority_lookup(spark, sf_dir):
    first = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    then = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return archive.priority_lookup(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k", [first, then]).select("k", "name", "tier")


@query("SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events) WHERE place <= 12")
def latest_n_per_key(spark, sf_dir):
    return archive.latest_n(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id")], 12).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_type, max(ts) AS ts FROM events, n WHERE epoch(now)::BIGINT - epoch(ts)::BIGINT <= 200000 GROUP BY 1""")
def ttl_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    now = rows.agg(F.max("ts").alias("now"))
    aged = rows.join(F.broadcast(now))  # one row
    return archive.within_ttl(aged, "event_type", "ts", F.col("now"), 200_000).select("event_type", "ts")


@query("SELECT l_returnflag, floor(sum(l_quantity*l_extendedprice)/sum(l_quantity*l_quantity)*10000+0.5)/10000 AS slope FROM lineitem GROUP BY 1")
def slope_origin(spark, sf_dir):
    slope = pixels.slope_through_origin(F.col("l_quantity"), F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(colour.half_up(slope, 4).alias("slope"))


MOMENTS_SQL = f"""round(sum(w), 4) AS weight, round(sum(w*L)/sum(w), 4) AS L_mean, round(sqrt(greatest(0, sum(w*L*L)/sum(w) - pow(sum(w*L)/sum(w), 2))), 4) AS L_sd,
round(sum(w*C)/sum(w), 4) AS C_mean, round(sqrt(greatest(0, sum(w*C*C)/sum(w) - pow(sum(w*C)/sum(w), 2))), 4) AS C_sd,
round({hue('sum(w*a)/sum(w)', 'sum(w*b_)/sum(w)')}, 3) AS hue_mean,
round(least(1, sqrt(pow(sum(w*a)/sum(w), 2) + pow(sum(w*b_)/sum(w), 2))/(sum(w*C)/sum(w))), 4) AS hue_strength, round(sum(w*a)/sum(w), 4) AS a_mean, round(sum(w*b_)/sum(w), 4) AS b_mean"""


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(c, 3 if c == "hue_mean" else 4).alias(c) for c in df.columns if c not in keys])


@query(f"{IMAGE_SQL} SELECT image, {MOMENTS_SQL} FROM (SELECT *, 1.0::DOUBLE AS w FROM lab) GROUP BY image")
def region_stats(spark, sf_dir):
    rows = pixels.with_lab(images(spark, sf_dir))
    return _rounded(rows.groupBy("image").agg(*pixels.moments(F.lit(1.0))), ["image"])


ZONE_SQL = """z AS (SELECT *, greatest(0, 1-L/0.5) AS wsh, greatest(0, (L-0.5)/0.5) AS whi, greatest(0, 1-abs(L-0.5)/0.5) AS wmi FROM lab),
zz AS (SELECT *, 'zone.shadow' AS zone, wsh/(wsh+wmi+whi) AS w FROM z UNION ALL SELECT *, 'zone.midtone', wmi/(wsh+wmi+whi) FROM z UNION ALL SELECT *, 'zone.highlight', whi/(wsh+wmi+whi) FROM z)"""


@query(f"{IMAGE_SQL}, {ZONE_SQL} SELECT image, zone, {MOMENTS_SQL} FROM zz WHERE w > 0 GROUP BY image, zone")
def zone_stats(spark, sf_dir):
    rows = pixels.zones(pixels.with_lab(images(spark, sf_dir)))
    return _rounded(rows.groupBy("image", "zone").agg(*pixels.moments(F.col("w"))), ["image", "zone"])


BIN_SQL = "CASE WHEN L <= 0 THEN 0 WHEN L >= 1 THEN 511 ELSE floor(L*511)::INT END"


@query(f"""{IMAGE_SQL}, h AS (SELECT image, {BIN_SQL} AS bin, count(*)::DOUBLE AS n FROM lab GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY image ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY image) AS total FROM h)
SELECT image, step, CASE WHEN step = 0 THEN 0 ELSE min(bin) END/511.0::DOUBLE AS level FROM c, range(21) r(step) WHERE cum >= step/20.0::DOUBLE*total GROUP BY image, step""")
def hist_percentiles(spark, sf_dir):
    rows = pixels.with_lab(images(spark, sf_dir)).groupBy("image", pixels.histogram_bin(F.col("L")).alias("bin")).agg(F.count("*").cast("double").alias("n"))
    return pixels.histogram_percentiles(rows, ["image"]).withColumn("step", F.col("step").cast("long"))


HSL_SQL = "(list_sort([{" + "}, {".join(f"'d': {circ('floor(H)', str(h))}, 'i': {i}, 'k': '{k}'" for i, (k, h) in enumerate(pixels.BANDS)) + "}]))[1].k"


@query(f"""{IMAGE_SQL}, b AS (SELECT *, {HSL_SQL} AS band FROM lab WHERE C >= 0.02)
SELECT image, band, count(*) AS n, round(avg(C), 4) AS chroma, round(avg(L), 4) AS L, round({hue('avg(a)', 'avg(b_)')}, 3) AS hue, round(count(*)/sum(count(*)) OVER (PARTITION BY image), 4) AS share FROM b GROUP BY image, band""")
def hsl_bands(spark, sf_dir):
    found = pixels.bands(pixels.with_lab(images(spark, sf_dir)), ["image"])
    return found.select("image", "band", "n", *[F.round(c, d).alias(c) for c, d in (("chroma", 4), ("L", 4), ("hue", 3), ("share", 4))])


def smooth(lo: float, hi: float) -> str:
    t = f"least(1, greatest(0, (L-{lo})/({hi}-{lo})))"
    return f"({t}*{t}*(3-2*{t}))"


@query(f"""{IMAGE_SQL}, v AS (SELECT *, greatest(0, least({smooth(0.06, 0.26)}, 1-{smooth(0.85, 0.97)})) AS lit, greatest(0, C-0.02) AS above, floor(H/10)::INT%36 AS bin FROM lab),
s AS (SELECT image, bin, sum(lit*C*above) AS w, sum(lit*C*above*L) AS wL, sum(lit*C*above*a) AS wa, sum(lit*C*above*b_) AS wb, sum(lit) AS lit, sum(lit*L) AS litL, sum(lit*above) AS mass FROM v GROUP BY ALL),
t AS (SELECT image, sum(w) AS w_all, sum(lit) AS lit, sum(litL) AS litL, sum(mass) AS mass FROM s GROUP BY image),
r AS (SELECT image, (bin+k+36)%36 AS centre, sum(w) AS w, sum(wL) AS wL, sum(wa) AS wa, sum(wb) AS wb FROM s, (VALUES (-2),(-1),(0),(1),(2)) x(k) GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY round(w, 9) DESC, centre) AS n FROM r),
f AS (SELECT t.image, t.lit, litL, w_all <= 0 OR (t.lit > 0 AND mass/t.lit < 0.007) AS none, wL/w AS mL, wa/w AS ma, wb/w AS mb FROM t JOIN q ON t.image = q.image AND n = 1)
SELECT image, round(CASE WHEN none THEN coalesce(litL/nullif(lit, 0), 0.5) WHEN sqrt(ma*ma+mb*mb) < 0.035 THEN coalesce(litL/nullif(lit, 0), mL) ELSE mL END, 4) AS L,
round(CASE WHEN none OR sqrt(ma*ma+mb*mb) < 0.035 THEN 0 ELSE sqrt(ma*ma+mb*mb) END, 4) AS C, round(CASE WHEN none OR sqrt(ma*ma+mb*mb) < 0.035 THEN 0 ELSE {hue('ma', 'mb')} END, 3) AS H FROM f""")
def dominant_hue(spark, sf_dir):
    found = pixels.dominant(pixels.with_lab(images(spark, sf_dir)), ["image"])
    return found.select("image", *[F.round(c, d).alias(c) for c, d in (("L", 4), ("C", 4), ("H", 3))])


@query(f"""WITH {IMAGE}, p AS (SELECT image, 0.2126*{lin('r')} + 0.7152*{lin('g')} + 0.0722*{lin('b')} AS light, sqrt(pow(x-31.5, 2)+pow(y-23.5, 2))/sqrt(31.5*31.5+23.5*23.5) AS rad,
CASE WHEN y < 23.5 THEN 0 ELSE 2 END + CASE WHEN x < 31.5 THEN 0 ELSE 1 END AS q FROM image_px),
s AS (SELECT image, coalesce(avg(light) FILTER (rad < 0.3), 0) AS centre, {', '.join(f'coalesce(avg(light) FILTER (rad > 0.78 AND q = {i}), 0) AS c{i}' for i in range(4))} FROM p GROUP BY image),
m AS (SELECT *, (c0+c1+c2+c3)/4 AS mean FROM s),
v AS (SELECT *, CASE WHEN mean <= 1e-4 THEN 0 ELSE exp(-2*sqrt((pow(c0-mean,2)+pow(c1-mean,2)+pow(c2-mean,2)+pow(c3-mean,2))/4)/mean) END AS symmetry FROM m)
SELECT image, round(log2(greatest(mean, 1e-4)/greatest(centre, 1e-4)), 4) AS falloff, round(symmetry, 4) AS symmetry, symmetry >= 0.62 AS usable FROM v""")
def vignette(spark, sf_dir):
    found = pixels.vignette(images(spark, sf_dir), ["image"], F.lit(64), F.lit(48))
    return found.select("image", F.round("falloff", 4).alias("falloff"), F.round("symmetry", 4).alias("symmetry"), "usable")


@query(f"""WITH {IMAGE}, g AS (SELECT image, least(y*4//48, 3)*4 + least(x*4//64, 3) AS cell, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM image_px GROUP BY ALL), {lab_cte('g', 'lab')}
SELECT image, cell::INT AS cell, floor(L*10000+0.5)/10000 AS L, floor(a*10000+0.5)/10000 AS a, floor(b_*10000+0.5)/10000 AS b FROM lab""")
def grid_signature(spark, sf_dir):
    return pixels.signature(images(spark, sf_dir), ["image"], F.lit(64), F.lit(48))


@query("""WITH e AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS eroded FROM events) SELECT * FROM e""")
def sliding_min(spark, sf_dir):
    return pixels.sliding_min(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 3)


@query(f"""WITH {IMAGE}, c AS (SELECT image, x, y, min(r) AS v FROM image_px GROUP BY ALL)
SELECT a.image, a.x, a.y, a.v, min(b.v) AS eroded FROM c a JOIN c r ON r.image = a.image AND r.x = a.x AND r.y BETWEEN a.y-2 AND a.y+2
JOIN c b ON b.image = a.image AND b.y = r.y AND b.x BETWEEN r.x-2 AND r.x+2 GROUP BY ALL""")
def box_erosion(spark, sf_dir):
    cells = images(spark, sf_dir).groupBy("image", "x", "y").agg(F.min("r").alias("v"))
    return pixels.box_min(cells, ["image"], 2)


@query(f"""WITH {IMAGE}, l AS (SELECT image, y, x, avg(0.2126*r+0.7152*g+0.0722*b) AS luma FROM image_px GROUP BY ALL),
d AS (SELECT image, x, abs(luma - lag(luma) OVER (PARTITION BY image, y ORDER BY x)) AS d FROM l),
m AS (SELECT image, coalesce(avg(d) FILTER (x%8 = 0), 0) AS on_, coalesce(avg(d) FILTER (x%8 <> 0), 0) AS off_ FROM d WHERE d IS NOT NULL GROUP BY image)
SELECT image, round(CASE WHEN off_ < 0.45 THEN 1 ELSE on_/off_ END, 4) AS blockiness FROM m""")
def blockiness(spark, sf_dir):
    luma = colour.luma(F.col("r"), F.col("g"), F.col("b"))
    rows = images(spark, sf_dir).groupBy("image", "y", "x").agg(F.avg(luma).alias("luma"))
    return pixels.blockiness(rows, ["image"], "y", "x", "luma").select("image", F.round("blockiness", 4).alias("blockiness"))


@query(f"""WITH {IMAGE}, m AS (SELECT DISTINCT x*16//64 AS mx, y*12//48 AS my, ((x*16//64)*31 + (y*12//48)*57)%256 AS v FROM image_px)
SELECT image, count(*) AS n, round(avg(r), 4) AS r FROM image_px JOIN m ON least(15, x*16//64) = mx AND least(11, y*12//48) = my WHERE v >= 128 GROUP BY image""")
def mask_join(spark, sf_dir):
    """Pixels inside a mask on a coarser grid of its own."""
    at = images(spark, sf_dir).withColumn("mx", pixels.mask_cell(F.col("x"), F.lit(64), F.lit(16))).withColumn("my", pixels.mask_cell(F.col("y"), F.lit(48), F.lit(12)))
    mask = at.select("mx", "my", ((F.col("mx") * 31 + F.col("my") * 57) % 256).alias("v")).distinct()
    return at.join(mask.where("v >= 128"), ["mx", "my"]).groupBy("image").agg(F.count("*").alias("n"), F.round(F.avg("r"), 4).alias("r"))


@query("""SELECT coalesce(a.px, b.px) AS px, greatest(coalesce(a.v, 0), coalesce(b.v, 0)) AS together, 255 - greatest(coalesce(a.v, 0), coalesce(b.v, 0)) AS complement
FROM (SELECT p_partkey%500 AS px, max(p_size*5) AS v FROM part WHERE p_partkey%2 = 0 GROUP BY 1) a FULL JOIN (SELECT p_partkey%500 AS px, max(p_size*4) AS v FROM part WHERE p_partkey%3 = 0 GROUP BY 1) b ON a.px = b.px""")
def mask_union(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("px", F.col("p_partkey") % 500)
    a = part.where("p_partkey % 2 = 0").groupBy("px").agg(F.max(F.col("p_size") * 5).alias("v"))
    b = part.where("p_partkey % 3 = 0").groupBy("px").agg(F.max(F.col("p_size") * 4).alias("w"))
    both = a.join(b, "px", "full_outer").withColumn("together", F.greatest(F.coalesce("v", F.lit(0)), F.coalesce("w", F.lit(0))))
    return both.select("px", "together", (255 - F.col("together")).alias("complement"))


EMB = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, vec_id%7+1 AS h, vec_id%5+1 AS w, vec_id%37/37.0::DOUBLE AS L, vec_id%11/40.0::DOUBLE AS C, vec_id%360*1.0::DOUBLE AS H,
CASE WHEN vec_id%9 <> 4 THEN list_transform(range(48), lambda i: (vec_id*(i + 3))%17/40.0::DOUBLE) END AS grid FROM embeddings),
raw AS (SELECT c.vec_id, 1 - list_dot_product(r.v, c.v) AS emb, CASE WHEN c.grid IS NULL THEN 0 ELSE sqrt(list_sum(list_transform(range(16), lambda i: pow(r.grid[i*3 + 1] - c.grid[i*3 + 1], 2)))) END AS tone,
CASE WHEN c.grid IS NULL THEN 0 ELSE sqrt(list_sum(list_transform(range(16), lambda i: pow(r.grid[i*3 + 2] - c.grid[i*3 + 2], 2) + pow(r.grid[i*3 + 3] - c.grid[i*3 + 3], 2)))) END AS layout, abs(ln((c.h/c.w)/(r.h/r.w))) AS asp,
sqrt(pow(r.L-c.L, 2)+pow(r.C*cos(radians(r.H))-c.C*cos(radians(c.H)), 2)+pow(r.C*sin(radians(r.H))-c.C*sin(radians(c.H)), 2)) AS dom
FROM e c, (SELECT * FROM e WHERE vec_id = 0) r WHERE c.vec_id <> 0),
sc AS (SELECT vec_id, 0.6*emb + 0.25*tone + 0.15*asp AS comp, 0.65*layout + 0.35*dom AS col FROM raw),
nm AS (SELECT vec_id, (comp - min(comp) OVER ())/coalesce(nullif(max(comp) OVER () - min(comp) OVER (), 0), 1) AS comp, (col - min(col) OVER ())/coalesce(nullif(max(col) OVER () - min(col) OVER (), 0), 1) AS col FROM sc)"""


def _looks(spark, sf_dir):
    k = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        k.alias("id"), "embedding", (k % 7 + 1).alias("height"), (k % 5 + 1).alias("width"), F.when(k % 9 != 4, F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: k * (i + 3) % 17 / 40.0)).alias("grid"),
        (k % 37 / 37.0).alias("L"), (k % 11 / 40.0).alias("C"), (k % 360).cast("double").alias("H"),
    )


@query(f"WITH {EMB} SELECT vec_id AS id, round(comp, 6) AS comp, round(col, 6) AS col FROM nm")
def similar_scores(spark, sf_dir):
    rows = _looks(spark, sf_dir)
    found = ranking.similar(rows.where("id = 0"), rows.where("id <> 0"))
    return found.select("id", F.round("comp", 6).alias("comp"), F.round("col", 6).alias("col"))


@query(f"WITH {EMB} SELECT vec_id AS id, round(0.6*comp + 0.4*col, 6) AS score FROM nm ORDER BY round(0.6*comp + 0.4*col, 9), vec_id LIMIT 30")
def similar_rank(spark, sf_dir):
    rows = _looks(spark, sf_dir)
    found = ranking.blended(ranking.similar(rows.where("id = 0"), rows.where("id <> 0")), 0.6, 30)
    return found.select("id", F.round("score", 6).alias("score"))


LOOK = f"""{IMAGE_SQL}, {ZONE_SQL}, g AS (SELECT image, avg(a) AS ga, avg(b_) AS gb, avg(C) AS gc, sqrt(greatest(0, avg(L*L)-avg(L)*avg(L))) AS sd FROM lab GROUP BY image),
zs AS (SELECT image, zone, floor(sum(w)+0.5) AS sampled, sum(w*a)/sum(w) AS za, sum(w*b_)/sum(w) AS zb FROM zz WHERE w > 0 GROUP BY ALL),
sp AS (SELECT h.image, h.za-s.za AS sa, h.zb-s.zb AS sb FROM zs h JOIN zs s ON h.image = s.image WHERE h.zone = 'zone.highlight' AND s.zone = 'zone.shadow' AND h.sampled >= 10 AND s.sampled >= 10),
hb AS (SELECT image, {BIN_SQL} AS bin, count(*)::DOUBLE AS n FROM lab GROUP BY ALL),
hc AS (SELECT *, sum(n) OVER (PARTITION BY image ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY image) AS total FROM hb),
pc AS (SELECT image, step, CASE WHEN step = 0 THEN 0 ELSE min(bin) END/511.0::DOUBLE AS level FROM hc, range(21) r(step) WHERE cum >= step/20.0::DOUBLE*total GROUP BY image, step),
tone AS (SELECT c.image, sqrt(sum(pow(c.level-r.level, 2))/21) AS tone FROM pc c JOIN pc r ON c.step = r.step WHERE r.image = 1 GROUP BY c.image),
pt AS (SELECT c.image, tone/0.04 AS tone, sqrt(pow(c.ga-r.ga, 2)+pow(c.gb-r.gb, 2))/0.02 AS cast_, abs(c.gc-r.gc)/0.025 AS sat, abs(c.sd-r.sd)/0.03 AS con,
sqrt(pow(s.sa-q.sa, 2)+pow(s.sb-q.sb, 2))/0.02 AS split FROM g c JOIN tone USING (image) CROSS JOIN (SELECT * FROM g WHERE image = 1) r LEFT JOIN sp s ON s.image = c.image LEFT JOIN sp q ON q.image = 1),
ds AS (SELECT image, (tone*0.34 + cast_*0.24 + sat*0.17 + con*0.15 + coalesce(split*0.10, 0))/(0.9 + CASE WHEN split IS NULL THEN 0 ELSE 0.1 END) AS distance, split IS NULL AS no_split FROM pt WHERE image <> 1)"""


@query(f"{LOOK} SELECT image AS id, round(distance, 4) AS distance, no_split FROM ds WHERE distance <= 2.5 ORDER BY round(distance, 9), image LIMIT 8")
def resemble_rank(spark, sf_dir):
    looks = ranking.looks(pixels.with_lab(images(spark, sf_dir)), "image")
    found = ranking.resemblance(looks.where("id = 1"), looks.where("id <> 1"), least_sampled=10)
    ranked = ranking.nearest(found, 2.5, 8)
    return ranked.select("id", F.round("distance", 4).alias("distance"), F.array_contains("missing", "split").alias("no_split"))


@query("""SELECT vec_id AS id, list_transform(embedding, lambda x: floor(x::DOUBLE/sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))*100000+0.5)/100000) AS v FROM embeddings""")
def unit_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vectors.normalised(F.col("embedding").cast("array<double>")).alias("v"))


@query("""WITH c AS (SELECT c_custkey AS id, [{'x': 0.0, 'y': 0.0}, {'x': 60.0 + c_custkey%40, 'y': 90.0}, {'x': 255.0, 'y': 255.0}] AS p FROM customer)
SELECT id, round((SELECT sum(CASE WHEN i <= p[2].x THEN 90.0*i/p[2].x ELSE 90 + 165*(i-p[2].x)/(255-p[2].x) END) FROM range(256) r(i)), 4) AS total FROM c""")
def curve_table(spark, sf_dir):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    points = F.array(point(F.lit(0), 0), point(60 + F.col("id") % 40, 90), point(F.lit(255), 255))
    rows = timeline.dealt_out(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))  # a small file would be one task
    return rows.select("id", points.alias("p")).select("id", F.round(vectors.total(vectors.curve(F.col("p"))), 4).alias("total"))


@query("SELECT count(*) AS n, count(DISTINCT p_brand) AS chapters, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM part")
def stamp(spark, sf_dir):
    """One row that identifies a record set, all its ids in order."""
    rows = table(spark, sf_dir, "part")
    ids = F.array_sort(F.collect_list("p_partkey"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("chapters"), F.array_join(ids, ",").alias("ids"))


@query("""WITH i AS (SELECT p_partkey AS id, 400 + p_partkey*7%3000 AS w, 400 + p_partkey*11%2000 AS h FROM part), r AS (SELECT *, w - 2*floor(w*0.08)::INT - 192 AS sx, h - 2*floor(h*0.08)::INT - 192 AS sy FROM i)
SELECT id, gx::INT AS gx, gy::INT AS gy, ((floor(w*0.08)::INT + floor(sx*gx/3.0::DOUBLE + 0.5)::INT)>>3)<<3 AS "left", ((floor(h*0.08)::INT + floor(sy*gy/2.0::DOUBLE + 0.5)::INT)>>3)<<3 AS top FROM r, range(4) a(gx), range(3) b(gy) WHERE sx > 0 AND sy > 0""".replace('<<3 AS "left"', '<<3)::INT AS "left"').replace("((floor(w", "(((floor(w").replace("<<3 AS top", "<<3)::INT AS top").replace("((floor(h", "(((floor(h"))
def texture_grid(spark, sf_dir):
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(p.alias("id"), (p * 7 % 3000 + 400).cast("int").alias("width"), (p * 11 % 2000 + 400).cast("int").alias("height"))
    return texture.origins(rows).select("id", "gx", "gy", "left", "top")


def image_masks(spark, sf_dir):
    """(image, region, width, height, x, y, level): a sky for two images of three and skin for every fourth, on a grid of 20 by 15."""
    k = F.col("image")
    every = images(spark, sf_dir).select("image").distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(299))).alias("i"))
    rows = every.select("image", (F.col("i") % 20).alias("x"), F.floor(F.col("i") / 20).cast("int").alias("y"))
    sky = rows.where("image % 3 > 0").select("image", F.lit("scene.sky").alias("region"), "x", "y", ((k * 31 + F.col("x") * 7 + F.col("y") * 13) % 256).alias("level"))
    skin = rows.where("image % 4 = 1").select("image", F.lit("people.skin").alias("region"), "x", "y", ((k * 17 + F.col("x") * 29 + F.col("y") * 3) % 256).alias("level"))
    return sky.union(skin).select("image", "region", F.lit(20).alias("width"), F.lit(15).alias("height"), "x", "y", "level")


_LEVEL_CELL = "least(19, floor(sx*20/sw)::INT) AS mx, least(14, floor(sy*15/sh)::INT) AS my"


@query(f"""{IMAGE_SQL}, lv AS (SELECT image, edge, L, a, b_, C, x//s AS sx, y//s AS sy, (64 + s - 1)//s AS sw, (48 + s - 1)//s AS sh FROM lab, (VALUES (64, 1), (32, 2), (16, 4)) v(edge, s) WHERE x%s = 0 AND y%s = 0),
zw AS (SELECT *, greatest(0, 1-L/0.5) AS wsh, greatest(0, (L-0.5)/0.5) AS whi, greatest(0, 1-abs(L-0.5)/0.5) AS wmi, {_LEVEL_CELL} FROM lv),
rg AS (SELECT *, 'global' AS region, 1.0::DOUBLE AS w FROM zw UNION ALL SELECT *, 'zone.shadow', wsh/(wsh+wmi+whi) FROM zw UNION ALL SELECT *, 'zone.midtone', wmi/(wsh+wmi+whi) FROM zw UNION ALL SELECT *, 'zone.highlight', whi/(wsh+wmi+whi) FROM zw
  UNION ALL SELECT *, 'scene.sky', 1.0 FROM zw WHERE image%3 > 0 AND (image*31 + mx*7 + my*13)%256 >= 128 UNION ALL SELECT *, 'people.skin', 1.0 FROM zw WHERE image%4 = 1 AND (image*17 + mx*29 + my*3)%256 >= 128),
st AS (SELECT image, edge, region, sum(w) AS n, sum(w*L)/sum(w) AS L, sum(w*L*L)/sum(w) AS LL, sum(w*C)/sum(w) AS C, sum(w*C*C)/sum(w) AS CC, sum(w*a)/sum(w) AS a, sum(w*b_)/sum(w) AS b FROM rg WHERE w > 0 GROUP BY ALL),
gl AS (SELECT image, edge, n AS whole FROM st WHERE region = 'global'),
mk AS (SELECT i.image, r.region, avg((CASE r.region WHEN 'scene.sky' THEN (i.image*31 + c%20*7 + c//20*13)%256 ELSE (i.image*17 + c%20*29 + c//20*3)%256 END >= 128)::INT) AS coverage FROM (SELECT DISTINCT image FROM image_px) i, (VALUES ('scene.sky'), ('people.skin')) r(region), range(300) q(c) GROUP BY ALL),
hb AS (SELECT image, edge, region, {BIN_SQL} AS bin, sum(w) AS n FROM rg WHERE w > 0 GROUP BY ALL),
hc AS (SELECT *, sum(n) OVER (PARTITION BY image, edge, region ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY image, edge, region) AS total FROM hb),
md AS (SELECT image, edge, region, min(bin) FILTER (cum >= 0.5::DOUBLE*total) AS median FROM hc GROUP BY ALL)
SELECT st.image, st.edge, st.region, round(CASE WHEN st.region = 'global' THEN 1 WHEN st.region LIKE 'zone.%' THEN n/greatest(1, whole) ELSE mk.coverage END, 6) AS coverage, floor(n + 0.5)::BIGINT AS sampled,
  round(L, 6) AS L, round(sqrt(greatest(0, LL - L*L)), 5) AS L_sd, round(C, 6) AS C, round(sqrt(greatest(0, CC - C*C)), 5) AS C_sd, round(a, 6) AS a, round(b, 6) AS b, round(CASE WHEN C > 1e-6 THEN least(1, sqrt(a*a + b*b)/C) ELSE 0 END, 5) AS strength, CASE WHEN st.region IN ('global', 'scene.sky', 'people.skin') THEN median END AS median
FROM st JOIN gl ON st.image = gl.image AND st.edge = gl.edge JOIN md ON st.image = md.image AND st.edge = md.edge AND st.region = md.region LEFT JOIN mk ON st.image = mk.image AND st.region = mk.region WHERE n >= 1e-6""")
def region_measures(spark, sf_dir):
    """All regions of each image at three sampling edges (small ones, as the images are), from one scan: the whole, zones and masks on a grid of their own."""
    masks = image_masks(spark, sf_dir)
    rows = images(spark, sf_dir).withColumns({"width": F.lit(64), "height": F.lit(48)})
    found = measure.region_stats(measure.measure(rows, "image", masks, (64, 32, 16)), ["image", "edge"], measure.coverage(masks, "image"))
    median = F.floor(F.get("curve", F.lit(10)) * 511 + 0.5).cast("int")  # shares of a zone's weight are near ties of sums, so only whole counts are compared
    names = {"coverage": 6, "L": 6, "L_sd": 5, "C": 6, "C_sd": 5, "a": 6, "b": 6, "strength": 5}
    return found.select("image", "edge", "region", "sampled", *[F.round(c, n).alias(c) for c, n in names.items()], F.when(F.col("region").isin("global", "scene.sky", "people.skin"), median).alias("median"))


def small_images(spark, sf_dir):
    """(image, x, y, luma): five images of 16 by 12 samples, each the mean of many pixels."""
    luma = colour.luma(F.col("r"), F.col("g"), F.col("b"))
    at = (F.col("image") % 5).alias("image"), F.floor(F.col("x") / 4).alias("x"), F.floor(F.col("y") / 4).alias("y")
    return images(spark, sf_dir).groupBy(*at).agg(F.avg(luma).alias("luma"))


@query()
def texture_crops(spark, sf_dir):
    """Texture of images that are one small crop each; those with a missing sample are refused."""
    return texture.image_texture(texture.crops(small_images(spark, sf_dir), ["image"]), "image", F.lit(1000), F.lit(600))


#: A side of the crops of photos that arithmetic stands in for, and how many of them one task makes and measures.
SMALL_CROP, TASK_CROPS = texture.CROP, 64


def textured(spark, sf_dir):
    """(id, width, height): a photo for each supplier, from too small ones to ones that are compared at a smaller size."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.alias("id"), (s * 997 % 3400 + 700).cast("int").alias("width"), (s * 613 % 2000 + 450).cast("int").alias("height"))


def texture_luma(k: Column, x: Column, y: Column) -> Column:
    """Light of a pixel: by key steps of blocks, hardly any detail, or noise over an edge."""
    noise = F.pmod(F.xxhash64(k, x, y), F.lit(1000)) / 1000.0
    blocks = F.pmod(F.xxhash64(k, F.floor(x / 8), F.floor(y / 8)), F.lit(180)) + noise * 4
    smooth = 90 + x % 64 / 8.0 + noise * 0.2
    grainy = 60 + noise * (k % 9 * 3 + 4) + F.when((x + y) % 40 < 20, k % 7 * 12 + 10).otherwise(0)
    return F.when(k % 5 == 1, blocks).when(k % 5 == 2, smooth).otherwise(grainy)


def crop_pixels(places: DataFrame) -> DataFrame:
    """(id, gx, gy, x, y, luma) of the crops at places (id, gx, gy, left, top), each made where it is measured."""
    places = timeline.dealt_out(places, ["id", "gx", "gy"], TASK_CROPS)
    i = F.explode(F.sequence(F.lit(0), F.lit(SMALL_CROP**2 - 1)))
    rows = places.select("id", "gx", "gy", "left", "top", i.alias("i")).select("id", "gx", "gy", (F.col("left") + F.col("i") % SMALL_CROP).alias("x"), (F.col("top") + F.floor(F.col("i") / SMALL_CROP)).alias("y"))
    return rows.withColumn("luma", texture_luma(F.col("id"), F.col("x"), F.col("y")))


def textures(spark, sf_dir, wanted: DataFrame | None = None):
    """Textures of all photos, or of those that wanted (photo) names: no others are measured."""
    images = textured(spark, sf_dir)
    images = images if wanted is None else images.join(wanted, F.col("id") == F.col("photo"), "left_semi")
    spread = F.array(*[F.struct(F.lit(x).alias("gx"), F.lit(y).alias("gy")) for x, y in texture.SPREAD])
    native = texture.origins(images, SMALL_CROP).where(F.array_contains(spread, F.struct("gx", "gy")))
    scaled = texture.origins(texture.normalised(images), SMALL_CROP)
    crops = [texture.crops(crop_pixels(p), ["id", "gx", "gy"]) for p in (native, scaled)]
    return texture.gated(images, *crops)


@query()
def image_textures(spark, sf_dir):
    """Grain, its size and sharpness of each photo, or why they can't be told, through all gates."""
    return textures(spark, sf_dir)


GRADE_SQL = f"""{IMAGE_SQL}, {ZONE_SQL}, zs AS (SELECT image, zone, sum(w) AS n, sum(w*a)/sum(w) AS a, sum(w*b_)/sum(w) AS b FROM zz WHERE w > 0 GROUP BY ALL),
zc AS (SELECT *, n/sum(n) OVER (PARTITION BY image) AS coverage FROM zs), rf AS (SELECT zone, greatest(1e-4, coverage) AS w, a AS ra, b AS rb FROM zc WHERE image = 1),
g AS (SELECT image, least(3, greatest(0.25, coalesce(sum(w*sqrt(ra*ra+rb*rb))/nullif(sum(w*sqrt(a*a+b*b)), 0), 1))) AS ratio, sum(w*a) AS sa, sum(w*b) AS sb, sum(w*ra) AS sra, sum(w*rb) AS srb, sum(w) AS n FROM zc JOIN rf USING (zone) WHERE image <> 1 GROUP BY image),
hb AS (SELECT image, {BIN_SQL} AS bin, count(*)::DOUBLE AS n FROM lab GROUP BY ALL), hc AS (SELECT *, sum(n) OVER (PARTITION BY image ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY image) AS total FROM hb),
pc AS (SELECT image, step, CASE WHEN step = 0 THEN 0 ELSE min(bin) END/511.0::DOUBLE AS level FROM hc, range(21) r(step) WHERE cum >= step/20.0::DOUBLE*total GROUP BY image, step),
ex AS (SELECT c.image, avg(log2(r.level/c.level)) FILTER (r.level > 0.02 AND c.level > 0.02) AS lr FROM pc c JOIN pc r ON c.step = r.step AND r.image = 1 WHERE c.step BETWEEN 2 AND 18 AND c.step%2 = 0 GROUP BY c.image)"""


@query(f"""{GRADE_SQL} SELECT image, round(greatest(-3, least(3, coalesce(3*lr, 0))), 4) AS faithful, round(greatest(-1.2, least(1.2, coalesce(3*lr, 0)*0.62)), 4) AS restrained, round(ratio, 4) AS ratio, round((sra - ratio*sa)/n, 4) AS da, round((srb - ratio*sb)/n, 4) AS db FROM g JOIN ex USING (image)""")
def grade_match(spark, sf_dir):
    """Exposure, saturation and cast that bring each image to the first one."""
    lab = pixels.with_lab(images(spark, sf_dir))
    zones = pixels.zones(lab).groupBy("image", "zone").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("a")) / F.sum("w")).alias("a"), (F.sum(F.col("w") * F.col("b_")) / F.sum("w")).alias("b"))
    zones = zones.withColumn("coverage", F.col("n") / F.sum("n").over(Window.partitionBy("image")))
    colours = grade.zone_grade(zones, "image", 1)
    looks = ranking.looks(lab, "image").select("id", "curve")
    curves = looks.join(F.broadcast(looks.where("id = 1").select(F.col("curve").alias("told"))))
    stops = curves.select(F.col("id").alias("image"), *[F.round(grade.exposure_stops(F.col("told"), F.col("curve"), r), 4).alias(n) for n, r in (("faithful", False), ("restrained", True))])
    return colours.join(stops, "image").select("image", "faithful", "restrained", *[F.round(c, 4).alias(c) for c in ("ratio", "da", "db")])
