"""Golden values and invariants of functions and of operators that SQL can't express."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumaframe.functions import clock, colour, field, geodesy, sky, text, vectors
from lumaframe.operators import archive, itinerary, pixels, places, terrain, timeline
from lumaframe.sources import feeds, sinks


def one(spark, expr, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()] or [F.lit(1).alias("x")])
    return row.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(("width", "tags"), [(4341, ["640", "1280", "2000"]), (1500, ["640", "1280"]), (700, ["640"]), (480, ["full"]), (0, ["640", "1280", "2000"])])
def test_expected_tags(spark, width, tags):
    assert one(spark, archive.expected_tags(F.col("w")), w=width) == tags


def test_names_and_tags(spark):
    assert one(spark, archive.tag_of(F.lit("d62b2154e7fee842-2000.avif"))) == "2000"
    assert one(spark, archive.tag_of(F.lit(".gitkeep"))) is None
    assert one(spark, colour.chapter_name(F.lit("achromatic-deep"))) == "Charcoal"
    assert one(spark, colour.chapter_name(F.lit("teal-pale"))) == "Pale Teal"
    assert one(spark, colour.chapter_name(F.lit("teal-pale"), F.lit("Sea"))) == "Pale Sea"


@pytest.mark.parametrize(("hue", "anchor"), [(8.9, "magenta"), (9.1, "red"), (359.0, "magenta"), (28.0, "red"), (45.0, "red"), (122.6, "green")])
def test_hue_boundaries(spark, hue, anchor):
    assert one(spark, colour.nearest_anchor(F.col("h")), h=hue) == anchor


def test_colour_of_primaries(spark):
    got = one(spark, colour.oklch(F.lit(255), F.lit(0), F.lit(0)))
    assert (round(got.L, 3), round(got.C, 3), round(got.H, 1)) == (0.628, 0.258, 29.2)
    assert sum(z.w for z in one(spark, colour.zone_weights(F.lit(0.37)))) == pytest.approx(1)
    assert one(spark, colour.signed_delta(F.lit(180.0), F.lit(0.0))) == 180 and one(spark, colour.signed_delta_low(F.lit(180.0), F.lit(0.0))) == -180
    assert one(spark, colour.hex_colour(F.lit(1.0), F.lit(0.0), F.lit(0.5))) == "#ff00bc"


def test_missing_vectors(spark):
    a, none = F.array(F.lit(1.0), F.lit(0.0)), F.lit(None).cast("array<double>")
    assert one(spark, vectors.embedding_distance(a, none)) == 2 and one(spark, vectors.embedding_distance(a, F.array(F.lit(1.0)))) == 2
    assert one(spark, vectors.grid_distance(none, none, (0,))) == 0 and one(spark, vectors.rms(a, none)) is None
    assert one(spark, vectors.lerp_hue(F.lit(350.0), F.lit(10.0), F.lit(0.5))) == pytest.approx(0)
    assert one(spark, vectors.clamp(F.lit(float("nan")), -1, 1)) == 0


def at(*when):
    return datetime.datetime(*when, tzinfo=datetime.UTC).timestamp()


def test_sun(spark):
    rows = [(51.4769, 0.0, at(2026, 6, 21, 12, 2)), (0.0, 0.0, at(2026, 3, 20, 12, 7)), (69.65, 18.96, at(2026, 12, 21, 11))]
    df = spark.createDataFrame(rows, "lat double, lon double, t double")
    a, b, c = sky.SUN.on(df).collect()
    assert a.sun_altitude == pytest.approx(90 - 51.4769 + 23.436, abs=0.02) and a.sun_azimuth == pytest.approx(180, abs=0.5)
    assert b.sun_altitude > 89.5 and c.phase == "golden"
    days = sky.DAY.on(df).collect()
    assert days[0].sunrise == pytest.approx(at(2026, 6, 21, 3, 43), abs=120) and days[0].sunset == pytest.approx(at(2026, 6, 21, 20, 22), abs=120)
    assert days[2].polar == "polar-night" and days[2].sunrise is None


def test_moon_and_core(spark):
    full, new = at(2026, 8, 28, 4, 19), at(2026, 8, 12, 17, 37)
    df = spark.createDataFrame([(55.95, -3.19, full), (55.95, -3.19, new)], "lat double, lon double, t double")
    a, b = sky.ILLUMINATION.on(df).collect()
    assert a.moon_phase == "full" and a.lit > 0.99 and b.moon_phase == "new" and b.lit < 0.01
    moon = sky.MOON.on(df).first()
    assert 356_000 < moon.moon_km < 407_000
    core = sky.CORE.on(spark.createDataFrame([(-24.5, -69.25, float(t)) for t in range(int(full), int(full) + 86400, 600)], "lat double, lon double, t double"))
    assert core.agg(F.max("core_altitude")).first()[0] == pytest.approx(90 - abs(-24.5 + 29.0), abs=0.2)


def test_clock_changes(spark):
    grid = {(str(r.day), r.minute): r["at"] for r in clock.month_grid(spark.createDataFrame([(m, "Europe/London") for m in ("2026-03", "2026-10", "2026-13", "2028-02")], "month string, zone string"), [90]).collect()}
    assert grid["2026-03-29", 90] is None and len(grid) == 31 + 31 + 29
    assert grid["2026-10-25", 90] == datetime.datetime(2026, 10, 25, 0, 30)


def test_weather(spark):
    rows = [(0, 0.0, None, None, None, 30.0), (4, None, None, None, None, 30.0), (None, 50.0, 30.0, 0.0, 5.0, -5.0)]
    df = spark.createDataFrame(rows, "code int, cloud double, low double, mid double, high double, sun double")
    got = field.CLOUD.on(df).collect()
    assert [r.condition for r in got] == ["Clear", "Code 4", "Not known"]
    assert [r.quality for r in got] == ["hard", "unknown", "none"] and got[2].dominant == "low" and got[1].direct == 1


def test_geodesy(spark):
    df = spark.createDataFrame([(55.9533, -3.1883, 55.9533 + math.degrees(30 / 6371000), -3.1883 + math.degrees(40 / 6371000 / math.cos(math.radians(55.9533))))], "lat1 double, lon1 double, lat2 double, lon2 double")
    assert geodesy.INVERSE.on(df).first().flat == pytest.approx(50, abs=0.5)


def test_paths_and_folds():
    rng = np.random.default_rng(2)
    p = rng.random((60, 3))
    length = lambda o: float(np.linalg.norm(np.diff(p[o], axis=0), axis=1).sum())
    order = list(rng.permutation(60))
    short = archive.shorten(p, order)
    assert sorted(short) == list(range(60)) and length(short) < length(order)
    groups = pd.DataFrame({"chapter": ["achromatic", "red", "orange", "teal"], "n": [1, 2, 9, 9], "sL": [0.5, 1.0, 4.5, 4.5], "sa": [0.0, 0.2, 0.8, -0.9], "sb": [0.0, 0.1, 0.9, -0.3]})
    assert archive.fold_small_chapters(groups).tolist() == ["achromatic", "orange", "orange", "teal"]


def test_day_plan(spark):
    windows = "array<struct<start: int, end: int>>"
    rows = [(1, 1, 55.95, -3.19, 500, [(480, 520)]), (1, 2, 55.96, -3.19, 430, [(400, 450)]), (1, 3, 55.95, -3.18, 700, [(690, 700)]), (2, 1, 10.0, 0.0, 100, [(90, 130)]), (2, 2, 40.0, 90.0, 140, [(130, 170)])]
    df = spark.createDataFrame(rows, f"plan int, pos int, lat double, lon double, best int, windows {windows}")
    got = {r.plan: r for r in itinerary.day_plans(df).collect()}
    assert [s.pos for s in got[1].stops] == [2, 1] and got[1].scheduled == 2 and got[2].scheduled == 1
    for r in got.values():
        assert all(b.start >= a.start + 20 for a, b in zip(r.stops, r.stops[1:], strict=False))


def test_shadow_mask_matches_rays(spark):
    rng = np.random.default_rng(5)
    h = rng.random((24, 24)) * 60
    df = spark.createDataFrame([(int(r), int(c), float(h[r, c])) for r in range(24) for c in range(24)], "row int, col int, height double")
    for az in (0.0, 90.0, 180.0, 270.0):
        got = {(r.row, r.col): r.shaded for r in terrain.shadow_mask(df, az, 20.0, 30.0).collect()}
        dr, dc = {0.0: (-1, 0), 90.0: (0, 1), 180.0: (1, 0), 270.0: (0, -1)}[az]
        for (r, c), dark in got.items():
            ray = [(r + k * dr, c + k * dc, 30 * k) for k in range(1, 24) if 0 <= r + k * dr < 24 and 0 <= c + k * dc < 24]
            assert dark == any(h[i, j] - d * d / (2 * terrain.EFFECTIVE_RADIUS_M) > h[r, c] + d * math.tan(math.radians(20)) for i, j, d in ray)
    assert terrain.shadow_mask(df, 0.0, -1.0, 30.0).where("NOT shaded").count() == 0


def test_hull():
    p = np.random.default_rng(3).random((50, 2))
    h = terrain.hull(p)
    turns = [np.cross(np.append(b - a, 0), np.append(q - b, 0))[2] for a, b, q in zip(h, np.roll(h, -1, 0), np.roll(h, -2, 0), strict=True)]
    assert min(turns) > 0
    inside = [all(np.cross(np.append(b - a, 0), np.append(q - a, 0))[2] >= -1e-12 for a, b in zip(h, np.roll(h, -1, 0), strict=True)) for q in p]
    assert all(inside)


def test_alignment_times(spark):
    from lumaframe.plans.catalogue import QUERIES

    rows = QUERIES["sun_alignments"](spark, "/root/testdata/sf0.001").limit(200).collect()
    check = spark.createDataFrame([(r.spot % 100 - 50.0, r.spot * 7 % 360 - 180.0, r.t, float(r.spot * 31 % 360)) for r in rows], "lat double, lon double, t double, bearing double")
    off = sky.SUN.on(check).select(F.abs(colour.signed_delta(F.col("sun_azimuth"), F.col("bearing"))).alias("o")).agg(F.max("o")).first()[0]
    assert rows and off < 0.05


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, -1.0), (1, 10, 1.0), (1, 20, 3.0), (1, 30, -1.0), (2, 0, 2.0), (2, 10, 2.0)], "k int, t int, v double")
    got = sorted((r.k, r.start, r.end) for r in timeline.positive_intervals(df, ["k"], "t", "v").collect())
    assert got == [(1, 5.0, 27.5), (2, 0.0, 10.0)]
    a = spark.createDataFrame([(0, 0, 100), (0, 200, 300)], "k int, start int, end int")
    b = spark.createDataFrame([(0, 100, 200), (0, 50, 250)], "k int, start int, end int")
    assert sorted((r.start, r.end) for r in timeline.intersections(a, b, ["k"], 30).collect()) == [(50, 100), (200, 250)]


def test_text_and_feeds(spark, tmp_path):
    assert one(spark, text.plain_text(F.lit("<b>a</b>&amp;lt; &#39;x&#039;  y"))) == "a <  'x' y".replace("  ", " ")
    assert one(spark, text.medium(F.lit(None).cast("string"), F.lit("VueScan 9"), F.lit(False))) == "film"
    assert one(spark, text.shutter(F.lit(0.004))) == "1/250s" and one(spark, text.degrees_of(F.lit(55), F.lit(57), F.lit(11.9), F.lit("S"))) == -55.953306
    bad = spark.createDataFrame([(i, b) for i, b in enumerate([None, "{}", "[]", "x", '{"hourly": {"time": 3}}'])], "k int, body string")
    assert feeds.forecast(bad, "k", "body").count() == 0 and feeds.seeing(bad, "k", "body").count() == 0
    spots = spark.createDataFrame([(1, '[{"name": " a ", "lat": 1, "lon": 2, "radiusKm": 900}, {"name": "", "lat": 1, "lon": 2}, {"name": "b", "lat": 91, "lon": 2}]')], "k int, body string")
    assert [(r.name, r.radius) for r in feeds.saved_spots(spots, "k", "body").collect()] == [("a", None)]
    (tmp_path / "a.jpg").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"abc")
    assert [r.id for r in feeds.originals(spark, str(tmp_path)).collect()] == ["ba7816bf8f01cfea"]
    sinks.replace_table(spark.range(3), f"{tmp_path}/t")
    sinks.replace_table(spark.range(5), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 5


def test_percentiles_of_a_flat_image(spark):
    df = spark.createDataFrame([(1, 255, 3.0)], "g int, bin int, n double")
    got = pixels.histogram_percentiles(df, ["g"]).orderBy("step").collect()
    assert len(got) == 21 and got[0].level == 0 and got[1].level == 255 / 511


def brute_pairs(a, b, metres, distance):
    return {(i, j) for i, la, lo in a for j, lb, lp in b if distance(la, lo, lb, lp) <= metres}


def flat(la, lo, lb, lp):
    turn = (lp - lo + 180) % 360 - 180
    return math.hypot(math.radians(lb - la), math.radians(turn) * math.cos(math.radians((la + lb) / 2))) * 6371000.0


def sphere(la, lo, lb, lp):
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize(("metres", "kind"), [(60.0, "flat"), (5000.0, "flat"), (5000.0, "sphere"), (700_000.0, "sphere")])
def test_within_has_no_holes(spark, metres, kind):
    rng = np.random.default_rng(7)
    rows, step = [], metres / 111_000
    for lat in (-90.0, -89.99, -85.0, -80.2, 0.0, 55.9, 79.9, 85.0, 89.0, 89.9999, 90.0):
        for lon in (-180.0, -179.99, 0.0, 179.99, 180.0):
            for _ in range(3):
                rows.append((len(rows), float(np.clip(lat + rng.normal() * step, -90, 90)), float((lon + rng.normal() * step / max(0.01, math.cos(math.radians(lat))) + 180) % 360 - 180)))
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    how = {"flat": (places.flat_metres, flat), "sphere": (places.great_circle, sphere)}[kind]
    got = [(r.a_id, r.b_id) for r in places.within(df, df, metres, how[0]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, rows, metres, how[1])


def test_terrain_shadow_of_any_direction(spark):
    rng = np.random.default_rng(5)
    field = {(r, c): float(rng.random() * 60) for r in range(24) for c in range(24)}
    df = spark.createDataFrame([(r, c, h) for (r, c), h in field.items()], "row long, col long, height double")
    for azimuth, altitude in ((90.0, 12.0), (301.0, 7.0), (200.0, 20.0)):
        dx, dy = math.sin(math.radians(azimuth)), -math.cos(math.radians(azimuth))
        slope, step = math.tan(math.radians(altitude)), 30.0 / max(abs(dx), abs(dy))
        line = lambda r, c: math.floor(r - c * (dy / dx) + 0.5) if abs(dx) >= abs(dy) else math.floor(c - r * (dx / dy) + 0.5)  # noqa: B023, E731
        along = lambda r, c: (c if dx > 0 else -c) if abs(dx) >= abs(dy) else (r if dy > 0 else -r)  # noqa: B023, E731
        want = {}
        for p, h in field.items():
            ahead = [(q, g) for q, g in field.items() if line(*q) == line(*p) and along(*q) > along(*p)]
            away = [((along(*q) - along(*p)) * step, g) for q, g in ahead]
            want[p] = any(g - d * d / (2 * terrain.EFFECTIVE_RADIUS_M) > h + d * slope for d, g in away)
        got = {(r.row, r.col): r.shaded for r in terrain.shadow_mask(df, azimuth, altitude, 30.0).collect()}
        assert got == want


def test_hulls_of_many_rings():
    rng = np.random.default_rng(8)
    for many in (1, 2, 3, 4, 9, 30):
        rings = np.round(rng.random((60, many, 2)) * 6)  # whole numbers: many equal and collinear corners
        for got, ring in zip(terrain.hulls(rings), rings, strict=True):
            assert got.tolist() == terrain.hull(ring).tolist()
    assert terrain.hulls(np.zeros((0, 4, 2))) == []


def test_replace_table_keeps_one(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in (3, 5):
        sinks.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_identity_is_fnv(spark):
    def plain(seed):
        out = ""
        for salt in range(4):
            h = (0x811C9DC5 ^ (salt * 0x9E3779B9)) & 0xFFFFFFFF
            for c in seed:
                h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
            out += f"{h:08X}"
        return out

    for seed in ("abc:0.50", "d62b2154e7fee842:1.00", "x"):
        assert one(spark, text.identity_of(F.col("s")), s=seed) == plain(seed)


def test_wheel_hue(spark):
    """Directions of the plane come out at the hue of a colour that lies there."""
    for rgb, want in (((255, 0, 0), 0), ((0, 255, 0), 120), ((0, 0, 255), 240), ((255, 255, 0), 60)):
        lab = one(spark, colour.oklch(*(F.lit(x) for x in rgb)))
        got = one(spark, colour.wheel_hue(F.lit(lab.C * math.cos(math.radians(lab.H))), F.lit(lab.C * math.sin(math.radians(lab.H)))))
        assert abs((got - want + 180) % 360 - 180) < 20, (rgb, got)
    assert one(spark, colour.wheel_hue(F.lit(0.0), F.lit(0.0))) == 0


def test_guard_stops_a_broken_build(spark):
    from lumaframe.operators import ledger

    audit = spark.createDataFrame([("missing", 1), ("orphan", None)], "fault string, id long")
    assert ledger.guarded(spark.range(3), audit.where("fault = 'orphan'")).count() == 3
    with pytest.raises(Exception, match="1 broken images"):
        ledger.guarded(spark.range(3), audit).collect()


def test_disc_paths(spark):
    assert one(spark, text.moon_disc(F.lit(1.0), F.lit(True))) == "M 0 -12 A 12 12 0 0 1 0 12 A 12.0 12 0 0 1 0 -12"
    assert one(spark, text.moon_disc(F.lit(0.25), F.lit(False))) == "M 0 -12 A 12 12 0 0 0 0 12 A 6.0 12 0 0 1 0 -12"


def test_no_great_circle_between_antipodes(spark):
    at = lambda *v: one(spark, places.between(*(F.lit(float(x)) for x in v)))
    got = at(0, 0, 0, 90, 0.5)
    assert (got.lat, got.lon) == (pytest.approx(0, abs=1e-9), pytest.approx(45))
    assert at(10, 20, 10, 20, 0.3).lat == 10
    with pytest.raises(Exception, match="antipodes"):
        at(0, 0, 0, 180, 0.5)


def test_json_store_and_trimmed_regions(spark, tmp_path):
    from lumaframe.operators import ranking

    (tmp_path / "store.json").write_text('[{"id": "a", "width": 3}, {"id": "b", "width": "x"}]')
    rows = feeds.json_store(spark, f"{tmp_path}/store.json", "id string, width int").collect()
    assert [(r.id, r.width) for r in rows] == [("a", 3), ("b", None)]
    assert one(spark, ranking.trimmed(F.create_map(F.lit("global"), F.lit(1), F.lit("other"), F.lit(2)), ("global",))) == {"global": 1}


def test_places_of_many_rows_meet_once(spark):
    """Pairs are found between distinct places; rows of one place are counted or joined to them."""
    rows = [(i, 55.9 + i % 3 * 0.0004, -3.2) for i in range(3000)]
    df = spark.createDataFrame([*rows, (3000, None, -3.2)], "id long, lat double, lon double")
    near = places.places_within(df, df, 60.0).collect()
    assert len(near) == 7 and len(set(near)) == 7  # three places in a row, the outer two are 89 m apart
    few = df.where("id < 30 OR lat IS NULL")
    got = [(r.a_id, r.b_id) for r in places.within(few, few, 60.0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows[:30], rows[:30], 60.0, flat)


def test_rows_of_places_are_merged(spark):
    """Rows are joined to pairs of places by merges at every size: none is broadcast, so none passes through the driver."""
    df = spark.createDataFrame([(i, 55.9, -3.2) for i in range(20)], "id long, lat double, lon double")
    pairs = places.within(df, df, 60.0)
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 2
    assert pairs.count() == 400
