"""Nulls, ends and exact sentences of labels, curves, frames, profiles and reports."""

from pyspark.sql import functions as F

from lumaframe.functions import wording
from lumaframe.operators import framing, grade, places
from lumaframe.sources import sinks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_labels_at_their_ends(spark):
    none = F.lit(None).cast("double")
    got = one(spark, a=wording.duration(F.lit(-3)), b=wording.duration(F.lit(119.6)), c=wording.duration(none), d=wording.shadow_ratio(F.lit(0.2)), e=wording.shadow_ratio(none), f=wording.column_label(F.lit(1500)), g=wording.light_label(none, none, none), h=wording.seeing_label(F.lit(9), F.lit(None)), i=wording.sensor(F.lit("film"), 0), j=wording.sun_windows(F.lit(None).cast("array<struct<start:int,end:int>>")), k=wording.change_label(F.lit(True), F.lit(60), F.lit(0)))
    assert got.a == "0 m" and got.b == "2 h" and got.c is None and got.d == "1 : 99+" and got.e == "—" and got.f == "01:00"
    assert got.g.startswith("No direct sun") and got.h == ",  (7Timer, ~10 km grid)." and got.i is None and got.j == "No direct sun here today." and got.k == ""


def brute_curve(own, told):
    byte = lambda v: int(255 * (v**3 * 12.92 if v**3 <= 0.0031308 else 1.055 * v ** (3 / 2.4) - 0.055) + 0.5)
    points, high = [(0.0, 0.0)], 0
    for i in grade.CURVE_TAPS:
        x, y = byte(own[i]), byte(told[i])
        if x > 2 and 14 <= x - points[-1][0] and x <= 241:
            high = max(high, y)
            points.append((float(x), float(min(high, points[-1][1] + 3 * (x - points[-1][0])))))
    return [*points, (255.0, 255.0)]


def test_curves_rise_and_are_spaced(spark):
    level = [i / 20 for i in range(21)]
    rows = [(0, level, [v**0.4 for v in level]), (1, [0.5] * 21, level), (2, level, [1 - v for v in level]), (3, level, level), (4, [], level)]
    got = {r.id: [tuple(p) for p in r.p] for r in spark.createDataFrame(rows, "id int, own array<double>, told array<double>").select("id", grade.tone_curve(F.col("own"), F.col("told")).alias("p")).collect()}
    for i, own, told in rows[:4]:
        assert got[i] == brute_curve(own, told)
    assert got[4] == [(0.0, 0.0), (255.0, 255.0)]  # nothing is known of the image
    line = spark.createDataFrame([([(0.0, 0.0), (255.0, 255.0)],)], "p array<struct<x:double,y:double>>")
    assert set(line.select(*[v.alias(n) for n, v in grade.curve_words(F.col("p")).items()]).first()) == {0.0}
    assert line.select(grade.softened(F.array(F.struct(F.lit(10.0).alias("x"), F.lit(30.0).alias("y"))), 0.5)[0]["y"]).first()[0] == 20


def test_scores_of_a_match(spark):
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    got = one(spark, a=grade.reachability(zero, zero, zero, zero, zero, zero), b=grade.reachability(none, zero, zero, zero, zero, zero), c=grade.confidence(F.lit("export"), F.lit("export"), F.lit(6), F.lit(True)), d=grade.extremes([("A", F.lit(-90), 85), ("B", none, 85), ("C", F.lit(84), 85)]))
    assert got.a == 1 and got.b == 0 and got.c == 1 and got.d == ["A"]


def test_region_in_a_frame(spark):
    fields = "id int, az double, alt double, aim double, tilt double, across double, upward double"
    rows = [(0, 180.0, 20.0, 180.0, 20.0, 74.0, 53.0), (1, 0.0, 20.0, 180.0, 20.0, 74.0, 53.0), (2, 240.0, 20.0, 180.0, 20.0, 74.0, 53.0), (3, 180.0, 44.0, 180.0, 20.0, 74.0, 53.0), (4, None, 0.0, 0.0, 0.0, 74.0, 53.0)]
    got = {r.id: r for r in framing.region(spark.createDataFrame(rows, fields), F.lit(10.0)).collect()}
    assert got[0].whole and got[0].partly and got[0].over == 0 and got[0].over_edge == "" and abs(got[0].span_h - 20 / 53) < 0.01
    assert not got[1].whole and not got[1].partly and got[1].span_w == 0 and got[1].over_edge == ""  # behind the camera
    assert not got[2].partly and got[2].short > 0 and got[2].short_edge == "right" and got[2].over > got[2].short
    assert got[3].partly and got[3].over_edge == "top" and 7 < got[3].over < 8 and got[3].short == 0
    assert framing.region(spark.createDataFrame([], fields), F.lit(10.0)).count() == 0


def test_profiles_and_reports(spark):
    flat = [(1, 0.0, 5.0, 5.0), (1, 50.0, None, 5.0), (1, 100.0, 5.0, 5.0), (2, 0.0, None, 1.0)]
    got = places.profile_path(spark.createDataFrame(flat, "k int, d double, g double, l double"), ["k"], "d", "g", "l", F.lit(100.0), 200, 50).collect()
    assert [(r.k, r.terrain, r.sight) for r in got] == [(1, "M0.00 25.00L200.00 25.00L200.00 50L0.00 50Z", "M0.00 25.00L200.00 25.00")]
    rows = spark.createDataFrame([(1, f"n{i:02}") for i in range(14)] + [(2, "a"), (2, "a")], "g int, n string")
    told = {r.g: r.report.split("\n") for r in sinks.listed(rows, "g", "n", "Would add", "photograph").collect()}
    assert told[1][0] == "Would add 14 photographs:" and told[1][1] == "  n00" and told[1][-1] == "  …and 2 more" and len(told[1]) == 14
    assert told[2] == ["Would add 2 photographs:", "  a", "  a"]


def test_bands_and_zones_move_to_the_reference(spark):
    bands = spark.createDataFrame([(1, "red", 0.5, 0.2, 0.5, 350.0), (2, "red", 0.3, 0.1, 0.6, 10.0), (2, "blue", 0.25, 0.1, 0.5, 240.0), (2, "aqua", 0.01, 0.1, 0.5, 200.0)], "image int, band string, share double, chroma double, L double, hue double")
    got = {r.band: r for r in grade.mixer(bands, "image", 1).collect()}
    assert set(got) == {"red", "blue"} and got["red"].sat == 100 and abs(got["red"].lum + 32) < 1e-6 and abs(got["red"].hue + 2000 / 22) < 1e-6 and got["blue"].sat == -60
    assert {r.band: r.sat for r in grade.mixer(bands, "image", 1, True).collect()}["red"] == 32
    zones = spark.createDataFrame([(1, "z", 0.06, 0.0), (2, "z", 0.0, 0.0), (3, "z", -0.06, 0.0), (4, "z", 0.058, 0.0)], "image int, zone string, a double, b double")
    tints = {r.image: (round(r.da, 6), round(r.sat, 6)) for r in grade.zone_tints(zones, "image", 1).collect()}
    assert tints == {2: (0.06, 100.0), 3: (0.06, 100.0), 4: (0.0, 0.0)}
