"""Registered queries without SQL, as queries, against plain forms."""

import math

import pytest
from pyspark.sql import functions as F

from lumaframe.functions import sky
from lumaframe.operators import alignments
from lumaframe.plans import catalogue
from lumaframe.plans.extras import aims
from lumaframe.plans.light import instants

SF = "/root/testdata/sf0.001"


def test_every_query_reads_a_table(spark):
    """No query runs on literals alone, and none is registered twice."""
    functions = list(catalogue.QUERIES.values())
    assert len(set(functions)) == len(functions)
    for name in ("month_grid", "month_sun", "forecast_heads", "building_sets"):
        assert name in catalogue.ORACLES


def test_moon_passes(spark):
    """At each pass the moon stands on the bearing, at the clearance told, as lit as the formula has it; and each is the lowest of its crossings."""
    found = catalogue.QUERIES["moon_passes"](spark, SF)
    spots = aims(spark, SF).select("spot", "lat", "lon", "bearing", "horizon")
    rows = found.join(spots, "spot").withColumn("t", F.col("at"))
    rows = sky.ILLUMINATION.on(alignments.BODIES["moon"].on(rows)).collect()
    assert len(rows) > 20
    for r in rows:
        # near the nadir a bearing turns fast, so it is the angle across that counts
        assert abs(r.off) * math.cos(math.radians(r.altitude)) < 0.01 and r.clearance == pytest.approx(r.altitude - r.horizon, abs=1e-6)
        assert r.fraction == pytest.approx(r.lit) and r.phase == r.moon_phase and r.waxing == (r.age < 180)
        assert r.meets == (abs(r.clearance) <= r.disc) and (r.dates > 0) == r.meets
    every, _ = alignments.bearing_crossings(aims(spark, SF), ["spot"], "moon", 600)
    crossings = {}
    horizon = {r.spot: r.horizon for r in spots.collect()}
    for r in every.select("spot", "descending", "t", "altitude").orderBy("t").collect():
        crossings.setdefault((r.spot, r.descending), []).append((r.t, abs(r.altitude - horizon[r.spot])))
    want = set()
    for k, own in crossings.items():
        for i, (t, d) in enumerate(own):
            if (i == 0 or d < own[i - 1][1]) and (i + 1 == len(own) or d <= own[i + 1][1]):
                want.add((*k, round(t)))
    assert {(r.spot, r.descending, round(r.at)) for r in rows} == want


def sun_longitude(t):
    """Apparent longitude of the sun by the short series, good to a hundredth of a degree."""
    c = (t / 86400 + 2440587.5 - 2451545) / 36525
    m = math.radians(357.52911 + 35999.05029 * c - 0.0001537 * c * c)
    centre = (1.914602 - 0.004817 * c - 0.000014 * c * c) * math.sin(m) + (0.019993 - 0.000101 * c) * math.sin(2 * m) + 0.000289 * math.sin(3 * m)
    return (280.46646 + 36000.76983 * c + 0.0003032 * c * c + centre - 0.00569 - 0.00478 * math.sin(math.radians(125.04 - 1934.136 * c))) % 360


def test_next_season(spark):
    """The event ahead is where the sun's longitude meets the next quarter, and no quarter is passed before."""
    at = {r.id: r.t for r in instants(spark, SF).collect()}
    rows = catalogue.QUERIES["next_season"](spark, SF).collect()
    assert {r.id for r in rows} == set(at)
    for r in rows:
        t = at[r.id]
        then = t + r.in_days * 86400
        quarter = sun_longitude(then) / 90
        assert abs(quarter - round(quarter)) < 0.02 / 90 * 2 and 0 <= r.in_days < 95
        passed = (round(quarter) % 4 * 90 - sun_longitude(t)) % 360
        assert passed < 92
        assert r.june < r.december or r.december < r.june
        for s, quarter_ in ((r.june, 90), (r.december, 270)):
            assert abs((sun_longitude(s) - quarter_ + 180) % 360 - 180) < 0.02
