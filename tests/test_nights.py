"""Rises, sets, nights and seasons against dense samples and published instants."""

import datetime

import pytest
from pyspark.sql import functions as F

from lumaframe.functions import almanac, sky
from lumaframe.operators import nights
from lumaframe.plans import catalogue
from lumaframe.plans.sky import nights_of

SF = "/root/testdata/sf0.001"
STEP = 20


@pytest.fixture(scope="module")
def dense(spark):
    """Altitudes every STEP seconds of each night."""
    spots = nights_of(spark, SF)
    rows = spots.withColumn("t", F.explode(F.sequence("start", "end", F.lit(STEP)).cast("array<double>")))
    rows = sky.CORE.on(sky.MOON.on(sky.SUN.on(rows))).select("spot", "t", "sun_altitude", "moon_altitude", "core_altitude")
    out = {}
    for r in rows.orderBy("spot", "t").collect():
        out.setdefault(r.spot, []).append(r)
    return out


def turns(rows, column, level):
    """(t, rising) of sign changes between dense samples."""
    v = [getattr(r, column) - level for r in rows]
    return [(rows[i].t, v[i] > 0) for i in range(1, len(v)) if (v[i - 1] <= 0) != (v[i] <= 0)]


def near(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) <= STEP)


def test_moon(spark, dense):
    for r in catalogue.QUERIES["moon_times"](spark, SF).collect():
        found = turns(dense[r.spot], "moon_altitude", almanac.MOONRISE)
        assert near(r.rise, next((t for t, up in found if up), None)) and near(r.set, next((t for t, up in found if not up), None))
        up = [x.moon_altitude > almanac.MOONRISE for x in dense[r.spot]]
        assert (r.always_up, r.always_down) == (all(up), not any(up))
        assert r.peak == pytest.approx(max(x.moon_altitude for x in dense[r.spot]), abs=0.1)


def test_roots_are_exact(spark):
    rows = catalogue.QUERIES["moon_times"](spark, SF).where("rise IS NOT NULL").join(nights_of(spark, SF), "spot").withColumn("t", F.col("rise"))
    for r in sky.MOON.on(rows).collect():
        assert abs(r.moon_altitude - almanac.MOONRISE) < 0.5 * 15 / 3600  # half a second of the sky's turning


def test_core(spark, dense):
    for r in catalogue.QUERIES["core_times"](spark, SF).collect():
        found = turns(dense[r.spot], "core_altitude", 0.0)
        assert near(r.rise, next((t for t, up in found if up), None)) and near(r.set, next((t for t, up in reversed(found) if not up), None))
        assert (r.transit is None) == (max(x.core_altitude for x in dense[r.spot]) <= 0)


def test_nights(spark, dense):
    spots = nights_of(spark, SF)
    seen, told = nights.core_nights(spots, ["spot"])
    spans = {}
    for r in seen.collect():
        spans.setdefault(r.spot, []).append((r.start, r.end))
    for r in told.collect():
        rows = dense[r.spot]
        ok = [x.t for x in rows if x.sun_altitude < -18 and x.moon_altitude < almanac.MOONRISE and x.core_altitude > 10]
        inside = [x.t for x in rows if any(a <= x.t <= b for a, b in spans.get(r.spot, []))]
        assert len(set(ok) ^ set(inside)) <= 4
        assert bool(ok) == (r.refusal == "") == (r.best is not None)
        if ok:
            assert r.best == pytest.approx(max(x.core_altitude for x in rows if x.t in set(ok)), abs=1.3)
        elif max(x.core_altitude for x in rows) <= 10:
            assert r.refusal.startswith("The core ")
        elif min(x.sun_altitude for x in rows) >= -18:
            assert "astronomically dark" in r.refusal
        elif not any(x.sun_altitude < -18 and x.moon_altitude < almanac.MOONRISE for x in rows):
            assert "moon is up" in r.refusal
        else:
            assert "not at the same time" in r.refusal


def at(*when):
    return datetime.datetime(*when, tzinfo=datetime.UTC).timestamp()


def test_seasons(spark):
    want = {(2026, "march-equinox"): at(2026, 3, 20, 14, 46), (2026, "june-solstice"): at(2026, 6, 21, 8, 24), (2026, "september-equinox"): at(2026, 9, 23, 0, 5), (2026, "december-solstice"): at(2026, 12, 21, 20, 50)}
    got = almanac.season_events(spark.createDataFrame([(2026,)], "year int")).collect()
    for r in got:
        assert abs(r["at"] - want[r.year, r.season]) < 20 * 60
    # at each instant the sun's longitude is the goal's
    for year in (2026, 2027):
        for r in almanac.season_events(spark.createDataFrame([(year,)], "year int")).collect():
            lam = spark.sql(f"SELECT {r['at']}D AS t")
            for group in sky.sun_state("t", "w_"):
                lam = lam.selectExpr("*", *[f"{v} AS {k}" for k, v in group.items()])
            assert abs((lam.first()["w_lam"] - r.goal + 180) % 360 - 180) < 1e-5
    after = almanac.next_season(spark.sql(f"SELECT {at(2026, 12, 30)}D AS t UNION ALL SELECT {at(2026, 1, 2)}D")).collect()
    assert {(r.season, round(r.in_days)) for r in after} == {("march-equinox", 81), ("march-equinox", 78)}
    near_by = almanac.nearest_solstices(spark.sql(f"SELECT {at(2026, 12, 28)}D AS t")).first()
    assert 0 < at(2026, 12, 28) - near_by.december < 8 * 86_400
    names = [spark.range(1).select(almanac.season_name(F.lit("june-solstice"), F.lit(x)).alias("n")).first().n for x in (10, -10)]
    assert names == ["Summer solstice", "Winter solstice"]
