"""Passes of the sun over a horizon against dense samples."""

import pytest
from pyspark.sql import functions as F

from lumaframe.operators import alignments

START, DAYS = 1_772_323_200, 40


@pytest.fixture(scope="module")
def spots(spark):
    rows = [(1, 55.9, -3.2, 120.0, 4.0), (2, 55.9, -3.2, 350.0, 2.0), (3, -23.0, -68.0, 80.0, 60.0), (4, 55.9, -3.2, 177.0, 1.0), (5, 55.9, -3.2, 110.0, 15.0)]
    df = spark.createDataFrame(rows, "spot long, lat double, lon double, bearing double, horizon double")
    return df.withColumns({"start": F.lit(START).cast("long"), "end": F.lit(START + DAYS * 86_400).cast("long")})


def test_sun(spark, spots):
    form = alignments.BODIES["sun"]
    dense = form.on(spots.withColumn("t", F.explode(F.sequence("start", "end", F.lit(30)).cast("array<double>")))).select("spot", "horizon", "t", "off", "altitude", "disc").orderBy("spot", "t").collect()
    found, gaps = alignments.bearing_crossings(spots, ["spot"], "sun")
    got = {}
    for r in found.collect():
        got.setdefault(r.spot, []).append(r)
    events, told = alignments.alignments(spots, ["spot"], "sun")
    told = {r.spot: r for r in told.collect()}
    passes = {}
    for r in events.collect():
        passes.setdefault(r.spot, []).append(r)
    for spot in range(1, 6):
        rows = [r for r in dense if r.spot == spot]
        want = []
        for a, b in zip(rows, rows[1:]):
            if (a.off > 0) != (b.off > 0) and abs(a.off) + abs(b.off) < 180:
                want.append((a.t, b.t, b.altitude - rows[0].horizon, b.disc, b.altitude < a.altitude))
        mine = sorted(got.get(spot, []), key=lambda r: r.t)
        assert len(mine) == len(want) == told[spot].crossings
        for r, (lo, hi, clear, _, falling) in zip(mine, want):
            assert lo - 1 <= r.t <= hi + 1 and r.descending == falling and abs(r.altitude - rows[0].horizon - clear) < 0.3
        clear = [r.altitude - rows[0].horizon for r in mine]
        touched = [abs(c) <= r.disc for c, r in zip(clear, mine)]
        if not mine:
            assert told[spot].absence == "no-bearing"
        elif any(touched):
            assert told[spot].absence is None
        else:
            assert told[spot].absence == ("always-above" if min(clear) > 0 else "always-below" if max(clear) < 0 else "never-quite")
        for falling in (True, False):
            own = [(r.t, c, d) for r, c, d in zip(mine, clear, touched) if r.descending == falling]
            best = [i for i in range(len(own)) if (i == 0 or abs(own[i][1]) < abs(own[i - 1][1])) and (i == len(own) - 1 or abs(own[i][1]) <= abs(own[i + 1][1]))]
            mine_p = sorted((r for r in passes.get(spot, []) if r.descending == falling), key=lambda r: r["at"])
            assert [round(r["at"]) for r in mine_p] == [round(own[i][0]) for i in best]
            for r, i in zip(mine_p, best):
                assert r.meets == own[i][2] and r.edge == ("start" if i == 0 else "end" if i == len(own) - 1 else None)
                if r.meets:
                    lo = hi = i
                    while lo and own[lo - 1][2]:
                        lo -= 1
                    while hi < len(own) - 1 and own[hi + 1][2]:
                        hi += 1
                    assert r.dates == hi - lo + 1
    assert {told[i].absence for i in told} >= {None, "always-above", "always-below"}


def test_moon_has_a_phase(spark, spots):
    events = alignments.with_moon_phase(alignments.alignments(spots.where("spot = 1"), ["spot"], "moon", 600)[0]).collect()
    assert events and all(0 <= r.fraction <= 1 and isinstance(r.waxing, bool) for r in events)


def test_alike_spots_are_searched_once(spark):
    """Spots that agree in all but their key, nulls too, are one search whose result is told of all."""
    from lumaframe.operators import timeline

    spots = spark.createDataFrame([(3, 1.0, None), (1, 1.0, None), (2, 1.0, 5.0), (9, 1.0, 5.0), (7, 2.0, 5.0)], "spot long, lat double, bearing double")
    kept = timeline.alike(spots, ["spot"])
    assert {r.spot for r in kept.collect()} == {1, 2, 7}
    found = kept.where("spot <> 7").select("spot", (F.col("spot") * 10).alias("v"))
    assert sorted((r.spot, r.v) for r in timeline.told_all(found, spots, kept, ["spot"]).collect()) == [(1, 10), (2, 20), (3, 10), (9, 20)]
