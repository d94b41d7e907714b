"""Box means over summed-area tables, and when a body is in a frame, against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from lumaframe.functions import sky
from lumaframe.functions.formulas import Formula
from lumaframe.operators import areas, framing
from lumaframe.plans.sky import frames_of

SF = "/root/testdata/sf0.001"


def plain(cells, reach):
    """cells: {(key, row, col): [values]}."""
    out = {}
    for k, r, c in cells:
        near = [v for (kk, rr, cc), vs in cells.items() if kk == k and abs(rr - r) <= reach and abs(cc - c) <= reach for v in vs if v is not None]
        out[k, r, c] = (sum(near) / len(near) if near else None, len(near))
    return out


@pytest.mark.parametrize("block", [4, 7, 128])
def test_box_means(spark, block):
    rng = random.Random(block)
    rows = [("a", r, c, rng.randrange(100) if rng.random() > 0.1 else None) for r in range(-3, 20) for c in range(5, 23) if rng.random() > 0.2]
    rows += [(None, r, c, r * c) for r in range(6) for c in range(9)] + [("b", 3, 3, None), ("b", 5, 4, 2), ("b", 5, 4, 4), ("c", 0, 0, 7)]
    df = spark.createDataFrame(rows, "k string, row int, col int, v int")
    cells = {}
    for k, r, c, v in rows:
        cells.setdefault((k, r, c), []).append(v)
    got = {}
    for r in areas.box_means(df, ["k"], "v", [0, 2, 30], block).collect():
        got.setdefault(r.reach, {})[r.k, r.row, r.col] = (r.mean, r.n)
    for reach in (0, 2, 30):
        want = plain(cells, reach)
        assert got[reach].keys() == want.keys()
        for k, (mean, n) in want.items():
            assert got[reach][k][1] == n and got[reach][k][0] == (None if mean is None else pytest.approx(mean)), (reach, k)


def test_one_field_without_keys_and_no_rows(spark):
    df = spark.range(3000).selectExpr("id DIV 50 AS row", "id % 50 AS col", "id % 7 = 0 AS shaded")
    got = {(r.row, r.col): (r.coverage, r.alpha) for r in areas.mask_coverage(df, [], "shaded", 2.0, [1]).collect()}
    flags = {(i // 50, i % 50): i % 7 == 0 for i in range(3000)}
    for (r, c), (coverage, alpha) in got.items():
        near = [flags[y, x] for y in (r - 1, r, r + 1) for x in (c - 1, c, c + 1) if (y, x) in flags]
        assert coverage == pytest.approx(sum(near) / len(near)) and alpha == int(255 * sum(near) / len(near) + 0.5)
    assert len(got) == 3000 and areas.mask_coverage(df.limit(0), [], "shaded", 0.5, [1]).count() == 0


def test_work_does_not_grow_with_reach(spark):
    df = spark.range(40_000).selectExpr("id DIV 200 AS row", "id % 200 AS col", "id % 11 AS v")
    rows = areas.box_means(df, [], "v", [150])
    assert rows.agg(F.max("n")).first()[0] == 200 * 200 and rows.where("row = 0 AND col = 0").first().n == 151 * 151


def dense(spark, rows, body, az, alt, step):
    """(key, first, last) of stretches of samples every step seconds that are in the frame."""
    side = Formula([*body.groups, {"az_": f"{az} - aim", "alt_": alt}], ["az_", "alt_"])
    at = rows.withColumn("t", F.explode(F.sequence(F.col("start") * 1000, F.col("end") * 1000, F.lit(int(step * 1000))))).withColumn("t", F.col("t") / 1000.0)
    r = lambda c: F.radians(F.col(c))
    ahead = F.cos(r("tilt")) * F.cos(r("alt_")) * F.cos(r("az_")) + F.sin(r("tilt")) * F.sin(r("alt_"))
    up = F.cos(r("tilt")) * F.sin(r("alt_")) - F.sin(r("tilt")) * F.cos(r("alt_")) * F.cos(r("az_"))
    inside = (ahead > 0) & (F.abs(F.degrees(F.atan2(F.cos(r("alt_")) * F.sin(r("az_")), ahead))) < F.col("across") / 2) & (F.abs(F.degrees(F.atan2(up, ahead))) < F.col("upward") / 2)
    found = {}
    for k, t in side.on(at).where(inside).select("spot", "t").orderBy("spot", "t").collect():
        runs = found.setdefault(k, [])
        if runs and t - runs[-1][1] < 1.5 * step:
            runs[-1][1] = t
        else:
            runs.append([t, t])
    return found


def test_core_in_frame(spark):
    spots = frames_of(spark, SF)
    got = {}
    for r in framing.in_frame(spots, ["spot"], sky.CORE, "core_azimuth", "core_altitude").orderBy("spot", "start").collect():
        got.setdefault(r.spot, []).append((r.start, r.end))
    want = dense(spark, spots, sky.CORE, "core_azimuth", "core_altitude", 2)
    assert got.keys() == want.keys() and len(got) > 4
    for k, runs in want.items():
        assert len(runs) == len(got[k])
        for (a, b), (x, y) in zip(runs, got[k], strict=True):
            assert 0 <= a - x <= 2.01 and 0 <= y - b <= 2.01


def test_edges_that_switch_inside_a_step(spark):
    """A body that turns fast: it comes in over one edge and goes out over another between two samples."""
    body = Formula([{"az": "pace * t", "alt": "slope * t + base"}], ["az", "alt"])
    rows = [(k, 0, 3600, 0.05 + 0.004 * k, 0.003 * (k % 7 - 3), 5.0 * (k % 5), 20.0 + 8 * k, 4.0 * (k % 3), 6.0 + k % 4, 9.0 - k % 3) for k in range(24)]
    spots = spark.createDataFrame(rows, "spot long, start long, end long, pace double, slope double, base double, aim double, tilt double, across double, upward double")
    want = dense(spark, spots, body, "az", "alt", 0.25)
    got = {}
    for r in framing.in_frame(spots, ["spot"], body, "az", "alt", 300).orderBy("spot", "start").collect():
        got.setdefault(r.spot, []).append((r.start, r.end))
    short = 0
    for k, runs in want.items():
        assert len(runs) == len(got.get(k, [])), k
        for (a, b), (x, y) in zip(runs, got[k], strict=True):
            assert abs(a - x) <= 0.5 and abs(y - b) <= 0.5
            short += b - a < 300 and a // 300 == b // 300
    assert got.keys() == want.keys() and len(got) > 10 and short > 3
