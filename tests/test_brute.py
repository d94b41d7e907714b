"""Queries without SQL against plain versions on their own whole tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.functions import appearance
from lumaframe.operators import alignments, archive, texture
from lumaframe.plans import catalogue
from lumaframe.plans.archive import photos, small_images
from lumaframe.plans.extras import aims
from lumaframe.plans.light import town
from lumaframe.plans.records import plan_spots

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalogue.QUERIES[name](spark, SF)


def metres(a, b):
    return math.hypot(math.radians(b[0] - a[0]), math.radians(b[1] - a[1]) * math.cos(math.radians((a[0] + b[0]) / 2))) * 6371000.0


def test_hotspots(spark):
    points = [(r.id, r.lat, r.lon) for r in town(spark, SF).orderBy("id").collect()]
    free, want = set(range(len(points))), []
    for s in range(len(points)):
        if s not in free:
            continue
        free.discard(s)
        members, queue = [s], [s]
        while queue:
            origin = queue.pop(0)
            for c in sorted(free):
                if metres(points[origin][1:], points[c][1:]) > 60:
                    continue
                trial = [points[m] for m in [*members, c]]
                middle = (sum(p[1] for p in trial) / len(trial), sum(p[2] for p in trial) / len(trial))
                if max(metres(p[1:], middle) for p in trial) <= 250:
                    free.discard(c)
                    members.append(c)
                    queue.append(c)
        want.append((points[s][0], sorted(points[m][0] for m in members)))
    got = [(r.seed, r.n, r.members) for r in run(spark, "hotspots").collect()]
    assert got == [(s, len(m), m) for s, m in sorted(want, key=lambda x: (-len(x[1]), x[0]))]


def chapters_of(spark):
    rows = archive.split_chapters(photos(spark, SF), "base").select("chapter", "id", "L", "a", F.col("b_").alias("b")).collect()
    out = {}
    for r in rows:
        out.setdefault(r.chapter, {})[r.id] = np.array([r.L, r.a, r.b])
    return out


def test_gradient_order(spark):
    got = {}
    for r in run(spark, "gradient_order").collect():
        got.setdefault(r.chapter, []).append((r.pos, r.id))
    chapters = chapters_of(spark)
    assert got.keys() == chapters.keys()
    for chapter, colours in chapters.items():
        order = [i for _, i in sorted(got[chapter])]
        assert sorted(p for p, _ in got[chapter]) == list(range(len(colours))) and sorted(order) == sorted(colours)
        left, greedy = set(colours), [min(colours, key=lambda i: (colours[i][0], i))]
        while len(greedy) < len(colours):
            left.discard(greedy[-1])
            greedy.append(min(left, key=lambda i: (np.linalg.norm(colours[i] - colours[greedy[-1]]), i)))
        length = lambda path: sum(np.linalg.norm(colours[a] - colours[b]) for a, b in itertools.pairwise(path))  # noqa: B023, E731
        assert length(order) <= length(greedy) + 1e-9
        for i, k in itertools.combinations(range(len(order)), 2):  # no reversal makes it shorter
            assert length(order[:i] + order[i : k + 1][::-1] + order[k + 1 :]) >= length(order) - 1e-8


def test_chapter_fold(spark):
    chapters = {c: list(v.values()) for c, v in chapters_of(spark).items()}
    ranks = dict(spark.createDataFrame([(c,) for c in chapters], "chapter string").select("chapter", catalogue_rank()).collect())
    groups = [[c, [c], chapters[c]] for c in sorted(chapters, key=lambda c: (ranks[c], c))]

    def mean(g):
        L, a, b = np.mean(g[2], axis=0)
        c, h = math.floor(math.hypot(a, b) * 1000 + 0.5) / 1000, math.floor(math.degrees(math.atan2(b, a)) % 360 * 10 + 0.5) / 10
        return np.array([math.floor(L * 1000 + 0.5) / 1000, c * math.cos(math.radians(h)), c * math.sin(math.radians(h))])

    grey = lambda g: g[0].startswith("achromatic")
    while True:
        for i, g in enumerate(groups):
            near = [j for j in (i - 1, i + 1) if len(g[2]) <= 2 and 0 <= j < len(groups) and grey(groups[j]) == grey(g)]
            if near:
                to = min(near, key=lambda j: (np.linalg.norm(mean(groups[j]) - mean(g)), j))
                groups[to][1] += g[1]
                groups[to][2] = groups[to][2] + g[2]
                del groups[i]
                break
        else:
            break
    want = {c: g[0] for g in groups for c in g[1]}
    assert {r.chapter: r.folded for r in run(spark, "chapter_fold").collect()} == want


def catalogue_rank():
    from lumaframe.functions import colour

    return colour.chapter_rank(F.col("chapter"))


def test_manifest(spark):
    rows = run(spark, "manifest").collect()
    folded = {r.chapter: r.folded for r in run(spark, "chapter_fold").collect()}
    home = {i: folded[c] for c, v in chapters_of(spark).items() for i in v}
    assert {r.id: r.chapter for r in rows} == home
    colours = {i: x for v in chapters_of(spark).values() for i, x in v.items()}
    paths = {}
    for r in sorted(rows, key=lambda r: (r["rank"], r.chapter, r.pos)):
        paths.setdefault((r["rank"], r.chapter), []).append(r.id)
    last = None
    for ids in paths.values():
        if last is not None and len(ids) > 1:  # each chapter begins at its end that is nearer to the one before
            assert np.linalg.norm(colours[last] - colours[ids[0]]) <= np.linalg.norm(colours[last] - colours[ids[-1]]) + 1e-12
        last = ids[-1]


def test_day_plan(spark):
    plans = {}
    for r in plan_spots(spark, SF).withColumn("plan", F.floor(F.col("pos") / 6)).collect():
        plans.setdefault(r.plan, []).append(r)
    got = {r.plan: r for r in run(spark, "day_plan").collect()}
    for plan, spots in list(plans.items())[:12]:
        best = None
        usable = {s.pos: [w for w in s.windows if w.end - w.start >= 20] for s in spots}
        for n in range(len(spots) + 1):
            for order in itertools.permutations([s for s in spots if usable[s.pos]], n):
                clock, at, off, way, path, ok = 0, None, 0, 0.0, [], True
                for s in order:
                    away = 0.0
                    if at is not None:
                        h = math.sin(math.radians(s.lat - at[0]) / 2) ** 2 + math.cos(math.radians(at[0])) * math.cos(math.radians(s.lat)) * math.sin(math.radians(s.lon - at[1]) / 2) ** 2
                        away = 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))
                    ready = clock + math.ceil(away / 1000 / 40 * 60)
                    begin = next((max(w.start, ready) for w in usable[s.pos] if max(w.start, ready) + 20 <= min(w.end, 1440)), None)
                    if begin is None:
                        ok = False
                        break
                    clock, at, off, way = begin + 20, (s.lat, s.lon), off + abs(begin - s.best), way + away
                    path.append((s.pos, begin))
                if ok:
                    score = (-len(path), off, round(way, 6), [p for p, _ in path])
                    if best is None or score < best[0]:
                        best = (score, path)
        r = got[plan]
        assert (r.scheduled, r.off_best) == (-best[0][0], best[0][1]) and r.metres == pytest.approx(best[0][2], abs=1e-3)
        assert [(s.pos, s.start) for s in r.stops] == best[1]


def test_sun_alignments(spark):
    """Each instant has the sun on its bearing; and every supplier has as many as a year of ten-minute samples shows."""
    s = F.col("s_suppkey")
    spots = spark.read.parquet(f"{SF}/supplier.parquet").select(s.alias("spot"), (s % 100 - 50.0).alias("lat"), (s * 7 % 360 - 180.0).alias("lon"), (s * 31 % 360).cast("double").alias("bearing"))
    form = alignments.BODIES["sun"]
    found = run(spark, "sun_alignments").select("spot", "t").join(spots, "spot")
    assert all(abs(r.off) < 0.01 for r in form.on(found).select("off").collect())
    rows = form.on(spots.withColumn("t", F.explode(F.sequence(F.lit(1_772_323_200), F.lit(1_772_323_200 + 365 * 86_400), F.lit(600)).cast("array<double>")))).select("spot", "t", "off").orderBy("spot", "t").collect()
    want = {}
    for a, b in itertools.pairwise(rows):
        if a.spot == b.spot and (a.off > 0) != (b.off > 0) and abs(a.off) + abs(b.off) < 180:
            want[a.spot] = want.get(a.spot, 0) + 1
    got = {r.spot: r["count"] for r in run(spark, "sun_alignments").groupBy("spot").count().collect()}
    assert all(abs(got.get(k, 0) - want.get(k, 0)) <= 2 for k in {*got, *want})


def test_sun_searches(spark):
    told = {r.spot: r for r in run(spark, "sun_searches").collect()}
    assert told.keys() == {r.spot for r in aims(spark, SF).collect()}
    passes = run(spark, "sun_passes").collect()
    for r in told.values():
        own = [p for p in passes if p.spot == r.spot]
        assert bool(own) == (r.crossings > 0) == (r.absence != "no-bearing")
        assert any(p.meets for p in own) == (r.absence is None)
        if own:
            assert abs(r.nearest) == pytest.approx(min(abs(p.clearance) for p in own), abs=1e-9)


def test_building_ramps(spark):
    def at(stops, a, c):
        if a <= stops[0][0]:
            return stops[0][1][c]
        for (x, u), (y, v) in itertools.pairwise(stops):
            if a <= y:
                return u[c] + (v[c] - u[c]) * (a - x) / (y - x)
        return stops[-1][1][c]

    told = lambda rgb: "#" + "".join(f"{math.floor(min(255, max(0, v)) + 0.5):02x}" for v in rgb)
    for r in run(spark, "building_ramps").collect():
        a = r.id * 7 % 90 - 22
        t = min(1, max(0, (a + 6) / 12))
        night, day = appearance.BUILDING_ENDS[r.theme]
        low, tall = ([n + (d - n) * t for n, d in zip(night[i], day[i])] for i in (0, 1))
        up = min(1, math.log10(1 + r.height / 8) / math.log10(26))
        assert r.colour == told([x + (y - x) * up for x, y in zip(low, tall)])
        raw = [at(appearance.LIGHT, a, c) for c in range(3)]
        peak = max(*raw, 1)
        assert r.light == told([v * 255 / peak + (255 - v * 255 / peak) * 0.4 for v in raw])


def test_day_light(spark):
    """Lit minutes counted with the wall rays of the skyline query's SQL form: no spot is lit before its sun is up."""
    rows = run(spark, "day_light").collect()
    assert {r.spot for r in rows} == {r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    for r in rows:
        assert (r.first is None) == (r.total == 0)
        if r.total:
            assert 0 <= r.first <= r["last"] < 1440


def test_texture_crops(spark):
    """Edges and steps across 8-pixel boundaries by loops; an image with a missing sample has no row."""
    grids = {}
    for r in small_images(spark, SF).collect():
        grids.setdefault(r.image, {})[r.x, r.y] = r.luma
    got = {r.image: r for r in run(spark, "texture_crops").collect()}
    whole = {k for k, g in grids.items() if len(g) == (max(x for x, _ in g) - min(x for x, _ in g) + 1) * (max(y for _, y in g) - min(y for _, y in g) + 1)}
    assert got and got.keys() <= whole
    for k, r in got.items():
        on, off = [], []
        for (x, y), v in grids[k].items():
            if (x - 1, y) in grids[k]:
                (on if x % 8 == 0 else off).append(abs(v - grids[k][x - 1, y]))
        assert r.blockiness == pytest.approx(np.mean(on) / np.mean(off))
    thin = spark.createDataFrame([(1, x, y, float(x * y % 7)) for x in range(12) for y in range(12) if (x, y) != (5, 5)], "image long, x long, y long, luma double")
    assert texture.crops(thin, ["image"]).count() == 0
