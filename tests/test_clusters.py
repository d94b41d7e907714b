"""Clusters and paths against sequential forms."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.operators import archive, clusters, paths


def metres(a, b):
    turn = (b[1] - a[1] + 180) % 360 - 180
    return math.hypot(math.radians(b[0] - a[0]), math.radians(turn) * math.cos(math.radians((a[0] + b[0]) / 2))) * 6371000.0


def sequential(points, reach=60.0, span=250.0):
    """points: {id: (lat, lon)}."""
    free, seed = dict(sorted(points.items())), {}
    for s in sorted(points):
        if s not in free:
            continue
        del free[s]
        members, queue, seed[s] = [s], [s], s
        while queue:
            origin = queue.pop(0)
            for c in [c for c in free if metres(points[origin], points[c]) <= reach]:
                trial = [points[m] for m in [*members, c]]
                middle = (sum(p[0] for p in trial) / len(trial), sum(p[1] for p in trial) / len(trial))
                if max(metres(p, middle) for p in trial) <= span:
                    del free[c]
                    members.append(c)
                    queue.append(c)
                    seed[c] = s
    return seed


def scattered(n, lat, lon, size, seed):
    rng = np.random.default_rng(seed)
    turn = size / max(0.02, math.cos(math.radians(lat)))
    return [(float(np.clip(lat + size * (x - 0.5), -90, 90)), float((lon + turn * (y - 0.5) + 180) % 360 - 180)) for x, y in rng.random((n, 2))]


PLACES = {
    "dense": scattered(500, 48.0, 11.0, 0.012, 1),
    "wide": scattered(900, 48.0, 11.0, 0.25, 2) + scattered(400, 48.1, 11.1, 0.03, 3),
    "line": [(50.0, 8.0 + 0.0006 * k) for k in range(600)],
    "line back": [(50.0, 8.0 - 0.0006 * k) for k in range(600)],
    "meridian 180": scattered(500, 10.0, 180.0, 0.05, 4),
    "near a pole": scattered(300, 89.99, 20.0, 0.015, 5),
    "one place": [(1.0, 2.0)] * 300 + scattered(200, 1.0, 2.0, 0.01, 6),
    "far apart": [(float(k % 170 - 85), float(k * 7 % 360 - 180)) for k in range(200)],
}


@pytest.mark.parametrize("name", PLACES)
def test_clusters_are_the_sequential_ones(spark, name):
    points = dict(enumerate(PLACES[name]))
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "id long, lat double, lon double").repartition(3)
    found = clusters.cluster(df).collect()
    assert len(found) == len(points) and {r.id: r.seed for r in found} == sequential(points)


def test_small_tiles_and_other_reaches(spark, monkeypatch):
    monkeypatch.setattr(clusters, "TILE", 2)
    points = dict(enumerate(scattered(900, 47.0, 5.0, 0.06, 9)))
    df = spark.createDataFrame([(f"p{i:05}", *p) for i, p in points.items()], "id string, lat double, lon double")
    for reach, span in ((30.0, 60.0), (200.0, 150.0)):
        got = {int(r.id[1:]): int(r.seed[1:]) for r in clusters.cluster(df, reach, span).collect()}
        assert got == sequential(points, reach, span)


def test_lost_points_and_no_points(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 5.0, None), (3, 5.0, 5.0), (4, 5.0, 5.0001)], "id long, lat double, lon double")
    assert {r.id: r.seed for r in clusters.cluster(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    assert clusters.cluster(df.limit(0)).count() == 0


def test_hotspots(spark):
    rng = np.random.default_rng(1)
    near = lambda n, north: [(north / 6371000 * 57.29578 + 55.9533 + x / 111194.9, -3.1883 + y / 62260) for x, y in rng.normal(0, 8, (n, 2))]
    chain = [(56.0 + i * 50 / 111194.9, -3.0) for i in range(20)]
    rows = [(i, float(p[0]), float(p[1])) for i, p in enumerate(near(200, 0) + near(5, 3000) + chain)]
    got = clusters.hotspots(spark.createDataFrame(rows, "id long, lat double, lon double")).collect()
    assert got[0].n == 200 and sum(r.n for r in got) == len(rows)
    assert all(r.span <= 250.000001 for r in got) and len(got) >= 4
    assert sorted(m for r in got for m in r.members) == list(range(len(rows)))


def test_a_dense_town_is_many_tasks(spark):
    df = spark.range(120_000).selectExpr("id", "48 + 0.2 * rand(3) AS lat", "11 + 0.3 * rand(4) AS lon")
    tiles = clusters._tiles(df, 6 * 1005.0, 2010.0, 0.0).groupBy("y", "x").count().agg(F.max("count"), F.count("*")).first()
    assert tiles[1] >= 16 and tiles[0] < 120_000 / 4
    assert clusters.cluster(df).select("id").distinct().count() == 120_000


def plain_path(lab):
    free, at = np.ones(len(lab), bool), int(lab[:, 0].argmin())
    order = [at]
    free[at] = False
    for _ in range(len(lab) - 1):
        at = int(np.where(free, np.linalg.norm(lab - lab[at], axis=1), np.inf).argmin())
        free[at] = False
        order.append(at)
    return order


@pytest.mark.parametrize("n", [1, 2, 9, 300, 2100])
def test_paths_are_the_plain_ones(n):
    rng = np.random.default_rng(n)
    for lab in (rng.random((n, 3)), np.round(rng.random((n, 3)), 1), np.repeat(rng.random((1, 3)), n, axis=0), np.c_[np.arange(n)[::-1] % 7, np.zeros((n, 2))].astype(float)):
        assert paths.nearest_path(lab) == plain_path(lab)


def test_one_path_whatever_the_size(spark):
    """No change of form at any size, and near n log n steps."""
    rng = np.random.default_rng(6)
    rows = [(i, "a" if i % 3 else "b", *map(float, rng.random(3) if i % 5 else (0.5, 0.1, 0.1))) for i in range(7500)]
    df = spark.createDataFrame(rows, "id long, chapter string, L double, a double, b double")
    got = {}
    for r in archive.path_order(df, "chapter", "id").collect():
        got.setdefault(r.chapter, {})[r.pos] = r.id
    for c in "ab":
        own = [x for x in rows if x[1] == c]
        order = plain_path(np.array([x[2:] for x in own]))
        assert [got[c][k] for k in range(len(own))] == [own[i][0] for i in order]
    took = {}
    for n in (20_000, 40_000):
        lab = rng.random((n, 3))
        began = time.process_time()
        paths.nearest_path(lab)
        took[n] = time.process_time() - began
    assert took[40_000] < 4 * took[20_000]
