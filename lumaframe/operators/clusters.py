"""Proximity clusters grown in a fixed order, in parallel.

A cluster grows from the first free point, over steps of reach, and takes a point only if all
its members stay within span of their mean. Growth is sequential by its definition: what
an earlier seed has taken, a later one can't. But a cluster is at most two spans wide, so two
seeds can't meet unless they are within four spans and steps of reach lead from one to the
other. So space is cut into tiles, and each tile grows, in the order of keys, every cluster
whose surroundings it sees and on which no seed that it can't decide has a say; the rest
waits for the next round, with tiles moved by half their size. The first free point of all can always be decided, so rounds end; a round
leaves what depends on a chain of ever earlier neighbours across a tile's edge.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.sources.scratch import discard, written

from .places import FLAT_EARTH_M, flat_metres

#: A tile's side in reaches of influence; at least 2.
TILE = 6
#: Candidates that are looked at before the mean is taken anew.
SOME = 256


def _metres(lat1, lon1, lat2, lon2):
    turn = (lon2 - lon1 + 180) % 360 - 180
    return np.hypot(np.radians(lat2 - lat1), np.radians(turn) * np.cos(np.radians((lat1 + lat2) / 2))) * FLAT_EARTH_M


class _Members:
    """A growing cluster: its mean, and whether all would stay within span of it with one more."""

    def __init__(self, lat: float, lon: float, span: float):
        self.span, self.n, self.lat, self.lon = span, 1, lat, lon
        self.sum_lat, self.sum_lon, self.most = lat, lon, 0.0  # most: no member is further from the mean
        self.places, self.known = np.empty((16, 2)), {(lat, lon)}  # distinct places
        self.places[0] = lat, lon

    @staticmethod
    def away(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
        turn = (lon2 - lon1 + 180) % 360 - 180
        return math.hypot(math.radians(lat2 - lat1), math.radians(turn) * math.cos(math.radians((lat1 + lat2) / 2))) * FLAT_EARTH_M

    def take(self, lat: float, lon: float) -> bool:
        n = self.n + 1
        mid_lat, mid_lon = (self.sum_lat + lat) / n, (self.sum_lon + lon) / n
        own = self.away(lat, lon, mid_lat, mid_lon)
        if own > self.span:
            return False
        most = max(own, self.most + self.away(self.lat, self.lon, mid_lat, mid_lon))
        if most * 1.001 + 0.01 > self.span:  # too near to tell without looking at all
            places = self.places[: len(self.known)]
            most = max(own, float(_metres(places[:, 0], places[:, 1], mid_lat, mid_lon).max()))
            if most > self.span:
                return False
        self.n, self.lat, self.lon, self.most = n, mid_lat, mid_lon, most
        self.sum_lat, self.sum_lon = self.sum_lat + lat, self.sum_lon + lon
        if (lat, lon) not in self.known:
            if len(self.known) == len(self.places):
                self.places = np.concatenate((self.places, np.empty_like(self.places)))
            self.places[len(self.known)] = lat, lon
            self.known.add((lat, lon))
        return True

    def possible(self, lat: np.ndarray, lon: np.ndarray, many: int | None = None) -> np.ndarray:
        """Which of a few places may be taken, as the mean may move while they, or many points of theirs, are."""
        moved = self.span * min(1.0, (len(lat) if many is None else many) / (self.n + 1))
        return _metres(lat, lon, self.lat, self.lon) * (self.n / (self.n + 1)) <= (self.span + moved) * 1.001 + 0.01


def _parts(lat: np.ndarray, lon: np.ndarray, ys: np.ndarray, xs: np.ndarray, reach: float) -> np.ndarray:
    """A part for each point such that points within reach are of one part; parts may be too large, never too small.

    ys and xs are cells in which points within reach are at most two cells apart. Points of
    a cell are one part, cells are joined where a pair of theirs is within reach, or where
    they have so many points that one is.
    """
    wide = int(xs.max() - xs.min()) + 5
    cell, of, count = np.unique((ys - ys.min()) * wide + (xs - xs.min()), return_inverse=True, return_counts=True)
    order = np.argsort(of, kind="stable")
    start = np.cumsum(count) - count
    joined = [(np.zeros(0, np.int64),) * 2]
    for step in [dy * wide + dx for dy in (0, 1, 2) for dx in (-2, -1, 0, 1, 2) if dy or dx > 0]:
        at = np.minimum(np.searchsorted(cell, cell + step), len(cell) - 1)
        a = np.flatnonzero(cell[at] == cell + step)
        b = at[a]
        pairs = count[a] * count[b]
        joined.append((a[pairs > 64], b[pairs > 64]))
        a, b, pairs = a[pairs <= 64], b[pairs <= 64], pairs[pairs <= 64]
        for low in range(0, len(a), 50_000):
            i, j, n = a[low : low + 50_000], b[low : low + 50_000], pairs[low : low + 50_000]
            pair = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            p, q = order[start[i[pair]] + k // count[j[pair]]], order[start[j[pair]] + k % count[j[pair]]]
            hit = np.unique(pair[_metres(lat[p], lon[p], lat[q], lon[q]) <= reach])
            joined.append((i[hit], j[hit]))
    a, b = (np.concatenate(x) for x in zip(*joined, strict=True))
    part = np.arange(len(cell))
    while True:
        new = part.copy()
        np.minimum.at(new, part[a], part[b])
        np.minimum.at(new, part[b], part[a])
        new = np.minimum(new, new[part])
        new = new[new]
        if (new == part).all():
            return part[of]
        part = new


def _grow(lat: np.ndarray, lon: np.ndarray, known: np.ndarray, reach: float, span: float, round_world: bool) -> np.ndarray:
    """The seed of each point, by position in the order of keys; -1 where it can't be decided here."""
    n, influence = len(lat), 4.02 * span
    seed, free = np.full(n, -1), np.ones(n, bool)
    turned = lon * 0 if round_world else (lon - lon[0] + 180) % 360 - 180
    narrow = max(1e-6, math.cos(math.radians(min(89.9999, np.abs(lat).max()))))

    def cells(size: float) -> tuple[np.ndarray, np.ndarray]:
        step = math.degrees(size / FLAT_EARTH_M) * 1.000001
        return np.floor(lat / step).astype(np.int64), np.floor(turned / (step / narrow)).astype(np.int64)

    ys, xs = cells(reach)
    # points of one place are looked at together: a place has its free points, in order, and a cell its places
    spot, first, at = np.unique(np.stack((lat, lon), axis=1), axis=0, return_index=True, return_inverse=True)
    at = at.reshape(-1)
    order = np.argsort(at, kind="stable")
    left = np.split(order, np.cumsum(np.bincount(at, minlength=len(spot)))[:-1])
    order = np.lexsort((xs[first], ys[first]))
    cut = np.flatnonzero(np.append(True, (np.diff(ys[first[order]]) != 0) | (np.diff(xs[first[order]]) != 0)))
    held = {(int(ys[first[o[0]]]), int(xs[first[o[0]]])): o for o in np.split(order, cut[1:])}
    full, taken = np.bincount(at, minlength=len(spot)), np.zeros(len(spot), np.int64)
    round_: dict[int, np.ndarray] = {}
    wide_y, wide_x = cells(influence)
    part_of = _parts(lat, lon, *cells(reach / 1.6), reach)
    blocked: set[tuple[int, int, int]] = set()  # parts and cells in which a point that can't be decided may have a say

    def near(i: int) -> np.ndarray:
        """Places within reach of point i that have free points."""
        p = int(at[i])
        if p not in round_:
            y, x = int(ys[i]), int(xs[i])
            found = [held[key] for key in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)] if key in held]
            some = np.concatenate(found)
            round_[p] = some[_metres(spot[some, 0], spot[some, 1], lat[i], lon[i]) <= reach]
        some = round_[p]
        open_ = taken[some] < full[some]
        if not open_.all():
            round_[p] = some = some[open_]
        return some

    def points_of(some: np.ndarray) -> np.ndarray:
        """Free points of places, in order."""
        for p in some.tolist():
            if taken[p] > full[p] - len(left[p]):
                left[p] = left[p][free[left[p]]]
        return np.sort(np.concatenate([left[p] for p in some.tolist()])) if len(some) else first[:0]

    for s in range(n):
        if not free[s]:
            continue
        part, y, x = int(part_of[s]), int(wide_y[s]), int(wide_x[s])
        if not known[s] or (part, y, x) in blocked:
            blocked.update((part, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1))
            continue
        members = _Members(float(lat[s]), float(lon[s]), span)
        free[s], seed[s], queue, head = False, s, [s], 0
        taken[at[s]] += 1
        refused: dict[int, int] = {}  # the cluster's size when all round a place were last refused
        while head < len(queue):
            here = int(at[queue[head]])
            some = near(queue[head]) if refused.get(here) != members.n else first[:0]
            head += 1
            size = members.n
            # in the order of keys over all places, but those alone that may be taken however the mean moves
            many = int((full[some] - taken[some]).sum())
            if many > SOME:
                some = some[members.possible(spot[some, 0], spot[some, 1], many)]
            some = points_of(some)
            for low in range(0, len(some), SOME):
                few = some[low : low + SOME]
                for c in few[members.possible(lat[few], lon[few])].tolist():
                    if members.take(float(lat[c]), float(lon[c])):
                        free[c], seed[c] = False, s
                        taken[at[c]] += 1
                        queue.append(c)
            if members.n == size:
                refused[here] = size
    return seed


def _tiles(points: DataFrame, side: float, halo: float, shift: float) -> DataFrame:
    """points laid out over the tiles (y, x) that they are in or at most halo metres from, with known: no more than half of that."""
    step, edge = math.degrees(side / FLAT_EARTH_M), math.degrees(halo / FLAT_EARTH_M) * 1.01
    high = F.col("lat") + 90 + shift * step
    own = F.floor(high / step)
    rows = points.withColumn("__h", high).withColumn("y", F.explode(F.array(own - 1, own, own + 1)))
    off = F.greatest(F.col("y") * step - F.col("__h"), F.col("__h") - (F.col("y") + 1) * step)  # degrees beyond the tile's row
    rows = rows.withColumn("__off", off).where(F.col("__off") <= edge)
    # the smallest cosine that a row of tiles reaches with its halo, and how many tiles go round the earth there
    end = F.greatest(F.abs(F.col("y") * step - 90 - shift * step - edge), F.abs((F.col("y") + 1) * step - 90 - shift * step + edge))
    least = F.cos(F.radians(F.least(F.lit(90.0), end)))
    n = F.greatest(F.lit(1), F.floor(360 / step * least)).cast("long")
    rows = rows.withColumns({"__n": n, "__wide": F.when(n > 2, edge / least).otherwise(360.0)})
    turn = F.pmod(F.col("lon") + 180 + shift * 360 / F.col("__n"), F.lit(360.0))
    cell = lambda at: F.floor(at / 360 * F.col("__n"))
    low, high_x = cell(F.col("__t") - F.col("__wide")), cell(F.col("__t") + F.col("__wide"))
    rows = rows.withColumn("__t", turn).withColumns({"__a": low, "__b": F.least(high_x, low + F.col("__n") - 1)})
    rows = rows.withColumn("__x", F.explode(F.sequence("__a", "__b")))
    beyond = F.greatest(F.col("__x") * 360 / F.col("__n") - F.col("__t"), F.col("__t") - (F.col("__x") + 1) * 360 / F.col("__n"))
    known = (F.col("__off") <= edge / 2) & ((F.col("__n") <= 2) | (beyond <= F.col("__wide") / 2))
    return rows.select("id", "lat", "lon", "y", F.pmod("__x", "__n").alias("x"), known.alias("known"), (F.col("__n") <= 2).alias("round"))


def cluster(points: DataFrame, reach: float = 60.0, span: float = 250.0) -> DataFrame:
    """(id, seed): single-link clusters over steps of reach, kept within span of their centre, as a table.

    Points (id, lat, lon) are taken in the order of id: the first free one is a seed, its
    cluster grows to free points within reach of a member, nearest queue first and in the order
    of id, each only if all members stay within span of the mean. A point without a place
    is its own seed; ids are not null and no id occurs twice.
    """
    influence = 4.02 * span
    halo, side = 2 * influence, TILE * influence
    # half a halo is influence: whoever has a say on a known point is in the tile's halo
    every = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    lost = every.where("lat IS NULL OR lon IS NULL").select("id", F.col("id").alias("seed"))
    free = written(every.where("lat IS NOT NULL AND lon IS NOT NULL"), "points")
    kind = points.schema["id"].dataType.simpleString()

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        seed = _grow(rows["lat"].to_numpy(), rows["lon"].to_numpy(), rows["known"].to_numpy(bool), reach, span, bool(rows["round"].iloc[0]))
        done = seed >= 0
        return pd.DataFrame({"id": rows["id"][done], "seed": rows["id"].to_numpy()[seed[done]]})

    rounds: list[DataFrame] = []
    while not free.isEmpty():
        tiles = _tiles(free, side, halo, len(rounds) % 2 / 2)
        grown = tiles.groupBy("y", "x").applyInPandas(grow, f"id {kind}, seed {kind}")
        rounds.append(written(grown.dropDuplicates(["id"]), "clusters"))  # tiles that decide a seed agree on it
        taken = rounds[-1].select(F.col("id").alias("__taken"))
        last, free = free, written(free.join(taken, F.col("id") == F.col("__taken"), "left_anti"), "points")
        discard(last)
    discard(free)
    for part in rounds:
        lost = lost.union(part)
    return lost


def hotspots(points: DataFrame, **options) -> DataFrame:
    """(seed, n, lat, lon, span, members) of clusters, the largest first."""
    rows = points.join(cluster(points, **options), "id")
    middle = rows.groupBy("seed").agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"), F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("members"))
    span = F.max(flat_metres(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))).alias("span")
    spans = rows.join(middle.select("seed", "c_lat", "c_lon"), "seed").groupBy("seed").agg(span)
    return middle.join(spans, "seed").select("seed", "n", F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"), "span", "members").orderBy(F.desc("n"), "seed")
