"""Day plans: the order of a few spots that meets most of them in their light.

A plan is one row with its spots in order, MOST at most. All orders of all subsets of MOST
spots are one fixed table, and a batch of plans goes through it step by step with array
arithmetic; plans are independent rows, so the only shuffle gathers a plan's spots.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .places import EARTH_M

MOST = 6
#: Plans that are weighed at once.
PLANS = 64
#: Best minutes closer than a visit, and than this, are a clash.
LEAST_CLASH = 10


@cache
def _orders() -> tuple[np.ndarray, np.ndarray]:
    """Every order of every subset of MOST places, in the order in which equals are chosen, and how long it is; -1 after its end."""
    found = [p for n in range(MOST + 1) for p in permutations(range(MOST), n)]
    return np.array([p + (-1,) * (MOST - len(p)) for p in found]), np.array([len(p) for p in found])


def _away(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Metres of the great circle between all places of a plan."""
    lat, lon = np.radians(lat), np.radians(lon)
    h = np.sin((lat[:, :, None] - lat[:, None]) / 2) ** 2 + np.cos(lat[:, :, None]) * np.cos(lat[:, None]) * np.sin((lon[:, :, None] - lon[:, None]) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _weigh(plans: list[list[dict]], dwell: int, speed: float, start: int, end: int) -> list[tuple[list[dict], int, float]]:
    """Stops (pos, start, travel, metres), minutes off the best light and metres of the best schedule of each plan."""
    orders, length = _orders()
    n, most = len(plans), max([1, *(len(s["use"]) for p in plans for s in p)])
    lat, lon, best = (np.zeros((n, MOST)) for _ in range(3))
    opens, closes = np.zeros((n, MOST, most)), np.full((n, MOST, most), -np.inf)
    for i, spots in enumerate(plans):
        for j, s in enumerate(spots):
            lat[i, j], lon[i, j], best[i, j] = s["lat"], s["lon"], s["best"]
            for k, w in enumerate(s["use"]):
                opens[i, j, k], closes[i, j, k] = w["start"], min(w["end"], end)
    away = _away(lat, lon)
    travel = np.ceil(away / 1000 / speed * 60)
    clock = np.full((n, len(orders)), float(start))
    fits = np.ones((n, len(orders)), bool)
    off, metres, begins = np.zeros_like(clock), np.zeros_like(clock), np.zeros((n, len(orders), MOST))
    row = np.arange(n)[:, None]
    for step in range(MOST):
        spot = orders[:, step]
        here = np.maximum(spot, 0)[None]
        ready = clock
        if step:
            last = np.maximum(orders[:, step - 1], 0)[None]
            ready = clock + travel[row, last, here]
            metres = metres + np.where(spot >= 0, away[row, last, here], 0.0)
        begin = np.full_like(clock, np.inf)
        for k in range(most):
            first = np.maximum(opens[row, here, k], ready)
            begin = np.where(np.isinf(begin) & (first + dwell <= closes[row, here, k]), first, begin)
        fits &= (spot < 0) | ~np.isinf(begin)
        begin = np.where(np.isinf(begin), 0.0, begin)
        off = off + np.where(spot >= 0, np.abs(begin - best[row, here]), 0.0)
        clock = np.where(spot >= 0, begin + dwell, clock)
        begins[:, :, step] = begin
    done = []
    for i, spots in enumerate(plans):
        left = fits[i]
        for value in (-length, off[i], metres[i]):
            left = left & (value == value[left].min())
        k = int(left.argmax())
        path = [int(x) for x in orders[k, : length[k]]]
        hops = [(0, 0.0), *((int(travel[i, a, b]), float(away[i, a, b])) for a, b in zip(path, path[1:], strict=False))]
        stops = [{"pos": spots[j]["pos"], "start": int(begins[i, k, s]), "travel": hops[s][0], "metres": hops[s][1]} for s, j in enumerate(path)]
        done.append((stops, int(off[i, k]), float(metres[i, k])))
    return done


def _considered(spots: DataFrame, dwell: int) -> DataFrame:
    """(plan, spots, dropped): the first MOST spots of each plan that have a window long enough, and those that are left out for one of the two."""
    place = F.row_number().over(Window.partitionBy("plan").orderBy("pos"))
    use = F.filter("windows", lambda w: w["end"] - w["start"] >= dwell)
    first = spots.withColumn("__n", place).where(F.col("__n") <= MOST).select("plan", "pos", "lat", "lon", "best", use.alias("use"))
    one, lit = F.struct("pos", "lat", "lon", "best", "use"), F.size("use") > 0
    never = F.when(~lit, F.struct("pos", F.lit("never-lit").alias("reason")))
    return first.groupBy("plan").agg(F.array_sort(F.collect_list(F.when(lit, one))).alias("spots"), F.array_sort(F.collect_list(never)).alias("dropped"))


def day_plans(spots: DataFrame, dwell: int = 20, speed: float = 40.0, start: int = 0, end: int = 1440) -> DataFrame:
    """(plan, stops, scheduled, off_best, metres, dropped): the best schedule of each plan that has a spot with light.

    spots has plan, pos, lat, lon, best (minute) and windows, an array of (start, end) minutes of
    light in order. More spots count first, then minutes off the best light, then metres, then
    the order in which spots are listed; spots from the seventh on are not weighed. stops has
    pos, start, and minutes and metres from the stop before; dropped has the weighed spots
    without a stop: never-lit, or no-room.
    """
    rows = _considered(spots, dwell).where(F.size("spots") > 0)
    pos = spots.schema["pos"].dataType.simpleString()
    made = f"struct<pos:{pos},start:int,travel:int,metres:double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, PLANS):
                some = batch.slice(low, PLANS)
                plans = some.column(1).to_pylist()
                stops, off, metres = zip(*_weigh(plans, dwell, speed, start, end), strict=True)
                place = some.schema.field(1).type.value_type.field("pos").type
                kind = pa.list_(pa.struct([("pos", place), ("start", pa.int32()), ("travel", pa.int32()), ("metres", pa.float64())]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(stops, kind), pa.array(off, pa.int32()), pa.array(metres, pa.float64()), some.column(1), some.column(2)], ["plan", "stops", "off_best", "metres", "spots", "dropped"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    done = rows.select("plan", "spots", "dropped").mapInArrow(run, f"plan {kinds['plan']}, stops array<{made}>, off_best int, metres double, spots {kinds['spots']}, dropped {kinds['dropped']}")
    placed = F.transform("stops", lambda s: s["pos"])
    room = F.transform(F.filter("spots", lambda s: ~F.array_contains(placed, s["pos"])), lambda s: F.struct(s["pos"].alias("pos"), F.lit("no-room").alias("reason")))
    return done.select("plan", "stops", F.size("stops").alias("scheduled"), "off_best", "metres", F.concat("dropped", room).alias("dropped"))


def conflicts(spots: DataFrame, dwell: int = 20) -> DataFrame:
    """(plan, a, b): pairs of a plan's spots that are weighed (see day_plans) and at their best within a visit of each other, MOST spots at most.

    A clash is a matter of the light alone, whether or not both have a stop.
    """
    width = max(LEAST_CLASH, dwell)
    rows = _considered(spots, dwell).select("plan", F.transform("spots", lambda s: F.struct(s["pos"].alias("pos"), s["best"].alias("best"))).alias("s"))
    sides = rows.select("plan", "s", F.posexplode("s").alias("i", "x"))
    pairs = sides.select("plan", "x", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("y"))
    return pairs.where(F.abs(F.col("x.best") - F.col("y.best")) < width).select("plan", F.col("x.pos").alias("a"), F.col("y.pos").alias("b"))


def clashes(spots: DataFrame, dwell: int = 20) -> DataFrame:
    """(plan, a, b): pairs of all spots (plan, pos, best) of a plan, however many, whose best minutes are within a visit of each other.

    A spot meets those of its own stretch of minutes and of the next one; what is found is as
    many rows as there are clashes, and no task holds a plan.
    """
    width = max(LEAST_CLASH, dwell)
    rows = spots.select("plan", "pos", "best", F.floor(F.col("best") / width).alias("cell"))
    side = lambda p: [F.col("pos").alias(f"{p}_pos"), F.col("best").alias(f"{p}_best")]
    left = rows.select("plan", "cell", *side("x"), F.col("cell").alias("own"))
    right = rows.select("plan", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"), *side("y"), F.col("cell").alias("other"))
    both = left.join(right.hint("merge"), ["plan", "cell"]).where(F.abs(F.col("x_best") - F.col("y_best")) < width)
    # a pair of one stretch is met twice, once each way round
    both = both.where((F.col("own") != F.col("other")) | (F.col("x_pos") < F.col("y_pos")))
    return both.where(F.col("x_pos") != F.col("y_pos")).select("plan", F.least("x_pos", "y_pos").alias("a"), F.greatest("x_pos", "y_pos").alias("b"))
