"""Seasons, moonlight and the moon's and core's levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .formulas import Formula, turn
from .sky import sun_state

# The sun's mean motion, the altitude of moonrise, and where a season's search begins (month, day, longitude).
DEGREES_A_DAY, MOONRISE, CORE_RISE, CORE_USABLE = 0.98564736, -0.833, 0.0, 10.0
SEASONS = (("march-equinox", 3, 20, 0), ("june-solstice", 6, 21, 90), ("september-equinox", 9, 22, 180), ("december-solstice", 12, 21, 270))
NAMES = {
    "march-equinox": ("Spring equinox", "Autumn equinox"),
    "june-solstice": ("Summer solstice", "Winter solstice"),
    "september-equinox": ("Autumn equinox", "Spring equinox"),
    "december-solstice": ("Winter solstice", "Summer solstice"),
}
_STEPS = 6


def _step(i: int) -> list[dict[str, str]]:
    away = f"{turn(f'goal - w{i}_lam + 540')} - 180"
    return [*sun_state(f"t{i}", f"w{i}_"), {f"t{i + 1}": f"t{i} + ({away}) / {DEGREES_A_DAY} * 86400e0"}]


#: seed (seconds), goal (degrees) -> the instant near seed at which the sun's apparent longitude is goal.
LONGITUDE_CROSSING = Formula([{"t0": "seed"}, *[g for i in range(_STEPS) for g in _step(i)], {"at": f"floor(t{_STEPS} * 1000 + 0.5) / 1000e0"}], ["at"])


def season_events(years: DataFrame, year: str = "year") -> DataFrame:
    """years with season, goal and at (seconds): the four equinoxes and solstices of each year."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("season"), F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(float(g)).alias("goal")) for n, m, d, g in SEASONS]))
    made = years.withColumn("__s", rows).select(*years.columns, "__s.season", "__s.goal", F.make_date(F.col(year), F.col("__s.m"), F.col("__s.d")).alias("__day"))
    made = made.withColumn("seed", F.unix_date("__day") * 86400.0 + 43200)
    return LONGITUDE_CROSSING.on(made).drop("__day", "seed")


def season_name(season: Column, latitude: Column) -> Column:
    """What an event is called where one stands."""
    out = F.lit(None).cast("string")
    for key, (north, south) in NAMES.items():
        out = F.when(season == key, F.when(latitude >= 0, north).otherwise(south)).otherwise(out)
    return out


def next_season(instants: DataFrame, t: str = "t") -> DataFrame:
    """instants with season, at and in_days of the first event after t, from t's year or the next.

    Years are few: their events are worked out once for each year and joined by it.
    """
    year = F.year(F.col(t).cast("timestamp"))
    rows = instants.withColumn("__year", year)
    years = rows.select(F.explode(F.array("__year", F.col("__year") + 1)).alias("year")).distinct()
    events = season_events(years).groupBy("year").agg(F.array_sort(F.collect_list(F.struct("at", "season"))).alias("events"))
    for offset in (0, 1):
        own = events.select((F.col("year") - offset).alias("__y"), F.col("events").alias(f"__e{offset}"))
        rows = rows.join(own, F.col("__year") == F.col("__y")).drop("__y")
    first = F.get(F.filter(F.concat("__e0", "__e1"), lambda e: e["at"] > F.col(t)), F.lit(0))
    rows = rows.withColumn("__n", first)
    return rows.select(*instants.columns, F.col("__n.season").alias("season"), F.col("__n.at").alias("at"), ((F.col("__n.at") - F.col(t)) / 86400).alias("in_days"))


def nearest_solstices(instants: DataFrame, t: str = "t") -> DataFrame:
    """instants with june and december, the solstices nearest to t among those of three years; the earlier year's on a tie."""
    rows = instants.withColumn("__year", F.year(F.col(t).cast("timestamp")))
    years = rows.select(F.explode(F.array(F.col("__year") - 1, F.col("__year"), F.col("__year") + 1)).alias("year")).distinct()
    events = season_events(years).where(F.col("season").isin("june-solstice", "december-solstice"))
    near = events.select("season", "at", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)).alias("__y"))
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("season") == s, F.col("at"))))
    near = near.groupBy("__y").agg(of("june-solstice").alias("__june"), of("december-solstice").alias("__december"))
    rows = rows.join(near, F.col("__year") == F.col("__y"))
    pick = lambda c: F.array_min(F.transform(c, lambda at: F.struct(F.abs(at - F.col(t)).alias("d"), at.alias("at"))))["at"]
    return rows.select(*instants.columns, pick("__june").alias("june"), pick("__december").alias("december"))


def moonlight(altitude: Column, fraction: Column) -> Column:
    """How much light the moon gives to work with."""
    return (
        F.when(altitude <= MOONRISE, "below the horizon")
        .when(fraction < 0.15, "a sliver — a subject, not a light")
        .when(altitude < 10, "low — behind anything on the skyline")
        .when(fraction > 0.85, "bright enough to light a landscape")
        .when(fraction > 0.5, "usable fill on a long exposure")
        .otherwise("faint — expect to expose for the sky")
    )
