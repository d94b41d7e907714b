"""Saved spots: matching by distance, saving over, editing, visits, removal. A list has a few dozen spots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.sources.feeds import MOST_SPOTS, MOST_VISITS

from .places import flat_metres

SAME_SPOT_M = 50.0
#: What a spot keeps of its notebook when it is saved again without.
NOTEBOOK = ("note", "frame", "height", "photos", "visits")


def matched(saved: DataFrame, at: DataFrame, key: list[str]) -> DataFrame:
    """(key, pos): the first spot of each list within SAME_SPOT_M of at's place; lists without one have no row.

    Several spots of a list may stand at one place. Where at has opened, the pos of the spot
    that it was opened from, that one goes before the others if it is within reach too.
    """
    opened = F.col("opened") if "opened" in at.columns else F.lit(None).cast("int")
    near = saved.select(*key, "pos", F.col("lat").alias("__la"), F.col("lon").alias("__lo")).join(at.select(*key, "lat", "lon", opened.alias("__opened")), key)
    near = near.where(flat_metres(F.col("__la"), F.col("__lo"), F.col("lat"), F.col("lon")) <= SAME_SPOT_M)
    return near.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("pos") == F.col("__opened"), F.col("pos"))), F.min("pos")).alias("pos"))


def save(saved: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """saved with one new spot for each list of new in front: it takes the place of the spot that it matches.

    The new spot's fields win; what its notebook doesn't say stays as it was. Lists keep their
    first MOST_SPOTS.
    """
    hit = matched(saved, new, key)
    old = saved.join(hit, [*key, "pos"]).select(*key, *[F.col(c).alias(f"__{c}") for c in NOTEBOOK])
    merged = new.join(old, key, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in NOTEBOOK}).drop(*[f"__{c}" for c in NOTEBOOK])
    rest = saved.join(hit, [*key, "pos"], "left_anti")
    both = rest.unionByName(merged.withColumn("pos", F.lit(-1)).select(*saved.columns))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("pos")) - 1
    return both.withColumn("pos", place).where(F.col("pos") < MOST_SPOTS)


def edit(saved: DataFrame, at: DataFrame, key: list[str], fields: dict[str, Column]) -> DataFrame:
    """saved with fields of the spot that matches at's place set anew, in its place; fields may use at's columns as a struct `at`."""
    hit = matched(saved, at, key).withColumn("__hit", F.lit(True))
    told = at.select(*key, F.struct(*[c for c in at.columns if c not in key]).alias("at"))
    both = saved.join(hit, [*key, "pos"], "left").join(told, key, "left")
    made = {c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in fields.items()}
    return both.withColumns(made).select(*saved.columns)


def add_visit(saved: DataFrame, at: DataFrame, key: list[str]) -> DataFrame:
    """saved with at's visit (a struct) logged first against the spot that matches; where none does, nothing changes."""
    old = F.coalesce(F.col("visits"), F.array().cast(saved.schema["visits"].dataType))
    return edit(saved, at, key, {"visits": F.slice(F.concat(F.array("at.visit"), old), 1, MOST_VISITS)})


def remove(saved: DataFrame, at: DataFrame, key: list[str]) -> DataFrame:
    """saved without the spots that match, the others moved up."""
    rest = saved.join(matched(saved, at, key), [*key, "pos"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("pos")) - 1
    return rest.withColumn("pos", place)


def match_note(off: Column, round_: Column, day: Column, weather: Column, cloud: Column, outcome: Column) -> Column:
    """What the closest visit tells: how near its sun stood, the weather, and what came of it."""
    whole = lambda x: F.format_string("%.0f", x)
    near = F.when(off < 3, "nearly the same height").when(off < 10, F.concat(whole(off), F.lit("° different in height"))).otherwise(F.concat(whole(off), F.lit("° off in height — not that close a match")))
    sky = F.nullif(F.concat_ws(", ", F.nullif(weather, F.lit("")), F.nullif(cloud, F.lit(""))), F.lit(""))
    said = F.when(F.coalesce(outcome, F.lit("")) != "", F.concat(F.lit(' "'), outcome, F.lit('"'))).otherwise(" No outcome was logged.")
    return F.concat(F.lit("Closest logged visit: "), day, F.lit(", sun "), near, F.lit(", "), whole(round_), F.lit("° round in bearing."), F.coalesce(F.concat(F.lit(" "), sky, F.lit(".")), F.lit("")), said)
