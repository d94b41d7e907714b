"""Zones, days and month grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zoned_instant(day: Column, minute: Column, zone: Column | str) -> Column:
    """The instant of a wall-clock minute; null where the clocks skip it, the first where they repeat it.

    The session's time zone must be UTC.
    """
    wall = (F.unix_micros(day.cast("timestamp")) / 1_000_000 + minute * 60).cast("timestamp")
    at = F.to_utc_timestamp(wall, zone)
    return F.when(F.from_utc_timestamp(at, zone) == wall, at)


def month_grid(places: DataFrame, minutes: list[int]) -> DataFrame:
    """places (month as yyyy-MM, zone) with day, minute, at: every day of the month at each minute; a month that is none gives no rows."""
    days = places.withColumn("__first", F.try_to_date(F.concat("month", F.lit("-01")))).where("__first is not null")
    days = days.withColumn("day", F.explode(F.sequence("__first", F.last_day("__first")))).drop("__first")
    cells = days.withColumn("minute", F.explode(F.array(*map(F.lit, minutes))))
    return cells.withColumn("at", zoned_instant(F.col("day"), F.col("minute"), F.col("zone")))


def track(df: DataFrame, start: str, end: str, step_seconds: int) -> DataFrame:
    """df with t, one row for each step from start to end seconds, both included."""
    return df.withColumn("t", F.explode(F.sequence(F.col(start), F.col(end), F.lit(step_seconds))))


def offset_minutes(at: Column, zone: str) -> Column:
    """How far a zone is ahead of UTC at an instant, in minutes; the session's zone must be UTC."""
    there = F.from_utc_timestamp(at, zone)
    return F.floor((F.unix_micros(there) - F.unix_micros(at)) / 60_000_000 + 0.5).cast("int")


def local_date(at: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def zoned_noon(day: Column, zone: str) -> Column:
    """Midday of a date at a place: no zone and no change of clocks moves it out of its day."""
    return F.to_utc_timestamp((F.unix_date(day) * 86400 + 43200).cast("timestamp"), zone)


def day_label(day: Column) -> Column:
    return F.date_format(day, "EEE d MMM")
