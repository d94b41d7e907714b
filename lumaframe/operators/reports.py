"""Plans as plain text: a place's day, and a day over several places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import sky, text

# Sentences of the reports.
MODELLED = "Sun and moon are computed; shadows are modelled"
NOTHING = "Nothing could be planned for this day."
NEVER, NO_ROOM = "%s has no stretch of direct sun long enough for %d minutes.", "%s could not be reached in time from anywhere else in the day, in any order."
TOGETHER = "%s and %s are both at their best within %d minutes of each other — you can have one of them at its best, not both."
UNREACHABLE = "No ordering fits %s between the others and still meets its light."
TRAVEL = "Travel is straight-line distance at %s km/h, plus %d minutes at each spot. Real routes are longer — treat every move as a lower bound."


def columns_of(pairs: Column) -> Column:
    """Lines of (label, value) pairs; labels are padded to the widest, so that values line up."""
    wide = F.array_max(F.transform(pairs, lambda p: F.length(p["label"])))
    return F.transform(pairs, lambda p: F.concat(F.rpad(p["label"], wide + 2, F.lit(" ")), p["value"]))


def span(start: Column, end: Column | None = None) -> Column:
    """Clock times of minutes: one, two as a span, or a dash where there is none."""
    one = F.when(start.isNull(), F.lit("—")).otherwise(text.clock(start))
    return one if end is None else F.when(start.isNotNull() & end.isNotNull(), F.concat(one, F.lit("–"), text.clock(end))).otherwise(one)


def _closing(zone: Column, caveat: Column) -> list[Column]:
    told = F.when(caveat.isNotNull(), F.concat(F.lit(f"{MODELLED} — "), caveat)).otherwise(F.lit(f"{MODELLED}, not measured."))
    return [F.concat(F.lit("Times are local to "), zone, F.lit(".")), told]


def _joined(*parts: Column) -> Column:
    """Arrays of lines as one text; each part that has lines but the last is followed by an empty line."""
    last = len(parts) - 1
    spaced = [p if i == last else F.when(F.size(p) > 0, F.concat(p, F.array(F.lit("")))).otherwise(F.array().cast("array<string>")) for i, p in enumerate(parts)]
    return F.array_join(F.concat(*spaced), "\n")


def shoot_plan(name: Column, day: Column, lat: Column, lon: Column, events: Column, notes: Column, zone: Column, caveat: Column) -> Column:
    """A place's day as text: events, an array of (label, value), notes, an array of lines with nulls left out, and what the times are worth."""
    head = F.array(F.concat(name, F.lit(" — "), day), F.format_string("%.5f, %.5f", lat, lon))
    return _joined(head, columns_of(events), F.array_compact(notes), F.array(*_closing(zone, caveat)))


def itinerary_reports(plans: DataFrame, spots: DataFrame, conflicts: DataFrame, day: Column, midnight: int, zone: str, dwell: int = 20, speed: float = 40.0) -> DataFrame:
    """(plan, report) of day_plans() and conflicts(): stops with travel and the sun's altitude, sums, all that is left out, clashes, and assumptions.

    spots (plan, pos, name, lat, lon) are those of the plans; minutes count from midnight (seconds). A plan has few spots, so its lines are few.
    """
    key = ["plan", "pos"]
    stops = plans.select("plan", F.posexplode("stops").alias("i", "s")).select("plan", "i", "s.*").join(spots, key)
    stops = sky.SUN.on(stops.withColumn("t", (F.col("start") * 60 + midnight).cast("double")))
    sun = F.floor(F.col("sun_altitude") + 0.5).cast("long").cast("string")
    way = F.when(F.col("travel") > 0, F.concat(F.lit("("), F.col("travel").cast("string"), F.lit(" min travel, sun "), sun, F.lit("°)"))).otherwise(F.concat(F.lit("(sun "), sun, F.lit("°)")))
    line = F.struct(F.concat(text.clock(F.col("start")), F.lit("–"), text.clock(F.col("start") + dwell)).alias("label"), F.concat("name", F.lit("  "), way).alias("value"))
    lists = [stops.select("plan", F.struct(F.lit(0).alias("kind"), F.col("i").alias("a"), F.lit(0).alias("b"), line.alias("line")).alias("x"))]
    said = lambda kind, a, b, note: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.struct(note.alias("label"), F.lit("").alias("value")).alias("line")).alias("x")
    dropped = plans.select("plan", F.explode("dropped").alias("d")).select("plan", "d.*").join(spots, key)
    never = F.col("reason") == "never-lit"
    lists.append(dropped.select("plan", said(1, F.when(never, 0).otherwise(1), F.col("pos"), F.concat(F.lit("  "), F.when(never, F.format_string(NEVER, "name", F.lit(dwell))).otherwise(F.format_string(NO_ROOM, "name"))))))
    lists.append(dropped.where(~never).select("plan", said(3, F.col("pos"), F.lit(0), F.concat(F.lit("  "), F.format_string(UNREACHABLE, "name")))))
    named = lambda c: spots.select("plan", F.col("pos").alias(c), F.col("name").alias(f"{c}_name"))
    clash = conflicts.join(named("a"), ["plan", "a"]).join(named("b"), ["plan", "b"])
    lists.append(clash.select("plan", said(2, F.col("a"), F.col("b"), F.concat(F.lit("  "), F.format_string(TOGETHER, "a_name", "b_name", F.lit(max(10, dwell)))))))
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    rows = plans.join(every.groupBy("plan").agg(F.sort_array(F.collect_list("x")).alias("x")), "plan", "left")
    kind = lambda *ks: F.transform(F.filter("x", lambda x: x["kind"].isin(*ks)), lambda x: x["line"])
    words = lambda *ks: F.transform(kind(*ks), lambda x: x["label"])
    headed = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(title)), lines)).otherwise(F.array().cast("array<string>"))
    total = lambda f: F.aggregate("stops", F.lit(0.0), lambda n, s: n + s[f])
    n = F.size("stops")
    sums = F.concat(n.cast("string"), F.when(n == 1, " spot · ").otherwise(" spots · "), total("travel").cast("long").cast("string"), F.lit(" min travelling · "), F.format_string("%.1f", F.floor(total("metres") + 0.5) / 1000), F.lit(" km"))
    ends = F.array(F.lit(TRAVEL % (f"{speed:g}", dwell)), *_closing(F.lit(zone), F.lit(None).cast("string")))
    some = n > 0
    report = _joined(
        F.array(F.concat(F.lit("Day plan — "), day)), F.when(some, columns_of(kind(0))).otherwise(F.array(F.lit(NOTHING))), F.when(some, F.array(sums)).otherwise(F.array().cast("array<string>")),
        headed("Left out:", words(1)), headed("Clashes:", words(2, 3)), ends,
    )
    return rows.withColumn("x", F.coalesce("x", F.array().cast(every.groupBy("plan").agg(F.collect_list("x").alias("x")).schema["x"].dataType))).select("plan", report.alias("report"))
