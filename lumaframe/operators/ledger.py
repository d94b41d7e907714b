"""Audits with repairs, match records, caches of results, stamps, and comparison of two sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .archive import expected_tags, keep_first

GENERATED, MOST_UNKEPT, MOST_CACHED = "avif", 12, 64
HEAVY = ("embedding", "grid")
# Order in which regions are compared, hue strength below which a hue says nothing, and presence of a band.
WEAK_HUE, ABSENT_BAND, SPARSE_BAND = 0.3, 0.01, 0.02


def light_columns(df: DataFrame, heavy: tuple[str, ...] = HEAVY) -> DataFrame:
    """df without the columns that no page shows; the scan never reads them."""
    return df.drop(*heavy)


def union_of_owners(*stores: tuple[str, DataFrame]) -> DataFrame:
    """(owner, id, width, file, tag, format): the declared files of several stores as one table.

    A store has id, width and derivatives, an array of (tag, file, format).
    """
    out: DataFrame | None = None
    for name, store in stores:
        own = store.select(F.lit(name).alias("owner"), "id", "width", F.explode_outer("derivatives").alias("d")).select("owner", "id", "width", "d.file", "d.tag", "d.format")
        out = own if out is None else out.unionByName(own)
    return out


def full_audit(owned: DataFrame, present: DataFrame) -> DataFrame:
    """(fault, id, file, tag, format): missing files, expected sizes that nothing declares, and files without an owner.

    owned is a union_of_owners, present has file; names that begin with a dot are not files.
    """
    there = present.where(~F.col("file").startswith(".")).select("file").distinct()
    missing = owned.where("file is not null").join(there, "file", "left_anti").select(F.lit("missing").alias("fault"), "id", "file", "tag", "format").distinct()
    wanted = owned.select("id", "width").distinct().select("id", F.explode(expected_tags(F.col("width"))).alias("tag"))
    none = F.lit(None).cast("string")
    undeclared = wanted.join(owned.where(F.col("format") == GENERATED).select("id", "tag"), ["id", "tag"], "left_anti").select(F.lit("undeclared").alias("fault"), "id", none.alias("file"), "tag", none.alias("format"))
    orphans = there.join(owned.select("file"), "file", "left_anti").select(F.lit("orphan").alias("fault"), F.lit(None).cast(owned.schema["id"].dataType).alias("id"), "file", none.alias("tag"), none.alias("format"))
    return missing.unionByName(undeclared).unionByName(orphans)


def only_rendered(audit: DataFrame, rendered: DataFrame) -> DataFrame:
    """An audit whose faults are those of rendered ids; orphans stay as they are."""
    orphan = F.col("fault") == "orphan"
    return audit.where(~orphan).join(rendered.select("id").distinct(), "id", "left_semi").unionByName(audit.where(orphan))


def repair_plan(audit: DataFrame) -> DataFrame:
    """(id, action): render again what lacks a generated file or an expected size, rewrite what only declares stale formats."""
    again = audit.where((F.col("fault") == "undeclared") | ((F.col("fault") == "missing") & (F.col("format") == GENERATED))).select("id").distinct()
    stale = audit.where((F.col("fault") == "missing") & (F.col("format") != GENERATED)).select("id").distinct().join(again, "id", "left_anti")
    return again.withColumn("action", F.lit("render")).unionByName(stale.withColumn("action", F.lit("rewrite")))


def guarded(df: DataFrame, audit: DataFrame) -> DataFrame:
    """df, which fails on its first row when the audit has missing files."""
    n = audit.where(F.col("fault") == "missing").agg(F.count("*").alias("__missing"))
    both = df.join(F.broadcast(n))  # one row
    told = F.raise_error(F.format_string("this build would publish %d broken images", "__missing"))
    return both.where(F.when(F.col("__missing") > 0, told.cast("boolean")).otherwise(F.lit(True))).drop("__missing")


def stamp_of(text: Column) -> Column:
    """A stamp read back from JSON, null for anything that isn't one: builtAt must be a date and count a number."""
    v = F.try_parse_json(text)
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    built, number = F.try_variant_get(v, "$.builtAt", "string"), kind("$.count").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    ids = F.from_json(F.try_variant_get(v, "$.photos", "string"), "array<string>")
    fine = (kind("$.builtAt") == "STRING") & F.try_to_timestamp(built).isNotNull() & number
    made = F.struct(
        built.alias("built_at"), F.try_variant_get(v, "$.count", "bigint").alias("count"), F.coalesce(F.when(kind("$.chapters").rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$.chapters", "bigint")), F.lit(0)).alias("chapters"),
        F.coalesce(ids, F.array().cast("array<string>")).alias("photos"),
    )
    return F.when(fine, made)


def match_id(reference: Column, own: Column, baseline: Column) -> Column:
    """The id of a match: of the hashes of both files and the baseline."""
    return F.substring(F.sha2(F.concat_ws(":", reference, own, baseline).cast("binary"), 256), 1, 16)


def add_matches(records: DataFrame, batch: DataFrame) -> DataFrame:
    """records with batch's matches that it lacks, the first of each id, and evicted() applied."""
    fresh = keep_first(batch, ["id"], [F.col("created")]).join(records.select("id"), "id", "left_anti")
    return evicted(records.unionByName(fresh.select(*records.columns)))


def evicted(records: DataFrame, most: int = MOST_UNKEPT) -> DataFrame:
    """records (id, created, kept) without the oldest that nobody keeps beyond the latest most."""
    loose = records.where(~F.col("kept")).orderBy(F.desc("created"), F.desc("id")).limit(most)
    return records.where("kept").unionByName(loose)


def cache_key(content: Column, baseline: Column) -> Column:
    """What a result is cached under: the content's hash and how it was read."""
    return F.concat_ws(":", F.substring(F.sha2(content, 256), 1, 16), baseline)


def measured(batch: DataFrame, results: DataFrame, key: str, measure) -> DataFrame:
    """results with what measure makes of batch's keys that they lack, one row for each key; failures have null measures and stay apart.

    measure takes and returns a DataFrame with key and seen, the place in line.
    """
    new = keep_first(batch, [key], [F.col("seen")]).join(results.select(key), key, "left_anti")
    return results.unionByName(measure(new).select(*results.columns))


def bounded_cache(results: DataFrame, key: str, seen: str, most: int = MOST_CACHED) -> DataFrame:
    """The latest most results, first in first out."""
    return results.orderBy(F.desc(seen), key).limit(most)


def all_default(record: Column, defaults: dict[str, float]) -> Column:
    """Whether every constant of a record, a struct, is the shipped one."""
    out = F.lit(True)
    for name, value in defaults.items():
        out = out & record[name].eqNullSafe(F.lit(value))
    return out


def compared_regions(reference: DataFrame, own: DataFrame) -> DataFrame:
    """(region, comparable, cover, dL, dC, dH) over the regions of both sides: what own must change by to reach the reference.

    Both have region, coverage, L, C, hue and strength. A region of one side stays, marked as
    not comparable; a hue difference counts only where both hues are clear.
    """
    fields = ("coverage", "L", "C", "hue", "strength")
    side = lambda df, p: df.select("region", *[F.col(c).alias(f"{p}_{c}") for c in fields])
    both = side(reference, "r").join(side(own, "m"), "region", "full_outer")
    comparable = F.col("r_L").isNotNull() & F.col("m_L").isNotNull()
    turned = F.pmod(F.col("r_hue") - F.col("m_hue") + 180, F.lit(360.0)) - 180
    clear = (F.col("r_strength") >= WEAK_HUE) & (F.col("m_strength") >= WEAK_HUE)
    cover = F.when(comparable, "both").when(F.col("r_L").isNotNull(), "reference only").otherwise("yours only")
    return both.select("region", comparable.alias("comparable"), cover.alias("cover"), (F.col("r_L") - F.col("m_L")).alias("dL"), (F.col("r_C") - F.col("m_C")).alias("dC"), F.when(comparable & clear, turned).alias("dH"))


def compared_bands(reference: DataFrame, own: DataFrame) -> DataFrame:
    """(band, presence, dC, dL) of colour bands (band, share, chroma, L): absent in both is no row, sparse in either has no differences."""
    side = lambda df, p: df.select("band", *[F.col(c).alias(f"{p}_{c}") for c in ("share", "chroma", "L")])
    both = side(reference, "r").join(side(own, "m"), "band", "full_outer").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("r_share", "m_share")})
    both = both.where((F.col("r_share") >= ABSENT_BAND) | (F.col("m_share") >= ABSENT_BAND))
    sparse = (F.col("r_share") < SPARSE_BAND) | (F.col("m_share") < SPARSE_BAND)
    gap = lambda c: F.when(~sparse, F.col(f"r_{c}") - F.col(f"m_{c}"))
    return both.select("band", F.when(sparse, "sparse").otherwise("both").alias("presence"), gap("chroma").alias("dC"), gap("L").alias("dL"))


def photos_of(chapters: DataFrame, fields: list[str]) -> DataFrame:
    """(chapter, name, pos, fields): the photos of nested chapters, each with its chapter's name."""
    rows = chapters.select("chapter", "name", F.posexplode("photos").alias("pos", "p"))
    return rows.select("chapter", "name", "pos", *[F.col(f"p.{f}").alias(f) for f in fields])


def gate_forecasts(pins: DataFrame, forecasts: DataFrame, gate: Column) -> DataFrame:
    """pins (id, cell) with their own forecast and that of their gate's cell, null where there is none; forecasts have cell and value."""
    own = forecasts.select("cell", F.col("value").alias("here"))
    there = forecasts.select(F.col("cell").alias("__g"), F.col("value").alias("there"))
    both = pins.withColumn("gate", gate).join(own, "cell", "left").join(there, F.col("gate") == F.col("__g"), "left")
    return both.drop("__g")


def lit_windows(samples: DataFrame, key: list[str], minute: str) -> DataFrame:
    """(key, run, lit, below, start, end): runs of samples (minute, lit, altitude) that agree in light and in being below the horizon."""
    along = Window.partitionBy(*key).orderBy(minute)
    state = F.struct(F.col("lit").alias("lit"), (~F.coalesce(F.col("altitude") > 0, F.lit(False))).alias("below"))
    rows = samples.withColumn("__s", state)
    fresh = F.when(F.col("__s").eqNullSafe(F.lag("__s").over(along)) & (F.row_number().over(along) > 1), 0).otherwise(1)
    rows = rows.withColumn("__new", fresh).withColumn("run", F.sum("__new").over(along).cast("int"))
    made = rows.groupBy(*key, "run").agg(F.first("__s").alias("s"), F.min(minute).alias("start"), (F.max(minute) + 1).alias("end"))
    return made.select(*key, "run", "s.lit", "s.below", "start", "end")


def light_summary(windows: DataFrame, key: list[str]) -> DataFrame:
    """(key, first, last, total, longest): first and last lit minute, all of them, and the longest run of lit_windows; the first of equals."""
    own = windows.where("lit").withColumn("__n", F.col("end") - F.col("start"))
    best = F.max_by(F.struct("start", "end"), F.struct("__n", -F.col("start")))
    made = own.groupBy(*key).agg(F.min("start").alias("first"), (F.max("end") - 1).alias("last"), F.sum("__n").alias("total"), best.alias("longest"))
    return windows.select(*key).distinct().join(made, key, "left").select(*key, "first", "last", F.coalesce("total", F.lit(0)).alias("total"), "longest")


def golden_runs(cells: DataFrame, key: list[str], minute: str = "minute", phase: str = "phase", day: int = 1440) -> DataFrame:
    """(key, start, end): runs of golden cells, each to the next cell; one that is open ends with the day."""
    along = Window.partitionBy(*key).orderBy(minute)
    rows = cells.withColumn("__g", F.col(phase) == "golden").withColumn("__next", F.lead(minute).over(along))
    rows = rows.withColumn("__isle", F.row_number().over(along) - F.row_number().over(Window.partitionBy(*key, "__g").orderBy(minute)))
    return rows.where("__g").groupBy(*key, "__isle").agg(F.min(minute).alias("start"), F.max(F.coalesce("__next", F.lit(day))).alias("end")).drop("__isle")


def sides_of_noon(windows: Column, noon: Column) -> Column:
    """Struct (morning, evening) of an ordered array of (start, end): the window before noon and the one after it.

    Before is the first that ends by noon, else the first that begins before it; after the
    first that begins at noon or later, else the last that ends after it. One window alone is
    not told twice.
    """
    first = lambda f: F.get(F.filter(windows, f), F.lit(0))
    before = F.coalesce(first(lambda w: w["end"] <= noon), first(lambda w: w["start"] < noon))
    after = F.coalesce(first(lambda w: w["start"] >= noon), F.try_element_at(F.filter(windows, lambda w: w["end"] > noon), F.lit(-1)))
    again = before["start"] == after["start"]
    return F.struct(before.alias("morning"), F.when(~F.coalesce(again, F.lit(False)), after).alias("evening"))


# Rows of a day's light, by key, label and whether they are windows.
EVENT_ROWS = (("blueMorning", "Blue hour"), ("sunrise", "Sunrise"), ("goldenMorning", "Golden hour"), ("solarNoon", "Solar noon"), ("goldenEvening", "Golden hour"), ("sunset", "Sunset"), ("blueEvening", "Blue hour"))


def event_rows(days: DataFrame, key: list[str]) -> DataFrame:
    """(key, place, event, label, start, end) of days (key, solar_noon, sunrise, sunset, golden, blue with arrays of windows).

    Windows are placed by the side of noon that they are on; an event that a day doesn't have
    is listed without a time.
    """
    sides = {n: sides_of_noon(F.col(n), F.col("solar_noon")) for n in ("golden", "blue")}
    rows = days.withColumns({f"__{n}": s for n, s in sides.items()})
    none = F.lit(None).cast("double")
    of = lambda name: (F.col(f"__{name}.start"), F.col(f"__{name}.end"))
    span = {"blueMorning": of("blue.morning"), "goldenMorning": of("golden.morning"), "goldenEvening": of("golden.evening"), "blueEvening": of("blue.evening"), "sunrise": (F.col("sunrise"), none), "sunset": (F.col("sunset"), none), "solarNoon": (F.col("solar_noon"), none)}
    made = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("event"), F.lit(label).alias("label"), span[k][0].alias("start"), span[k][1].alias("end")) for i, (k, label) in enumerate(EVENT_ROWS)])
    return rows.select(*key, F.inline(made))


def audit_report(audit: DataFrame, shown: int = 8) -> DataFrame:
    """(place, line) of an audit: the count of each kind of fault, the first ids or files of it, and how many more there are.

    Counts are aggregated, and only the names that are shown are gathered.
    """
    heads = F.create_map(*[F.lit(x) for kv in (("missing", "Listed but not on disk"), ("undeclared", "Large enough for a width no derivative records"), ("orphan", "On disk, owned by no entry")) for x in kv])
    order = F.create_map(*[F.lit(x) for kv in (("missing", 0), ("undeclared", 1000), ("orphan", 2000)) for x in kv])
    name = F.coalesce("file", F.concat(F.col("id").cast("string"), F.lit(" "), F.col("tag")))
    rows = audit.select("fault", name.alias("name"))
    place = F.row_number().over(Window.partitionBy("fault").orderBy("name"))
    top = rows.withColumn("n", place).where(F.col("n") <= shown)
    counts = rows.groupBy("fault").agg(F.count("*").alias("all"))
    start = F.element_at(order, F.col("fault"))
    lines = top.select((start + F.col("n")).alias("place"), F.concat(F.lit("  "), "name").alias("line"))
    head = counts.select(start.alias("place"), F.concat(F.element_at(heads, F.col("fault")), F.lit(": "), F.col("all").cast("string")).alias("line"))
    more = counts.where(F.col("all") > shown).select((start + shown + 1).alias("place"), F.concat(F.lit("  …and "), (F.col("all") - shown).cast("string"), F.lit(" more")).alias("line"))
    return head.unionByName(lines).unionByName(more)
