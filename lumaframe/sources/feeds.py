"""Readers: metadata stores, columnar JSON forecasts, seeing forecasts, saved places, directories of originals.

Bodies come as rows of text; a body that can't be read gives no rows instead of an error.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaframe.functions.text import plain_text, sane_date

# Hourly fields of a forecast and the names that rows give them.
HOURLY = {
    "temperature_2m": "temperature", "dew_point_2m": "dew_point", "cloud_cover": "cloud", "cloud_cover_low": "low", "cloud_cover_mid": "mid", "cloud_cover_high": "high",
    "precipitation_probability": "rain", "weather_code": "code", "visibility": "visibility",
}


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON store, one array of records in a file; records that don't fit have nulls."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")


def originals(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,tif,tiff,webp,avif}", below: bool = False) -> DataFrame:
    """(id, path, length): files of a directory, and of those below it, named by the first 16 digits of their SHA-256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", below).load(path)
    return files.select(F.substring(F.sha2("content", 256), 1, 16).alias("id"), "path", "length")


def finite(x: Column) -> Column:
    """x, null if it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def utc(text: Column) -> Column:
    """Seconds of an ISO time; one without a zone is UTC; null if it is none."""
    zoned = F.when(text.rlike("([Zz]|[+-][0-9]{2}:?[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    full = F.regexp_replace(zoned, "(T[0-9]{2}:[0-9]{2})([Zz+-])", "$1:00$2")  # seconds may be left out
    return F.unix_micros(F.try_to_timestamp(full)) / 1e6


def forecast(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, time, fields): one row for each hour of a columnar forecast whose time can be read.

    Columns of a body are parallel arrays; short ones give nulls, and values that are not
    finite numbers become null.
    """
    fields = ", ".join(f"{f}: array<double>" for f in HOURLY)
    parsed = F.from_json(F.col(body), f"struct<hourly: struct<time: array<string>, {fields}>>")
    rows = bodies.select(key, parsed.alias("j")).where("j.hourly.time is not null")
    rows = rows.select(key, F.col("j.hourly").alias("h"), F.posexplode("j.hourly.time").alias("i", "text"))
    values = [finite(F.get(F.col(f"h.{f}"), F.col("i"))).alias(n) for f, n in HOURLY.items()]
    return rows.select(key, utc(F.col("text")).alias("time"), *values).where("time is not null")


def seeing(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, time, seeing, transparency) of a forecast that counts hours from a start of ten digits; classes outside 1..8 are dropped."""
    parsed = F.from_json(F.col(body), "struct<init: string, dataseries: array<struct<timepoint: double, seeing: double, transparency: double>>>")
    rows = bodies.select(key, parsed.alias("j")).where(F.col("j.init").rlike("^[0-9]{10}$"))
    start = F.unix_micros(F.try_to_timestamp(F.col("j.init"), F.lit("yyyyMMddHH"))) / 1e6
    rows = rows.select(key, start.alias("start"), F.explode("j.dataseries").alias("p")).where("start is not null and p.timepoint >= 0")
    whole = lambda c: (F.col(c) == F.floor(c)) & F.col(c).between(1, 8)
    kept = rows.where(whole("p.seeing") & whole("p.transparency"))
    return kept.select(key, (F.col("start") + F.col("p.timepoint") * 3600).alias("time"), F.col("p.seeing").cast("int").alias("seeing"), F.col("p.transparency").cast("int").alias("transparency"))


def forecast_heads(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, latitude, longitude, current fields): what a forecast says of itself and of now; a missing place is 0."""
    fields = ", ".join(f"{f}: double" for f in HOURLY)
    parsed = F.from_json(F.col(body), f"struct<latitude: double, longitude: double, current: struct<time: string, {fields}>>")
    rows = bodies.select(key, parsed.alias("j"))
    place = [F.coalesce(finite(F.col(f"j.{c}")), F.lit(0.0)).alias(c) for c in ("latitude", "longitude")]
    return rows.select(key, *place, utc(F.col("j.current.time")).alias("time"), *[finite(F.col(f"j.current.{f}")).alias(n) for f, n in HOURLY.items()])


def air_quality(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, latitude, longitude, time, aod): hours of an air forecast whose time can be read; a depth that is no number is null."""
    parsed = F.from_json(F.col(body), "struct<latitude: double, longitude: double, hourly: struct<time: array<string>, aerosol_optical_depth: array<double>>>")
    rows = bodies.select(key, parsed.alias("j")).where("j.hourly.time is not null")
    place = [F.coalesce(finite(F.col(f"j.{c}")), F.lit(0.0)).alias(c) for c in ("latitude", "longitude")]
    rows = rows.select(key, *place, F.col("j.hourly.aerosol_optical_depth").alias("d"), F.posexplode("j.hourly.time").alias("i", "text"))
    return rows.select(key, "latitude", "longitude", utc(F.col("text")).alias("time"), finite(F.get("d", F.col("i"))).alias("aod")).where("time is not null")


def search_titles(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, title): files that a search names, in its order."""
    hits = F.from_json(F.get_json_object(body, "$.query.search"), "array<struct<title: string>>")
    rows = bodies.select(key, F.posexplode(hits).alias("pos", "hit")).where(F.col("hit.title").startswith("File:"))
    return rows.select(key, "pos", F.col("hit.title").alias("title"))


def photo_details(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, id, title, lat, lon, origin, thumb, author, licence, licence_url, taken, megapixels) of photographs in a details response.

    A file without a valid place, an image type, both links, an author or a licence is dropped.
    """
    value = "struct<value: string>"
    meta = ", ".join(f"{f}: {value}" for f in ("Artist", "LicenseShortName", "License", "LicenseUrl", "DateTimeOriginal"))
    info = f"struct<mime: string, thumburl: string, descriptionurl: string, width: double, height: double, extmetadata: struct<{meta}>>"
    pages = F.from_json(F.get_json_object(body, "$.query.pages"), f"array<struct<pageid: string, title: string, coordinates: array<struct<lat: double, lon: double>>, imageinfo: array<{info}>>>")
    rows = bodies.select(key, F.posexplode(pages).alias("pos", "p")).withColumns({"at": F.get("p.coordinates", F.lit(0)), "i": F.get("p.imageinfo", F.lit(0))})
    said = lambda f: F.nullif(plain_text(F.col(f"i.extmetadata.{f}.value")), F.lit(""))
    size = F.floor(F.col("i.width") * F.col("i.height") / 100_000 + 0.5) / 10
    made = rows.select(
        key, "pos", F.coalesce("p.pageid", F.regexp_replace("p.title", "^File:", "")).alias("id"), F.coalesce(F.nullif(F.regexp_replace("p.title", "^File:", ""), F.lit("")), F.lit("Untitled")).alias("title"),
        finite(F.col("at.lat")).alias("lat"), finite(F.col("at.lon")).alias("lon"), F.nullif(F.col("i.descriptionurl"), F.lit("")).alias("origin"), F.nullif(F.col("i.thumburl"), F.lit("")).alias("thumb"),
        said("Artist").alias("author"), F.coalesce(said("LicenseShortName"), said("License")).alias("licence"), said("LicenseUrl").alias("licence_url"), sane_date(said("DateTimeOriginal")).alias("taken"),
        F.when((F.col("i.width") > 0) & (F.col("i.height") > 0), size).alias("megapixels"), F.col("i.mime").alias("mime"),
    )
    fine = F.col("mime").rlike("^image/(jpeg|png|webp|avif|tiff)$") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    whole = F.col("origin").isNotNull() & F.col("thumb").isNotNull() & F.col("author").isNotNull() & F.col("licence").isNotNull()
    return made.where(fine & whole).drop("mime")


def places_found(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, name, detail, lat, lon, kind, bounds) of a place search; results without a position are dropped.

    The name is the first part of the whole name where there is none; detail has the next
    three parts. bounds come as south, north, west, east and leave as west, south, east, north.
    """
    fields = "lat: string, lon: string, name: string, display_name: string, type: string, category: string, addresstype: string, boundingbox: array<string>"
    rows = bodies.select(key, F.posexplode(F.from_json(F.col(body), f"array<struct<{fields}>>")).alias("pos", "p"))
    full = F.filter(F.transform(F.split(F.coalesce("p.display_name", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumns({"full": full, "la": finite(F.col("p.lat").try_cast("double")), "lo": finite(F.col("p.lon").try_cast("double"))})
    name = F.coalesce(F.nullif(F.trim("p.name"), F.lit("")), F.get("full", F.lit(0)), F.lit("Unnamed place"))
    rows = rows.where("la is not null and lo is not null").withColumn("name", name)
    rest = F.when(F.get("full", F.lit(0)) == F.col("name"), F.slice("full", 2, 3)).otherwise(F.slice("full", 1, 3))
    kind = F.coalesce(*[F.nullif(F.col(f"p.{c}"), F.lit("")) for c in ("addresstype", "type", "category")], F.lit("place"))
    box = F.transform("p.boundingbox", lambda x: finite(x.try_cast("double")))
    bounds = F.when((F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull()), F.array(*[F.get(box, F.lit(i)) for i in (2, 0, 3, 1)]))
    wrapped = F.when((F.col("lo") >= -180) & (F.col("lo") < 180), F.col("lo")).otherwise(F.pmod(F.col("lo") + 180, F.lit(360.0)) - 180)
    lat = F.when(F.col("la") < -90, -90.0).when(F.col("la") > 90, 90.0).otherwise(F.col("la"))
    return rows.select(key, "pos", "name", F.array_join(rest, ", ").alias("detail"), lat.alias("lat"), wrapped.alias("lon"), kind.alias("kind"), bounds.alias("bounds"))


# How many entries of a saved list count and how long their texts may be.
MOST_SPOTS, MOST_PHOTOS, MOST_VISITS, NOTE_LENGTH, URL_LENGTH = 24, 6, 12, 600, 500


def _text(v: Column, path: str, most: int) -> Column:
    """A text field, trimmed and cut; null where it is anything else."""
    own = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(own) == "STRING", F.nullif(F.left(F.trim(F.try_variant_get(v, path, "string")), F.lit(most)), F.lit("")))


def _number(v: Column, path: str) -> Column:
    """A finite number; the field is looked up once."""
    return F.get(F.filter(F.array(F.try_variant_get(v, path, "double")), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(0))


def _objects(v: Column, path: str) -> Column:
    """The members of an array field, each as a variant."""
    return F.transform(F.from_json(F.try_variant_get(v, path, "string"), "array<string>"), F.try_parse_json)


def frame_of(v: Column) -> Column:
    """A saved lens: all of sensor, focal length, orientation, bearing and tilt, or nothing."""
    sensor, focal, side, bearing, tilt = _text(v, "$.sensor", 24), _number(v, "$.focalLengthMm"), F.try_variant_get(v, "$.orientation", "string"), _number(v, "$.bearing"), _number(v, "$.tiltDeg")
    fine = sensor.isNotNull() & focal.between(1, 2000) & side.isin("landscape", "portrait") & bearing.isNotNull() & (F.abs(tilt) <= 90)
    return F.when(fine, F.struct(sensor.alias("sensor"), focal.alias("focal"), side.alias("orientation"), F.pmod(bearing, F.lit(360.0)).alias("bearing"), tilt.alias("tilt")))


def _some(items: Column) -> Column:
    """items, or null if there are none; what makes them is evaluated once."""
    return F.get(F.filter(F.array(items), lambda x: F.size(x) > 0), F.lit(0))


def photos_of(items: Column) -> Column:
    """The photos of saved members: those with an address, the first MOST_PHOTOS."""
    # members are read into structs first and judged by their fields, so that each field is read once
    read = F.transform(items, lambda v: F.struct(F.try_variant_get(v, "$.url", "string").alias("url"), _text(v, "$.credit", 200).alias("credit"), _text(v, "$.licence", 200).alias("licence"), _text(v, "$.source", 40).alias("source")))
    return F.slice(F.filter(read, lambda p: (F.length(p["url"]) <= URL_LENGTH) & p["url"].rlike("(?i)^https?://[^/\\s]+")), 1, MOST_PHOTOS)


def visits_of(items: Column) -> Column:
    """The latest MOST_VISITS logged visits that have a time and the sun's place; the rest enriches a visit and never invalidates it."""
    read = F.transform(
        items,
        lambda v: F.struct(
            _number(v, "$.at").alias("at"), _number(v, "$.sunAltitude").alias("altitude"), _number(v, "$.sunAzimuth").alias("azimuth"), _number(v, "$.moonFraction").alias("moon"),
            _text(v, "$.cloud", 200).alias("cloud"), _text(v, "$.weather", 60).alias("weather"), _text(v, "$.outcome", NOTE_LENGTH).alias("outcome"),
        ),
    )
    fine = F.filter(read, lambda x: (x["at"] > 0) & (F.abs(x["altitude"]) <= 90) & x["azimuth"].isNotNull())
    latest = F.slice(F.array_sort(fine, lambda a, b: F.when(a["at"] > b["at"], -1).when(a["at"] < b["at"], 1).otherwise(0)), 1, MOST_VISITS)
    made = {"azimuth": lambda x: F.pmod(x["azimuth"], F.lit(360.0)), "moon": lambda x: F.when(x["moon"].between(0, 1), x["moon"])}
    names = ("at", "altitude", "azimuth", "moon", "cloud", "weather", "outcome")
    return F.transform(latest, lambda x: F.struct(*[(made[n](x) if n in made else x[n]).alias(n) for n in names]))


def saved_spots(bodies: DataFrame, key: str, body: str, part: str | None = None) -> DataFrame:
    """(key, pos, name, lat, lon, time_zone, radius, saved_at, note, frame, height, photos, visits) of saved lists.

    One bad entry costs that entry, one bad field of the notebook that field. The latest
    MOST_SPOTS of a list stay, in the order in which they were saved, with their first photos
    and latest visits. A body that is no list gives no rows. A long list may come in several
    bodies, in the order of part. Only what decides which entries stay is read of all of them.
    """
    order = [part, "i"] if part else ["i"]
    rows = bodies.select(key, *order[:-1], F.posexplode(F.from_json(F.col(body), "array<string>")).alias("i", "text"))
    # a whole list in one body may hold very many entries: they are dealt out before they are read
    rows = (rows if part else rows.repartition(key, "i")).select(key, *order, F.try_parse_json("text").alias("v"))
    v = F.col("v")
    lat, lon, radius, height = (_number(v, f"$.{c}") for c in ("lat", "lon", "radiusKm", "slabHeightM"))
    made = rows.select(key, *order, "v", _text(v, "$.name", 120).alias("name"), lat.alias("lat"), lon.alias("lon"), F.coalesce(_number(v, "$.savedAt"), F.lit(0.0)).alias("saved_at"))
    made = made.where("name is not null and abs(lat) <= 85 and abs(lon) <= 180")
    # the place itself is what is limited, so that every task keeps the latest of its own and no list is sorted whole
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("saved_at"), *order))
    kept = made.withColumn("__place", place).where(F.col("__place") <= MOST_SPOTS)
    return kept.select(
        key, (F.col("__place") - 1).alias("pos"), "name", "lat", "lon", F.nullif(F.try_variant_get(v, "$.timeZone", "string"), F.lit("")).alias("time_zone"),
        F.when(radius.between(1, 50), F.floor(radius + 0.5).cast("int")).alias("radius"), "saved_at", _text(v, "$.note", NOTE_LENGTH).alias("note"),
        frame_of(F.try_variant_get(v, "$.frame", "variant")).alias("frame"), F.when((height > 0) & (height <= 1000), F.floor(height + 0.5).cast("int")).alias("height"),
        _some(photos_of(_objects(v, "$.photos"))).alias("photos"), _some(visits_of(_objects(v, "$.visits"))).alias("visits"),
    )


def known_zone(zone: Column) -> Column:
    """A zone's name, null for one that isn't known and would shift every time."""
    return F.when(zone.isin(*sorted(available_timezones())), zone)


def link(query: Column) -> Column:
    """Struct (lat, lon, radius, date, minute, time_zone, name) of a link's query text; null without a valid place, null parts where not valid."""
    part = lambda k: F.nullif(F.try_url_decode(F.regexp_extract(query, rf"(?:^|[?&]){k}=([^&]*)", 1)), F.lit(""))
    at = F.regexp_extract_all(part("at"), F.lit(r"^([^,]*),([^,]*)$"), F.lit(1)), F.regexp_extract_all(part("at"), F.lit(r"^([^,]*),([^,]*)$"), F.lit(2))
    lat, lon = (F.get(x, F.lit(0)).try_cast("double") for x in at)
    number = lambda k, low, high: F.when(part(k).try_cast("double").between(low, high), F.floor(part(k).try_cast("double") + 0.5))
    day = F.when(part("d").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.date_format(F.try_to_date(part("d")), "yyyy-MM-dd"))
    name = F.nullif(F.left(F.trim(part("n")), F.lit(120)), F.lit(""))
    made = F.struct(lat.alias("lat"), lon.alias("lon"), number("r", 1, 50).alias("radius"), day.alias("date"), number("t", 0, 1440).alias("minute"), known_zone(part("tz")).alias("time_zone"), name.alias("name"))
    return F.when((F.abs(lat) <= 85) & (F.abs(lon) <= 180), made)


def to_link(lat: Column, lon: Column, radius: Column, day: Column, minute: Column, zone: Column, name: Column) -> Column:
    """The query text of a link; parts without a value are left out."""
    place = lambda x: F.round(x, 5).cast("string")
    parts = [F.concat(F.lit("at="), place(lat), F.lit("%2C"), place(lon)), F.concat(F.lit("r="), F.floor(radius + 0.5).cast("string")), F.concat(F.lit("d="), day), F.concat(F.lit("t="), F.floor(minute + 0.5).cast("string")), F.concat(F.lit("tz="), F.url_encode(zone)), F.concat(F.lit("n="), F.url_encode(F.left(name, F.lit(120))))]
    return F.concat_ws("&", *parts)
