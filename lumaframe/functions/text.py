"""Strings of records: slugs, names, markup, dates, queries, media, exposure text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Software that reads film, by pattern.
SCANNERS = r"(?i)noritsu|frontier|fuji.*sp-?\d|silverfast|vuescan|plustek|primefilm|reflecta|imacon|flextight|coolscan|pakon|epson scan|scanner"


def slug(name: Column, n: int = 60) -> Column:
    """Letters, digits, - and _ of a name, runs of others as one -, at most n characters."""
    return F.left(F.regexp_replace(name, "[^a-zA-Z0-9_-]+", "-"), F.lit(n))


def plain_text(html: Column) -> Column:
    """Text of markup: tags become spaces, the common entities characters, white space one space."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sane_date(text: Column) -> Column:
    """The time of a text if photography could have been there, from 1826 to 2200."""
    at = F.try_to_timestamp(text)
    return F.when(F.year(at).between(1826, 2200), at)


def query_key(text: Column) -> Column:
    """A search text in one form: trimmed, lower case, single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def is_calendar_date(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text).isNotNull(), F.lit(False))


def medium(camera: Column, software: Column, exposed: Column) -> Column:
    """film for scanners and for records without a camera, digital for a camera with exposure data."""
    hay = F.concat_ws(" ", F.coalesce(camera, F.lit("")), F.coalesce(software, F.lit("")))
    return F.when(hay.rlike(SCANNERS), "film").when(camera.isNotNull() & (camera != "") & exposed, "digital").otherwise("film")


def shutter(seconds: Column) -> Column:
    return F.when(seconds >= 1, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(F.lit("1/"), F.floor(1 / seconds + 0.5).cast("string"), F.lit("s")))


def degrees_of(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Signed decimal degrees, six digits."""
    plain = d + m / 60 + s / 3600
    signed = F.when(ref.isin("S", "W"), -plain).otherwise(plain)
    return F.floor(signed * 1e6 + 0.5) / 1e6


def clock(minute: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))


def coarse_key(lat: Column, lon: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f_%.{digits}f", lat, lon)


def query_digest(text: Column, limit: Column, version: int = 2) -> Column:
    """What a search is cached under: twenty digits of the SHA-1 of its version, its text in one form and its limit."""
    return F.left(F.sha1(F.concat_ws(" ", F.lit(f"v{version}"), query_key(text), limit.cast("string")).cast("binary")), F.lit(20))


def cover_count(html: Column) -> Column:
    """Struct (count, chapters) off a cover's kicker; null if the cover has changed."""
    pattern = r'class="cover-kicker"[^>]*>\s*(\d+)\s*·\s*(\d+)\s*chapters'
    part = lambda i: F.nullif(F.regexp_extract(html, pattern, i), F.lit("")).cast("long")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("count"), part(2).alias("chapters")))


def identity_of(seed: Column) -> Column:
    """32 hex digits that name a text: four 32-bit FNV-1a hashes of its UTF-16 units with salts of their own, the same in every export."""
    coded = F.hex(F.encode(seed, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(1), F.length(coded), F.lit(4)), lambda i: F.conv(F.substr(coded, i, F.lit(4)), 16, 10).cast("long"))
    units = F.when(F.length(coded) > 0, units).otherwise(F.array().cast("array<bigint>"))
    word = lambda x: F.pmod(x, F.lit(2**32))
    begin = [(0x811C9DC5 ^ (salt * 0x9E3779B9)) & 0xFFFFFFFF for salt in range(4)]
    parts = [F.lpad(F.hex(F.aggregate(units, F.lit(b).cast("long"), lambda h, u: word(h.bitwiseXOR(u) * 0x01000193))), 8, "0") for b in begin]
    return F.upper(F.concat(*parts))


# Extensions of raw files.
RAW = "arw srf sr2 axr cr2 cr3 crw nef nrw nefx raf orf rw2 pef dng erf dcr mrw mos rwl iiq srw 3fr fff dxo raw".split()


def is_raw(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1)).isin(*RAW)


def match_name(own: Column, reference: Column, n: int = 60) -> Column:
    """What a preset is called: both names without extension, then without the hash at their end."""
    clean = lambda s: F.regexp_replace(F.regexp_replace(s, r"\.[^.]+$", ""), r"(?i)\.[0-9a-f]{8,}$", "")
    return F.left(F.concat(clean(own), F.lit(" as "), clean(reference)), F.lit(n))


def preset_files(name: Column, automatic: Column, safe: Column) -> Column:
    """Struct (files, chosen): a file with masks if a mask can be made again, always one without, and the one that is asked for."""
    base = F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9-_ ]+", ""), r"\s+", "-")
    files = F.when(automatic > 0, F.array(F.concat(base, F.lit(".xmp")), F.concat(base, F.lit("-safe.xmp")))).otherwise(F.array(F.concat(base, F.lit(".xmp"))))
    return F.struct(files.alias("files"), F.when(safe, F.element_at(files, -1)).otherwise(F.element_at(files, 1)).alias("chosen"))


def place_label(lat: Column, lon: Column) -> Column:
    """Four places of each coordinate with its side."""
    part = lambda x, pos, neg: F.concat(F.format_string("%.4f°", F.abs(x)), F.when(x >= 0, pos).otherwise(neg))
    return F.concat_ws(" ", part(lat, "N", "S"), part(lon, "E", "W"))


def shadow_caveat(showing: Column, cast: Column, guessed: Column) -> Column:
    """How much of a shadow picture is inferred; null where there is none."""
    told = F.when(guessed == 0, F.concat(cast.cast("string"), F.lit(" buildings, all from recorded heights."))).otherwise(F.concat(guessed.cast("string"), F.lit(" of "), cast.cast("string"), F.lit(" building heights are storey-count estimates.")))
    return F.when(showing & (cast > 0), told)


def moon_disc(fraction: Column, waxing: Column, r: int = 12) -> Column:
    """The lit part of the disc as a path."""
    k = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))
    sweep = F.when(k > 0.5, 1).otherwise(0)
    side, back = F.when(waxing, 1).otherwise(0), F.when(waxing, sweep).otherwise(1 - sweep)
    rx = F.floor(r * F.abs(1 - 2 * k) * 10_000 + 0.5) / 10_000
    return F.concat(F.lit(f"M 0 {-r} A {r} {r} 0 0 "), side.cast("string"), F.lit(f" 0 {r} A "), rx.cast("string"), F.lit(f" {r} 0 0 "), back.cast("string"), F.lit(f" 0 {-r}"))
