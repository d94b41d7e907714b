"""Labels and short sentences as column functions; a null input gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .colour import half_up
from .text import clock

# What the classes 1 to 8 of a seeing forecast stand for.
SEEING = ("<0.5″", "0.5″–0.75″", "0.75″–1″", "1″–1.25″", "1.25″–1.5″", "1.5″–2″", "2″–2.5″", ">2.5″")
TRANSPARENCY = ("<0.3", "0.3–0.4", "0.4–0.5", "0.5–0.6", "0.6–0.7", "0.7–0.85", "0.85–1", ">1")
# Sensors with their width and height in mm.
SENSORS = {
    "ff": ("Full frame (35mm)", 35.9, 24.0),
    "apsc": ("APS-C / crop mode", 23.5, 15.6),
    "mft": ("Micro Four Thirds", 17.3, 13.0),
    "medium": ("Medium format (44×33)", 43.8, 32.9),
    "phone": ('Phone main camera (1/1.28")', 9.8, 7.3),
}


def whole(x: Column) -> Column:
    """The nearest whole number, halves upward, as text."""
    return F.floor(x + 0.5).cast("bigint").cast("string")


def fixed(x: Column, digits: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", half_up(x, digits)))


def duration(minutes: Column) -> Column:
    """24 m, 2 h or 2 h 5 m; below nothing is 0 m."""
    total = F.greatest(F.floor(minutes + 0.5), F.lit(0)).cast("bigint")
    rest = (total % 60).cast("string")
    hours = F.concat(F.floor(total / 60).cast("string"), F.lit(" h"))
    text = F.when(total < 60, F.concat(rest, F.lit(" m"))).when(total % 60 == 0, hours).otherwise(F.concat(hours, F.lit(" "), rest, F.lit(" m")))
    return F.when(minutes.isNotNull(), text)


def shadow_ratio(altitude: Column) -> Column:
    """Metres of shadow for a metre of height; a sun that isn't up, or unknown, has a dash."""
    ratio = 1 / F.tan(F.radians(altitude))
    written = F.when(ratio > 99, "99+").when(ratio < 10, fixed(ratio, 2)).otherwise(fixed(ratio, 1))
    return F.when(altitude > 0, F.concat(F.lit("1 : "), written)).otherwise("—")


def column_label(minute: Column) -> Column:
    """Clock time of a minute of the day; later days start anew."""
    return clock(minute % 1440)


def sensor(key: Column, part: int) -> Column:
    """Label (0), width (1) or height (2) of a sensor; unknown keys give null."""
    pairs = [F.lit(x) for k, v in SENSORS.items() for x in (k, v[part])]
    return F.try_element_at(F.create_map(*pairs), key)


def lens_label(key: Column, focal: Column, equivalent: Column, across: Column, upward: Column) -> Column:
    """Focal length, what it equals on full frame unless it is one, and the angles of view."""
    mm = F.concat(focal.cast("string"), F.lit("mm"))
    head = F.when(key == "ff", mm).otherwise(F.concat(mm, F.lit(" ("), whole(equivalent), F.lit("mm equiv.)")))
    return F.concat(head, F.lit(" · "), whole(across), F.lit("° × "), whole(upward), F.lit("°"))


def frame_label(focal: Column, portrait: Column, bearing: Column, tilt: Column) -> Column:
    """Focal length, orientation if upright, bearing, and tilt unless level."""
    t = F.floor(tilt + 0.5)
    lean = F.when(t != 0, F.concat(F.when(t > 0, "+").otherwise(""), t.cast("bigint").cast("string"), F.lit("° tilt")))
    return F.concat_ws(" · ", F.concat(whole(focal), F.lit(" mm")), F.when(portrait, "portrait"), F.concat(whole(bearing), F.lit("°")), lean)


def light_label(direct: Column, kelvin: Column, stops: Column) -> Column:
    """Colour temperature to 50 K and how hard the light is; without direct sun, or unknown, a note of that."""
    hard = F.when(stops >= 4.5, "hard").when(stops >= 3, "firm").when(stops >= 1.8, "soft").otherwise("flat")
    text = F.concat((F.floor(kelvin / 50 + 0.5) * 50).cast("bigint").cast("string"), F.lit(" K · "), hard, F.lit(", "), fixed(stops, 1), F.lit(" stops key to fill"))
    return F.when(direct > 50, text).otherwise("No direct sun — everything here is skylight.")


def seeing_label(seeing: Column, transparency: Column) -> Column:
    """Both bands of a seeing forecast; classes that don't exist are empty."""
    band = lambda names, v, unit: F.coalesce(F.concat(F.get(F.array(*map(F.lit, names)), v.cast("int") - 1), F.lit(unit)), F.lit(""))
    return F.concat(band(SEEING, seeing, " seeing"), F.lit(", "), band(TRANSPARENCY, transparency, " mag/airmass transparency"), F.lit(" (7Timer, ~10 km grid)."))


def visit_date(at: Column) -> Column:
    """Day, short month and year of a timestamp in the session's zone."""
    return F.date_format(at, "d MMM yyyy")


def sun_windows(windows: Column) -> Column:
    """One sentence about a day's sunlit windows, an ordered array of (start, end) minutes."""
    span = lambda w: F.concat(clock(w["start"]), F.lit("–"), clock(w["end"]))
    total = duration(F.aggregate(windows, F.lit(0).cast("bigint"), lambda s, w: s + (w["end"] - w["start"]).cast("bigint")))
    n, last = F.size(windows), F.element_at(windows, -1)
    listed = F.array_join(F.transform(F.slice(windows, 1, F.greatest(n - 1, F.lit(0))), span), ", ")
    joined = F.when(n == 1, span(last)).otherwise(F.concat(listed, F.lit(" and "), span(last)))
    many = F.concat(F.lit("Sun in "), n.cast("string"), F.lit(" spells, "), total, F.lit(" in all — first "), clock(F.get(windows, F.lit(0))["start"]), F.lit(", last ends "), clock(last["end"]), F.lit("."))
    return F.when(windows.isNull() | (n <= 0), "No direct sun here today.").when(n > 3, many).otherwise(F.concat(F.lit("Direct sun "), joined, F.lit(" · "), total, F.lit(" in all.")))


def change_label(lit: Column, at: Column, ahead: Column) -> Column:
    """The next change of light and how many minutes ahead it is; empty if there is none ahead."""
    text = F.concat(F.when(lit, "Lit").otherwise("In shadow"), F.lit(" in "), duration(ahead), F.lit(", at "), clock(at), F.lit("."))
    return F.coalesce(F.when(ahead > 0, text), F.lit(""))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """A number with its noun."""
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))
