"""How light, sky, ground and buildings look at an altitude of the sun: ramps between fixed stops."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (altitude, colour) and (altitude, value) stops, and the ends of building ramps by theme.
LIGHT = ((-18, (18, 22, 40)), (-6, (40, 58, 105)), (-4, (92, 106, 158)), (0, (214, 122, 62)), (6, (240, 176, 104)), (20, (252, 226, 186)), (60, (255, 248, 236)))
AMBIENT = ((-18, (10, 11, 16)), (-6, (22, 28, 48)), (0, (46, 54, 76)), (15, (78, 88, 104)), (60, (104, 112, 124)))
SKY = ((-18, (6, 7, 11)), (-12, (10, 14, 28)), (-6, (24, 36, 70)), (-2, (66, 74, 116)), (2, (150, 108, 88)), (10, (96, 118, 150)), (40, (70, 100, 140)))
SHADOW = ((0, (14, 18, 32)), (10, (20, 26, 44)), (45, (28, 34, 52)))
WASH = (
    (-18, (4, 8, 22)), (-8, (10, 18, 44)), (-4, (26, 32, 68)), (-1, (86, 62, 92)), (1, (214, 118, 54)), (4, (232, 152, 70)), (10, (244, 200, 132)), (25, (252, 236, 206)), (55, (255, 250, 240)),
)
WASH_OPACITY = ((-18, 0.5), (-8, 0.46), (-4, 0.38), (-1, 0.3), (1, 0.26), (4, 0.22), (10, 0.14), (25, 0.07), (55, 0.03))
BUILDING_HEIGHTS = (0, 8, 18, 40, 90, 200)
BUILDING_ENDS = {
    "dark": (((20, 22, 28), (43, 49, 60)), ((46, 50, 58), (98, 107, 121))),
    "light": (((44, 49, 64), (84, 93, 115)), ((191, 184, 172), (244, 239, 230))),
}


def ramp(stops, altitude: Column, channel: int | None = None) -> Column:
    """The value at an altitude, straight between stops and level beyond them."""
    value = lambda s: float(s[1] if channel is None else s[1][channel])
    out = F.lit(value(stops[-1]))
    for a, b in reversed(list(zip(stops, stops[1:], strict=False))):
        part = value(a) + (value(b) - value(a)) * ((altitude - a[0]) / float(b[0] - a[0]))
        out = F.when(altitude <= b[0], part).otherwise(out)
    return F.when(altitude <= stops[0][0], value(stops[0])).otherwise(out)


def clamp01(x: Column) -> Column:
    """x within 0 and 1; named once, so that nested uses don't multiply the expression. A null becomes 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _once(value: Column, use) -> Column:
    """What use makes of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hex_of(r: Column, g: Column, b: Column) -> Column:
    """Channels from 0 to 255 as a hex colour, rounded half up."""
    byte = lambda v: F.lower(F.lpad(F.hex(F.floor(v + 0.5).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), byte(r), byte(g), byte(b))


def colour_at(stops, altitude: Column) -> Column:
    """The ramp's colour as hex."""
    return hex_of(*(ramp(stops, altitude, c) for c in range(3)))


def sunlight_strength(altitude: Column) -> Column:
    """How strong direct light is; none below the horizon."""
    return F.when(altitude <= 0, 0.0).otherwise(clamp01(F.sin(F.least(altitude, F.lit(60.0)) / 60 * (math.pi / 2)) * 0.62 + 0.06))


def shadow_opacity(altitude: Column) -> Column:
    return F.when(altitude > 0, 0.24 + 0.22 * clamp01(altitude / 18)).otherwise(0.0)


def directional_strength(altitude: Column) -> Column:
    """How directional light is: most for a low sun."""
    return F.when(altitude <= 0, 0.08).otherwise(0.42 + 0.36 * clamp01(1 - altitude / 25))


def extrusion_light(altitude: Column) -> Column:
    """The light's hue at full brightness, two fifths of the way to white."""
    raw = F.struct(*[ramp(LIGHT, altitude, c).alias(f"c{c}") for c in range(3)])
    full = _once(raw, lambda v: F.transform(F.array(v["c0"], v["c1"], v["c2"]), lambda c: c * 255 / F.greatest(v["c0"], v["c1"], v["c2"], F.lit(1.0))))
    return _once(full, lambda v: hex_of(*(v[i] + (255 - v[i]) * 0.4 for i in range(3))))


def building_colours(altitude: Column, theme: str) -> Column:
    """Array of (height, colour): low and tall buildings between night and day."""
    (night_low, night_tall), (day_low, day_tall) = BUILDING_ENDS[theme]
    span = math.log10(1 + 200 / 8)

    def stop(height: int, t: Column) -> Column:
        up = min(1.0, max(0.0, math.log10(1 + height / 8) / span))
        part = lambda c: (night_low[c] + (day_low[c] - night_low[c]) * t) * (1 - up) + (night_tall[c] + (day_tall[c] - night_tall[c]) * t) * up
        return F.struct(F.lit(height).alias("height"), hex_of(part(0), part(1), part(2)).alias("colour"))

    return _once(clamp01((altitude + 6) / 12), lambda t: F.array(*[stop(h, t) for h in BUILDING_HEIGHTS]))


def light_position(azimuth: Column, altitude: Column) -> Column:
    """(radial, azimuthal, polar) of a light that stands where the sun stands."""
    polar = 90 - altitude
    return F.struct(F.lit(1.4).alias("radial"), F.pmod(azimuth, F.lit(360.0)).alias("azimuthal"), F.when(polar < 0, 0.0).when(polar > 180, 180.0).otherwise(polar).alias("polar"))
