"""Perceptual colour as Column expressions: sRGB, OKLab, OKLCH, hue arithmetic, chapters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The OKLab matrices, hue anchors, thresholds and bands.
TO_CONE = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
ANCHORS = (("red", 28), ("orange", 62), ("yellow", 100), ("green", 145), ("teal", 195), ("blue", 255), ("violet", 305), ("magenta", 350))
ACHROMATIC, ACHROMATIC_CHROMA = "achromatic", 0.035
DEEP_BELOW, PALE_FROM = 0.45, 0.72


def circular_distance(a: Column, b: Column) -> Column:
    """Degrees between two hues, 0 to 180."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.when(d > 180, 360 - d).otherwise(d)


def signed_delta(a: Column, b: Column) -> Column:
    """Degrees from b to a, above -180 and up to 180."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def signed_delta_low(a: Column, b: Column) -> Column:
    """Degrees from b to a, from -180 and below 180."""
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


def decode(byte: Column) -> Column:
    """An sRGB byte as linear light."""
    x = byte / F.lit(255.0)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def encode(light: Column) -> Column:
    """Linear light, clamped to 0..1, as an sRGB value of 0..1."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), light))
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def oklab(r: Column, g: Column, b: Column) -> Column:
    """Struct (L, a, b) of linear red, green and blue."""
    cone = [F.cbrt(m[0] * r + m[1] * g + m[2] * b) for m in TO_CONE]
    return F.struct(*[sum((k * c for k, c in zip(m[1:], cone[1:], strict=True)), m[0] * cone[0]).alias(n) for n, m in zip("Lab", TO_LAB, strict=True)])


def _inverse(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return tuple(tuple(x / det for x in row) for row in ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d)))


def linear_rgb(L: Column, a: Column, b: Column) -> Column:
    """Struct (r, g, b) of linear light for an OKLab colour, by the inverse matrices."""
    back, out = _inverse(TO_LAB), _inverse(TO_CONE)
    cone = [F.pow(m[0] * L + m[1] * a + m[2] * b, F.lit(3.0)) for m in back]
    return F.struct(*[(m[0] * cone[0] + m[1] * cone[1] + m[2] * cone[2]).alias(n) for n, m in zip("rgb", out, strict=True)])


def hue(a: Column, b: Column) -> Column:
    """Hue of a direction, 0 up to 360."""
    h = F.atan2(b, a) * 180 / math.pi
    return F.when(h < 0, h + 360).otherwise(h)


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def oklch(r: Column, g: Column, b: Column) -> Column:
    """Struct (L, a, b, C, H) of sRGB bytes."""
    lab = oklab(decode(r), decode(g), decode(b))
    return F.struct(lab["L"].alias("L"), lab["a"].alias("a"), lab["b"].alias("b"), chroma(lab["a"], lab["b"]).alias("C"), hue(lab["a"], lab["b"]).alias("H"))


def half_up(x: Column, digits: int) -> Column:
    """Rounded with halves upward."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def nearest_name(h: Column, names: tuple[tuple[str, int], ...]) -> Column:
    """Name of the nearest of several hues, listed in rising order, to h, 0 up to 360; of equally near ones the first listed.

    Neighbours meet half-way, so this is a chain of comparisons in generated code.
    """
    (first, low), (last, high) = names[0], names[-1]
    seam = (low + high + 360) / 2 % 360  # between the last hue and the first, which wins a tie
    out = F.when(h < seam, last) if seam <= low else F.when(h >= seam, first)
    for (name, at), (_, then) in zip(names, names[1:], strict=False):
        out = out.when(h <= (at + then) / 2, name)
    return out.otherwise(last)


def nearest_anchor(h: Column) -> Column:
    """Slug of the nearest hue anchor."""
    return nearest_name(h, ANCHORS)


def classify(c: Column, h: Column) -> Column:
    return F.when(c < ACHROMATIC_CHROMA, F.lit(ACHROMATIC)).otherwise(nearest_anchor(h))


def lightness_band(L: Column) -> Column:
    return F.when(L < DEEP_BELOW, "deep").when(L >= PALE_FROM, "pale").otherwise("mid")


def chapter_key(base: Column, band: Column) -> Column:
    return F.when(band == "mid", base).otherwise(F.concat_ws("-", base, band))


def base_of(key: Column) -> Column:
    return F.regexp_replace(key, "-(deep|pale)$", "")


def band_of(key: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(key, "-(deep|pale)$", 1), F.lit("")), F.lit("mid"))


def chapter_rank(key: Column) -> Column:
    """Place on the wheel: achromatic first, then by hue, dark before light; unknown hues before red."""
    at = F.create_map(*[F.lit(x) for slug, h in ((ACHROMATIC, -1000), *ANCHORS) for x in (slug, h)])
    band = F.when(band_of(key) == "deep", 0).when(band_of(key) == "mid", 1).otherwise(2)
    return F.coalesce(F.try_element_at(at, base_of(key)), F.lit(-1)) * 10 + band


def chapter_name(key: Column, base_name: Column | None = None) -> Column:
    """The name of a chapter; base_name, where not null, stands for a hue's own name."""
    plain = F.initcap(base_of(key)) if base_name is None else F.coalesce(base_name, F.initcap(base_of(key)))
    grey = F.when(band_of(key) == "deep", "Charcoal").when(band_of(key) == "pale", "Silver").otherwise("Ash")
    hued = F.when(band_of(key) == "mid", plain).otherwise(F.concat_ws(" ", F.initcap(band_of(key)), plain))
    return F.when(base_of(key) == ACHROMATIC, grey).otherwise(hued)


def css(L: Column, c: Column, h: Column) -> Column:
    return F.format_string("oklch(%.3f %.3f %.1f)", L, c, h)


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))
    return t * t * (3 - 2 * t)


def lit_weight(L: Column) -> Column:
    """How far a lightness is from black and from white, 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(smoothstep(0.06, 0.26, L), 1 - smoothstep(0.85, 0.97, L)))


def zone_weights(L: Column) -> Column:
    """Array of (zone, weight) whose weights sum to 1."""
    shadow = F.greatest(F.lit(0.0), 1 - L / 0.5)
    light = F.greatest(F.lit(0.0), (L - 0.5) / 0.5)
    middle = F.greatest(F.lit(0.0), 1 - F.abs(L - 0.5) / 0.5)
    total = shadow + middle + light
    pairs = (("shadow", shadow), ("midtone", middle), ("highlight", light))
    return F.array(*[F.struct(F.lit(f"zone.{n}").alias("zone"), (w / total).alias("w")) for n, w in pairs])


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast_ratio(y1: Column, y2: Column) -> Column:
    """WCAG contrast of two relative luminances."""
    return (F.greatest(y1, y2) + 0.05) / (F.least(y1, y2) + 0.05)


def hex_luminance(text: Column) -> Column:
    """Relative luminance of a colour as #rrggbb, with the knee of the contrast rule."""
    def linear(i: int) -> Column:
        c = F.conv(F.substring(F.replace(text, F.lit("#"), F.lit("")), i, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(1) + 0.7152 * linear(3) + 0.0722 * linear(5)


def contrast_of(a: Column, b: Column) -> Column:
    """WCAG contrast of two hex colours."""
    return contrast_ratio(hex_luminance(a), hex_luminance(b))


def wheel_hue(da: Column, db: Column) -> Column:
    """The hue, red at 0 and green at 120, of a colour of middle chroma in a direction of the a-b plane; 0 without a direction."""
    size = F.hypot(da, db)
    scale = 0.12 / F.when(size < 1e-9, F.lit(1.0)).otherwise(size)
    rgb = F.transform(F.array(linear_rgb(F.lit(0.62), da * scale, db * scale)), lambda c: F.struct(*[encode(c[n]).alias(n) for n in "rgb"]))

    def hue_of(c: Column) -> Column:
        top = F.greatest(c["r"], c["g"], c["b"])
        d = top - F.least(c["r"], c["g"], c["b"])
        safe = F.when(d < 1e-9, F.lit(1.0)).otherwise(d)
        sixth = F.when(top == c["r"], (c["g"] - c["b"]) / safe).when(top == c["g"], (c["b"] - c["r"]) / safe + 2).otherwise((c["r"] - c["g"]) / safe + 4)
        return F.when(d < 1e-9, 0.0).otherwise(F.pmod(sixth * 60, F.lit(360.0)))

    return F.when(size < 1e-9, 0.0).otherwise(F.get(F.transform(rgb, hue_of), F.lit(0)))


def ramp(x: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear through (x, y) stops in rising order, constant beyond the ends."""
    out = F.when(x <= stops[0][0], F.lit(float(stops[0][1])))
    for (x0, y0), (x1, y1) in zip(stops, stops[1:], strict=False):
        out = out.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return out.otherwise(F.lit(float(stops[-1][1])))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of light of any scale: normalised by its peak, then encoded."""
    peak = F.greatest(r, g, b)
    byte = lambda x: F.lpad(F.lower(F.hex(F.floor(encode(F.when(peak > 0, x / peak).otherwise(0.0)) * 255 + 0.5).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), byte(r), byte(g), byte(b))
