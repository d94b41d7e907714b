"""Grade matching: exposure, tone curve, saturation, cast, colour bands and zones that bring images to a reference.

The closed-form steps of a grade as aggregates over percentile curves and tonal zones;
each image is one row and independent of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import colour, vectors

# Percentiles that set exposure, and ranges of the controls.
TAPS, LEAST_LEVEL, MOST_STOPS, RATIOS = tuple(range(2, 19, 2)), 0.02, 3.0, (0.25, 3.0)
RESTRAINED, RESTRAINED_STOPS = 0.62, 1.2


def exposure_stops(reference: Column, own: Column, restrained: bool = False) -> Column:
    """Stops from one percentile curve to another: three times the mean log ratio of levels that aren't black; 0 if all are."""
    pairs = F.array(*[F.struct(F.get(reference, F.lit(i)).alias("r"), F.get(own, F.lit(i)).alias("m")) for i in TAPS])
    seen = F.filter(pairs, lambda p: (p["r"] > LEAST_LEVEL) & (p["m"] > LEAST_LEVEL))
    total = F.aggregate(seen, F.lit(0.0), lambda s, p: s + F.log2(p["r"] / p["m"]))
    stops = F.when(F.size(seen) > 0, 3 * total / F.size(seen)).otherwise(F.lit(0.0)) * (RESTRAINED if restrained else 1.0)
    most = RESTRAINED_STOPS if restrained else MOST_STOPS
    return F.greatest(F.lit(-most), F.least(F.lit(most), stops))


def zone_grade(zones: DataFrame, image: str, reference: int) -> DataFrame:
    """(image, ratio, da, db): chroma ratio and a-b shift to the reference image over the zones that both have.

    zones has image, zone, coverage, a and b. Zones weigh by the reference's coverage; the
    reference's three rows are joined by zone.
    """
    told = zones.where(F.col(image) == reference).select("zone", F.greatest(F.lit(1e-4), F.col("coverage")).alias("w"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    both = zones.where(F.col(image) != reference).join(told, "zone")
    w = F.col("w")
    ratio = F.sum(w * F.hypot("ra", "rb")) / F.nullif(F.sum(w * F.hypot("a", "b")), F.lit(0.0))
    low, high = RATIOS
    sums = both.groupBy(image).agg(ratio.alias("ratio"), *[F.sum(w * F.col(c)).alias(f"s_{c}") for c in ("a", "b", "ra", "rb")], F.sum(w).alias("n"))
    k = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce("ratio", F.lit(1.0))))
    rows = sums.withColumn("ratio", k)
    shift = lambda c: (F.col(f"s_r{c}") - F.col("ratio") * F.col(f"s_{c}")) / F.col("n")
    return rows.select(image, "ratio", shift("a").alias("da"), shift("b").alias("db"))


def blend(identity: Column, restrained: Column, faithful: Column, strength: Column) -> Column:
    """A control at a strength of 0 to 1: nothing, restrained at one half, faithful at one."""
    low = identity + (restrained - identity) * strength * 2
    return F.when(strength <= 0.5, low).otherwise(restrained + (faithful - restrained) * (strength * 2 - 1))


# Percentiles that carry a tone curve, closest points on it and its steepest rise.
CURVE_TAPS, LEAST_GAP, STEEPEST = (1, 3, 6, 10, 14, 17, 19), 14, 3.0
# Share of a band that counts as present, its gains, and limits of a restrained mixer.
PRESENT, LUMINANCE_GAIN, HUE_DEGREES, RESTRAINED_MIX = 0.02, 320, 22, {"sat": 32.0, "lum": 26.0, "hue": 20.0}
# Shift of a full wheel, and the least shift that is set.
WHEEL, LEAST_TINT = 0.06, 0.004
# How far each kind of rendering can be trusted.
FIDELITY = {"export": 1.0, "native": 0.9, "macos": 0.8, "preview": 0.55}


def tone_curve(own: Column, reference: Column) -> Column:
    """Points (x, y) of 0..255 that lead one percentile curve to another; rising, spaced, never steep.

    Percentiles that are missing or too close to the last point or to an end are left out.
    """
    byte = lambda level: colour.half_up(colour.encode(F.pow(level, F.lit(3.0))) * 255, 0)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    taps = F.array(*[at(byte(F.get(own, F.lit(i))), byte(F.get(reference, F.lit(i)))) for i in CURVE_TAPS])

    def step(s: Column, p: Column) -> Column:
        last = F.element_at(s["points"], -1)
        high = F.greatest(s["high"], p["y"])
        y = F.least(high, last["y"] + STEEPEST * (p["x"] - last["x"]))
        fits = (p["x"] > 2) & (p["x"] - last["x"] >= LEAST_GAP) & (p["x"] <= 255 - LEAST_GAP) & p["y"].isNotNull()
        return F.when(fits, F.struct(F.concat(s["points"], F.array(at(p["x"], y))).alias("points"), high.alias("high"))).otherwise(s)

    start = F.struct(F.array(at(F.lit(0), F.lit(0))).alias("points"), F.lit(0.0).alias("high"))
    return F.aggregate(taps, start, step, lambda s: F.concat(s["points"], F.array(at(F.lit(255), F.lit(255)))))


def curve_level(points: Column, x: float) -> Column:
    """The level that a curve of at least two points gives at x, linearly between points."""
    inner = F.slice(points, F.lit(2), F.size(points) - 2)
    i = F.size(F.filter(inner, lambda p: p["x"] < x))
    a, b = F.get(points, i), F.get(points, i + 1)
    share = F.when(b["x"] == a["x"], 0.0).otherwise((F.lit(float(x)) - a["x"]) / (b["x"] - a["x"]))
    return a["y"] + (b["y"] - a["y"]) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def softened(points: Column, pull: float) -> Column:
    """A curve drawn towards the straight line by pull."""
    return F.transform(points, lambda p: F.struct(p["x"].alias("x"), (p["y"] + (p["x"] - p["y"]) * pull).alias("y")))


def curve_words(points: Column) -> dict[str, Column]:
    """What a curve amounts to on five tone sliders."""
    off = lambda x: (curve_level(points, x) - x) / 2.55 * 1.6
    slope = (curve_level(points, 180) - curve_level(points, 76)) / (180 - 76)
    sliders = {"contrast": (slope - 1) * 100, "highlights": off(200), "shadows": off(56), "whites": off(240), "blacks": off(16)}
    return {name: colour.half_up(v, 0) for name, v in sliders.items()}


def mixer(bands: DataFrame, image: str, reference: int, restrained: bool = False) -> DataFrame:
    """(image, band, sat, lum, hue): the mixer's move of each colour band to the reference image's.

    bands has image, band, share, chroma, L and hue. A band that the reference hardly has is
    drained, the more the wider it is; one that the image hardly has is left alone. The
    reference's few rows are joined by band.
    """
    damp = RESTRAINED if restrained else 1.0
    most = RESTRAINED_MIX if restrained else dict.fromkeys(RESTRAINED_MIX, 100.0)
    told = bands.where(F.col(image) == reference).select("band", F.col("share").alias("rs"), F.col("chroma").alias("rc"), F.col("L").alias("rl"), F.col("hue").alias("rh"))
    both = bands.where((F.col(image) != reference) & (F.col("share") >= PRESENT)).join(told, "band", "left")
    known = F.coalesce(F.col("rs") >= PRESENT, F.lit(False))
    ratio = F.when(F.col("chroma") > 1e-5, F.col("rc") / F.col("chroma")).otherwise(1.0)
    gone = -60 * F.least(F.lit(1.0), F.col("share") / 0.25)
    moves = {
        "sat": F.when(known, (ratio - 1) * 100).otherwise(gone),
        "lum": F.when(known, (F.col("rl") - F.col("L")) * LUMINANCE_GAIN).otherwise(0.0),
        "hue": F.when(known, colour.signed_delta(F.col("rh"), F.col("hue")) / HUE_DEGREES * 100).otherwise(0.0),
    }
    limited = {n: F.greatest(F.lit(-most[n]), F.least(F.lit(most[n]), v * damp)) for n, v in moves.items()}
    return both.select(image, "band", *[v.alias(n) for n, v in limited.items()])


def zone_tints(zones: DataFrame, image: str, reference: int) -> DataFrame:
    """(image, zone, da, db, sat): the shift of each tonal zone to the reference's, as far as a full wheel reaches.

    zones has image, zone, a and b; shifts too small to see are 0.
    """
    told = zones.where(F.col(image) == reference).select("zone", F.col("a").alias("ra"), F.col("b").alias("rb"))
    both = zones.where(F.col(image) != reference).join(told, "zone").withColumns({"da": F.col("ra") - F.col("a"), "db": F.col("rb") - F.col("b")})
    both = both.withColumn("far", F.hypot("da", "db")).withColumn("sat", F.when(F.col("far") < LEAST_TINT, 0.0).otherwise(F.least(F.lit(100.0), F.col("far") / WHEEL * 100)))
    reach = F.when(F.col("far") > 0, F.col("sat") / 100 * WHEEL / F.col("far")).otherwise(0.0)
    scaled = F.least(F.lit(1.0), reach)
    return both.select(image, "zone", (F.col("da") * scaled).alias("da"), (F.col("db") * scaled).alias("db"), "sat")


def reachability(L: Column, a: Column, b: Column, to_L: Column, to_a: Column, to_b: Column) -> Column:
    """1 where a grade has closed the gap to the reference, 0 where it is plain to see; unknown means count as 0."""
    gap = F.abs(to_L - L) / 0.1 + F.hypot(to_a - a, to_b - b) / 0.06
    return F.coalesce(_unit(1 - gap / 2), F.lit(0.0))


def confidence(reference: Column, own: Column, shared: Column, textures: Column) -> Column:
    """Trust in a match from both kinds of rendering, the number of shared regions and whether textures compare."""
    of = lambda kind: F.element_at(F.create_map(*[F.lit(x) for kv in FIDELITY.items() for x in kv]), kind)
    cover = F.least(F.lit(1.0), shared / 6)
    return _unit(F.least(of(reference), of(own)) * (0.65 + 0.35 * cover) * F.when(textures, 1.0).otherwise(0.9))


def extremes(controls: list[tuple[str, Column, float]]) -> Column:
    """Names of the controls that stand at or beyond their limit on either side, in the order given."""
    return F.array_compact(F.array(*[F.when(F.abs(v) >= limit, F.lit(name)) for name, v, limit in controls]))


def _unit(x: Column) -> Column:
    """x within 0 and 1; null stays null."""
    return F.when(x < 0, 0.0).when(x > 1, 1.0).otherwise(x)


# The range of every control, and of a mask's.
RANGES = {
    "exposure": (-5, 5), "contrast": (-100, 100), "highlights": (-100, 100), "shadows": (-100, 100), "whites": (-100, 100), "blacks": (-100, 100), "temp": (-100, 100), "tint": (-100, 100), "vibrance": (-100, 100), "saturation": (-100, 100),
    "texture": (-100, 100), "clarity": (-100, 100), "dehaze": (-100, 100), "vignette": (-100, 100), "grain": (0, 100), "grain_size": (0, 100), "roughness": (0, 100), "sharpen": (0, 150), "sharpen_radius": (0.5, 3), "sharpen_detail": (0, 100),
    "noise": (0, 100), "colour_noise": (0, 100), "blending": (0, 100), "balance": (-100, 100),
}
# Controls of a record that changes nothing, where that isn't 0.
NEUTRAL = {"grain_size": 25.0, "roughness": 50.0, "sharpen_radius": 1.0, "sharpen_detail": 25.0, "blending": 50.0}
MASK_RANGES = {"exposure": (-4, 4), "temp": (-100, 100), "tint": (-100, 100), "saturation": (-100, 100), "contrast": (-100, 100)}
# What a full control does, as shipped.
CALIBRATION = {"saturation": 1.0, "vibrance": 1.6, "wheel": 0.06, "band_saturation": 1.0, "band_luminance": 320.0, "band_hue": 22.0, "grain": 0.055, "local_temp": 0.05, "local_tint": 0.045, "local_saturation": 1.0}


def neutral() -> Column:
    """The record of controls that changes nothing."""
    return F.struct(*[F.lit(float(NEUTRAL.get(k, 0.0))).alias(k) for k in RANGES])


def _named(value: Column, use) -> Column:
    """What use makes of a value that is named once, so that a record isn't written out for each of its fields."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def within_ranges(record: Column, ranges: dict[str, tuple[float, float]] | None = None) -> Column:
    """A record with every control inside its range; what isn't finite is 0 before that. An importer would drop others silently."""
    return _named(record, lambda r: F.struct(*[vectors.clamp(r[k], float(a), float(b)).alias(k) for k, (a, b) in (ranges or RANGES).items()]))


def at_strength(restrained: Column, faithful: Column, strength: Column) -> Column:
    """The record at a strength of 0 to 1: neutral, restrained at one half, faithful at one; beyond, the ends."""
    both = F.struct(restrained.alias("r"), faithful.alias("f"), vectors.clamp(strength, 0.0, 1.0).alias("t"))
    mixed = _named(both, lambda v: F.struct(*[blend(F.lit(float(NEUTRAL.get(k, 0.0))), v["r"][k], v["f"][k], v["t"]).alias(k) for k in RANGES]))
    return within_ranges(mixed)


def blended_masks(a: DataFrame, b: DataFrame, t: Column) -> DataFrame:
    """(key, region, controls) of both sides' masks at t: a mask of one side alone fades from or to neutral."""
    side = lambda df, p: df.select("id", "region", *[F.col(c).alias(f"{p}{c}") for c in MASK_RANGES])
    both = side(a, "a_").join(side(b, "b_"), ["id", "region"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    made = both.select("id", "region", *[(zero(f"a_{c}") + (zero(f"b_{c}") - zero(f"a_{c}")) * t).alias(c) for c in MASK_RANGES])
    return made.select("id", "region", *[vectors.clamp(F.col(c), float(lo), float(hi)).alias(c) for c, (lo, hi) in MASK_RANGES.items()])


def render_values(record: Column, masks: Column) -> Column:
    """What a renderer needs of a record: linear chroma scale, grain and texture, and four mask channels, an array of (exposure, temp, tint, saturation), short ones filled with nothing."""
    c = CALIBRATION
    part = lambda f: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: f(F.get(masks, i)))
    zero = lambda m, k: F.coalesce(m[k], F.lit(0.0))
    scale = 1 + record["saturation"] / (100 * c["saturation"]) + record["vibrance"] / (100 * c["vibrance"])
    return F.struct(
        record["exposure"].alias("exposure"), F.greatest(F.lit(0.0), scale).alias("chroma"), (record["grain"] / 100 * c["grain"]).alias("grain"), (record["texture"] / 100).alias("texture"),
        part(lambda m: zero(m, "exposure")).alias("mask_exposure"), part(lambda m: zero(m, "tint") / 100 * c["local_tint"]).alias("mask_a"), part(lambda m: zero(m, "temp") / 100 * c["local_temp"]).alias("mask_b"),
        part(lambda m: F.greatest(F.lit(0.0), 1 + zero(m, "saturation") / (100 * c["local_saturation"]))).alias("mask_chroma"),
    )


def render_bands(hue: Column, saturation: Column, luminance: Column) -> Column:
    """A colour band's sliders as degrees, a chroma factor and a change of lightness."""
    c = CALIBRATION
    return F.struct((hue / 100 * c["band_hue"]).alias("degrees"), F.greatest(F.lit(0.0), 1 + saturation / (100 * c["band_saturation"])).alias("chroma"), (luminance / c["band_luminance"]).alias("lightness"))
