"""The whole grade as one chain: each step moves a predicted state, and the next works on what is left.

An image is one row with its tone curve, its regions and its colour bands; the reference's
stand beside them. A step is a column expression over the state before it. Controls reach
only as far as they go, and the state moves by what they deliver, so what remains at the
end is what no control can close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import colour

from . import grade, measure, pixels, texture

# Limits of a restrained grade, as factors of chroma and shares of the image's own chroma.
CHROMA_UP, CHROMA_DOWN, CAST_SHARE, ZONE_SHARE, CURVE_PULL, SKIN_DAMP = 0.3, -0.25, 0.4, 0.25, 0.5, 0.35
# Weakest hue, least casts and masks that are set, most of a mask's exposure, reach of a band's hue.
HUE_STRENGTH, LEAST_CAST, LEAST_OWN_CHROMA, BAND_REACH = 0.3, 0.002, 0.012, 55.0
MASK_LEAST = {"exposure": 0.12, "colour": 0.012, "saturation": 6.0}
MASK_EXPOSURE = {False: 1.0, True: 0.5}
MASKS = {
    "scene.sky": "sky", "subject": "subject", "background": "background", "people.skin": "manual", "people.hair": "manual", "people.clothing": "manual", "scene.foliage": "manual", "scene.water": "manual", "scene.built": "manual", "scene.ground": "manual",
}
ZONES = measure.ZONES
TEMP, TINT, VIGNETTE_STOPS, GRAIN, TEXTURE, NOISE = 0.055, 0.05, 2.2, 0.055, 0.5, 0.45


def analysed(rows: DataFrame, image: str, regions: str | None = None, covered: DataFrame | None = None) -> DataFrame:
    """(id, curve, regions, bands) of pixels with L, a, b_, C and H: all that a grade is solved from, in one scan.

    regions has key, coverage, L, C, a, b and strength of the whole image, its three tonal
    zones and the masks that the column regions names; covered (id, region, coverage) tells
    how much of the image a mask holds. bands has share, chroma, L and hue of eight hues in order.
    """
    return measure.analysed(measure.sums(rows.withColumnRenamed(image, "id"), ["id"], regions), ["id"], covered)


def pairs(analyses: DataFrame, reference: int) -> DataFrame:
    """Every other image's row with the reference's, prefixed by r_."""
    told = analyses.where(F.col("id") == reference).limit(1).select(*[F.col(c).alias(f"r_{c}") for c in analyses.columns])
    return analyses.where(F.col("id") != reference).join(F.broadcast(told))  # one row


def _of(regions: Column, key: str) -> Column:
    return F.get(F.filter(regions, lambda r: r["key"] == key), F.lit(0))


def _limit(x: Column, most: float) -> Column:
    """x within most on both sides; what is unknown is 0."""
    fine = F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)
    return F.greatest(F.lit(-most), F.least(F.lit(most), fine))


def _moved(regions: Column, **fields) -> Column:
    """regions with fields (functions of a region) changed, and chroma as the length of a and b unless it is among them."""
    names = ("key", "coverage", "L", "C", "a", "b", "strength")
    return F.transform(regions, lambda r: F.struct(*[(fields[n](r) if n in fields else r[n]).alias(n) for n in names]))


def _level(points: Column, L: Column) -> Column:
    """A lightness as a curve of 0..255 leaves it."""
    x = colour.encode(F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), L)), F.lit(3.0))) * 255
    inner = F.slice(points, F.lit(2), F.size(points) - 2)
    i = F.size(F.filter(inner, lambda p: p["x"] < x))
    a, b = F.get(points, i), F.get(points, i + 1)
    share = F.when(b["x"] == a["x"], 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a["x"]) / (b["x"] - a["x"]))))
    return F.cbrt(F.greatest(F.lit(0.0), colour.decode(a["y"] + (b["y"] - a["y"]) * share)))


def solved(rows: DataFrame, restrained: bool, shared_x: str | None = None) -> DataFrame:
    """rows of pairs() with controls (a struct), masks, curve points, and what is left: reachability and residual.

    shared_x names a curve whose places along x this one takes, so that both can be blended.
    """
    damp = grade.RESTRAINED if restrained else 1.0
    keep = rows.columns
    c = F.col
    # exposure
    rows = rows.withColumn("exposure", grade.exposure_stops(c("r_curve"), c("curve"), restrained)).withColumn("k", F.pow(F.lit(2.0), c("exposure") / 3))
    scaled = lambda x: F.least(F.lit(1.0), x * c("k"))
    rows = rows.withColumns({"st": _moved(c("regions"), L=lambda r: scaled(r["L"])), "pc": F.transform("curve", scaled), "bd": F.transform("bands", lambda b: b.withField("L", scaled(b["L"])))})
    # tone curve
    points = grade.tone_curve(c("pc"), c("r_curve"))
    rows = rows.withColumn("points", grade.softened(points, CURVE_PULL) if restrained else points)
    if shared_x:
        rows = rows.withColumn("points", F.transform(shared_x, lambda p, i: F.struct(p["x"].alias("x"), F.coalesce(F.get(c("points"), i)["y"], p["x"]).alias("y"))))
    rows = rows.withColumns({"st": _moved(c("st"), L=lambda r: _level(c("points"), r["L"])), "bd": F.transform("bd", lambda b: b.withField("L", _level(c("points"), b["L"])))})
    # saturation: a factor fitted on the lengths of the zones' colours, the reference's coverage as weight
    zones = F.filter(F.transform(F.array(*map(F.lit, ZONES)), lambda k: F.struct(F.get(F.filter("st", lambda r: r["key"] == k), F.lit(0)).alias("m"), F.get(F.filter("r_regions", lambda r: r["key"] == k), F.lit(0)).alias("r"))), lambda p: p["m"].isNotNull() & p["r"].isNotNull())
    rows = rows.withColumns({"zones": zones, "g": _of(c("st"), "global"), "rg": _of(c("r_regions"), "global"), "og": _of(c("regions"), "global")})
    total = lambda f: F.aggregate("zones", F.lit(0.0), lambda s, p: s + F.greatest(F.lit(1e-4), p["r"]["coverage"]) * f(p))
    plain = F.when(c("g.C") > 1e-5, c("rg.C") / c("g.C")).otherwise(1.0)
    length = total(lambda p: F.hypot(p["m"]["a"], p["m"]["b"]))
    ratio = F.when((F.size("zones") >= 2) & (length > 1e-9), total(lambda p: F.hypot(p["r"]["a"], p["r"]["b"])) / length).otherwise(plain)
    rows = rows.withColumn("ratio", F.greatest(F.lit(grade.RATIOS[0]), F.least(F.lit(grade.RATIOS[1]), ratio)))
    wanted = (c("ratio") - 1) * damp
    if restrained:
        wanted = F.greatest(F.lit(CHROMA_DOWN), F.least(F.lit(CHROMA_UP), wanted))
    gain = grade.CALIBRATION
    rows = rows.withColumns({
        "saturation": _limit(wanted * 100 * gain["saturation"] * (0.3 if restrained else 1.0), 100.0),
        "vibrance": _limit(wanted * 100 * 0.7 * gain["vibrance"], 100.0) if restrained else F.lit(0.0),
    })
    rows = rows.withColumn("applied", 1 + c("saturation") / (100 * gain["saturation"]) + c("vibrance") / (100 * gain["vibrance"]))
    by = lambda f: lambda r: r[f] * c("applied")
    # cast: the shift that the zones have in common, taken before the factor moves them
    n = total(lambda p: F.lit(1.0))
    shift = lambda f: F.when(F.size("zones") >= 2, total(lambda p: p["r"][f] - c("applied") * p["m"][f]) / n).otherwise(c(f"rg.{f}") - c(f"g.{f}") * c("applied")) * damp
    rows = rows.withColumns({"da": shift("a"), "db": shift("b")})
    rows = rows.withColumns({"st": _moved(c("st"), C=by("C"), a=by("a"), b=by("b")), "bd": F.transform("bd", lambda b: b.withField("chroma", b["chroma"] * c("applied"))), "own": F.greatest(F.lit(LEAST_OWN_CHROMA), c("og.C"))})
    rows = rows.withColumn("cast", F.hypot("da", "db"))
    if restrained:
        cap = F.when(c("cast") > c("own") * CAST_SHARE, c("own") * CAST_SHARE / c("cast")).otherwise(1.0)
        rows = rows.withColumn("cap", cap).withColumns({"da": c("da") * c("cap"), "db": c("db") * c("cap"), "cast": c("cast") * c("cap")})
    rows = rows.withColumn("global_sat", F.when(c("cast") > LEAST_CAST, F.least(F.lit(100.0), c("cast") / grade.WHEEL * 100)).otherwise(0.0))
    rows = rows.withColumn("global_hue", F.when(c("global_sat") > 0, colour.wheel_hue(c("da"), c("db"))).otherwise(0.0))
    rows = rows.withColumn("reach", F.when(c("cast") > 1e-9, F.least(F.lit(1.0), c("global_sat") / 100 * grade.WHEEL / c("cast"))).otherwise(0.0))
    rows = rows.withColumn("st", _moved(c("st"), a=lambda r: r["a"] + c("da") * c("reach"), b=lambda r: r["b"] + c("db") * c("reach")))
    rows = rows.withColumn("st", F.when(c("global_sat") > 0, _moved(c("st"), C=lambda r: F.hypot(r["a"], r["b"]))).otherwise(c("st")))
    # mixer
    most = grade.RESTRAINED_MIX if restrained else dict.fromkeys(grade.RESTRAINED_MIX, 100.0)

    def band(b: Column) -> Column:
        m, o, r = b["m"], b["o"], b["r"]
        here, there = o["share"] >= grade.PRESENT, r["share"] >= grade.PRESENT
        drained = _limit(-60 * F.least(F.lit(1.0), o["share"] / 0.25) * damp * gain["band_saturation"], most["sat"])
        factor = F.when(m["chroma"] > 1e-5, r["chroma"] / m["chroma"]).otherwise(1.0)
        sat = F.when(here & ~there, drained).when(here & there, _limit((factor - 1) * 100 * damp * gain["band_saturation"], most["sat"])).otherwise(0.0)
        lum = F.when(here & there, _limit((r["L"] - m["L"]) * grade.LUMINANCE_GAIN * damp, most["lum"])).otherwise(0.0)
        hue = F.when(here & there, _limit(colour.signed_delta_low(r["hue"], m["hue"]) / grade.HUE_DEGREES * 100 * damp, most["hue"])).otherwise(0.0)
        return F.struct(sat.alias("sat"), lum.alias("lum"), hue.alias("hue"))

    rows = rows.withColumn("mix", F.transform(F.arrays_zip(c("bd").alias("m"), c("bands").alias("o"), c("r_bands").alias("r")), band))
    anchors = F.array(*[F.lit(float(h)) for _, h in pixels.BANDS])

    def mixed(r: Column) -> Column:
        """What the mixer makes of a region: its bands by their distance in hue."""
        weight = lambda h: F.pow(F.greatest(F.lit(0.0), 1 - colour.circular_distance(colour.hue(r["a"], r["b"]), h) / BAND_REACH), F.lit(2.0))
        parts = F.zip_with(F.transform(anchors, weight), "mix", lambda w, m: F.struct(w.alias("w"), (w * m["hue"] / 100 * grade.HUE_DEGREES).alias("rot"), (w * (1 + m["sat"] / (100 * gain["band_saturation"]))).alias("chroma"), (w * m["lum"] / grade.LUMINANCE_GAIN).alias("lum")))
        zero = F.struct(*[F.lit(0.0).alias(n) for n in ("w", "rot", "chroma", "lum")])
        sums = F.aggregate(parts, zero, lambda s, p: F.struct(*[(s[n] + p[n]).alias(n) for n in ("w", "rot", "chroma", "lum")]))
        return F.struct(r.alias("r"), sums.alias("s"))

    def after(x: Column) -> Column:
        r, s = x["r"], x["s"]
        size = F.hypot(r["a"], r["b"])
        fine = (size >= 0.004) & (s["w"] > 1e-4)
        angle, chroma = F.radians(colour.hue(r["a"], r["b"]) + s["rot"] / s["w"]), size * s["chroma"] / s["w"]
        new = {"L": F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["L"] + s["lum"] / s["w"])), "C": chroma, "a": chroma * F.cos(angle), "b": chroma * F.sin(angle)}
        return F.struct(*[(F.when(fine, new[n]).otherwise(r[n]) if n in new else r[n]).alias(n) for n in ("key", "coverage", "L", "C", "a", "b", "strength")])

    rows = rows.withColumn("mx", F.transform("st", mixed)).withColumn("st", F.transform("mx", after))
    # tonal wheels: what is left of each zone, unless its hue says nothing
    for i, zone in enumerate(ZONES):
        rows = rows.withColumns({f"m{i}": _of(c("st"), zone), f"r{i}": _of(c("r_regions"), zone)})
        clear = c(f"m{i}").isNotNull() & c(f"r{i}").isNotNull() & (c(f"r{i}.strength") >= HUE_STRENGTH)
        rows = rows.withColumns({f"a{i}": F.when(clear, (c(f"r{i}.a") - c(f"m{i}.a")) * damp).otherwise(0.0), f"b{i}": F.when(clear, (c(f"r{i}.b") - c(f"m{i}.b")) * damp).otherwise(0.0)})
        raw = F.hypot(c(f"a{i}"), c(f"b{i}"))
        rows = rows.withColumn(f"raw{i}", raw).withColumn(f"mag{i}", F.least(c(f"raw{i}"), c("own") * ZONE_SHARE) if restrained else c(f"raw{i}"))
        rows = rows.withColumn(f"sat{i}", F.when(c(f"mag{i}") >= grade.LEAST_TINT, F.least(F.lit(100.0), c(f"mag{i}") / grade.WHEEL * 100)).otherwise(0.0))
        rows = rows.withColumn(f"hue{i}", F.when(c(f"sat{i}") > 0, colour.wheel_hue(c(f"a{i}"), c(f"b{i}"))).otherwise(0.0))
        part = F.when((c(f"sat{i}") > 0) & (c(f"raw{i}") > 1e-9), F.least(c(f"mag{i}"), c(f"sat{i}") / 100 * grade.WHEEL) / c(f"raw{i}")).otherwise(0.0)
        rows = rows.withColumn(f"p{i}", part)

    def tinted(f: str):
        def of(r: Column) -> Column:
            w = colour.zone_weights(r["L"])
            out = r[f]
            for i in range(3):
                out = out + F.get(w, F.lit(i))["w"] * c(f"{f}{i}") * c(f"p{i}")
            return out

        return of

    rows = rows.withColumn("st", _moved(c("st"), a=tinted("a"), b=tinted("b"))).withColumn("st", _moved(c("st"), C=lambda r: F.hypot(r["a"], r["b"])))
    ends = c("mag0") + c("mag2")
    rows = rows.withColumn("balance", F.when(ends > 1e-6, F.floor((c("mag2") - c("mag0")) / ends * 60 * damp + 0.5)).otherwise(0.0))
    # masks for what still differs inside a region that both have
    capped = MASK_EXPOSURE[restrained]

    def mask(m: Column) -> Column:
        r = F.get(F.filter("r_regions", lambda x: x["key"] == m["key"]), F.lit(0))
        own = F.when((m["key"] == "people.skin") & F.lit(restrained), damp * SKIN_DAMP).otherwise(damp)
        raw = F.when(m["L"] > 1e-4, 3 * F.log2(r["L"] / m["L"]) * own).otherwise(0.0)
        da, db = (r["a"] - m["a"]) * own, (r["b"] - m["b"]) * own
        sat = F.when(m["C"] > 1e-5, (r["C"] / m["C"] - 1) * 100 * own * gain["local_saturation"]).otherwise(0.0)
        exposure = _limit(raw, capped)
        worth = (F.abs(exposure) >= MASK_LEAST["exposure"]) | (F.hypot(da, db) >= MASK_LEAST["colour"]) | (F.abs(sat) >= MASK_LEAST["saturation"])
        kind = F.element_at(F.create_map(*[F.lit(x) for kv in MASKS.items() for x in kv]), m["key"])
        made = F.struct(m["key"].alias("region"), kind.alias("kind"), exposure.alias("exposure"), _limit(db / gain["local_temp"] * 100, 100.0).alias("temp"), _limit(da / gain["local_tint"] * 100, 100.0).alias("tint"), _limit(sat, 100.0).alias("saturation"))
        return F.when(r.isNotNull() & worth, made)

    rows = rows.withColumn("masks", F.array_compact(F.transform(F.filter("st", lambda r: r["key"].isin(*MASKS)), mask)))
    # what is left
    rows = rows.withColumns({"fg": _of(c("st"), "global"), "left": F.transform("zones", lambda p: F.struct(F.get(F.filter("st", lambda r: r["key"] == p["m"]["key"]), F.lit(0)).alias("m"), p["r"].alias("r")))})
    squares = F.aggregate("left", F.lit(0.0), lambda s, p: s + F.pow(p["r"]["a"] - p["m"]["a"], F.lit(2.0)) + F.pow(p["r"]["b"] - p["m"]["b"], F.lit(2.0)))
    residual = F.when(F.size("left") > 0, F.sqrt(squares / F.size("left"))).otherwise(0.0)
    controls = F.struct(
        c("exposure"), c("saturation"), c("vibrance"), _limit(c("db") / TEMP * 100, 100.0).alias("temp"), _limit(c("da") / TINT * 100, 100.0).alias("tint"), c("global_hue"), c("global_sat"), *[c(f"{n}{i}") for i in range(3) for n in ("hue", "sat")], c("balance"), c("mix")
    )
    return rows.select(*keep, controls.alias("controls"), "masks", "points", grade.reachability(c("fg.L"), c("fg.a"), c("fg.b"), c("rg.L"), c("rg.a"), c("rg.b")).alias("reachability"), residual.alias("residual"))


def detail_moves(reference: Column, own: Column, vignette: Column, comparable: Column, restrained: bool) -> Column:
    """Struct (grain, grain_size, noise, texture, vignette) from textures (grain, period, acutance) and falloffs of the corners (reference, own, usable).

    Grain can only be added; less of it is noise reduction. What can't be compared is left alone.
    """
    damp = grade.RESTRAINED if restrained else 1.0
    more = reference["grain"] - own["grain"]
    some = lambda cond, v: F.when(F.coalesce(comparable & cond, F.lit(False)), v).otherwise(0.0)
    return F.struct(
        some(more > 0, F.least(F.lit(100.0), more / GRAIN * 100 * damp)).alias("grain"), F.when(F.coalesce(comparable & (more > 0), F.lit(False)), F.greatest(F.lit(0.0), F.least(F.lit(100.0), (reference["period"] - 1) * 25))).otherwise(25.0).alias("grain_size"),
        some(more < 0, F.least(F.lit(100.0), -more / NOISE * 100 * damp)).alias("noise"), some(F.lit(True), _limit((reference["acutance"] - own["acutance"]) / TEXTURE * 100 * damp, 100.0)).alias("texture"),
        F.when(F.coalesce(vignette["usable"], F.lit(False)), _limit((vignette["reference"] - vignette["own"]) / VIGNETTE_STOPS * 100 * damp, 100.0)).otherwise(0.0).alias("vignette"),
    )


def details(textures: DataFrame, vignettes: DataFrame, reference: int) -> DataFrame:
    """(id, faithful_details, restrained_details) of every other image: what brings its texture and corners to the reference's.

    textures are rows of texture.gated(), vignettes (id, falloff, usable). Textures that were
    refused, or measured at sizes too different, are not compared; an image without a row in
    one of the two has nothing of it moved, and without the reference's nothing is moved at all.
    """
    one = lambda t: F.struct(F.col(f"{t}.grain").alias("grain"), F.col(f"{t}.grain_size").alias("period"), F.col(f"{t}.acutance").alias("acutance"))
    both = textures.select("id", F.struct("grain", "grain_size", "acutance", "usable", "long").alias("t")).join(vignettes.select("id", F.struct("falloff", "usable").alias("v")), "id", "full")
    told = both.where(F.col("id") == reference).select(F.col("t").alias("rt"), F.col("v").alias("rv")).limit(1)
    rows = both.where(F.col("id") != reference).join(F.broadcast(told), how="left")  # one row
    same = texture.comparable(F.col("rt.long"), F.col("t.long"), F.col("rt.usable"), F.col("t.usable"))
    corners = F.struct(F.col("rv.falloff").alias("reference"), F.col("v.falloff").alias("own"), (F.col("rv.usable") & F.col("v.usable")).alias("usable"))
    moves = lambda restrained: detail_moves(one("rt"), one("t"), corners, same, restrained)
    return rows.select("id", moves(False).alias("faithful_details"), moves(True).alias("restrained_details"))


def solution(rows: DataFrame) -> DataFrame:
    """rows of pairs() with the faithful and the restrained grade (controls, masks, curve), and reachability and residual of the faithful one.

    The faithful grade goes first: its curve's places along x are those of both.
    """
    faithful = solved(rows, False).withColumnsRenamed({"controls": "faithful", "masks": "faithful_masks", "points": "faithful_curve"})
    both = solved(faithful.withColumnsRenamed({"reachability": "__reach", "residual": "__residual"}), True, "faithful_curve")
    both = both.drop("reachability", "residual").withColumnsRenamed({"controls": "restrained", "masks": "restrained_masks", "points": "restrained_curve", "__reach": "reachability", "__residual": "residual"})
    return both
