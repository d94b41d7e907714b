"""Light through the air: spectral colour of sun and sky, clear-sky irradiance, star trails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formulas import Formula, cosd, sind

# Wavelength in nm, the 1931 colour matching functions, and the ozone cross-section there.
BANDS = [
    (380, 0.001368, 3.9e-05, 0.00645, 0.0),
    (390, 0.004243, 0.00012, 0.02005, 0.0),
    (400, 0.01431, 0.000396, 0.06785, 0.0),
    (410, 0.04351, 0.00121, 0.2074, 0.0),
    (420, 0.13438, 0.004, 0.6456, 0.0),
    (430, 0.2839, 0.0116, 1.3856, 0.0),
    (440, 0.34828, 0.023, 1.74706, 0.0),
    (450, 0.3362, 0.038, 1.77211, 0.003),
    (460, 0.2908, 0.06, 1.6692, 0.006),
    (470, 0.19536, 0.09098, 1.28764, 0.009),
    (480, 0.09564, 0.13902, 0.81295, 0.014),
    (490, 0.03201, 0.20802, 0.46518, 0.021),
    (500, 0.0049, 0.323, 0.272, 0.03),
    (510, 0.0093, 0.503, 0.1582, 0.04),
    (520, 0.06327, 0.71, 0.07825, 0.048),
    (530, 0.1655, 0.862, 0.04216, 0.063),
    (540, 0.2904, 0.954, 0.0203, 0.075),
    (550, 0.43345, 0.99495, 0.00875, 0.085),
    (560, 0.5945, 0.995, 0.0039, 0.103),
    (570, 0.7621, 0.952, 0.0021, 0.12),
    (580, 0.9163, 0.87, 0.00165, 0.12),
    (590, 1.0263, 0.757, 0.0011, 0.115),
    (600, 1.0622, 0.631, 0.0008, 0.125),
    (610, 1.0026, 0.503, 0.00034, 0.12),
    (620, 0.85445, 0.381, 0.00019, 0.105),
    (630, 0.6424, 0.265, 5e-05, 0.09),
    (640, 0.4479, 0.175, 2e-05, 0.079),
    (650, 0.2835, 0.107, 0.0, 0.067),
    (660, 0.1649, 0.061, 0.0, 0.057),
    (670, 0.0874, 0.032, 0.0, 0.048),
    (680, 0.04677, 0.017, 0.0, 0.036),
    (690, 0.0227, 0.00821, 0.0, 0.028),
    (700, 0.011359, 0.004102, 0.0, 0.023),
    (710, 0.00579, 0.002091, 0.0, 0.018),
    (720, 0.002899, 0.001047, 0.0, 0.014),
    (730, 0.00144, 0.00052, 0.0, 0.011),
    (740, 0.00069, 0.000249, 0.0, 0.01),
    (750, 0.000332, 0.00012, 0.0, 0.009),
    (760, 0.000166, 6e-05, 0.0, 0.007),
    (770, 8.3e-05, 3e-05, 0.0, 0.006),
    (780, 4.2e-05, 1.5e-05, 0.0, 0.005),
]
PLANCK, LIGHT, BOLTZMANN, SUN_KELVIN, SUN_LUX, OZONE_CM = 6.62607015e-34, 2.99792458e8, 1.380649e-23, 5772.0, 133100.0, 0.3


def _band(nm: Column) -> tuple[Column, Column]:
    """Relative power of the sun outside the air and the Rayleigh depth at sea level, at a wavelength."""
    metre, um = nm * 1e-9, nm / 1000.0
    power = 2 * PLANCK * LIGHT * LIGHT / (F.pow(metre, F.lit(5.0)) * (F.exp(PLANCK * LIGHT / (metre * BOLTZMANN * SUN_KELVIN)) - 1))
    inverse = F.pow(um, F.lit(-2.0))
    return power, 0.008569 * inverse * inverse * (1 + 0.0113 * inverse + 0.00013 * inverse * inverse)


def spectral(air_mass: Column, pressure: Column, alpha: Column, beta: Column) -> Column:
    """Struct (sun_x, sun_y, sun_cct, sky_x, sky_y, sky_cct, lux) of a sun at an air mass; null air mass: no direct light.

    A sum over 41 bands inside each row: the table is a literal, nothing is joined or shuffled.
    """
    bands = F.array(*[F.struct(F.lit(float(n)).alias("nm"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"), F.lit(o).alias("o")) for n, x, y, z, o in BANDS])
    path = air_mass * pressure

    def through(b: Column) -> Column:
        power, rayleigh = _band(b["nm"])
        air, dust, ozone = rayleigh * pressure, beta * F.pow(b["nm"] / 1000.0, -alpha), b["o"] * OZONE_CM
        beam = F.coalesce(power * F.exp(-(air + dust + ozone) * path), F.lit(0.0))
        sky = F.coalesce(power * (1 - F.exp(-air * path)) * F.exp(-(dust + ozone) * path), F.lit(0.0))
        return F.struct(b["x"].alias("x"), b["y"].alias("y"), b["z"].alias("z"), power.alias("p"), beam.alias("beam"), sky.alias("sky"))

    rows = F.transform(bands, through)
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("bx", "by", "bz", "sx", "sy", "sz", "out")])
    add = lambda s, r: F.struct(
        *[(s["b" + c] + r["beam"] * r[c]).alias("b" + c) for c in "xyz"], *[(s["s" + c] + r["sky"] * r[c]).alias("s" + c) for c in "xyz"], (s["out"] + r["p"] * r["y"]).alias("out")
    )
    return F.aggregate(rows, zero, add, lambda s: F.struct(*_chromaticity(s, "b", "sun"), *_chromaticity(s, "s", "sky"), (SUN_LUX * s["by"] / s["out"]).alias("lux")))


def _chromaticity(s: Column, p: str, name: str) -> list[Column]:
    total = s[p + "x"] + s[p + "y"] + s[p + "z"]
    x, y = s[p + "x"] / F.nullif(total, F.lit(0.0)), s[p + "y"] / F.nullif(total, F.lit(0.0))
    n = (x - 0.332) / (0.1858 - y)
    kelvin = 437 * n * n * n + 3601 * n * n + 6861 * n + 5517
    return [F.coalesce(x, F.lit(0.3333)).alias(f"{name}_x"), F.coalesce(y, F.lit(0.3333)).alias(f"{name}_y"), F.coalesce(kelvin, F.lit(0.0)).alias(f"{name}_cct")]


#: altitude, air_mass, pressure_ratio, alpha, beta, water -> watts on a clear day; no sun, no light.
CLEAR_SKY = Formula(
    [
        {"ma": "air_mass * pressure_ratio", "xo": f"{OZONE_CM} * air_mass", "xw": "water * air_mass", "cz": sind("altitude"), "tau": "0.2758 * beta * pow(0.38, -alpha) + 0.35 * beta * pow(0.5, -alpha)"},
        {"tr": "exp(-0.0903 * pow(ma, 0.84) * (1 + ma - pow(ma, 1.01)))", "to_": "1 - 0.1611 * xo * pow(1 + 139.48 * xo, -0.3034) - 0.002715 * xo / (1 + 0.044 * xo + 0.0003 * xo * xo)",
         "tm": "exp(-0.0127 * pow(ma, 0.26))", "tw": "1 - 2.4959 * xw / (pow(1 + 79.034 * xw, 0.6828) + 6.385 * xw)", "ta": "exp(-pow(tau, 0.873) * (1 + tau - pow(tau, 0.7088)) * pow(air_mass, 0.9108))"},
        {"dn": "0.9662 * 1353 * tr * to_ * tm * tw * ta", "taa": "1 - 0.1 * (1 - ma + pow(ma, 1.06)) * (1 - ta)"},
        {"ts": "ta / taa"},
        {"down": "1353 * cz * 0.79 * to_ * tm * tw * taa * (0.5 * (1 - tr) + 0.84 * (1 - ts)) / (1 - ma + pow(ma, 1.02))", "alb": "0.0685 + 0.16 * (1 - ts)"},
        {"gh": "(dn * cz + down) / (1 - 0.2 * alb)"},
        {"up_": "altitude > 0 AND air_mass IS NOT NULL"},
        {"direct_normal": "CASE WHEN up_ THEN greatest(0e0, dn) ELSE 0 END", "diffuse": "CASE WHEN up_ THEN greatest(0e0, gh - dn * cz) ELSE 0 END", "global_": "CASE WHEN up_ THEN greatest(0e0, gh) ELSE 0 END"},
    ],
    ["direct_normal", "diffuse", "global_"],
)

#: sensor_w, sensor_h (mm), megapixels, focal (mm), declination, seconds -> how far stars trail; null limits at the pole.
TRAILS = Formula(
    [
        {"pitch": "sensor_w / sqrt(megapixels * 1000000e0 * sensor_w / sensor_h)", "sc_": f"abs({cosd('declination')})"},
        {"rate": "CASE WHEN sc_ < 1e-12 THEN 0 ELSE 360 / 86164.0905 * sc_ END"},
        {"swept_": "rate * seconds", "r_": "CASE WHEN rate = 0 THEN NULL ELSE rate END"},
        {"trail": "CASE WHEN swept_ >= 90 THEN NULL ELSE focal * tan(radians(swept_)) / pitch END", "sharp": "degrees(atan(pitch / focal)) / r_", "tolerable": "degrees(atan(3 * pitch / focal)) / r_", "drift": "rate * 3600"},
    ],
    ["pitch", "trail", "sharp", "tolerable", "drift"],
)


def light_reading(direct_lux: Column, direct: Column, diffuse: Column, altitude: Column) -> Column:
    """Struct (diffuse_lux, ev, stops): the sky's light, the exposure value of a subject that faces the sun, and key against fill.

    direct_lux is the beam's light, direct and diffuse are watts of the beam and of the sky on
    the ground. Key and fill are both taken on the ground, where a shadow lies, so a low sun is
    soft. Without a beam the sky gives 110 lumens a watt.
    """
    sky = F.when(direct > 1, direct_lux * diffuse / direct).otherwise(diffuse * 110)
    floor = lambda x: F.greatest(x, F.lit(1e-6))
    lit = direct_lux * F.greatest(F.lit(0.0), F.sin(F.radians(altitude))) + sky
    stops = F.when(lit > floor(sky), F.log2(lit / floor(sky))).otherwise(0.0)
    return F.struct(sky.alias("diffuse_lux"), F.log2(floor(direct_lux + sky) / 2.5).alias("ev"), stops.alias("stops"))


def aerosol_note(aod: Column, sea: Column) -> Column:
    """Where the air's turbidity comes from, in words: measured or from a table, and how the size of its particles is known."""
    size = F.when(sea.isNull(), "particle size assumed continental").otherwise(F.concat(F.lit("particle size inferred from "), F.floor(sea * 100 + 0.5).cast("long").cast("string"), F.lit("% sea around the pin")))
    measured = F.concat(F.lit("aerosol depth "), F.format_string("%.2f", aod), F.lit(" at 550 nm, measured; "), size)
    known = aod.isNotNull() & ~F.isnan(aod)
    return F.when(known, measured).otherwise(F.concat(F.lit("turbidity from a table, "), size))
