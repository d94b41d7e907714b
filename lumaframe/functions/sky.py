"""Sun, moon and galactic core: positions, refraction, phases. Times are seconds since 1970 in UTC.

Published low-precision series; their coefficients are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formulas import Formula, clip, cosd, sind, turn

J2000, UNIX_JD, ELEMENT_JD = 2451545.0, 2440587.5, 2451543.5
PHASES = ((6.5, "new"), (83.5, "waxing-crescent"), (96.5, "first-quarter"), (173.5, "waxing-gibbous"), (186.5, "full"), (263.5, "waning-gibbous"), (276.5, "last-quarter"), (353.5, "waning-crescent"))
MONTH_DAYS = 29.530588853


def refraction(a: str) -> str:
    """Degrees by which air lifts a body at a geometric altitude."""
    t = f"tan(radians({a}))"
    low = f"(1735 + {a} * (-518.2 + {a} * (103.4 + {a} * (-12.79 + {a} * 0.711))))"
    high = f"(58.1 / {t} - 0.07 / pow({t}, 3) + 0.000086 / pow({t}, 5))"
    return f"(CASE WHEN {a} > 85 THEN 0 WHEN {a} > 5 THEN {high} WHEN {a} > -0.575 THEN {low} ELSE -20.772 / {t} END / 3600)"


def sun_state(t: str, p: str = "") -> list[dict[str, str]]:
    """Groups that give {p}dec, {p}ra, {p}eot, {p}lam and {p}au for seconds t."""
    return [
        {f"{p}jc": f"(({t}) / 86400e0 + {UNIX_JD} - {J2000}) / 36525"},
        {f"{p}L0": turn(f"280.46646 + {p}jc * (36000.76983 + {p}jc * 0.0003032)"), f"{p}M": f"357.52911 + {p}jc * (35999.05029 - 0.0001537 * {p}jc)",
         f"{p}e": f"0.016708634 - {p}jc * (0.000042037 + 0.0000001267 * {p}jc)", f"{p}om": f"125.04 - 1934.136 * {p}jc",
         f"{p}sec": f"21.448 - {p}jc * (46.815 + {p}jc * (0.00059 - {p}jc * 0.001813))"},
        {f"{p}c": f"{sind(p + 'M')} * (1.914602 - {p}jc * (0.004817 + 0.000014 * {p}jc)) + {sind('2 * ' + p + 'M')} * (0.019993 - 0.000101 * {p}jc) + {sind('3 * ' + p + 'M')} * 0.000289",
         f"{p}eps": f"23 + (26 + {p}sec / 60) / 60 + 0.00256 * {cosd(p + 'om')}"},
        {f"{p}lam": f"{p}L0 + {p}c - 0.00569 - 0.00478 * {sind(p + 'om')}", f"{p}y": f"pow(tan(radians({p}eps / 2)), 2)",
         f"{p}au": f"1.000001018 * (1 - {p}e * {p}e) / (1 + {p}e * {cosd(p + 'M + ' + p + 'c')})"},
        {f"{p}dec": f"degrees(asin({sind(p + 'eps')} * {sind(p + "lam")}))",
         f"{p}ra": turn(f"degrees(atan2({cosd(p + 'eps')} * {sind(p + "lam")}, {cosd(p + "lam")}))"),
         f"{p}eot": f"4 * degrees({p}y * {sind('2 * ' + p + 'L0')} - 2 * {p}e * {sind(p + 'M')} + 4 * {p}e * {p}y * {sind(p + 'M')} * {cosd('2 * ' + p + 'L0')}"
                    f" - 0.5 * {p}y * {p}y * {sind('4 * ' + p + 'L0')} - 1.25 * {p}e * {p}e * {sind('2 * ' + p + 'M')})"},
    ]


#: lat, lon, t -> where the sun stands.
SUN = Formula(
    [
        *sun_state("t"),
        {"la_": clip("lat", "-89.9999", "89.9999"), "st_": f"{turn('(t / 60e0 + eot + 4 * lon) / 4')} * 4"},
        {"ha_": "st_ / 4 - 180"},
        {"cz_": clip(f"{sind('la_')} * {sind('dec')} + {cosd('la_')} * {cosd('dec')} * {cosd('ha_')}", "-1e0", "1e0")},
        {"sun_altitude": "90 - degrees(acos(cz_))", "dn_": f"{cosd('la_')} * sin(acos(cz_))"},
        {"az_": f"CASE WHEN abs(dn_) < 1e-9 THEN NULL ELSE 180 - degrees(acos({clip(f'({sind("la_")} * cz_ - {sind("dec")}) / dn_', '-1e0', '1e0')})) END"},
        {"sun_azimuth": f"CASE WHEN az_ IS NULL THEN CASE WHEN la_ > 0 THEN 180e0 ELSE 0e0 END ELSE {turn('CASE WHEN ha_ > 0 THEN -az_ ELSE az_ END')} END",
         "sun_apparent": f"sun_altitude + {refraction('sun_altitude')}", "sun_declination": "dec", "equation_of_time": "eot", "sun_distance": "au"},
        {"phase": "CASE WHEN sun_altitude < -18 THEN 'night' WHEN sun_altitude < -12 THEN 'astronomical' WHEN sun_altitude < -6 THEN 'nautical' WHEN sun_altitude < -4 THEN 'blue' WHEN sun_altitude < 6 THEN 'golden' ELSE 'day' END",
         "shadow_bearing": turn("sun_azimuth + 180"), "shadow_ratio": "CASE WHEN sun_altitude <= 0 THEN NULL ELSE 1 / tan(radians(sun_altitude)) END"},
    ],
    ["sun_azimuth", "sun_altitude", "sun_apparent", "sun_declination", "equation_of_time", "sun_distance", "phase", "shadow_bearing", "shadow_ratio"],
)


def _newton(i: int) -> dict[str, str]:
    return {f"E{i + 1}": f"E{i} - (E{i} - degrees(0.0549 * {sind(f'E{i}')}) - mm) / (1 - 0.0549 * {cosd(f'E{i}')})"}


_LON = ((-1.274, "mm - 2 * el"), (0.658, "2 * el"), (-0.186, "ms"), (-0.059, "2 * mm - 2 * el"), (-0.057, "mm - 2 * el + ms"), (0.053, "mm + 2 * el"), (0.046, "2 * el - ms"), (0.041, "mm - ms"),
        (-0.035, "el"), (-0.031, "mm + ms"), (-0.015, "2 * af - 2 * el"), (0.011, "mm - 4 * el"))
_LAT = ((-0.173, "af - 2 * el"), (-0.055, "mm - af - 2 * el"), (-0.046, "mm + af - 2 * el"), (0.033, "af + 2 * el"), (0.017, "2 * mm + af"))

MOON_ECLIPTIC = [
    {"d": f"t / 86400e0 + {UNIX_JD} - {ELEMENT_JD}"},
    {"ws": "282.9404 + 0.0000470935 * d", "ms": turn("356.047 + 0.9856002585 * d"), "nn": "125.1228 - 0.0529538083 * d", "pg": "318.0634 + 0.1643573223 * d", "mm": turn("115.3654 + 13.0649929509 * d")},
    {"E0": f"mm + degrees(0.0549 * {sind('mm')} * (1 + 0.0549 * {cosd('mm')}))"},
    *[_newton(i) for i in range(4)],
    {"xv": f"60.2666 * ({cosd('E4')} - 0.0549)", "yv": f"60.2666 * sqrt(1 - 0.0549 * 0.0549) * {sind('E4')}"},
    {"rr": "sqrt(xv * xv + yv * yv)", "u": "degrees(atan2(yv, xv)) + pg", "mo": turn("nn + pg + mm"), "su": turn("ms + ws")},
    {"x0": f"rr * ({cosd('nn')} * {cosd('u')} - {sind('nn')} * {sind('u')} * {cosd('5.1454')})", "y0": f"rr * ({sind('nn')} * {cosd('u')} + {cosd('nn')} * {sind('u')} * {cosd('5.1454')})",
     "z0": f"rr * {sind('u')} * {sind('5.1454')}", "el": turn("mo - su"), "af": turn("mo - nn")},
    {"moon_lon": turn("degrees(atan2(y0, x0)) + " + " + ".join(f"({k}) * {sind(x)}" for k, x in _LON)),
     "moon_lat": "degrees(atan2(z0, sqrt(x0 * x0 + y0 * y0))) + " + " + ".join(f"({k}) * {sind(x)}" for k, x in _LAT),
     "er": f"sqrt(x0 * x0 + y0 * y0 + z0 * z0) - 0.58 * {cosd('mm - 2 * el')} - 0.46 * {cosd('2 * el')}"},
]
SIDEREAL = [{"jd_": f"t / 86400e0 + {UNIX_JD} - {J2000}"}, {"c_": "jd_ / 36525"}, {"gmst": turn("280.46061837 + 360.98564736629 * jd_ + 0.000387933 * c_ * c_ - c_ * c_ * c_ / 38710000")}]

#: lat, lon, t -> where the moon stands, seen from the place itself.
MOON = Formula(
    [
        *MOON_ECLIPTIC, *SIDEREAL,
        {"la_": clip("lat", "-89.9999", "89.9999"), "ob": "23.4393 - 0.0000003563 * d", "xe": f"er * {cosd('moon_lat')} * {cosd('moon_lon')}", "ye": f"er * {cosd('moon_lat')} * {sind('moon_lon')}", "ze": f"er * {sind('moon_lat')}"},
        {"yq": f"ye * {cosd('ob')} - ze * {sind('ob')}", "zq": f"ye * {sind('ob')} + ze * {cosd('ob')}"},
        {"mra": turn("degrees(atan2(yq, xe))"), "mdec": "degrees(atan2(zq, sqrt(xe * xe + yq * yq)))"},
        {"mha": turn("gmst + lon - mra")},
        {"mx": f"{cosd('mha')} * {cosd('mdec')} * {sind('la_')} - {sind('mdec')} * {cosd('la_')}", "my": f"{sind('mha')} * {cosd('mdec')}", "mz": f"{cosd('mha')} * {cosd('mdec')} * {cosd('la_')} + {sind('mdec')} * {sind('la_')}"},
        {"moon_azimuth": turn("degrees(atan2(my, mx)) + 180"), "ga": "degrees(atan2(mz, sqrt(mx * mx + my * my)))"},
        {"moon_altitude": f"ga - degrees(asin(1 / er)) * {cosd('ga')}", "moon_km": "er * 6378.137", "moon_declination": "mdec"},
        {"moon_apparent": f"moon_altitude + {refraction('moon_altitude')}", "moon_radius": "degrees(asin(1737.4 / moon_km))"},
    ],
    ["moon_azimuth", "moon_altitude", "moon_apparent", "moon_declination", "moon_km", "moon_radius"],
)

#: t -> phase of the moon.
ILLUMINATION = Formula(
    [
        *MOON_ECLIPTIC, *sun_state("t", "s_"),
        {"age": turn(f"moon_lon - {turn('s_lam')}")},
        {"phase_angle": f"180 - degrees(acos({clip(cosd('moon_lat') + ' * ' + cosd('age'), '-1e0', '1e0')}))"},
        {"lit": f"(1 + {cosd('phase_angle')}) / 2", "age_days": f"age / 360 * {MONTH_DAYS}",
         "moon_phase": "CASE " + " ".join(f"WHEN age < {a} THEN '{n}'" for a, n in PHASES) + " ELSE 'new' END"},
    ],
    ["age", "phase_angle", "lit", "age_days", "moon_phase"],
)

_CORE_RA, _CORE_DEC = f"{(17 + 45 / 60 + 40.04 / 3600) * 15:.12f}", f"{-(29 + 28.1 / 3600):.12f}"

#: lat, lon, t -> where the galactic core stands.
CORE = Formula(
    [
        *SIDEREAL,
        {"cra": turn(f"{_CORE_RA} + (3.07496 + 0.00186 * c_ + (20.0431 - 0.0085 * c_) / 15 * {sind(_CORE_RA)} * tan(radians({_CORE_DEC}))) * c_ * 100 * 15 / 3600"),
         "cdec": f"{_CORE_DEC} + (20.0431 - 0.0085 * c_) * {cosd(_CORE_RA)} * c_ * 100 / 3600"},
        {"cha": turn("gmst + lon - cra")},
        {"kx": f"{cosd('cha')} * {cosd('cdec')} * {sind('lat')} - {sind('cdec')} * {cosd('lat')}", "ky": f"{sind('cha')} * {cosd('cdec')}", "kz": f"{cosd('cha')} * {cosd('cdec')} * {cosd('lat')} + {sind('cdec')} * {sind('lat')}"},
        {"core_azimuth": turn("degrees(atan2(ky, kx)) + 180"), "core_altitude": "degrees(atan2(kz, sqrt(kx * kx + ky * ky)))"},
        {"core_apparent": f"core_altitude + {refraction('core_altitude')}"},
    ],
    ["core_azimuth", "core_altitude", "core_apparent"],
)


def _crossing(alt: float, name: str) -> list[dict[str, str]]:
    """Rise and set through an altitude: the solar state is taken again at both, three times."""
    cos_h = lambda dec: f"(sin(radians({alt}e0)) - {sind('la_')} * {sind(dec)}) / ({cosd('la_')} * {cosd(dec)})"
    groups = [{f"{name}_c": cos_h("n_dec")}, {f"{name}_h": f"CASE WHEN abs({name}_c) <= 1 THEN degrees(acos({name}_c)) END"}, {f"{name}_r0": f"mean_noon - n_eot * 60 - {name}_h * 240", f"{name}_s0": f"mean_noon - n_eot * 60 + {name}_h * 240"}]
    for i in range(3):
        for side, sign in (("r", "-"), ("s", "+")):
            p = f"{name}{side}{i}_"
            groups += sun_state(f"{name}_{side}{i}", p)
            groups += [{f"{p}k": cos_h(f"{p}dec")}]
        both = f"abs({name}r{i}_k) <= 1 AND abs({name}s{i}_k) <= 1"
        groups.append({f"{name}_{side}{i + 1}": f"CASE WHEN {both} THEN mean_noon - {name}{side}{i}_eot * 60 {sign} degrees(acos({clip(f'{name}{side}{i}_k', '-1e0', '1e0')})) * 240 ELSE {name}_{side}{i} END" for side, sign in (("r", "-"), ("s", "+"))})
    return groups


DAY_HEAD = [
    {"la_": clip("lat", "-89.9999", "89.9999"), "days_": f"t / 86400e0 + {UNIX_JD} - {J2000}"},
    {"mean_noon": f"(floor(days_ + lon / 360 + 0.5) - lon / 360 + {J2000} - {UNIX_JD}) * 86400e0"},
    *sun_state("mean_noon", "n_"), {"n1": "mean_noon - n_eot * 60"}, *sun_state("n1", "m_"), {"solar_noon": "mean_noon - m_eot * 60"},
]

#: lat, lon, t -> seconds of solar noon, rise and set, and whether the sun stays up or down all day.
DAY = Formula(
    [
        *DAY_HEAD,
        *_crossing(-0.833, "d"),
        {"sunrise": "d_r3", "sunset": "d_s3", "polar": "CASE WHEN d_c > 1 THEN 'polar-night' WHEN d_c < -1 THEN 'midnight-sun' ELSE 'none' END"},
    ],
    ["solar_noon", "sunrise", "sunset", "polar"],
)

_SIDE = "CASE WHEN {0}_c > 1 THEN 'below' WHEN {0}_c < -1 THEN 'above' ELSE 'ok' END"


def band(lower: float, upper: float) -> Formula:
    """lat, lon, t -> rise and set through both ends of a band of altitudes, and which kind of day that makes."""
    return Formula(
        [
            *DAY_HEAD,
            *_crossing(lower, "lo"), *_crossing(upper, "hi"),
            {"lo_k": _SIDE.format("lo"), "hi_k": _SIDE.format("hi")},
            {"r_lo": "lo_r3", "s_lo": "lo_s3", "r_hi": "hi_r3", "s_hi": "hi_s3",
             "kind": "CASE WHEN lo_k = 'below' THEN 'none' WHEN lo_k = 'ok' AND hi_k = 'below' THEN 'all day long' WHEN lo_k = 'ok' AND hi_k = 'ok' THEN 'twice' WHEN lo_k = 'ok' THEN 'none' WHEN hi_k = 'above' THEN 'none' WHEN hi_k = 'ok' THEN 'through midnight' ELSE 'whole day' END"},
        ],
        ["solar_noon", "r_lo", "s_lo", "r_hi", "s_hi", "kind"],
    )


#: Golden light from -4 to 6 degrees, blue light from -6 to -4.
GOLDEN, BLUE = band(-4, 6), band(-6, -4)


def band_windows() -> Column:
    """Array of (start, end) of a band's row: one or two windows of a solar day, none where the sun doesn't pass it."""
    window = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    c, noon = F.col, F.col("solar_noon")
    first, last = noon - 43_200, noon + 43_200
    none = F.array().cast("array<struct<start: double, end: double>>")
    return (
        F.when(c("kind") == "all day long", F.array(window(c("r_lo"), c("s_lo"))))
        .when(c("kind") == "twice", F.array(window(c("r_lo"), c("r_hi")), window(c("s_hi"), c("s_lo"))))
        .when(c("kind") == "through midnight", F.array(window(first, c("r_hi")), window(c("s_hi"), last)))
        .when(c("kind") == "whole day", F.array(window(first, last)))
        .otherwise(none)
    )
