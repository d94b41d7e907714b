"""Weather, air and camera arithmetic as formulas."""

from __future__ import annotations

from .formulas import Formula, clip, cosd, sind, up
from .geodesy import COMPASS8, compass

# Forecast codes.
CODES = {
    0: "Clear", 1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Fog", 48: "Freezing fog", 51: "Light drizzle", 53: "Drizzle", 55: "Heavy drizzle", 56: "Freezing drizzle",
    57: "Freezing drizzle", 61: "Light rain", 63: "Rain", 65: "Heavy rain", 66: "Freezing rain", 67: "Freezing rain", 71: "Light snow", 73: "Snow", 75: "Heavy snow", 77: "Snow grains",
    80: "Light showers", 81: "Showers", 82: "Violent showers", 85: "Snow showers", 86: "Snow showers", 95: "Thunderstorm", 96: "Thunderstorm, hail", 99: "Thunderstorm, hail",
}
HIGH_CLOUD_M, EFFECTIVE_RADIUS_M = 6000, 7 / 6 * 6371008.8


def overlap(a: str, b: str) -> str:
    """Per cent covered by two decks at random; null if neither is known."""
    x, y = (clip(f"coalesce({c}, 0)", "0", "100") + " / 100e0" for c in (a, b))
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN NULL ELSE (1 - (1 - {x}) * (1 - {y})) * 100 END"


#: code, cloud, low, mid, high (per cent, nullable), sun (degrees) -> what the light is like.
CLOUD = Formula(
    [
        {"condition": "CASE " + " ".join(f"WHEN code = {k} THEN '{v}'" for k, v in CODES.items()) + " WHEN code IS NULL THEN 'Not known' ELSE concat('Code ', code) END",
         "blocking": overlap("low", "mid"),
         "quality": "CASE WHEN sun <= -0.833 THEN 'none' WHEN cloud IS NULL THEN 'unknown' WHEN cloud < 12 THEN 'hard' WHEN cloud < 35 THEN 'mostly sun' WHEN cloud < 65 THEN 'broken' WHEN cloud < 88 THEN 'mostly cloud' ELSE 'flat' END",
         "top": "greatest(low, mid, high)", "known": "CASE WHEN low IS NULL THEN 0 ELSE 1 END + CASE WHEN mid IS NULL THEN 0 ELSE 1 END + CASE WHEN high IS NULL THEN 0 ELSE 1 END"},
        {"cover": "coalesce(blocking, cloud)", "second": "CASE WHEN known < 2 THEN NULL WHEN known = 3 THEN low + mid + high - greatest(low, mid, high) - least(low, mid, high) ELSE least(low, mid, high) END"},
        {"direct": f"CASE WHEN cover IS NULL THEN 1 ELSE {clip('1 - pow(' + clip('cover', '0', '100') + ' / 100e0, 2.2)', '0e0', '1e0')} END",
         "dominant": "CASE WHEN top >= 10 AND (second IS NULL OR top - second >= 10) THEN CASE WHEN low = top THEN 'low' WHEN mid = top THEN 'mid' ELSE 'high' END END"},
    ],
    ["condition", "blocking", "quality", "direct", "dominant"],
)

#: low, mid at the horizon and mid2, high2 overhead, bearing -> what a sunset may do.
HORIZON = Formula(
    [
        {"gate": overlap("low", "mid"), "canvas": overlap("mid2", "high2"), "metres": f"sqrt(2 * {EFFECTIVE_RADIUS_M:.6f} * {HIGH_CLOUD_M})"},
        {"verdict": "CASE WHEN gate IS NULL OR canvas IS NULL THEN 'unknown' WHEN gate >= 65 THEN 'blocked' WHEN canvas < 12 THEN 'bare' ELSE 'lit' END", "side": compass("bearing", COMPASS8)},
    ],
    ["gate", "canvas", "metres", "verdict", "side"],
)

#: altitude (degrees), elevation (metres), dew (degrees C), aod (nullable), sea (share, nullable) -> state of the air.
AIR = Formula(
    [
        {"a_": "greatest(altitude, -0.9)", "s_": clip("coalesce(sea, 0)", "0e0", "1e0")},
        {"air_mass": f"CASE WHEN altitude <= -1 THEN NULL ELSE 1 / ({sind('a_')} + 0.50572 * pow(a_ + 6.07995, -1.6364)) END", "pressure_ratio": "exp(-greatest(0e0, elevation) / 8434.5)",
         "water": f"CASE WHEN dew IS NULL THEN 1.5 ELSE {clip('exp(0.1102 + 0.0614 * dew)', '0.1', '6e0')} END", "alpha": "1.3 + (0.4 - 1.3) * s_", "table_beta": "0.05 + (0.12 - 0.05) * s_"},
        {"beta": "CASE WHEN aod IS NULL THEN table_beta ELSE greatest(0e0, aod) * pow(0.55, alpha) END", "basis": "CASE WHEN aod IS NULL THEN 'assumed' ELSE 'measured' END"},
    ],
    ["air_mass", "pressure_ratio", "water", "alpha", "beta", "basis"],
)

#: sensor_w, sensor_h (mm), focal (mm), aperture, coc (mm), focus (m) -> angles of view and what is sharp.
LENS = Formula(
    [
        {"across": "degrees(2 * atan(sensor_w / (2 * focal)))", "upward": "degrees(2 * atan(sensor_h / (2 * focal)))", "diagonal": "degrees(2 * atan(sqrt(sensor_w * sensor_w + sensor_h * sensor_h) / (2 * focal)))",
         "equivalent": "focal * sqrt(36e0 * 36 + 24 * 24) / sqrt(sensor_w * sensor_w + sensor_h * sensor_h)", "hyperfocal": "(focal + focal * focal / (aperture * coc)) / 1000",
         "f2_": "focal * focal", "nc_": "aperture * coc * (focus * 1000 - focal)"},
        {"near": "focus * f2_ / (f2_ + nc_)", "far": "CASE WHEN f2_ - nc_ > f2_ * 1e-9 THEN focus * f2_ / (f2_ - nc_) END", "width": "2 * focus * tan(radians(across / 2))"},
    ],
    ["across", "upward", "diagonal", "equivalent", "hyperfocal", "near", "far", "width"],
)

#: shutter (s), stops -> long exposure; clip (s), fps, every (s), mb -> timelapse.
EXPOSURE = Formula(
    [
        {"long": "shutter * pow(2e0, stops)", "photos": "ceil(clip * fps)"},
        {"shoot": "photos * every", "storage": "photos * mb", "speed": "every * fps", "whole": "floor(long + 0.5)"},
        {"label": "CASE WHEN long < 1 THEN concat('1/', cast(floor(1 / long + 0.5) as bigint), ' s') WHEN whole < 60 THEN concat(cast(whole as bigint), ' s')"
                  " WHEN whole < 3600 AND whole % 60 = 0 THEN concat(cast(floor(whole / 60) as bigint), ' min')"
                  " WHEN whole < 3600 THEN concat(cast(floor(whole / 60) as bigint), ' min ', cast(whole % 60 as bigint), ' s')"
                  " ELSE concat(cast(floor(whole / 3600) as bigint), ' h ', lpad(cast(cast(floor((whole % 3600) / 60) as bigint) as varchar(9)), 2, '0'), ' min') END"},
    ],
    ["long", "photos", "shoot", "storage", "speed", "label"],
)

#: az, alt (target), aim, tilt -> offsets in a frame.
FRAME = Formula(
    [
        {"right_": f"{cosd('alt')} * {sind('az - aim')}", "ahead_": f"{cosd('tilt')} * {cosd('alt')} * {cosd('az - aim')} + {sind('tilt')} * {sind('alt')}", "up_": f"{cosd('tilt')} * {sind('alt')} - {sind('tilt')} * {cosd('alt')} * {cosd('az - aim')}"},
        {"offset_across": up("degrees(atan2(right_, ahead_))", 6), "offset_up": up("degrees(atan2(up_, ahead_))", 6), "ahead": "ahead_ > 0"},
    ],
    ["offset_across", "offset_up", "ahead"],
)
