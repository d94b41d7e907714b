"""Distances, bearings, destinations, tiles and boxes on the sphere and the flat earth."""

from __future__ import annotations

from .formulas import Formula, clip, cosd, sind, turn

# Two earth radii of two different operators, and the tile projection's limit.
EARTH_M, FLAT_EARTH_M, TILE_LATITUDE, CIRCUMFERENCE_M = 6371008.8, 6371000.0, 85.05112878, 40075016.686
COMPASS16 = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
COMPASS8 = COMPASS16[::2]


def compass(bearing: str, names: list[str]) -> str:
    step = 360 / len(names)
    at = f"cast(floor({turn(bearing)} / {step}e0 + 0.5) as int) % {len(names)}"
    return "CASE " + at + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


#: lat1, lon1, lat2, lon2 -> great-circle distance in metres and initial bearing.
INVERSE = Formula(
    [
        {"h_": f"pow({sind('(lat2 - lat1) / 2')}, 2) + {cosd('lat1')} * {cosd('lat2')} * pow({sind('(lon2 - lon1) / 2')}, 2)",
         "by_": f"{sind('lon2 - lon1')} * {cosd('lat2')}", "bx_": f"{cosd('lat1')} * {sind('lat2')} - {sind('lat1')} * {cosd('lat2')} * {cosd('lon2 - lon1')}"},
        {"distance": f"2 * {EARTH_M} * asin(CASE WHEN h_ > 1 THEN 1 ELSE sqrt(h_) END)", "bearing": turn("degrees(atan2(by_, bx_))")},
        {"compass": compass("bearing", COMPASS16), "eighth": compass("bearing", COMPASS8),
         "flat": f"sqrt(pow(radians(lat2 - lat1), 2) + pow(radians(lon2 - lon1) * {cosd('(lat1 + lat2) / 2')}, 2)) * {FLAT_EARTH_M}"},
    ],
    ["distance", "bearing", "compass", "eighth", "flat"],
)

#: lat1, lon1, course, metres -> lat, lon (not wrapped) and the wrapped longitude.
DIRECT = Formula(
    [
        {"d_": f"metres / {EARTH_M}"},
        {"s_": f"{sind('lat1')} * cos(d_) + {cosd('lat1')} * sin(d_) * {cosd('course')}"},
        {"lat": f"degrees(asin({clip('s_', '-1e0', '1e0')}))",
         "lon": f"lon1 + degrees(atan2({sind('course')} * sin(d_) * {cosd('lat1')}, cos(d_) - {sind('lat1')} * s_))"},
        {"wrapped": f"CASE WHEN lon >= -180 AND lon < 180 THEN lon ELSE {turn('lon + 180')} - 180 END"},
    ],
    ["lat", "lon", "wrapped"],
)

#: lat1, lon1, lat2, lon2, part -> the point at part of the great circle; null between antipodes.
BETWEEN = Formula(
    [
        {"h_": f"pow({sind('(lat2 - lat1) / 2')}, 2) + {cosd('lat1')} * {cosd('lat2')} * pow({sind('(lon2 - lon1) / 2')}, 2)"},
        {"d_": "2 * asin(CASE WHEN h_ > 1 THEN 1 ELSE sqrt(h_) END)"},
        {"n_": "CASE WHEN abs(sin(d_)) < 1e-12 THEN NULL ELSE sin(d_) END"},
        {"p_": "sin((1 - part) * d_) / n_", "q_": "sin(part * d_) / n_"},
        {"x_": f"p_ * {cosd('lat1')} * {cosd('lon1')} + q_ * {cosd('lat2')} * {cosd('lon2')}",
         "y_": f"p_ * {cosd('lat1')} * {sind('lon1')} + q_ * {cosd('lat2')} * {sind('lon2')}",
         "z_": f"p_ * {sind('lat1')} + q_ * {sind('lat2')}"},
        {"lat": "CASE WHEN d_ = 0 THEN lat1 ELSE degrees(atan2(z_, sqrt(x_ * x_ + y_ * y_))) END",
         "lon": "CASE WHEN d_ = 0 THEN lon1 ELSE degrees(atan2(y_, x_)) END"},
    ],
    ["lat", "lon"],
)

#: lat, lon, zoom -> tile position, the tile's corner, metres of one of 256 samples.
TILE = Formula(
    [
        {"la_": clip("lat", f"-{TILE_LATITUDE}", f"{TILE_LATITUDE}"), "n_": "pow(2e0, zoom)"},
        {"tile_x": "(lon + 180) / 360e0 * n_", "tile_y": f"(1 - ln(tan(radians(la_)) + 1 / {cosd('la_')}) / pi()) / 2 * n_"},
        {"west": "floor(tile_x) / n_ * 360 - 180", "m_": "pi() - 2 * pi() * floor(tile_y) / n_"},
        {"north": "degrees(atan(0.5 * (exp(m_) - exp(-m_))))", "metres": f"{CIRCUMFERENCE_M} * {cosd('lat')} / (n_ * 256)"},
    ],
    ["tile_x", "tile_y", "west", "north", "metres"],
)

#: r, g, b of an elevation tile -> metres.
ELEVATION = Formula([{"height": "r * 256e0 + g + b / 256e0 - 32768"}], ["height"])
