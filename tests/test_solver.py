"""The grade as a chain against a plain version that walks one image at a time."""

import math

import pytest
from pyspark.sql import functions as F

from lumaframe.functions import colour
from lumaframe.operators import pixels, solver
from lumaframe.plans.archive import images

SF = "/root/testdata/sf0.001"
HUES = [h for _, h in pixels.BANDS]


def clip(x, lo, hi):
    return min(hi, max(lo, x))


def enc(y):
    y = clip(y, 0, 1)
    return 12.92 * y if y <= 0.0031308 else 1.055 * y ** (1 / 2.4) - 0.055


def dec(v):
    return v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4


def level(curve, L):
    x = enc(clip(L, 0, 1) ** 3) * 255
    i = 0
    while i < len(curve) - 2 and curve[i + 1][0] < x:
        i += 1
    (x0, y0), (x1, y1) = curve[i], curve[i + 1]
    t = 0 if x1 == x0 else clip((x - x0) / (x1 - x0), 0, 1)
    return dec((y0 + (y1 - y0) * t) / 255) ** (1 / 3)


def fit(own, told):
    points = [[0, 0]]
    for i in (1, 3, 6, 10, 14, 17, 19):
        x, y = (math.floor(enc(v[i] ** 3) * 255 + 0.5) for v in (own, told))
        if x > 2 and x - points[-1][0] >= 14 and x <= 241:
            points.append([x, y])
    points.append([255, 255])
    for a, b in zip(points, points[1:]):
        b[1] = max(a[1], b[1])
    for a, b in zip(points, points[1:-1]):
        b[1] = min(b[1], a[1] + 3 * (b[0] - a[0]))
    return [tuple(p) for p in points]


def turn(d):
    return (d + 540) % 360 - 180


def plain(own, ref, restrained, shared=None):
    damp = 0.62 if restrained else 1.0
    regs = {r["key"]: dict(r) for r in own["regions"]}
    told = {r["key"]: r for r in ref["regions"]}
    bands = [dict(b) for b in own["bands"]]
    logs = [math.log2(ref["curve"][i] / own["curve"][i]) for i in range(2, 19, 2) if ref["curve"][i] > 0.02 and own["curve"][i] > 0.02]
    top = 1.2 if restrained else 3
    exposure = clip((3 * sum(logs) / len(logs) if logs else 0) * damp, -top, top)
    k = 2 ** (exposure / 3)
    curve_in = [min(1, v * k) for v in own["curve"]]
    for v in [*regs.values(), *bands]:
        v["L"] = min(1, v["L"] * k)
    curve = fit(curve_in, ref["curve"])
    if restrained:
        curve = [(x, y + (x - y) * 0.5) for x, y in curve]
    if shared:
        curve = [(x, curve[i][1] if i < len(curve) else x) for i, (x, _) in enumerate(shared)]
    for v in [*regs.values(), *bands]:
        v["L"] = level(curve, v["L"])
    pts = [(regs[z], told[z], max(1e-4, told[z]["coverage"])) for z in solver.ZONES if z in regs and z in told]
    ratio = told["global"]["C"] / regs["global"]["C"] if regs["global"]["C"] > 1e-5 else 1
    den = sum(w * math.hypot(m["a"], m["b"]) for m, _, w in pts)
    if len(pts) >= 2 and den > 1e-9:
        ratio = sum(w * math.hypot(r["a"], r["b"]) for _, r, w in pts) / den
    wanted = (clip(ratio, 0.25, 3) - 1) * damp
    if restrained:
        wanted = clip(wanted, -0.25, 0.3)
        vib, sat = clip(wanted * 70 * 1.6, -100, 100), clip(wanted * 30, -100, 100)
    else:
        vib, sat = 0, clip(wanted * 100, -100, 100)
    applied = 1 + sat / 100 + vib / 160
    if len(pts) >= 2:
        n = sum(w for *_, w in pts)
        da, db = (sum(w * (r[f] - applied * m[f]) for m, r, w in pts) / n * damp for f in "ab")
    else:
        da, db = ((told["global"][f] - applied * regs["global"][f]) * damp for f in "ab")
    for v in regs.values():
        for f in "Cab":
            v[f] *= applied
    for b in bands:
        b["chroma"] *= applied
    own_c = max(0.012, next(r["C"] for r in own["regions"] if r["key"] == "global"))
    cast = math.hypot(da, db)
    if restrained and cast > own_c * 0.4:
        da, db, cast = da * own_c * 0.4 / cast, db * own_c * 0.4 / cast, own_c * 0.4
    gsat = min(100, cast / 0.06 * 100) if cast > 0.002 else 0
    if gsat:
        part = min(1, gsat / 100 * 0.06 / cast)
        for v in regs.values():
            v["a"], v["b"] = v["a"] + da * part, v["b"] + db * part
            v["C"] = math.hypot(v["a"], v["b"])
    most = {"sat": 32, "lum": 26, "hue": 20} if restrained else dict.fromkeys(("sat", "lum", "hue"), 100)
    mix = []
    for m, o, r in zip(bands, own["bands"], ref["bands"]):
        move = {"sat": 0.0, "lum": 0.0, "hue": 0.0}
        if o["share"] >= 0.02 and r["share"] < 0.02:
            move["sat"] = clip(-60 * min(1, o["share"] / 0.25) * damp, -most["sat"], most["sat"])
        elif o["share"] >= 0.02:
            move["sat"] = clip(((r["chroma"] / m["chroma"] if m["chroma"] > 1e-5 else 1) - 1) * 100 * damp, -most["sat"], most["sat"])
            move["lum"] = clip((r["L"] - m["L"]) * 320 * damp, -most["lum"], most["lum"])
            move["hue"] = clip(turn(r["hue"] - m["hue"]) / 22 * 100 * damp, -most["hue"], most["hue"])
        mix.append(move)
    for v in regs.values():
        size = math.hypot(v["a"], v["b"])
        if size < 0.004:
            continue
        hue = math.degrees(math.atan2(v["b"], v["a"])) % 360
        ws = [max(0, 1 - abs(turn(hue - h)) / 55) ** 2 for h in HUES]
        if sum(ws) <= 1e-4:
            continue
        mean = lambda f: sum(w * f(m) for w, m in zip(ws, mix)) / sum(ws)  # noqa: B023, E731
        nh, nc = math.radians(hue + mean(lambda m: m["hue"] / 100 * 22)), size * mean(lambda m: 1 + m["sat"] / 100)
        v.update(a=nc * math.cos(nh), b=nc * math.sin(nh), C=nc, L=clip(v["L"] + mean(lambda m: m["lum"] / 320), 0, 1))
    wheels, dev = [], []
    for z in solver.ZONES:
        if z not in regs or z not in told or told[z]["strength"] < 0.3:
            wheels.append((0.0, 0.0))
            dev.append((0.0, 0.0))
            continue
        za, zb = (told[z]["a"] - regs[z]["a"]) * damp, (told[z]["b"] - regs[z]["b"]) * damp
        raw = math.hypot(za, zb)
        mag = min(raw, own_c * 0.25) if restrained else raw
        zsat = min(100, mag / 0.06 * 100) if mag >= 0.004 else 0.0
        part = min(mag, zsat / 100 * 0.06) / raw if zsat and raw > 1e-9 else 0.0
        wheels.append((mag, zsat))
        dev.append((za * part, zb * part))
    for v in regs.values():
        sh, hi, mid = max(0, 1 - v["L"] / 0.5), max(0, (v["L"] - 0.5) / 0.5), max(0, 1 - abs(v["L"] - 0.5) / 0.5)
        w = [x / (sh + mid + hi) for x in (sh, mid, hi)]
        v["a"], v["b"] = (v[f] + sum(x * d[i] for x, d in zip(w, dev)) for i, f in enumerate("ab"))
        v["C"] = math.hypot(v["a"], v["b"])
    masks = {}
    for z, m in regs.items():
        if z in solver.MASKS and z in told:
            r, local = told[z], damp * (0.35 if restrained and z == "people.skin" else 1)
            ex = clip(3 * math.log2(r["L"] / m["L"]) * local, *((-0.5, 0.5) if restrained else (-1, 1)))
            ma, mb, ms = (r["a"] - m["a"]) * local, (r["b"] - m["b"]) * local, (r["C"] / m["C"] - 1) * 100 * local
            if abs(ex) >= 0.12 or math.hypot(ma, mb) >= 0.012 or abs(ms) >= 6:
                masks[z] = (ex, clip(mb / 0.05 * 100, -100, 100), clip(ma / 0.045 * 100, -100, 100), clip(ms, -100, 100))
    g, t = regs["global"], told["global"]
    reach = clip(1 - (abs(t["L"] - g["L"]) / 0.1 + math.hypot(t["a"] - g["a"], t["b"] - g["b"]) / 0.06) / 2, 0, 1)
    rest = math.sqrt(sum((r["a"] - m["a"]) ** 2 + (r["b"] - m["b"]) ** 2 for m, r, _ in pts) / len(pts)) if pts else 0
    return {"exposure": exposure, "saturation": sat, "vibrance": vib, "global_sat": gsat, "mix": mix, "wheels": [w[1] for w in wheels], "masks": masks, "curve": curve, "reach": reach, "residual": rest}


def same(row, name, want):
    got = row[name]
    for f in ("exposure", "saturation", "vibrance", "global_sat"):
        assert got[f] == pytest.approx(want[f], abs=1e-6), (row.id, name, f)
    assert [got[f"sat{i}"] for i in range(3)] == pytest.approx(want["wheels"], abs=1e-5)
    for m, w in zip(got["mix"], want["mix"]):
        assert m.asDict() == pytest.approx(w, abs=1e-5)
    assert [v for p in row[f"{name}_curve"] for v in (p.x, p.y)] == pytest.approx([v for p in want["curve"] for v in p])
    assert {m.region: pytest.approx((m.exposure, m.temp, m.tint, m.saturation), abs=1e-5) for m in row[f"{name}_masks"]} == want["masks"]


def test_chain(spark):
    analyses = solver.analysed(pixels.with_lab(images(spark, SF)), "image").where("id < 40")
    # regions of a model stand beside the measured ones: a third of the images have a sky, some skin
    extra = lambda key, L: F.struct(F.lit(key).alias("key"), F.lit(0.2).alias("coverage"), (F.lit(L) + F.col("id") % 7 / 50).alias("L"), F.lit(0.08).alias("C"), (F.col("id") % 5 / 50 - 0.04).alias("a"), F.lit(0.03).alias("b"), F.lit(0.9).alias("strength"))
    with_sky = F.when(F.col("id") % 3 == 1, F.concat("regions", F.array(extra("scene.sky", 0.6), extra("people.skin", 0.5)))).otherwise(F.col("regions"))
    analyses = analyses.withColumn("regions", with_sky).cache()
    rows = {r.id: r.asDict(recursive=True) for r in analyses.collect()}
    made = solver.solution(solver.pairs(analyses, 1)).collect()
    assert {r.id for r in made} == set(rows) - {1}
    for r in made:
        faithful = plain(rows[r.id], rows[1], False)
        restrained = plain(rows[r.id], rows[1], True, faithful["curve"])
        same(r, "faithful", faithful)
        same(r, "restrained", restrained)
        assert (r.reachability, r.residual) == (pytest.approx(faithful["reach"], abs=1e-7), pytest.approx(faithful["residual"], abs=1e-7))
    assert any(r.faithful_masks for r in made)


def test_a_grade_to_itself_moves_nothing(spark):
    analyses = solver.analysed(pixels.with_lab(images(spark, SF)), "image").where("id = 1")
    twice = analyses.unionByName(analyses.withColumn("id", F.lit(2).cast("long")))
    r = solver.solution(solver.pairs(twice, 1)).first()
    assert r.reachability == pytest.approx(1, abs=0.1) and abs(r.faithful.exposure) < 1e-9 and abs(r.faithful.saturation) < 1e-6
    assert r.residual < 0.02


def test_details(spark):
    tex = lambda g, p, a: F.struct(F.lit(g).alias("grain"), F.lit(p).alias("period"), F.lit(a).alias("acutance"))
    vig = lambda ok: F.struct(F.lit(-0.5).alias("reference"), F.lit(0.2).alias("own"), F.lit(ok).alias("usable"))
    get = lambda *a: spark.range(1).select(solver.detail_moves(*a).alias("d")).first().d
    more = get(tex(0.03, 2.0, 0.3), tex(0.01, 1.0, 0.2), vig(True), F.lit(True), False)
    assert (more.grain, more.grain_size, more.noise) == (pytest.approx(0.02 / 0.055 * 100), 25.0, 0.0) and more.texture == pytest.approx(20) and more.vignette == pytest.approx(-0.7 / 2.2 * 100)
    less = get(tex(0.01, 2.0, 0.2), tex(0.04, 1.0, 0.3), vig(False), F.lit(True), True)
    assert less.grain == 0 and less.noise == pytest.approx(0.03 / 0.45 * 100 * 0.62) and less.vignette == 0 and less.texture == pytest.approx(-20 * 0.62)
    assert get(tex(0.01, 2.0, 0.2), tex(0.04, 1.0, 0.3), vig(True), F.lit(False), False).noise == 0


def test_wheel_hues_of_the_chain(spark):
    row = solver.solution(solver.pairs(solver.analysed(pixels.with_lab(images(spark, SF)), "image").where("id < 6"), 1)).first()
    assert 0 <= row.faithful.global_hue < 360 and colour.ANCHORS


def test_masks_and_details_of_an_image_table(spark):
    """The registered query: masks measured from pixels, solved by the plain version; texture and corners by their formulas."""
    from lumaframe.plans import catalogue, extras

    analyses = extras.masked_analyses(spark, SF)
    rows = {r.id: r.asDict(recursive=True) for r in analyses.collect()}
    assert {r["key"] for r in rows[1]["regions"]} == {"global", *solver.ZONES, "scene.sky", "people.skin"}
    textures, vignettes = ({r.id: r for r in df.collect()} for df in extras.image_details(spark, SF))
    made = {r.id: r for r in catalogue.QUERIES["grade_masked"](spark, SF).collect()}
    assert made.keys() == set(rows) - {1}
    moved = 0
    for k, r in made.items():
        faithful = plain(rows[k], rows[1], False)
        for name, want in (("faithful", faithful), ("restrained", plain(rows[k], rows[1], True, faithful["curve"]))):
            assert {m.region: pytest.approx((m.exposure, m.temp, m.tint, m.saturation), abs=1e-5) for m in r[f"{name}_masks"]} == want["masks"], (k, name)
        a, b, va, vb = textures[1], textures[k], vignettes[1], vignettes[k]
        same = a.usable and b.usable and abs(a.long - b.long) / max(a.long, b.long) <= 0.15
        d = r.faithful_details
        assert d.grain == pytest.approx(min(100, max(0, a.grain - b.grain) / 0.055 * 100) if same else 0)
        assert d.noise == pytest.approx(min(100, max(0, b.grain - a.grain) / 0.45 * 100) if same else 0)
        assert d.texture == pytest.approx(clip((a.acutance - b.acutance) / 0.5 * 100, -100, 100) if same else 0)
        assert d.vignette == pytest.approx(clip((va.falloff - vb.falloff) / 2.2 * 100, -100, 100) if va.usable and vb.usable else 0)
        moved += bool(r.faithful_masks)
    assert moved > 20


def test_one_scan(spark, monkeypatch):
    """Whole, zones, masks and bands come from one scan of the pixels, whatever is read from the sums."""
    from lumaframe.operators import measure

    scans, write = [], measure.written
    monkeypatch.setattr(measure, "written", lambda df, name: scans.append(df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet")) or write(df, name))
    table = measure.sums(pixels.with_lab(images(spark, SF)), ["image"])
    for df in (measure.region_stats(table, ["image"]), measure.band_stats(table, ["image"]), measure.analysed(table, ["image"])):
        assert df.count() and "lineitem.parquet" not in df._jdf.queryExecution().executedPlan().toString()
    assert scans == [1]
