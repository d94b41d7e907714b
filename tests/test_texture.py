import math

import numpy as np
import pytest

from lumaframe.operators import texture
from lumaframe.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_flat_and_noise():
    rng = np.random.default_rng(1)
    assert texture.measure_crop(np.full((192, 192), 128.0)) is None
    low, high = (texture.measure_crop(128 + (rng.random((192, 192)) - 0.5) * a) for a in (10, 40))
    assert high["grain"] > 3 * low["grain"] and 0.95 < high["blockiness"] < 1.05


def test_blocky():
    base = np.repeat(np.repeat(np.random.default_rng(2).random((24, 24)) * 200, 8, 0), 8, 1)
    noisy = base + np.random.default_rng(3).random((192, 192)) * 2
    assert texture.measure_crop(noisy)["blockiness"] > texture.BLOCKY


def test_box_mean_clamps_edges():
    a = np.random.default_rng(4).random((9, 7))
    want = np.array([[np.mean([a[min(8, max(0, y + j)), min(6, max(0, x + i))] for j in (-1, 0, 1) for i in (-1, 0, 1)]) for x in range(7)] for y in range(9)])
    np.testing.assert_allclose(texture.box_mean(a, 1), want)


def plain_crop(luma, w, h):
    """All measures of a crop by loops over its pixels."""
    at = lambda a, x, y: a[min(h - 1, max(0, y)) * w + min(w - 1, max(0, x))]
    blur = lambda r: [sum(at(luma, x + i, y + j) for i in range(-r, r + 1) for j in range(-r, r + 1)) / (2 * r + 1) ** 2 for y in range(h) for x in range(w)]
    fine, coarse = blur(1), blur(2)
    grad = {}
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            gx = sum(k * (at(fine, x + 1, y + j) - at(fine, x - 1, y + j)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (at(fine, x + i, y + 1) - at(fine, x + i, y - 1)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            grad[x, y] = math.hypot(gx, gy)
    levels = sorted(min(255, int(g)) for g in grad.values())
    cut = lambda p: next(b for b in range(256) if sum(v <= b for v in levels) >= p * len(levels))
    low, high = cut(0.35), cut(0.85)
    flat, edge = [p for p, g in grad.items() if g <= low], [p for p, g in grad.items() if g > low and g >= high]
    if not flat or not edge:
        return None
    rms = lambda ps, b: math.sqrt(sum((luma[y * w + x] - b[y * w + x]) ** 2 for x, y in ps) / len(ps)) / 255
    steps = {True: [], False: []}
    for y in range(h):
        for x in range(1, w):
            steps[x % 8 == 0].append(abs(luma[y * w + x] - luma[y * w + x - 1]))
    off = sum(steps[False]) / len(steps[False])
    grain, wide = rms(flat, fine), rms(flat, coarse)
    return {"grain": grain, "edge": rms(edge, fine), "acutance": sum(grad[p] for p in edge) / len(edge) / 255, "blockiness": 1 if off < 0.45 else sum(steps[True]) / len(steps[True]) / off, "scale": grain / wide if wide > 1e-9 else 1}


def test_every_measure_of_a_crop():
    rng = np.random.default_rng(5)
    for crop in (rng.random((16, 24)) * 90, np.add.outer(np.arange(20) % 7 * 9.0, rng.random(17) * 30), np.full((12, 12), 3.0)):
        got, want = texture.measure_crop(crop), plain_crop(crop.ravel().tolist(), crop.shape[1], crop.shape[0])
        assert (got is None) == (want is None) and (got is None or got == pytest.approx(want))


def test_gates(spark):
    """Every photo of the query: places of crops, measures and gates by plain code."""
    from lumaframe.plans import archive

    images = archive.textured(spark, SF)
    spread = [(0, 0), (3, 0), (0, 2), (3, 2), (1, 1)]
    got = {r.id: r for r in catalogue.QUERIES["image_textures"](spark, SF).collect()}
    side, kinds = archive.SMALL_CROP, set()

    def places(w, h):
        ix, iy = math.floor(w * 0.08), math.floor(h * 0.08)
        sx, sy = w - 2 * ix - side, h - 2 * iy - side
        return {(x, y): ((ix + math.floor(sx * x / 3 + 0.5)) & ~7, (iy + math.floor(sy * y / 2 + 0.5)) & ~7) for x in range(4) for y in range(3)} if sx > 0 and sy > 0 else {}

    for im in images.collect():
        r, long = got[im.id], max(im.width, im.height)
        factor = min(1, 2400 / long)
        scaled = places(math.floor(im.width * factor + 0.5), math.floor(im.height * factor + 0.5))
        native = {k: v for k, v in places(im.width, im.height).items() if k in spread}
        rows = [(n, *k, *v) for n, p in ((0, native), (1, scaled)) for k, v in p.items()]
        at = spark.createDataFrame([(im.id, *x) for x in rows], "id long, n int, gx int, gy int, left int, top int")
        pixels_ = {}
        for n in (0, 1):
            for p in archive.crop_pixels(at.where(f"n = {n}")).orderBy("gx", "gy", "y", "x").collect():
                pixels_.setdefault((n, p.gx, p.gy), []).append(p.luma)
        found = {k: plain_crop(v, side, side) for k, v in pixels_.items()}
        probe = [m["blockiness"] for k, m in found.items() if k[0] == 0 and m]
        crops = [m for k, m in found.items() if k[0] == 1 and m]
        mid = lambda f: float(np.median([m[f] for m in crops]))  # noqa: B023, E731
        if long < 900 or min(im.width, im.height) < 500 or len(probe) < 3:
            want = "resolution"
        elif np.median(probe) > 1.28:
            want = "compression"
        elif len(crops) < 4:
            want = "resolution"
        else:
            want = "upscaled" if mid("grain") < 0.0016 and mid("acutance") < 0.02 else "none"
        kinds.add(want)
        assert (r.blocked, r.usable, r.reason is None) == (want, want == "none", want == "none"), im
        if r.usable:
            size = max(1, min(6, 1 + (1 - min(1, mid("scale"))) * 8))
            assert (r.grain, r.grain_size, r.acutance, r.flat_to_edge) == pytest.approx((mid("grain"), size, mid("acutance"), mid("grain") / mid("edge")))
            assert r.normalised == (long > 2400) and r.long == min(long, 2400)
        else:
            assert (r.grain, r.acutance, r.grain_size) == (0, 0, 0)
    assert {"none", "compression"} <= kinds
