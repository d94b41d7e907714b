"""Presets, previews in containers and reports against plain forms."""

import random
import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumaframe.functions import text
from lumaframe.operators import reports
from lumaframe.plans import catalogue
from lumaframe.plans.records import containers, part_grades
from lumaframe.sources import presets, raws

SF = "/root/testdata/sf0.001"
BANDS = ["Red", "Orange", "Yellow", "Green", "Aqua", "Blue", "Purple", "Magenta"]


def plain_jpeg(buf, least, far):
    best, i = None, 0
    while i < len(buf) - 2:
        if buf[i : i + 3] != b"\xff\xd8\xff":
            i += 1
            continue
        limit = min(len(buf) - 1, i + far)
        end = next((j for j in range(i + 2, limit) if buf[j : j + 2] == b"\xff\xd9"), None)
        if end is None:
            i = max(limit, i + 1)
            continue
        if best is None or end + 2 - i > best[1]:
            best = (i, end + 2 - i)
        i = end + 2
    return best if best and best[1] >= least else None


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"\xff", b"\xd8", b"\xd9", b"\xff\xd8\xff", b"\xff\xd9", b"x", b"yy"]), max_size=40), st.integers(1, 9), st.integers(0, 12), st.integers(4, 60))
def test_largest_jpeg(parts, piece, least, far):
    buf, reads = b"".join(parts), []

    def read_at(at, n):
        reads.append(n)
        return buf[at : at + n]

    assert raws.largest_jpeg(read_at, len(buf), least, far, piece) == plain_jpeg(buf, least, far)
    assert max(reads, default=0) <= max(piece, 3)


def test_previews_of_rows_and_files(spark, tmp_path):
    rows = containers(spark, SF)
    for r in rows.collect():
        (tmp_path / f"{r.id}.raw").write_bytes(r.payload)
    want = {r.id: plain_jpeg(bytes(r.payload), raws.LEAST, raws.FAR) or (None, None) for r in rows.limit(6).collect()}
    files = rows.select("id", F.concat(F.lit(f"file:{tmp_path}/"), F.col("id").cast("string"), F.lit(".raw")).alias("path"))
    for found in (raws.embedded_previews(rows, "id", "payload"), raws.embedded_previews(rows, "id", "payload", piece=1000), raws.file_previews(files, "id", "path", piece=7001)):
        got = {r.id: (r.offset, r.length) for r in found.collect()}
        assert len(got) == 10 and {k: got[k] for k in want} == want
    assert any(v[0] for v in want.values()) and not all(v[0] for v in want.values())
    lost = spark.createDataFrame([(1, None), (2, b"")], "id int, payload binary")
    assert [tuple(r) for r in raws.embedded_previews(lost, "id", "payload").collect()] == [(1, None, None), (2, None, None)]
    assert raws.embedded_previews(lost.limit(0), "id", "payload").count() == 0


def identity(seed):
    units = seed.encode("utf-16-be")
    out = ""
    for salt in range(4):
        h = (0x811C9DC5 ^ (salt * 0x9E3779B9)) & 0xFFFFFFFF
        for i in range(0, len(units), 2):
            h = ((h ^ (units[i] << 8 | units[i + 1])) * 0x01000193) & 0xFFFFFFFF
        out += f"{h:08x}"
    return out.upper()


def test_identity(spark):
    seeds = ["", "a", "name as other", "é", "🌅", "x🌅y\U0010ffff", "日本"]
    got = spark.createDataFrame([(s,) for s in seeds], "s string").select("s", text.identity_of(F.col("s")).alias("u")).collect()
    assert {r.s: r.u for r in got} == {s: identity(s) for s in seeds}


def up(x):
    return int((x + 0.5) // 1)


def signed(x):
    n = up(x)
    return f"+{n}" if n > 0 else str(n)


def plain_preset(r, with_masks):
    """The same preset through an XML library."""
    for k, v in (("x", presets.META), ("rdf", presets.RDF), ("crs", presets.CRS)):
        ET.register_namespace(k, v)
    crs, rdf = (lambda n: f"{{{presets.CRS}}}{n}"), (lambda n: f"{{{presets.RDF}}}{n}")
    root = ET.Element(f"{{{presets.META}}}xmpmeta", {f"{{{presets.META}}}xmptk": "lumaframe"})
    about = ET.SubElement(ET.SubElement(root, rdf("RDF")), rdf("Description"), {rdf("about"): ""})
    put = lambda k, v: about.set(crs(k), v)
    for k, v in presets.HEAD.items():
        put(k, identity(f"{r.name}#{r.id}") if v is None else v)
    put("Exposure2012", ("+" if r.exposure >= 0 else "") + f"{r.exposure:.2f}")
    bent = any(abs(p.x - p.y) > 1 for p in r.curve)
    if bent:
        put("ToneCurveName2012", "Custom")
    for k, v in (("Texture", r.texture), ("Vibrance", r.vibrance), ("Saturation", r.saturation)):
        if v:
            put(k, signed(v))
    if any(b.hue or b.sat or b.lum for b in r.mix):
        for name, b in zip(BANDS, r.mix, strict=True):
            put(f"HueAdjustment{name}", signed(b.hue))
            put(f"SaturationAdjustment{name}", signed(b.sat))
            put(f"LuminanceAdjustment{name}", signed(b.lum))
    every = dict(r.asDict()["global"].asDict())
    if any(w["sat"] > 0 for w in (r.shadow, r.midtone, r.highlight, every)):
        for k, w in (("SplitToningShadow", r.shadow), ("SplitToningHighlight", r.highlight)):
            put(f"{k}Hue", str(max(0, up(w.hue))))
            put(f"{k}Saturation", str(max(0, up(w.sat))))
        for k, w in (("Midtone", r.midtone), ("Global", every)):
            put(f"ColorGrade{k}Hue", str(max(0, up(w["hue"]))))
            put(f"ColorGrade{k}Sat", str(max(0, up(w["sat"]))))
        for k, w in (("Shadow", r.shadow), ("Highlight", r.highlight), ("Midtone", r.midtone), ("Global", every)):
            put(f"ColorGrade{k}Lum", signed(w["lum"]))
        put("SplitToningBalance", signed(r.balance))
        put("ColorGradeBlending", str(up(r.blending)))
    if r.grain > 0:
        put("GrainAmount", str(up(r.grain)))
        put("GrainSize", str(up(r.grain_size)))
        put("GrainFrequency", str(up(r.roughness)))
    if r.vignette:
        put("PostCropVignetteAmount", signed(r.vignette))
        for k, v in (("Midpoint", "50"), ("Feather", "50"), ("Roundness", "0"), ("Style", "1")):
            put(f"PostCropVignette{k}", v)
    if r.noise > 0:
        put("LuminanceSmoothing", str(up(r.noise)))
    for k, v in (("Name", r.name), ("ShortName", r.name), ("SortName", r.name.lower()), ("Group", "Parts")):
        item = ET.SubElement(ET.SubElement(ET.SubElement(about, crs(k)), rdf("Alt")), rdf("li"), {"{http://www.w3.org/XML/1998/namespace}lang": "x-default"})
        item.text = v
    if bent:
        seq = ET.SubElement(ET.SubElement(about, crs("ToneCurvePV2012")), rdf("Seq"))
        for p in r.curve:
            ET.SubElement(seq, rdf("li")).text = f"{up(p.x)}, {up(p.y)}"
    usable = [m for m in r.masks if m.kind in presets.SUBTYPES]
    if with_masks and usable:
        seq = ET.SubElement(ET.SubElement(about, crs("MaskGroupBasedCorrections")), rdf("Seq"))
        for m in usable:
            own = {"What": "Correction", "CorrectionAmount": "1.000000", "CorrectionActive": "true", "CorrectionName": m.label, "LocalExposure2012": f"{m.exposure:.6f}", "LocalTemperature": f"{m.temp / 100:.6f}"}
            own |= {"LocalTint": f"{m.tint / 100:.6f}", "LocalSaturation": f"{m.saturation / 100:.6f}", "LocalContrast2012": f"{m.contrast / 100:.6f}"}
            d = ET.SubElement(ET.SubElement(seq, rdf("li")), rdf("Description"), {crs(k): v for k, v in own.items()})
            mask = {"What": "Mask/Image", "MaskActive": "true", "MaskName": m.label, "MaskBlendMode": "0", "MaskInverted": "false", "MaskValue": "1.000000", "MaskSubType": str(presets.SUBTYPES[m.kind])}
            inner = ET.SubElement(ET.SubElement(ET.SubElement(d, crs("CorrectionMasks")), rdf("Seq")), rdf("li"))
            ET.SubElement(inner, rdf("Description"), {crs(k): v for k, v in mask.items()})
    return ET.tostring(root, encoding="unicode")


def test_presets(spark):
    grades = {r.id: r for r in part_grades(spark, SF).collect()}
    got = catalogue.QUERIES["preset_files"](spark, SF).collect()
    same = lambda t: ET.canonicalize(t, strip_text=True, rewrite_prefixes=True)
    assert len(got) == len(grades) and any("🌅" in r.safe for r in got)
    for r in got:
        g = grades[r.id]
        usable = any(m.kind in presets.SUBTYPES for m in g.masks)
        assert (r.full is not None) == usable
        assert same(r.safe.split("\n", 1)[1]) == same(plain_preset(g, False))
        if usable:
            assert same(r.full.split("\n", 1)[1]) == same(plain_preset(g, True))


def test_itinerary_reports(spark):
    window = lambda a, b: {"start": a, "end": b}
    rows = [(1, i, 55.9 + i / 200, -3.2, best, [window(*w) for w in ws]) for i, (best, ws) in enumerate([(600, [(580, 700)]), (605, [(590, 640)]), (900, [(880, 890)]), (610, [(600, 620)])])]
    rows += [(2, 7, 10.0, 20.0, 700, [window(1, 9)]), (2, 8, 10.0, 20.0, 720, [window(700, 760)]), (3, 9, 0.0, 0.0, 700, [window(0, 10)])]
    from lumaframe.operators import itinerary

    spots = spark.createDataFrame(rows, "plan int, pos int, lat double, lon double, best int, windows array<struct<start:int,end:int>>")
    named = spots.select("plan", "pos", "lat", "lon", F.concat(F.lit("P"), "pos").alias("name"))
    plans = itinerary.day_plans(spots)
    got = {r.plan: r.report.split("\n") for r in reports.itinerary_reports(plans, named, itinerary.conflicts(spots), F.lit("Sun 1 Mar"), 1_772_323_200, "UTC").collect()}
    assert got.keys() == {1, 2}
    one = got[1]
    assert one[0] == "Day plan — Sun 1 Mar" and one[1] == "" and "3 spots" in one[6] or "2 spots" in one[5]
    assert any(x == "  P2 has no stretch of direct sun long enough for 20 minutes." for x in one)
    assert "  P0 and P1 are both at their best within 20 minutes of each other — you can have one of them at its best, not both." in one
    assert one[-2:] == ["Times are local to UTC.", "Sun and moon are computed; shadows are modelled, not measured."]
    assert got[2][2].startswith("11:40–12:00  P8  (sun ") and got[2][4] == "1 spot · 0 min travelling · 0.0 km"
    stops = {r.plan: [(s.pos, s.start, s.travel) for s in r.stops] for r in plans.collect()}
    for plan, pos, start, travel in [(p, *s) for p, v in stops.items() for s in v]:
        line = next(x for x in got[plan] if f"  P{pos}  " in x and "–" in x)
        assert line.startswith(f"{start // 60:02}:{start % 60:02}–") and (f"({travel} min travel, sun" in line) == (travel > 0)


def test_clashes_and_left_out(spark):
    from lumaframe.operators import itinerary

    rng = random.Random(3)
    rows = [(p, i, 50.0 + rng.random() / 5, 5.0, rng.randrange(500, 560), [{"start": 400, "end": 400 + rng.randrange(60)}]) for p in range(40) for i in range(rng.randrange(1, 9))]
    spots = spark.createDataFrame(rows, "plan int, pos int, lat double, lon double, best int, windows array<struct<start:int,end:int>>")
    want = set()
    dropped = {}
    for p in range(40):
        own = [r for r in rows if r[0] == p][:6]
        lit = [r for r in own if r[5][0]["end"] - r[5][0]["start"] >= 20]
        want |= {(p, a[1], b[1]) for i, a in enumerate(lit) for b in lit[i + 1 :] if abs(a[4] - b[4]) < 20}
        if lit:
            dropped[p] = {r[1] for r in own} - {r[1] for r in lit}
    assert {tuple(r) for r in itinerary.conflicts(spots).collect()} == want
    got = {r.plan: r for r in itinerary.day_plans(spots).collect()}
    assert got.keys() == dropped.keys()
    for p, r in got.items():
        assert {d.pos for d in r.dropped if d.reason == "never-lit"} == dropped[p]
        assert len(r.stops) + len(r.dropped) == min(6, sum(x[0] == p for x in rows))
    assert itinerary.day_plans(spots.limit(0)).count() == 0


def test_span_and_columns(spark):
    row = lambda a, b: F.struct(F.lit(a).alias("label"), F.lit(b).alias("value"))
    r = spark.range(1).select(reports.columns_of(F.array(row("a", "1"), row("long", "2"))).alias("c"), reports.span(F.lit(61)).alias("s"), reports.span(F.lit(None).cast("int"), F.lit(5)).alias("n"), reports.span(F.lit(1), F.lit(None).cast("int")).alias("o")).first()
    assert r.c == ["a     1", "long  2"] and (r.s, r.n, r.o) == ("01:01", "—", "00:01")


def test_text_of_a_plan_without_notes(spark):
    events = F.array(F.struct(F.lit("Sunrise").alias("label"), F.lit("—").alias("value")))
    made = reports.shoot_plan(F.lit("Here"), F.lit("Sat 1 Aug"), F.lit(1.0), F.lit(-2.5), events, F.array(F.lit(None).cast("string")), F.lit("Europe/London"), F.lit(None).cast("string"))
    assert spark.range(1).select(made.alias("t")).first().t == "Here — Sat 1 Aug\n1.00000, -2.50000\n\nSunrise  —\n\nTimes are local to Europe/London.\nSun and moon are computed; shadows are modelled, not measured."


@pytest.mark.parametrize("value,want", [(0.4, "0"), (0.5, "+1"), (-0.5, "0"), (-1.6, "-2"), (12.0, "+12")])
def test_signed_numbers(spark, value, want):
    assert spark.range(1).select(presets.whole(F.lit(value)).alias("v")).first().v == want


def test_numbers_of_large_groups(spark):
    """Places in groups of any size, nulls and equal rows included, from many ranges."""
    from lumaframe.operators import archive

    df = spark.range(20_000).selectExpr("if(id % 5 > 0, 'hot', if(id % 10 = 0, null, concat('g', id % 30))) AS g", "id % 7 AS o", "if(id % 11 = 0, 1, id) AS v").repartition(5)
    got = archive.numbered(df, ["g"], ["o", "v"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.place, r.o, r.v))
    assert sum(map(len, groups.values())) == 20_000 and len(groups["hot"]) == 16_000
    for rows in groups.values():
        rows.sort()
        assert [p for p, _, _ in rows] == list(range(len(rows))) and [(o, v) for _, o, v in rows] == sorted((o, v) for _, o, v in rows)
    assert archive.numbered(df.limit(0), ["g"], ["o"]).count() == 0


def test_clashes_of_more_spots_than_are_weighed(spark):
    """All pairs of a plan's spots count, also from the seventh on and across stretches of minutes."""
    from lumaframe.operators import itinerary

    rows = [(p, i, 400 + i * 37 % 60) for p in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "plan int, pos int, best int")
    got = [tuple(r) for r in itinerary.clashes(df).collect()]
    want = {(p, i, j) for p, i, x in rows for q, j, y in rows if p == q and i < j and abs(x - y) < 20}
    assert len(got) == len(set(got)) and set(got) == want
