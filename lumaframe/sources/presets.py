"""Presets of a grade as XMP: attributes, a tone curve's points, names, and masks that are made again.

A document is a tree of elements whose texts are columns, so a preset is one expression
over a grade's row and is written like any other column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sinks import escaped

# Fixed values of the format: namespaces, versions, flags, names of bands and kinds of masks that can be made again.
META, RDF, CRS = "adobe:ns:meta/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://ns.adobe.com/camera-raw-settings/1.0/"
VERSION, PROCESS = "18.2", "15.4"
HEAD = {
    "PresetType": "Normal", "Cluster": "", "UUID": None, "SupportsAmount": "True", "SupportsColor": "True", "SupportsMonochrome": "False", "SupportsHighDynamicRange": "True", "SupportsNormalDynamicRange": "True",
    "SupportsSceneReferred": "True", "SupportsOutputReferred": "True", "CameraModelRestriction": "", "Copyright": "", "ContactInfo": "", "Version": VERSION, "ProcessVersion": PROCESS, "HasSettings": "True", "ShowInPresets": "True",
}
BANDS = ("Red", "Orange", "Yellow", "Green", "Aqua", "Blue", "Purple", "Magenta")
SUBTYPES = {"background": 0, "subject": 1, "sky": 2}


def whole(x: Column) -> Column:
    """A rounded number, halves upward; a positive one with its sign."""
    n = F.floor(x + 0.5).cast("long")
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def unsigned(x: Column) -> Column:
    """A rounded number from 0 up, without a sign."""
    return F.greatest(F.lit(0), F.floor(x + 0.5)).cast("long").cast("string")


def fixed(x: Column, n: int) -> Column:
    return F.format_string(f"%.{n}f", x.cast("double"))


def attribute(name: str, value: Column, when: Column | None = None) -> Column:
    """`name="value"`, null where it is left out."""
    made = F.concat(F.lit(f'{name}="'), escaped(value), F.lit('"'))
    return made if when is None else F.when(when, made)


def element(name: str, depth: int, attributes: list[Column] | None = None, children: list[Column] | None = None, content: Column | None = None) -> Column:
    """An element on lines of its own, depth spaces in; null attributes and children are left out, and one without either is closed at once.

    Attributes stand on lines of their own unless there is just one, of which one at least is
    not null; content is text on the element's own line.
    """
    pad, lead = " " * depth, F.lit("")
    if attributes:
        # array_join skips nulls
        before = " " if len(attributes) == 1 else f"\n{pad} "
        lead = F.concat(F.lit(before), F.array_join(F.array(*attributes), before))
    if content is not None:
        return F.concat(F.lit(f"{pad}<{name}"), lead, F.lit(">"), escaped(content), F.lit(f"</{name}>"))
    if not children:
        return F.concat(F.lit(f"{pad}<{name}"), lead, F.lit("/>"))
    return F.concat(F.lit(f"{pad}<{name}"), lead, F.lit(">\n"), F.array_join(F.array(*children), "\n"), F.lit(f"\n{pad}</{name}>"))


def _alternative(name: str, value: Column) -> Column:
    item = element("rdf:li", 5, [attribute("xml:lang", F.lit("x-default"))], content=value)
    return element(f"crs:{name}", 3, children=[element("rdf:Alt", 4, children=[item])])


def _curve(points: Column) -> Column:
    item = lambda p: F.concat(F.lit("     <rdf:li>"), F.floor(p["x"] + 0.5).cast("long").cast("string"), F.lit(", "), F.floor(p["y"] + 0.5).cast("long").cast("string"), F.lit("</rdf:li>"))
    made = element("crs:ToneCurvePV2012", 3, children=[element("rdf:Seq", 4, children=[F.array_join(F.transform(points, item), "\n")])])
    return F.when(F.exists(points, lambda p: F.abs(p["x"] - p["y"]) > 1), made)


def _mask(m: Column, kind: Column) -> Column:
    local = lambda f: fixed(m[f] / 100, 6)  # noqa: E731  # sliders run from -1 to 1 here, exposure in stops
    image = element("rdf:Description", 9, [
        attribute("crs:What", F.lit("Mask/Image")), attribute("crs:MaskActive", F.lit("true")), attribute("crs:MaskName", m["label"]), attribute("crs:MaskBlendMode", F.lit("0")),
        attribute("crs:MaskInverted", F.lit("false")), attribute("crs:MaskValue", F.lit("1.000000")), attribute("crs:MaskSubType", kind.cast("string")),
    ])
    of = element("crs:CorrectionMasks", 6, children=[element("rdf:Seq", 7, children=[element("rdf:li", 8, children=[image])])])
    about = element("rdf:Description", 5, [
        attribute("crs:What", F.lit("Correction")), attribute("crs:CorrectionAmount", F.lit("1.000000")), attribute("crs:CorrectionActive", F.lit("true")), attribute("crs:CorrectionName", m["label"]),
        attribute("crs:LocalExposure2012", fixed(m["exposure"], 6)), attribute("crs:LocalTemperature", local("temp")), attribute("crs:LocalTint", local("tint")), attribute("crs:LocalSaturation", local("saturation")), attribute("crs:LocalContrast2012", local("contrast")),
    ], [of])
    return element("rdf:li", 4, children=[about])


def usable_masks(masks: Column) -> Column:
    """Those of masks whose kind can be made again on another photo."""
    return F.filter(masks, lambda m: m["kind"].isin(*SUBTYPES))


def _masks(masks: Column) -> Column:
    kind = F.create_map(*[F.lit(x) for kv in SUBTYPES.items() for x in kv])
    own = usable_masks(masks)
    made = element("crs:MaskGroupBasedCorrections", 3, children=[element("rdf:Seq", 4, children=[F.array_join(F.transform(own, lambda m: _mask(m, kind[m["kind"]])), "\n")])])
    return F.when(F.size(own) > 0, made)


def xmp(grade: dict[str, Column], name: Column, group: Column, mark: Column, masks: bool = True, toolkit: str = "lumaframe") -> Column:
    """A grade as a preset's text; mark is its identity (text.identity_of), the same in every export.

    grade has exposure, texture, vibrance, saturation, mix (eight of hue, sat, lum), shadow,
    midtone, highlight and global (hue, sat, lum), balance, blending, grain, grain_size,
    roughness, noise, vignette, curve (points x, y) and masks (kind, label, exposure, temp,
    tint, saturation, contrast).
    What a grade has no opinion on is left out, since a preset sets every field it has: a
    zero would take away what a photo brings along.
    """
    g, put = grade, []
    setting = lambda key, value, when=None: put.append(attribute(f"crs:{key}", value, when))
    setting("Exposure2012", F.concat(F.when(g["exposure"] >= 0, "+").otherwise(""), fixed(g["exposure"], 2)))
    setting("ToneCurveName2012", F.lit("Custom"), F.exists(g["curve"], lambda p: F.abs(p["x"] - p["y"]) > 1))
    for key, field in (("Texture", "texture"), ("Vibrance", "vibrance"), ("Saturation", "saturation")):
        setting(key, whole(g[field]), g[field] != 0)
    mixed = F.exists(g["mix"], lambda b: (b["hue"] != 0) | (b["sat"] != 0) | (b["lum"] != 0))
    for i, band in enumerate(BANDS):
        for key, field in (("Hue", "hue"), ("Saturation", "sat"), ("Luminance", "lum")):
            setting(f"{key}Adjustment{band}", whole(F.get(g["mix"], F.lit(i))[field]), mixed)
    wheels = {k: g[k] for k in ("shadow", "midtone", "highlight", "global")}
    tinted = (wheels["shadow"]["sat"] > 0) | (wheels["midtone"]["sat"] > 0) | (wheels["highlight"]["sat"] > 0) | (wheels["global"]["sat"] > 0)
    of = lambda k, f: unsigned(wheels[k][f])
    light = lambda k: whole(wheels[k]["lum"])
    for key, value in (
        ("SplitToningShadowHue", of("shadow", "hue")), ("SplitToningShadowSaturation", of("shadow", "sat")), ("SplitToningHighlightHue", of("highlight", "hue")), ("SplitToningHighlightSaturation", of("highlight", "sat")),
        ("SplitToningBalance", whole(g["balance"])), ("ColorGradeShadowLum", light("shadow")), ("ColorGradeHighlightLum", light("highlight")),
        ("ColorGradeMidtoneHue", of("midtone", "hue")), ("ColorGradeMidtoneSat", of("midtone", "sat")), ("ColorGradeMidtoneLum", light("midtone")),
        ("ColorGradeGlobalHue", of("global", "hue")), ("ColorGradeGlobalSat", of("global", "sat")), ("ColorGradeGlobalLum", light("global")), ("ColorGradeBlending", unsigned(g["blending"])),
    ):
        setting(key, value, tinted)
    for key, field in (("GrainAmount", "grain"), ("GrainSize", "grain_size"), ("GrainFrequency", "roughness")):
        setting(key, unsigned(g[field]), g["grain"] > 0)
    setting("PostCropVignetteAmount", whole(g["vignette"]), g["vignette"] != 0)
    for key, value in (("Midpoint", "50"), ("Feather", "50"), ("Roundness", "0"), ("Style", "1")):
        setting(f"PostCropVignette{key}", F.lit(value), g["vignette"] != 0)
    setting("LuminanceSmoothing", unsigned(g["noise"]), g["noise"] > 0)
    head = [attribute("rdf:about", F.lit("")), attribute("xmlns:crs", F.lit(CRS)), *[attribute(f"crs:{k}", mark if v is None else F.lit(v)) for k, v in HEAD.items()]]
    children = [_alternative("Name", name), _alternative("ShortName", name), _alternative("SortName", F.lower(name)), _alternative("Group", group), _curve(g["curve"])]
    if masks:
        children.append(_masks(g["masks"]))
    about = element("rdf:Description", 2, [*head, *put], children)
    body = element("x:xmpmeta", 0, [attribute("xmlns:x", F.lit(META)), attribute("x:xmptk", F.lit(toolkit))], [element("rdf:RDF", 1, [attribute("xmlns:rdf", F.lit(RDF))], [about])])
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), body, F.lit("\n"))
