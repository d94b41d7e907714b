"""Ranking by similarity of composition and colour, and by resemblance of tonal treatment.

A ranking compares one reference with all candidates: the reference is one row by its
key and is broadcast, candidates are scanned once and never multiplied.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions import colour, vectors

from . import pixels

# What a part's difference is measured in, and what it weighs.
SCALES = {"tone": 0.04, "cast": 0.02, "saturation": 0.025, "contrast": 0.03, "split": 0.02}
WEIGHTS = {"tone": 0.34, "cast": 0.24, "saturation": 0.17, "contrast": 0.15, "split": 0.10}
TOO_FAR, LEAST_SAMPLED = 2.5, 400


def _beside(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates with the columns of the one reference row prefixed by r_."""
    one = reference.limit(1).select(*[F.col(c).alias(f"r_{c}") for c in reference.columns])
    return candidates.join(F.broadcast(one))


def similar(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, comp, col): distance in composition and in colour from the reference, each over its range.

    Rows have id, embedding, grid (16 cells of L, a, b), width, height, L, C and H. A missing
    embedding counts as opposite, a missing grid as equal. Ranges come from a one-row
    aggregate that is joined back, so scores stay spread over the cluster.
    """
    rows = _beside(reference, candidates)
    at = lambda p, f: F.col(f"{p}C") * f(F.radians(f"{p}H"))
    apart = F.sqrt(F.pow(F.col("r_L") - F.col("L"), F.lit(2)) + F.pow(at("r_", F.cos) - at("", F.cos), F.lit(2)) + F.pow(at("r_", F.sin) - at("", F.sin), F.lit(2)))
    grid = F.col("r_grid"), F.col("grid")
    comp = 0.6 * vectors.embedding_distance(F.col("r_embedding"), F.col("embedding")) + 0.25 * vectors.grid_distance(*grid, (0,))
    comp += 0.15 * vectors.aspect_distance(F.col("r_height"), F.col("r_width"), F.col("height"), F.col("width"))
    raw = rows.select("id", comp.alias("comp"), (0.65 * vectors.grid_distance(*grid, (1, 2)) + 0.35 * apart).alias("col"))
    ends = raw.agg(*[f(c).alias(f"{n}_{c}") for c in ("comp", "col") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    both = raw.join(F.broadcast(ends))
    scaled = lambda c: (F.col(c) - F.col(f"lo_{c}")) / F.coalesce(F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)), F.lit(1.0))
    return both.select("id", scaled("comp").alias("comp"), scaled("col").alias("col"))


def blended(scores: DataFrame, weight: float = 0.6, n: int = 30) -> DataFrame:
    """The n best by a blend of composition and colour."""
    score = weight * F.col("comp") + (1 - weight) * F.col("col")
    return scores.withColumn("score", score).orderBy(F.round("score", 9), "id").limit(n)


def looks(rows: DataFrame, image: str) -> DataFrame:
    """One look for each image of pixels with L, a, b_ and C: curve, cast, chroma, spread and split.

    Pixels are read and converted once: they are summed by lightness bin, which is at most
    HIST_BINS rows for each image before anything is shuffled.
    """
    z = colour.zone_weights(F.col("L"))
    ends = {"shadow": 0, "highlight": 2}
    rows = rows.select(F.col(image).alias("id"), pixels.histogram_bin(F.col("L")).alias("bin"), "L", "a", "b_", "C", *[F.get(z, F.lit(i))["w"].alias(f"w_{n}") for n, i in ends.items()])
    sums = {"L": F.col("L"), "LL": F.col("L") * F.col("L"), "C": F.col("C"), "a": F.col("a"), "b": F.col("b_")}
    for n in ends:
        sums |= {f"n_{n}": F.col(f"w_{n}"), f"a_{n}": F.col(f"w_{n}") * F.col("a"), f"b_{n}": F.col(f"w_{n}") * F.col("b_")}
    bins = rows.groupBy("id", "bin").agg(F.count("*").cast("double").alias("n"), *[F.sum(v).alias(f"s_{k}") for k, v in sums.items()])
    along = Window.partitionBy("id").orderBy("bin")
    bins = bins.withColumn("cum", F.sum("n").over(along)).withColumn("all", F.sum("n").over(Window.partitionBy("id")))
    last = pixels.STEPS - 1
    reached = [F.min(F.when(F.col("cum") >= F.lit(k) / F.lit(float(last)) * F.col("all"), F.col("bin"))).alias(f"q_{k}") for k in range(1, last + 1)]
    whole = bins.groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(f"s_{k}").alias(f"s_{k}") for k in sums], *reached)
    mean = lambda k: F.col(f"s_{k}") / F.col("n")
    end = lambda n: F.when(F.col(f"s_n_{n}") > 0, F.struct(F.floor(F.col(f"s_n_{n}") + 0.5).alias("n"), *[(F.col(f"s_{c}_{n}") / F.col(f"s_n_{n}")).alias(c) for c in "ab"])).alias(n)
    curve = F.array(F.lit(0.0), *[F.col(f"q_{k}") / F.lit(float(pixels.HIST_BINS - 1)) for k in range(1, last + 1)])
    spread = F.sqrt(F.greatest(F.lit(0.0), mean("LL") - mean("L") * mean("L")))
    return whole.select("id", curve.alias("curve"), mean("a").alias("a"), mean("b").alias("b"), mean("C").alias("chroma"), spread.alias("spread"), end("shadow"), end("highlight"))


def _split(p: str, least: int) -> Column:
    """Direction from shadows to highlights, null unless both are large enough."""
    s, h = F.col(f"{p}shadow"), F.col(f"{p}highlight")
    return F.when((s["n"] >= least) & (h["n"] >= least), F.struct((h["a"] - s["a"]).alias("a"), (h["b"] - s["b"]).alias("b")))


def resemblance(reference: DataFrame, candidates: DataFrame, least_sampled: int = LEAST_SAMPLED) -> DataFrame:
    """(id, distance, parts, nearest, furthest, missing): how alike looks are, in multiples of a just visible step.

    A part that can't be measured on both sides is listed as missing and its weight goes to
    the others; with none left the distance is null.
    """
    rows = _beside(reference, candidates).where(F.col("id") != F.col("r_id"))
    rows = rows.withColumns({"s": _split("", least_sampled), "r_s": _split("r_", least_sampled)})
    raw = {
        "tone": vectors.rms(F.col("r_curve"), F.col("curve")),
        "cast": F.hypot(F.col("a") - F.col("r_a"), F.col("b") - F.col("r_b")),
        "saturation": F.abs(F.col("chroma") - F.col("r_chroma")),
        "contrast": F.abs(F.col("spread") - F.col("r_spread")),
        "split": F.hypot(F.col("s.a") - F.col("r_s.a"), F.col("s.b") - F.col("r_s.b")),
    }
    listed = F.array(*[F.struct(F.lit(k).alias("part"), (v / SCALES[k]).alias("d"), F.lit(WEIGHTS[k]).alias("w"), F.lit(i).alias("i")) for i, (k, v) in enumerate(raw.items())])
    rows = rows.select("id", listed.alias("every"))
    rows = rows.select("id", "every", F.filter("every", lambda x: x["d"].isNotNull()).alias("parts"))
    weighed = lambda f: F.aggregate("parts", F.lit(0.0), lambda s, x: s + f(x))
    by_size = F.array_sort(F.transform("parts", lambda x: F.struct(x["d"].alias("d"), x["i"].alias("i"), x["part"].alias("part"))))
    return rows.select(
        "id",
        F.when(F.size("parts") > 0, weighed(lambda x: x["d"] * x["w"]) / weighed(lambda x: x["w"])).alias("distance"),
        F.map_from_arrays(F.transform("parts", lambda x: x["part"]), F.transform("parts", lambda x: x["d"])).alias("parts"),
        F.get(by_size, F.lit(0))["part"].alias("nearest"),
        F.try_element_at(by_size, F.lit(-1))["part"].alias("furthest"),
        F.transform(F.filter("every", lambda x: x["d"].isNull()), lambda x: x["part"]).alias("missing"),
    )


def nearest(found: DataFrame, most: float | None = TOO_FAR, n: int | None = 8) -> DataFrame:
    """Comparable rows in order of distance, within most, the first n."""
    rows = found.where(F.col("distance").isNotNull())
    rows = rows if most is None else rows.where(F.col("distance") <= most)
    rows = rows.orderBy(F.round("distance", 9), "id")
    return rows if n is None else rows.limit(n)


# What the parts of a resemblance are called.
PART_NAMES = {"tone": "tone curve", "cast": "colour cast", "saturation": "saturation", "contrast": "contrast", "split": "split tone"}


def parts_text(parts: Column) -> Column:
    """A resemblance's parts (a map) in words, the nearest first; ties in the order in which parts are listed."""
    order = {k: i for i, k in enumerate(PART_NAMES)}
    named = F.create_map(*[F.lit(x) for kv in PART_NAMES.items() for x in kv])
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    rows = F.transform(F.map_entries(parts), lambda e: F.struct(e["value"].alias("v"), F.element_at(place, e["key"]).alias("i"), F.element_at(named, e["key"]).alias("n")))
    return F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat(r["n"], F.lit(" "), F.format_string("%.1f", r["v"]))), " · ")


def trimmed(regions: Column, kept: tuple[str, ...]) -> Column:
    """A look's regions (a map) that a comparison reads."""
    return F.map_filter(regions, lambda k, _: k.isin(*kept))


CLOSE_ENOUGH = 0.75


def note(distance: Column, nearest: Column, furthest: Column, missing: Column, measured: Column) -> Column:
    """What a resemblance says: near, far or in between, by which parts, and what could not be compared."""
    named = F.create_map(*[F.lit(x) for kv in PART_NAMES.items() for x in kv])
    name = lambda c: F.element_at(named, c)
    rest = F.when(measured == 1, "this rests on one measurement").otherwise(F.concat(F.lit("this rests on the other "), measured.cast("string")))
    listed = F.array_join(F.transform(missing, lambda m: F.element_at(named, m)), " and ")
    gap = F.when(F.size(missing) == 0, "").otherwise(F.concat(F.lit(" "), listed, F.lit(" could not be compared, so "), rest, F.lit(".")))
    close = F.concat(F.lit("Measures like the same treatment — closest on "), name(nearest), F.lit(", furthest apart on "), name(furthest), F.lit("."), gap, F.lit(" Alike in the numbers; not a claim about how either was edited."))
    between = F.concat(F.lit("In the same territory. Agrees on "), name(nearest), F.lit(", parts company on "), name(furthest), F.lit("."), gap)
    apart = F.concat(F.lit("Different photographs. The nearest they come is "), name(nearest), F.lit("."), gap)
    return F.when(distance <= CLOSE_ENOUGH, close).when(distance <= TOO_FAR, between).otherwise(apart)
