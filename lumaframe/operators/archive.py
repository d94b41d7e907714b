"""Record sets: chapters, overrides, de-duplication, audits, diffs, facets, keyed edits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions import colour, text
from lumaframe.sources.scratch import written

from .paths import nearest_path

SPLIT_ABOVE, MERGE_UP_TO = 5, 2


def resolve_overrides(df: DataFrame, overrides: DataFrame, key: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """df with each field the first non-null of overrides' column of that name and its own fallbacks.

    overrides has one row for each key. The join is left to the optimizer: a small override
    table is broadcast by its size, a large one is shuffled.
    """
    told = overrides.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields])
    both = df.join(told, F.col(key) == F.col("__key"), "left")
    made = {f: F.coalesce(F.col(f"__{f}"), *[F.col(c) for c in own]) for f, own in fields.items()}
    return both.withColumns(made).drop("__key", *[f"__{f}" for f in fields])


def split_chapters(photos: DataFrame, base: str, L: str = "L") -> DataFrame:
    """photos with chapter: deep and pale bands of a base stand alone once they hold more than SPLIT_ABOVE.

    Band sizes come from an aggregation that is joined back, so a base with most of the
    photos is not one task.
    """
    banded = photos.withColumn("band", colour.lightness_band(F.col(L)))
    sizes = banded.groupBy(base, "band").agg(F.count("*").alias("__n"))
    busy = sizes.where((F.col("band") != "mid") & (F.col("__n") > SPLIT_ABOVE)).select(F.col(base).alias("__b"), F.col("band").alias("__d"))
    both = banded.join(busy, (F.col(base) == F.col("__b")) & (F.col("band") == F.col("__d")), "left")
    kept = F.when(F.col("__b").isNotNull(), F.col("band")).otherwise("mid")
    return both.withColumn("chapter", colour.chapter_key(F.col(base), kept)).drop("__b", "__d")


def mean_colour(a: str = "a", b: str = "b", L: str = "L") -> list[Column]:
    """Aggregates (L, C, H): the mean in the a-b plane, so hues average on the circle, rounded half up."""
    ma, mb = F.avg(a), F.avg(b)
    return [
        colour.half_up(F.coalesce(F.avg(L), F.lit(0.5)), 3).alias("mean_L"),
        colour.half_up(F.coalesce(colour.chroma(ma, mb), F.lit(0.0)), 3).alias("mean_C"),
        colour.half_up(F.coalesce(colour.hue(ma, mb), F.lit(0.0)), 1).alias("mean_H"),
    ]


def fold_small_chapters(groups: pd.DataFrame) -> pd.Series:
    """The chapter that each chapter ends up in; groups has chapter, n and sums of L, a and b, in rank order.

    The first chapter of at most MERGE_UP_TO photos joins the nearer neighbour of its kind
    (grey or coloured; the earlier on a tie), and the search starts over. One row for each
    chapter, at most two dozen: the table is an aggregate, never photos.
    """
    names = groups["chapter"].tolist()
    n = groups["n"].to_numpy(float).tolist()
    sums = groups[["sL", "sa", "sb"]].to_numpy(float).tolist()
    members = [[x] for x in names]
    grey = [x.startswith(colour.ACHROMATIC) for x in names]

    def lab(i: int) -> np.ndarray:
        L, a, b = (s / n[i] for s in sums[i])
        c, h = np.floor(np.hypot(a, b) * 1000 + 0.5) / 1000, np.floor(np.degrees(np.arctan2(b, a)) % 360 * 10 + 0.5) / 10
        return np.array([np.floor(L * 1000 + 0.5) / 1000, c * np.cos(np.radians(h)), c * np.sin(np.radians(h))])

    i = 0
    while i < len(names) and len(names) > 1:
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(names) and grey[j] == grey[i]] if n[i] <= MERGE_UP_TO else []
        if not near:
            i += 1
            continue
        to = min(near, key=lambda j: (np.linalg.norm(lab(i) - lab(j)), j))
        n[to] += n[i]
        sums[to] = [x + y for x, y in zip(sums[to], sums[i], strict=True)]
        members[to] += members[i]
        for rows in (names, n, sums, members, grey):
            del rows[i]
        i = 0
    home = {m: name for name, some in zip(names, members, strict=True) for m in some}
    return groups["chapter"].map(home)


def folded_chapters(photos: DataFrame) -> DataFrame:
    """(chapter, folded): where the small chapters of split photos end up."""
    sums = photos.groupBy("chapter").agg(F.count("*").alias("n"), F.sum("L").alias("sL"), F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    sums = sums.withColumn("rank", colour.chapter_rank(F.col("chapter"))).withColumn("all", F.lit(1))

    def fold(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["rank", "chapter"], ignore_index=True)
        return pd.DataFrame({"chapter": groups["chapter"], "folded": fold_small_chapters(groups)})

    return sums.groupBy("all").applyInPandas(fold, "chapter string, folded string")


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order; WindowGroupLimit prunes before the shuffle."""
    place = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def append_new(store: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """store and the rows of batch whose key it lacks, the first of each key."""
    fresh = keep_first(batch, [key], order).join(store.select(key), key, "left_anti")
    return store.unionByName(fresh.select(*store.columns))


def update_by_key(df: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """df with the non-null fields of patch's row of the same key."""
    return resolve_overrides(df, patch, key, {f: (f,) for f in fields}).select(*df.columns)


def delete_by_key(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def remove_photos(store: DataFrame, overrides: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """store and overrides without the keys of gone: an override doesn't outlive its photo."""
    return delete_by_key(store, gone, key), delete_by_key(overrides, gone, key)


def ingested(files: DataFrame) -> DataFrame:
    """The record of each file (filename, content, width, camera, software, exposed): its id, the name it is kept under, its medium and its sizes.

    Files of equal content are one record, of the first name.
    """
    rows = files.withColumn("id", F.substring(F.sha2("content", 256), 1, 16))
    first = keep_first(rows, ["id"], [F.col("filename")])
    kept = F.concat(text.slug(F.regexp_replace("filename", r"\.[^.]*$", ""), 60), F.lit("."), F.col("id"), F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    return first.select("id", kept.alias("filename"), text.medium(F.col("camera"), F.col("software"), F.col("exposed")).alias("medium"), expected_tags(F.col("width")).alias("tags"))


def file_of(url: Column) -> Column:
    """The file that a page's address of a derivative names."""
    return F.regexp_replace(url, "^/img/", "")


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, state) over both sets: added is in left alone, removed in right alone, same in both."""
    a = left.select(F.col(key).alias("__a")).distinct()
    b = right.select(F.col(key).alias("__b")).distinct()
    state = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").otherwise("same")
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), state.alias("state"))


def audit(owners: DataFrame, present: DataFrame, file: str = "file") -> DataFrame:
    """(fault, file): declared files that are not present, and present files that nobody declares.

    Names that begin with a dot are not files. A file with several owners is one file.
    """
    there = present.where(~F.col(file).startswith(".")).select(file).distinct()
    owned = owners.select(file).distinct()
    missing = owned.join(there, file, "left_anti").select(F.lit("missing").alias("fault"), file)
    return missing.union(there.join(owned, file, "left_anti").select(F.lit("orphan").alias("fault"), file))


def expected_tags(width: Column) -> Column:
    """Sizes that a source of a width should have: all up to its width, `full` below the least, all if unknown."""
    sizes = (640, 1280, 2000)  # fixed values
    fits = F.filter(F.array(*map(F.lit, sizes)), lambda w: w <= width)
    every = F.array(*[F.lit(str(s)) for s in sizes])
    known = F.when(F.size(fits) > 0, F.transform(fits, lambda w: w.cast("string"))).otherwise(F.array(F.lit("full")))
    return F.when(width.isNull() | (width == 0), every).otherwise(known)


def tag_of(file: Column) -> Column:
    """The size in a derivative's name, null for other names."""
    return F.nullif(F.regexp_extract(file, r"^[0-9a-f]+-(\d+|full)\.(?:avif|webp)$", 1), F.lit(""))


def top_counts(df: DataFrame, value: str, n: int, first_seen: Column) -> DataFrame:
    """(value, count) of the n most frequent non-null values; ties in the order in which they are first seen."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), F.min(first_seen).alias("__first"))
    return counts.orderBy(F.desc("n"), "__first", "value").limit(n).drop("__first")


def facet_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass, as grouping sets."""
    counts = df.groupingSets([[F.col(f)] for f in facets], *facets).agg(F.count("*").alias("n"), F.grouping_id(*facets).alias("__g"))
    name = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(facets) for x in ((1 << len(facets)) - 1 - (1 << (len(facets) - 1 - i)), f)]), F.col("__g").cast("int"))
    return counts.select(name.alias("facet"), F.coalesce(*[F.col(f).cast("string") for f in facets]).alias("value"), "n")


def arg_max_label(df: DataFrame, group: list[str], label: str, score: Column, order: Column) -> DataFrame:
    """(group, label, total): the label of the largest score sum; ties by order, the smallest first."""
    sums = df.groupBy(*group, label).agg(F.sum(score).alias("total"), F.min(order).alias("__o"))
    best = F.max_by(F.struct(label, "total"), F.struct("total", -F.col("__o")))
    return sums.groupBy(*group).agg(best.alias("b")).select(*group, F.col(f"b.{label}").alias(label), "b.total")


def priority_lookup(keys: DataFrame, key: str, tables: list[DataFrame]) -> DataFrame:
    """The row of each key from the first table that has it."""
    union: DataFrame | None = None
    for i, t in enumerate(tables):
        t = t.withColumn("tier", F.lit(i))
        union = t if union is None else union.unionByName(t)
    found = keep_first(union, [key], [F.col("tier")])
    return keys.select(key).distinct().join(found, key)


def latest_n(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order."""
    place = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with place, the number of a row in its group from 0; a group of any size is many tasks.

    Rows are cut into even ranges of (group, order), numbered inside a range, and moved on by
    what the ranges before hold of the group: a row for each range and group. Equal rows are in any order.
    """
    rows = df.withColumn("__tie", F.monotonically_increasing_id())
    rows = written(rows.repartitionByRange(*group, *order, "__tie").withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(*group, "__part").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    held = held.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__part").alias("__p"), "__start")
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    own = F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order, "__tie"))
    return rows.withColumn("__own", own).join(held, same).select(*df.columns, (F.col("__start") + F.col("__own") - 1).cast("long").alias("place"))


def within_ttl(df: DataFrame, key: str, fetched: str, now: Column, seconds: int) -> DataFrame:
    """The latest row of each key that is at most seconds old."""
    age = now.cast("timestamp").cast("long") - F.col(fetched).cast("timestamp").cast("long")
    fresh = df.where((age >= 0) & (age <= seconds))
    return keep_first(fresh, [key], [F.col(fetched).desc()])


def path_order(photos: DataFrame, group: str, key: str, limit: int = 400) -> DataFrame:
    """(group, key, pos): a short path through each group's colours.

    From the darkest photo to the nearest unused one, then, up to limit photos, reversals of
    stretches while one makes the path shorter. Ties follow key. Each step depends on all
    before it, so a group is walked by one task, which looks for the next photo in a tree.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, ignore_index=True)
        lab = rows[["L", "a", "b"]].to_numpy(float)
        order = nearest_path(lab)
        if 2 < len(lab) <= limit:
            order = shorten(lab, order)
        pos = np.empty(len(lab), int)
        pos[order] = np.arange(len(lab))
        return pd.DataFrame({group: rows[group], key: rows[key], "pos": pos})

    kinds = ", ".join(f"{c} {photos.schema[c].dataType.simpleString()}" for c in (group, key))
    return photos.select(group, key, "L", "a", "b").groupBy(group).applyInPandas(walk, f"{kinds}, pos bigint")


def shorten(points: np.ndarray, order: list[int]) -> list[int]:
    """Reverses stretches of an open path as long as one makes it shorter; gains under 1e-9 don't count."""
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    path, n, better = np.array(order), len(order), True
    while better:
        better = False
        for i in range(n - 1):
            k = np.arange(i + 1, n)
            gain = np.zeros(len(k))
            if i:
                gain += d[path[i - 1], path[i]] - d[path[i - 1], path[k]]
            inner = k < n - 1
            after = path[np.minimum(k + 1, n - 1)]
            gain += np.where(inner, d[path[k], after] - d[path[i], after], 0.0)
            if gain.max() > 1e-9:
                j = int(k[gain.argmax()])
                path[i : j + 1] = path[i : j + 1][::-1].copy()
                better = True
    return path.tolist()


def chained(ordered: DataFrame, group: str, rank: str) -> DataFrame:
    """ordered (group, rank, pos, L, a, b) with pos counted from the other end where that joins better to the group before.

    Only the two ends of each group are gathered, in rank order; a group of one never turns.
    """
    ends = ordered.groupBy(group, rank).agg(F.min_by(F.struct("L", "a", "b"), "pos").alias("head"), F.max_by(F.struct("L", "a", "b"), "pos").alias("tail"), F.count("*").alias("n")).withColumn("all", F.lit(1))
    flat = ends.select("all", group, rank, "n", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("head", "tail") for c in "Lab"])

    def turn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([rank, group], ignore_index=True)
        head, tail = rows[["head_L", "head_a", "head_b"]].to_numpy(float), rows[["tail_L", "tail_a", "tail_b"]].to_numpy(float)
        turned, last = [], None
        for i in range(len(rows)):
            flip = last is not None and rows["n"][i] > 1 and np.linalg.norm(last - tail[i]) < np.linalg.norm(last - head[i])
            turned.append(bool(flip))
            last = head[i] if flip else tail[i]
        return pd.DataFrame({"g": rows[group], "n": rows["n"], "turned": turned})

    flips = flat.groupBy("all").applyInPandas(turn, f"g {ordered.schema[group].dataType.simpleString()}, n bigint, turned boolean")
    both = ordered.join(flips, F.col(group) == F.col("g"))
    return both.withColumn("pos", F.when(F.col("turned"), F.col("n") - 1 - F.col("pos")).otherwise(F.col("pos"))).drop("g", "n", "turned")
